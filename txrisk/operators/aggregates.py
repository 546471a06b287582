"""Group statistics, profiles and table reports.

Everything aggregates with map-side partial results and joins the (much smaller) statistics back;
``attach`` lets Spark broadcast them when they are small and splits skewed row partitions otherwise.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, exact_quantiles, keep, prefix_sums
from txrisk.operators.windows import KeyStat, category_values, guarded_std, ratio, settled
from txrisk.schema import DAY_US, DEFAULT, HOUR_US, MINUTE_US, Columns, micros


# ------------------------------------------------------------------ per-entity statistics

def amount_stats_features(key: str, value: str) -> list[KeyStat]:
    return [KeyStat(f"{key}_{value}_Mean", "avg", value), KeyStat(f"{key}_{value}_Std", "std", value), KeyStat(f"__size_{key}_{value}", "size", value)]


def amount_stats_columns(key: str, value: str) -> list[Column]:
    m, s, v = F.col(f"{key}_{value}_Mean"), guarded_std(F.col(f"{key}_{value}_Std")), F.col(value)
    return [s.alias(f"{key}_{value}_Std"), ((v - m) / s).alias(f"{key}_{value}_Z"),
            ratio(v, settled(m, F.col(f"__size_{key}_{value}"))).alias(f"{key}_{value}_Ratio")]


def entity_amount_stats(df: DataFrame, key: str, values: list[str] | None = None, fit_on: DataFrame | None = None,
                        cols: Columns = DEFAULT) -> DataFrame:
    """Mean, sample std (null or 0 becomes 1), z-score and ratio to the mean (0 where amounts cancel), per entity.

    Statistics come from ``df`` itself, or from ``fit_on`` so that scored rows use training statistics.
    """
    values = values or [cols.amount, cols.value]
    source = df if fit_on is None else fit_on
    stats = source.groupBy(key).agg(*[e for v in values for e in (
        F.avg(v).alias(f"{key}_{v}_Mean"), F.stddev_samp(v).alias(f"{key}_{v}_Std"), F.sum(F.abs(v)).alias(f"__size_{key}_{v}"))])
    out = attach(df, stats, key)
    return out.select(*df.columns, *[c for v in values for c in (
        F.col(f"{key}_{v}_Mean"), *amount_stats_columns(key, v))])


def target_rate(df: DataFrame, category: str, cols: Columns = DEFAULT) -> DataFrame:
    """(category, rate): mean label per category on the fit data."""
    return df.groupBy(category).agg(F.avg(cols.label).alias(f"{category}_FraudRate"))


def lookup_with_fallback(df: DataFrame, stats: DataFrame, key: str, source: DataFrame | None = None) -> DataFrame:
    """Left join of learnt statistics; rows of unseen keys get the mean of the joined column.

    ``source`` is a cheaper table with the same rows, used for that mean.
    """
    names = [c for c in stats.columns if c != key]
    counts = (df if source is None else source).groupBy(key).agg(F.count("*").alias("__n"))
    known = attach(counts, stats, key)
    means = known.agg(*[(F.sum(F.col(c) * F.col("__n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n")))).alias(f"__m_{c}")
                        for c in names])   # one row
    out = attach(df, stats, key).crossJoin(F.broadcast(means))
    return out.select(*df.columns, *[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) for c in names])


def daily_count(df: DataFrame, key: str, name: str | None = None, cols: Columns = DEFAULT,
                source: DataFrame | None = None) -> DataFrame:
    """Rows of the key on the row's calendar date, counted on ``source`` (default: the table itself)."""
    name = name or f"Daily_{key}_TxnCount"
    date = F.to_date(cols.ts).alias("__date")
    counts = (df if source is None else source).select(key, date).groupBy(key, "__date").agg(F.count("*").alias(name))
    return attach(df.select("*", date), counts, [key, "__date"]).drop("__date")


def batch_table(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """(batch, TxnPerBatch, TimeBetweenBatches): minutes since the start of the batch that began before it.

    Batches are ordered by start time and id. The order is global, so the previous batch is looked up
    inside the minute and, for the first batch of a minute, carried from the last earlier minute or day.
    """
    b = df.groupBy(cols.batch).agg(F.count("*").alias("TxnPerBatch"), F.min(micros(cols.ts)).alias("__start"))
    b = b.withColumns({"__day": F.floor(F.col("__start") / DAY_US), "__m": F.floor(F.col("__start") / MINUTE_US)})
    minutes = b.groupBy("__day", "__m").agg(F.max("__start").alias("__last"))
    days = minutes.groupBy("__day").agg(F.max("__last").alias("__last"))
    days = days.select("__day", F.lag("__last").over(W.orderBy("__day")).alias("__carry_day"))   # one row per day
    minutes = minutes.select("__day", "__m", F.lag("__last").over(W.partitionBy("__day").orderBy("__m")).alias("__carry_minute"))
    before = attach(minutes, days, "__day").select("__m", F.coalesce("__carry_minute", "__carry_day").alias("__carry"))
    inside = W.partitionBy("__m").orderBy("__start", cols.batch)
    prev = F.coalesce(F.lag("__start").over(inside), F.col("__carry"))
    return attach(b, before, "__m").select(
        cols.batch, "TxnPerBatch",
        F.coalesce((F.col("__start") - prev) / MINUTE_US, F.lit(0.0)).alias("TimeBetweenBatches"))


def batch_features(df: DataFrame, cols: Columns = DEFAULT, source: DataFrame | None = None) -> DataFrame:
    return attach(df, batch_table(df if source is None else source, cols), cols.batch)


SESSION_MODES = {"SessionChannel": "channel", "SessionMainProductCategory": "category", "SessionMainProductId": "product",
                 "SessionMainProvider": "provider", "SessionMainPricingStrat": "pricing"}


def session_stats(df: DataFrame, key: str, session: str = "SessionId", cols: Columns = DEFAULT) -> DataFrame:
    """One row per (key, session): size, amounts, duration and most frequent categories (smallest on ties)."""
    us = micros(cols.ts)
    return df.groupBy(key, session).agg(
        F.count("*").alias("SessionTxnCount"),
        F.sum(cols.amount).alias("SessionAmt"), F.avg(cols.amount).alias("SessionAmtMean"),
        F.stddev_samp(cols.amount).alias("SessionAmtStd"),
        F.sum(cols.value).alias("SessionValue"), F.avg(cols.value).alias("SessionValueMean"),
        F.stddev_samp(cols.value).alias("SessionValueStd"),
        ((F.max(us) - F.min(us)) / MINUTE_US).alias("SessionDuration"),
        # the state of mode() is one counter per category value
        *[F.mode(getattr(cols, role), True).alias(name) for name, role in SESSION_MODES.items()])


def tied_mode_mean(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Mean of the tied most frequent values of small-domain numeric columns, per key."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")).select(key, "x.*")
    counts = long.where("v IS NOT NULL").groupBy(key, "c", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy(key, "c").agg(F.max("n").alias("n"))
    ties = attach(counts, best.withColumnRenamed("n", "best"), [key, "c"]).where("n = best")
    return ties.groupBy(key).agg(*[F.avg(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in names])


def client_profile(df: DataFrame, key: str, means: list[str], mode_means: list[str] = ("Hour", "DayOfWeek", "DayOfMonth"),
                   modes: list[str] | None = None, cols: Columns = DEFAULT, prefix: str = "cluster_") -> DataFrame:
    """One row per client: means, mean of tied numeric modes, smallest mode of categoricals."""
    modes = list(cols.categoricals) if modes is None else modes
    base = df.groupBy(key).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in means],
                               *[F.mode(c, True).alias(f"{prefix}{c}") for c in modes])
    if not mode_means:
        return base
    tied = tied_mode_mean(df, key, list(mode_means))
    return attach(base, tied.withColumnsRenamed({c: f"{prefix}{c}" for c in mode_means}), key)


def client_value_counts(df: DataFrame, key: str, names: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per client with a count per (column, value), 0 where absent."""
    values = values or {c: category_values(df, c) for c in names}
    return df.groupBy(key).agg(*[
        F.count(F.when(F.col(c) == v, 1)).alias(f"{c}_perClient_{v}") for c in names for v in values[c]])


def unpivot_counts(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Tidy form: (key, column, value, counts)."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x"))
    return long.select(key, "x.*").groupBy(key, "column", "value").agg(F.count("*").alias("counts"))


# ------------------------------------------------------------------ table reports

def daily_fraud_stats(df: DataFrame, start_date: str, cols: Columns = DEFAULT) -> DataFrame:
    """Per day number: transactions, frauds, defrauded customers, calendar date. Needs the day column."""
    fraud = F.col(cols.label) == 1
    return df.groupBy(cols.day).agg(
        F.count(cols.customer).alias("nb_tx_per_day"),
        F.sum(cols.label).alias("nb_fraudulent_transactions_per_day"),
        F.count_distinct(F.when(fraud, F.col(cols.customer))).alias("nb_compromised_cards_per_day"),
    ).withColumn("tx_date", F.date_add(F.lit(start_date).cast("date"), F.col(cols.day)))


STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def describe(df: DataFrame, names: list[str], groups: list[str] | None = None) -> DataFrame:
    """Long table (groups.., column, stat, value) with exact quartiles."""
    groups = groups or []
    long = df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("x")
    ).select(*groups, "x.*")
    basic = long.groupBy(*groups, "column").agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    flat = basic.select(*groups, "column", F.explode(F.create_map(*[
        x for s in ("count", "mean", "std", "min", "max") for x in (F.lit(s), F.col(s))])).alias("stat", "value"))
    q = exact_quantiles(df, names, [0.25, 0.5, 0.75], groups)
    named = F.concat(F.round(F.col("q") * 100).cast("int").cast("string"), F.lit("%"))
    return flat.unionByName(q.select(*groups, "column", named.alias("stat"), "value"))


def describe_by_class(df: DataFrame, names: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """(column, stat, fraud, genuine, ratio)."""
    d = describe(df, names, [cols.label])
    return d.groupBy("column", "stat").agg(
        F.max(F.when(F.col(cols.label) == 1, F.col("value"))).alias("fraud"),
        F.max(F.when(F.col(cols.label) == 0, F.col("value"))).alias("genuine"),
    ).withColumn("ratio", F.try_divide("fraud", "genuine"))


def cardinality_report(df: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """(column, n_unique, unique_ratio)."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[fn(c).alias(c) for c in names], F.count("*").alias("__rows"))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("n_unique"),
                 F.try_divide(F.col(c), F.col("__rows")).alias("unique_ratio")) for c in names])).alias("x")).select("x.*")


def functional_dependency(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """How many key groups hold more than one distinct ``col``."""
    per = df.groupBy(*keys).agg(F.count_distinct(col).alias("n"))
    return per.agg(F.count("*").alias("groups"), F.count(F.when(F.col("n") > 1, 1)).alias("violations"))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(x, y, chi2, cramers_v) per column pair: bias-corrected, with the continuity correction of 2x2 tables.

    All pairs share one aggregate; the contingency tables stay distributed.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
        for a, b in pairs])).alias("p")).select("p.*").where("a IS NOT NULL AND b IS NOT NULL")
    cells = long.groupBy("x", "y", "a", "b").agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy("x", "y", "a").agg(F.sum("o").alias("r"))
    columns_ = cells.groupBy("x", "y", "b").agg(F.sum("o").alias("c"))
    full = attach(attach(cells, rows, ["x", "y", "a"]), columns_, ["x", "y", "b"])
    s = full.groupBy("x", "y").agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"))
    levels = rows.groupBy("x", "y").agg(F.count("*").alias("nr"), F.sum(1 / F.col("r")).alias("ir"))
    levels_c = columns_.groupBy("x", "y").agg(F.count("*").alias("nc"), F.sum(1 / F.col("c")).alias("ic"))
    s = attach(attach(s, levels, ["x", "y"]), levels_c, ["x", "y"])
    n = F.col("n")
    plain = n * (F.col("q") - 1)
    # in a 2x2 table every |observed - expected| equals d, and chi2 = d^2 * n * sum(1/r) * sum(1/c)
    weight = n * F.col("ir") * F.col("ic")
    d = F.sqrt(F.greatest(plain, F.lit(0.0)) / weight)
    shrunk = d - F.least(F.lit(0.5), d)
    chi2 = F.when((F.col("nr") == 2) & (F.col("nc") == 2), shrunk * shrunk * weight).otherwise(plain)
    r, k = F.col("nr"), F.col("nc")
    phi = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    v = F.coalesce(F.sqrt(F.try_divide(phi, F.least(kc - 1, rc - 1))), F.lit(0.0))
    return s.select("x", "y", chi2.alias("chi2"), v.alias("cramers_v"))


def cramers_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    return cramers_v(df, list(combinations(names, 2)))


def class_balance(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """One row: transactions, frauds, ratio, customers per class and in both."""
    per = df.groupBy(cols.customer).agg(F.max((F.col(cols.label) == 1).cast("int")).alias("f"),
                                        F.max((F.col(cols.label) == 0).cast("int")).alias("g"),
                                        F.count("*").alias("n"), F.sum(cols.label).alias("p"))
    return per.agg(
        F.sum("n").alias("n_tx"), F.sum("p").alias("n_fraud"), (F.sum("p") / F.sum("n")).alias("fraud_ratio"),
        F.sum("f").alias("fraud_customers"), F.sum("g").alias("genuine_customers"),
        F.sum(F.col("f") * F.col("g")).alias("common_customers"))


def time_coverage(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    us = micros(cols.ts)
    return df.agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"),
                  ((F.max(us) - F.min(us)) / (24 * HOUR_US)).alias("days"))


def mean_tx_per_day(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return df.groupBy(F.to_date(cols.ts).alias("d")).count().agg(F.avg("count").alias("mean_tx_per_day"))


def correlation_matrix(df: DataFrame, names: list[str], method: str = "pearson") -> DataFrame:
    """(x, y, corr) for every unordered pair."""
    pairs = list(combinations(names, 2))
    if method == "pearson":
        row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
        return row.select(F.explode(F.array(*[
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")
    return df.sparkSession.createDataFrame([(a, b, c) for (a, b), c in zip(pairs, _spearman(df, names, pairs))], "x string, y string, corr double")


def _spearman(df: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> list[float]:
    """Correlations of the mean ranks.

    Equal rows are counted first. Ranks belong to distinct values and come from running counts, so that neither the copies
    of a row nor the ties of a value are sorted or shuffled one by one.
    """
    cells = keep(df.select(*[F.col(c).cast("double").alias(c) for c in names]).groupBy(*names).agg(F.count("*").alias("__n")))
    unknown = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in names])
    n, bad = cells.agg(F.sum("__n"), F.sum(F.when(unknown, F.col("__n")))).first()
    if bad:
        raise ValueError(f"{bad} rows have a null or NaN in {names}")
    ranked = cells
    for i, c in enumerate(names):
        counts = cells.groupBy(c).agg(F.sum("__n").alias("__m"))
        # the mean of all ranks is taken off here, so that the products do not cancel
        rank = F.col("cum___m") - (F.col("__m") - 1) / 2 - ((n or 0) + 1) / 2
        ranked = attach(ranked, prefix_sums(counts, c, ["__m"]).select(c, rank.alias(f"__r{i}")), c)
    at = {c: F.col(f"__r{i}") for i, c in enumerate(names)}
    sums = ranked.agg(*[F.sum(F.col("__n") * at[a] * at[b]) for a, b in [*pairs, *[(c, c) for c in names]]]).first()
    cells.unpersist()
    square = dict(zip(names, sums[len(pairs):]))
    return [s / (square[a] * square[b]) ** 0.5 if square[a] and square[b] else float("nan") for s, (a, b) in zip(sums, pairs)]


def histogram(df: DataFrame, names: list[str], bins: int = 20) -> DataFrame:
    """(column, bin, low, high, n): equal-width bins over the column's range; the last one is closed."""
    lim = df.agg(*[e for c in names for e in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]).first()
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), equal_width_bin(F.col(c).cast("double"), lim[f"lo_{c}"], lim[f"hi_{c}"], bins).alias("bin"),
        F.lit(float(lim[f"lo_{c}"])).alias("lo"), F.lit((lim[f"hi_{c}"] - lim[f"lo_{c}"]) / bins).alias("w")) for c in names
    ])).alias("x")).select("x.*").where("bin IS NOT NULL")
    return long.groupBy("column", "bin", "lo", "w").agg(F.count("*").alias("n")).select(
        "column", "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("low"),
        (F.col("lo") + F.col("bin") * F.col("w")).alias("high"), "n")


def equal_width_bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based bin index; values at the upper limit belong to the last bin."""
    if hi <= lo:
        return F.when(x.isNotNull(), F.lit(1))
    return F.least(F.greatest(F.floor((x - lo) * bins / (hi - lo)) + 1, F.lit(1)), F.lit(bins)).cast("int")


def column_profile(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column, dtype, n_null, n_unique)."""
    names = names or df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    long = df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(c).cast("string").alias("v")) for c in names
    ])).alias("x")).select("x.*")
    counts = long.groupBy("column", "dtype", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column", "dtype").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.count("v").alias("n_unique"))
