"""Delay-aware, prequential, positional and group-aware splits, set reports and class samples.

Splits come back as long tables: the input rows plus ``fold`` and ``split`` columns, filtered once,
never as separately collected index lists.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, hash_u32, hash_unit, row_positions
from txrisk.schema import DAY_US, DEFAULT, Columns, micros


def _to_us(start: datetime | str | int) -> int:
    if isinstance(start, int):
        return start
    if isinstance(start, str):
        start = datetime.fromisoformat(start)
    start = start if start.tzinfo else start.replace(tzinfo=timezone.utc)
    delta = start - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def default_start(df: DataFrame, train: int, delay: int, test: int, cols: Columns = DEFAULT) -> int:
    """Latest start (microseconds) that leaves room for train, delay and test days."""
    return df.agg(F.max(micros(cols.ts))).first()[0] - (train + delay + test) * DAY_US


def prequential_split(df: DataFrame, n_folds: int = 3, start=None, train: int = 14, delay: int = 3, test: int = 7,
                      key: str | None = None, with_delay: bool = False, sampling_ratio: float = 1.0, seed: int = 0,
                      cols: Columns = DEFAULT) -> DataFrame:
    """Rows with ``fold`` and ``split`` (train, test, optionally delay); fold f starts f test windows earlier.

    Test day i of a fold keeps only rows whose key is not yet known as defrauded: known are keys with a
    fraud in the training period or on a day from train-1 up to train+i-1, counted from the first training day.
    The day loop is replaced by the first day on which a key counts as known.
    """
    key = key or cols.customer
    # the training period is bounded by timestamps, the test period by day numbers
    us = micros(cols.ts)
    last_start = default_start(df, train, delay, test, cols) if start is None else _to_us(start)
    starts = [last_start - f * test * DAY_US for f in range(n_folds)]
    in_train = lambda s: (us >= s) & (us < s + train * DAY_US)
    first_day = df.agg(*[F.min(F.when(in_train(s), F.col(cols.day))).alias(f"f{i}") for i, s in enumerate(starts)]).first()
    folds = [(i, s, first_day[f"f{i}"]) for i, s in enumerate(starts) if first_day[f"f{i}"] is not None]
    if not folds:
        raise ValueError("no training rows in the requested period")

    day = F.col(cols.day)

    def tags(i: int, s: int, s0: int):
        """Memberships of a row in one fold; train, delay and test may overlap by less than a day."""
        t0 = s0 + train + delay
        return [F.struct(F.lit(i).alias("fold"), F.lit("train").alias("split"), in_train(s).alias("is")),
                F.struct(F.lit(i).alias("fold"), F.lit("test").alias("split"), day.between(t0, t0 + test - 1).alias("is")),
                F.struct(F.lit(i).alias("fold"), F.lit("delay").alias("split"),
                         (F.lit(with_delay) & (us >= s + train * DAY_US) & (us < s + (train + delay) * DAY_US)).alias("is"))]

    member = F.filter(F.array(*[t for f in folds for t in tags(*f)]), lambda x: x["is"])
    rows = df.select("*", F.explode(member).alias("__m")).select("*", "__m.fold", "__m.split").drop("__m")

    def known_from(i: int, s: int, s0: int):
        pooled = day.between(s0 + train - 1, s0 + train + test - 2)
        return F.struct(F.lit(i).alias("fold"), F.lit(s0).alias("s0"),
                        F.when(in_train(s), 0).when(pooled, F.greatest(day - s0 - train + 1, F.lit(0))).alias("k"))

    frauds = df.where(F.col(cols.label) == 1)
    known = frauds.select(key, F.explode(F.array(*[known_from(*f) for f in folds])).alias("x")).select(key, "x.*")
    known = known.where("k IS NOT NULL").groupBy(key, "fold").agg(F.min("k").alias("__known"), F.first("s0").alias("__s0"))
    rows = attach(rows, known, [key, "fold"])
    bad = (F.col("split") == "test") & F.col("__known").isNotNull() & (F.col("__known") <= day - F.col("__s0") - train - delay)
    out = rows.where(~bad).drop("__known", "__s0")
    if sampling_ratio < 1:
        chosen = stratified_sample(out.where("split = 'train'"), sampling_ratio, seed, cols, strata=[cols.label, "fold"])
        out = chosen.unionByName(out.where("split <> 'train'"))
    return out


def holdout_split(df: DataFrame, start=None, train: int = 14, delay: int = 3, test: int = 7, key: str | None = None,
                  sampling_ratio: float = 1.0, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """Rows with a ``split`` column: train and the delay-aware test set."""
    return prequential_split(df, 1, start, train, delay, test, key, False, sampling_ratio, seed, cols).drop("fold")


def train_delay_test_split(df: DataFrame, start=None, train: int = 14, delay: int = 3, test: int = 7, key: str | None = None,
                           sampling_ratio: float = 1.0, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """As ``holdout_split`` on accounts, with the delay block kept."""
    return prequential_split(df, 1, start, train, delay, test, key or cols.account, True, sampling_ratio, seed, cols).drop("fold")


def remove_known_bad(test: DataFrame, known: DataFrame, key: str, delay_days: int, cols: Columns = DEFAULT) -> DataFrame:
    """Drop test rows whose key had its first fraud at least ``delay_days`` days before the row's day."""
    first = known.where(F.col(cols.label) == 1).groupBy(key).agg(F.min(cols.day).alias("__first"))
    j = attach(test, first, key)
    return j.where(F.col("__first").isNull() | (F.col("__first") > F.col(cols.day) - delay_days)).drop("__first")


def remove_group_overlap(val: DataFrame, train: DataFrame, group: str) -> DataFrame:
    """Validation rows whose group does not occur in train."""
    return val.join(train.select(group).distinct(), group, "left_anti")


def known_defrauded(df: DataFrame, key: str, cols: Columns = DEFAULT) -> DataFrame:
    """(key, first_day): the union over days of defrauded keys, as the first day of each."""
    return df.where(F.col(cols.label) == 1).groupBy(key).agg(F.min(cols.day).alias("first_day"))


def time_series_split(df: DataFrame, n_splits: int = 2, gap: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """Expanding-window folds by row position: rows with ``fold`` and ``split``."""
    us = df.withColumn("__us", micros(cols.ts))
    pos = row_positions(us, "__us", cols.id, "__pos")
    n = df.count()
    size = n // (n_splits + 1)
    if size == 0 or n - n_splits * size - gap <= 0:
        raise ValueError("too few rows for the requested number of splits and gap")
    p = F.col("__pos")

    def tag(j: int):
        a = n - (n_splits - j) * size
        return F.struct(F.lit(j).alias("fold"),
                        F.when(p < a - gap, "train").when((p >= a) & (p < a + size), "test").alias("split"))

    tags = F.filter(F.array(*[tag(j) for j in range(n_splits)]), lambda x: x["split"].isNotNull())
    return pos.select("*", F.explode(tags).alias("__t")).select(*df.columns, "__t.fold", "__t.split")


def group_split_windows(df: DataFrame, val_days: int = 30, n_splits: int = 3, cols: Columns = DEFAULT) -> list[tuple[int, int]]:
    """(start, end) microseconds of each validation window."""
    us = micros(cols.ts)
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    max_shift = (hi - lo) // DAY_US - val_days
    if max_shift <= 0:
        raise ValueError("the time span is too short for the validation window")
    shifts = [int(max_shift * i / (n_splits - 1)) if n_splits > 1 else 0 for i in range(n_splits)]
    return [(lo + s * DAY_US, lo + (s + val_days) * DAY_US) for s in shifts]


def rolling_group_splits(df: DataFrame, group: str | None = None, val_days: int = 30, n_splits: int = 3,
                         min_train_days: int | None = None, cols: Columns = DEFAULT) -> DataFrame:
    """Rows with ``fold`` and ``split`` (train, val); validation rows of groups seen in train are dropped."""
    group = group or cols.account
    windows = group_split_windows(df, val_days, n_splits, cols)
    us = F.col("__us")

    def tag(i: int, a: int, b: int):
        train = us < a if min_train_days is None else (us < a) & (us >= a - min_train_days * DAY_US)
        return F.struct(F.lit(i).alias("fold"),
                        F.when(train, "train").when((us >= a) & (us < b), "val").alias("split"))

    tags = F.filter(F.array(*[tag(i, a, b) for i, (a, b) in enumerate(windows)]), lambda x: x["split"].isNotNull())
    rows = df.withColumn("__us", micros(cols.ts)).select("*", F.explode(tags).alias("__t"))
    rows = rows.select(*df.columns, "__t.fold", "__t.split")
    in_train = rows.where("split = 'train'").groupBy("fold", group).agg(F.lit(True).alias("__seen"))
    rows = attach(rows, in_train, ["fold", group])
    return rows.where((F.col("split") == "train") | F.col("__seen").isNull()).drop("__seen")


def train_val_split(df: DataFrame, group: str | None = None, val_days: int = 30, cols: Columns = DEFAULT) -> DataFrame:
    """Train of the second and validation of the third rolling group split."""
    folds = rolling_group_splits(df, group, val_days, 3, None, cols)
    return folds.where("(fold = 1 AND split = 'train') OR (fold = 2 AND split = 'val')").drop("fold")


# ------------------------------------------------------------------ set reports

def union_slices(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def unique_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(key).subtract(b.select(key))


def unique_ratio(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of ``a``, keys missing in ``b``, their ratio."""
    seen = b.select(key).distinct().withColumn("__in", F.lit(1))
    j = attach(a.select(key).distinct(), seen, key)
    missing = F.count(F.when(F.col("__in").isNull(), 1))
    return j.agg(F.count("*").alias("n_keys"), missing.alias("n_unique"), F.try_divide(missing, F.count("*")).alias("ratio"))


def unseen_categories(train: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """(column, value): values of ``other`` that never occur in ``train``."""
    long = lambda df: df.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")
    return long(other).subtract(long(train))


# ------------------------------------------------------------------ class samples

def stratified_sample(df: DataFrame, ratio: float, seed: int = 0, cols: Columns = DEFAULT,
                      strata: list[str] | None = None, exact: bool = True) -> DataFrame:
    """The same share of every class, chosen by hash order.

    ``exact`` takes ``round(ratio * n)`` rows per class; otherwise the hash threshold alone decides,
    which needs no shuffle.
    """
    strata = strata or [cols.label]
    if not exact:
        return df.where(hash_unit(cols.id, seed) < ratio)
    return _hash_smallest(df, strata, lambda n: F.round(n * ratio), seed, cols)


def _hash_smallest(df: DataFrame, strata: list[str], wanted, seed: int, cols: Columns) -> DataFrame:
    """Per stratum the ``wanted(n)`` rows with the smallest (hash, id)."""
    u = df.withColumn("__u", hash_u32(cols.id, seed)).withColumn("__one", F.lit(1).cast("long"))
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    # hashes are uniform, so equal slices of the hash range keep every window group small
    n_slices = 256
    u = u.withColumn("__s", F.floor(F.col("__u") * n_slices / 4294967296))
    per = u.groupBy(*strata, "__s").agg(F.count("*").alias("__c"))
    w = W.partitionBy(*strata).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*strata, "__s", "__c", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    out = attach(u, attach(per, sizes, strata).select(*strata, "__s", "__off", "__c", wanted(F.col("__n")).alias("__want")), [*strata, "__s"])
    # whole slices below the cut are taken as they are; only rows of the slice that holds it are ranked
    sure = out.where(F.col("__off") + F.col("__c") <= F.col("__want"))
    edge = out.where((F.col("__off") < F.col("__want")) & (F.col("__off") + F.col("__c") > F.col("__want")))
    rank = F.col("__off") + F.row_number().over(W.partitionBy(*strata, "__s").orderBy("__u", cols.id))
    edge = edge.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__want"))
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def stratified_kfold(df: DataFrame, n: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """Balanced folds per class: rows are dealt to folds in hash order."""
    strata = [cols.label]
    u = df.withColumn("__u", hash_u32(cols.id, seed))
    n_slices = max(256, df.count() // 100_000)   # the size of a ranked group stays the same
    u = u.withColumn("__s", F.floor(F.col("__u") * n_slices / 4294967296))
    per = u.groupBy(*strata, "__s").agg(F.count("*").alias("__c"))
    w = W.partitionBy(*strata).orderBy("__s").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*strata, "__s", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__off"))
    out = attach(u, per, [*strata, "__s"])
    rank = F.col("__off") + F.row_number().over(W.partitionBy(*strata, "__s").orderBy("__u", cols.id)) - 1
    return out.withColumn("fold", F.pmod(rank, F.lit(n)).cast("int")).select(*df.columns, "fold")


def random_undersample(df: DataFrame, ratio: float, seed: int | str = 0, cols: Columns = DEFAULT) -> DataFrame:
    """All positives and a hash sample of negatives so that positives / negatives is about ``ratio``.

    The class sizes are one aggregate; the draw itself is a filter without a shuffle.
    """
    pos, neg = class_sizes(df, cols)
    share = min(1.0, pos / ratio / neg) if neg else 1.0
    return df.where((F.col(cols.label) == 1) | (hash_unit(cols.id, seed) < share))


def class_sizes(df: DataFrame, cols: Columns = DEFAULT) -> tuple[int, int]:
    row = df.agg(F.count(F.when(F.col(cols.label) == 1, 1)), F.count(F.when(F.col(cols.label) == 0, 1))).first()
    return row[0], row[1]
