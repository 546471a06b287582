"""Row-level features, checks and column clean-up."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from txrisk.schema import DAY_US, DEFAULT, Columns, micros


def drop_columns(df: DataFrame, names: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """Drop named columns of a feature table, which must not carry the label."""
    if cols.label in df.columns:
        raise ValueError(f"feature table still contains the label {cols.label}")
    return df.drop(*names)


def to_frame(df: DataFrame, vector: str, size: int, prefix: str = "to_df") -> DataFrame:
    """One numbered double column per element of a vector column."""
    is_vector = not isinstance(df.schema[vector].dataType, T.ArrayType)
    arr = vector_to_array(vector) if is_vector else F.col(vector)
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, *[arr[i].cast("double").alias(f"{prefix}_{i}") for i in range(size)])


def joined(names: list[str] | tuple[str, ...], sep: str) -> Column:
    """Text of several columns; nulls become the text ``null`` so that keys never lose a part."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names])


def composite_key(df: DataFrame, parts: list[str] | tuple[str, ...], name: str, sep: str = "+") -> DataFrame:
    return df.withColumn(name, joined(parts, sep))


def add_client_key(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return composite_key(df, cols.uid_parts, cols.client)


def calendar_features(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    t = F.col(cols.ts)
    h, dow, dom = F.hour(t), F.weekday(t), F.dayofmonth(t)
    flag = lambda c: c.cast("int")
    return df.withColumns({
        "Hour": h, "DayOfWeek": dow, "DayOfMonth": dom,
        "IsWeekend": flag(dow >= 5), "IsNight": flag(h.between(0, 6)),
        "IsMonthEnd": flag(F.to_date(t) == F.last_day(t)), "IsMonthStart": flag(dom == 1),
    })


def legacy_calendar_flags(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """The older flags: night is before 6 or after 18; days counted from the table's first row."""
    t = F.col(cols.ts)
    first = df.agg(F.min(micros(cols.ts)).alias("__us0"))   # one row
    return (df.crossJoin(F.broadcast(first))
            .withColumns({
                "TX_DURING_WEEKEND": (F.weekday(t) > 4).cast("int"),
                "TX_DURING_NIGHT": ((F.hour(t) < 6) | (F.hour(t) > 18)).cast("int"),
                "TX_HOUR": F.hour(t),
                cols.day: F.floor((micros(cols.ts) - F.col("__us0")) / DAY_US).cast("int"),
            }).drop("__us0"))


def day_offset(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Whole 24-hour blocks since the first transaction of the table."""
    first = df.agg(F.min(micros(cols.ts)).alias("__us0"))   # one row
    out = df.crossJoin(F.broadcast(first))
    return out.withColumn(cols.day, F.floor((micros(cols.ts) - F.col("__us0")) / DAY_US).cast("int")).drop("__us0")


def _crosses(df: DataFrame, groups: list[tuple[str, ...]]) -> DataFrame:
    return df.withColumns({"_".join(g): joined(g, "_") for g in dict.fromkeys(groups)})


def cross_features(df: DataFrame, names: list[str] | None = None, sizes: tuple[int, ...] = (2, 3),
                   cols: Columns = DEFAULT) -> DataFrame:
    """Joined category pairs and triples."""
    names = names or [cols.category, cols.pricing, cols.provider, cols.channel]
    return _crosses(df, [g for n in sizes for g in combinations(names, n)])


def temporal_identity_crosses(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Calendar flags crossed with provider and category; expects ``calendar_features``."""
    identity = {cols.provider, cols.category}
    flags = ["IsNight", "IsWeekend", cols.provider, cols.category, "IsMonthEnd", "IsMonthStart"]
    clock = ["DayOfWeek", cols.provider, cols.category, "Hour"]
    groups: list[tuple[str, ...]] = [("DayOfWeek", "Hour")]
    groups += list(combinations(flags, 3)) + list(combinations(clock, 3))
    for names in (flags, [*clock, "IsMonthEnd"]):
        groups += [g for g in combinations(names, 2) if set(g) != identity]
    return _crosses(df, groups)


def night_weekend_crosses(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return _crosses(df, [(f, c) for f in ("IsNight", "IsWeekend") for c in cols.categoricals])


# Cycle lengths kept for equal results; pass 7 and 31 for calendar-true cycles.
CYCLES = {"Hour": 24, "DayOfWeek": 6, "DayOfMonth": 30}


def cyclical_sincos(df: DataFrame, cycles: dict[str, int] | None = None) -> DataFrame:
    out = {}
    for c, m in (cycles or CYCLES).items():
        angle = F.col(c) * (2 * math.pi / m)
        out[f"{c}_sin"], out[f"{c}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


def spline_column(x: Column, low: float, high: float, j: int, n_knots: int = 6) -> Column:
    """Column ``j`` of the periodic cubic B-spline basis with uniform knots on [low, high]."""
    periods = n_knots - 1
    u = (x - low) / ((high - low) / periods) if high > low else x * 0.0
    v = F.pmod(u - j, F.lit(float(periods)))
    a = F.abs(v - 2)
    return (F.when(a < 1, (4 - 6 * a * a + 3 * a * a * a) / 6)
            .when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0))


def periodic_spline(df: DataFrame, names: list[str], ranges: dict[str, tuple[float, float]] | None = None,
                    n_knots: int = 6) -> DataFrame:
    """``n_knots - 1`` basis columns per feature; ranges are learnt in one pass when not given."""
    ranges = ranges or spline_ranges(df, names)
    return df.withColumns({f"{c}_spline_{j}": spline_column(F.col(c).cast("double"), *ranges[c], j, n_knots)
                           for c in names for j in range(n_knots - 1)})


def spline_ranges(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)]).first()
    return {c: (row[f"min_{c}"], row[f"max_{c}"]) for c in names}


def debit_and_ratio(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    amount, value = F.col(cols.amount), F.col(cols.value)
    return df.withColumns({"IsDebit": (amount < 0).cast("int"),
                           "AmountValueRatio": F.coalesce(F.try_divide(amount, value), F.lit(0.0))})


def finalise_features(df: DataFrame, helpers: list[str] = ()) -> DataFrame:
    """Drop helper columns and turn infinities and NaN into 0."""
    out = df.drop(*helpers)
    floats = [f.name for f in out.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return out.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c)) for c in floats}) if floats else out


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing): nulls and NaN per column, in one pass."""
    def missing(f: T.StructField) -> Column:
        m = F.col(f.name).isNull()
        return m | F.isnan(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else m
    counts = df.agg(*[F.sum(missing(f).cast("long")).alias(f.name) for f in df.schema])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("missing")) for c in df.columns
    ])).alias("x")).select("x.*")


def validate(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Raise if the label is present or any column has missing values; returns the input."""
    if cols.label in df.columns:
        raise ValueError(f"feature table contains the label {cols.label}")
    bad = {r["column"]: r["missing"] for r in missing_counts(df).where("missing > 0").collect()}
    if bad:
        raise ValueError(f"missing values in {bad}")
    return df


def constant_columns(df: DataFrame, tol: float = 1.0, names: list[str] | None = None) -> list[str]:
    """Columns whose most frequent value covers at least ``tol`` of the rows (1.0: a single value)."""
    names = names or df.columns
    if tol >= 1.0:
        row = df.agg(*[e for c in names for e in (
            F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"),
            F.count(c).alias(f"n_{c}"))], F.count("*").alias("n")).first()
        return [c for c in names if row[f"a_{c}"] == row[f"b_{c}"] and row[f"n_{c}"] in (0, row["n"])]
    text = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in names])).alias("x")).select("x.*")
    top = text.groupBy("column", "v").count().groupBy("column").agg(
        F.max("count").alias("top"), F.sum("count").alias("n"))
    return [r["column"] for r in top.where(F.col("top") >= F.col("n") * tol).collect()]


def drop_constant(df: DataFrame, tol: float = 1.0) -> DataFrame:
    return df.drop(*constant_columns(df, tol))


def duplicate_columns(df: DataFrame) -> list[str]:
    """Columns equal on every row to an earlier column of the same type."""
    prints = df.agg(*[F.sum(F.xxhash64(c).cast("decimal(38,0)")).alias(c) for c in df.columns]).first()
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    pairs = [(a, b) for a, b in combinations(df.columns, 2) if types[a] == types[b] and prints[a] == prints[b]]
    if not pairs:
        return []
    exact = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return list(dict.fromkeys(b for i, (_, b) in enumerate(pairs) if exact[f"p{i}"]))


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    return df.drop(*duplicate_columns(df))


def classify(df: DataFrame, threshold: float = 0.5, score: str = "predictions", name: str = "predicted") -> DataFrame:
    return df.withColumn(name, F.when(F.col(score) < threshold, 0).otherwise(1))


def apply_hooks(df: DataFrame, *hooks: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    for hook in hooks:
        df = df.transform(hook) if hook else df
    return df


def feature_union(df: DataFrame, *blocks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outputs of several feature blocks side by side; each block only adds columns, so no join is needed."""
    base = list(df.columns)
    out = df
    for block in blocks:
        got = block(out)
        if any(c not in got.columns for c in base):
            raise ValueError("a feature block must keep the columns of its input")
        out = got
    return out


def route_columns(df: DataFrame, ids: list[str] = (), skip: list[str] = (), onehot_threshold: int | None = None
                  ) -> dict[str, list[str]]:
    """Column names by treatment: numeric, ids, categorical (or low / high cardinality) and passthrough."""
    routes: dict[str, list[str]] = {"numeric": [], "ids": [c for c in ids if c in df.columns], "categorical": [], "passthrough": []}
    for f in df.schema:
        if f.name in skip or f.name in ids:
            continue
        if isinstance(f.dataType, T.NumericType):
            routes["numeric"].append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            routes["categorical"].append(f.name)
        else:
            routes["passthrough"].append(f.name)
    cats = routes["categorical"]
    if onehot_threshold is not None and cats:
        n = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cats]).first()
        routes["low_cardinality"] = [c for c in cats if n[c] <= onehot_threshold]
        routes["high_cardinality"] = [c for c in cats if n[c] > onehot_threshold]
    return routes
