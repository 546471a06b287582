"""Per-key ordered features.

Every feature of one key is described by a small spec and evaluated together by ``over_key`` so that a
key costs one shuffle. Ordinary keys use native window frames. A native group of a key that owns a
large share of the table would be one task, so hot keys take a sliced route with equal results:

* previous row, running sum: time slices with a carry from the earlier slices of the key;
* rolling aggregates: a frame is the end of one time slice, whole slices, and the begin of another; partial sums of these
  three parts are added in double precision, so nothing cancels and the cost does not grow with the frame length;
* row frames: blocks of consecutive row numbers, each with a short overlap.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, heavy_keys, num_partitions, split_hot, time_offsets
from txrisk.schema import DAY_US, DEFAULT, HOUR_US, MINUTE_US, Columns, micros

FRAME_SLICES = 16  # time slices per shortest frame of the sliced route
MAX_FRAME_SLICES = 1024  # time slices per longest frame that shares them
SLICE_US = HOUR_US  # slice length of hot keys
BLOCK_ROWS = 8192  # rows per block of the row-frame route
ROUNDING = 2.0 ** -52  # a sum of n doubles is off by at most (n - 1) / 2 of this times the sum of their sizes


@dataclass(frozen=True)
class Prev:
    """Value of ``col`` on the key's previous row, null on its first row."""
    name: str
    col: str


@dataclass(frozen=True)
class Running:
    """Running sum of ``col`` up to and including the row."""
    name: str
    col: str


@dataclass(frozen=True)
class Rolling:
    """``fn`` in count, sum, avg, std, size (sum of absolute values) over ``(t - lag - width, t - lag]``."""
    name: str
    fn: str
    width_us: int
    col: str | None = None
    lag_us: int = 0


@dataclass(frozen=True)
class LastRows:
    """``fn`` in avg, list over the last ``n`` rows of the key, the row included."""
    name: str
    fn: str
    n: int
    col: str


@dataclass(frozen=True)
class KeyStat:
    """``fn`` in count, sum, avg, std, min, max, size over all rows of the key."""
    name: str
    fn: str
    col: str | None = None


AGG = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "size": lambda c: F.sum(F.abs(c))}


def _agg(fn: str, col: str | None) -> Column:
    return F.count(F.lit(1)) if fn == "count" else AGG[fn](col)


def over_key(df: DataFrame, key: str, features: list, cols: Columns = DEFAULT, *,
             hot_rows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Add all ``features`` of one key; keys with more than ``hot_rows`` rows are sliced.

    ``source`` is a cheaper table with the same rows (such as the raw scan behind ``df``) to count keys on.
    """
    names = [f.name for f in features]
    heavy = heavy_keys(df if source is None else source, [key], hot_rows)
    parts = split_hot(df.withColumn("__us", micros(cols.ts)), [key], heavy)
    out = _native(parts.cold, key, features, cols)
    if parts.hot is not None:
        sliced = _sliced(parts.hot, key, features, cols)
        out = out.unionByName(sliced.select(out.columns))
    return out.select(*df.columns, *names)


def one_outer(df: DataFrame, key: str, outer: str) -> bool:
    """Whether no value of ``key`` stands with two values of ``outer``, null being a value."""
    return df.select(key, outer).distinct().groupBy(key).count().where("count > 1").isEmpty()


def over_nested_keys(df: DataFrame, blocks: list, cols: Columns = DEFAULT, *, hot_rows: int | None = None,
                     source: DataFrame | None = None) -> DataFrame:
    """Several keys whose groups lie inside those of the first: one shuffle by the first key serves all of them.

    ``blocks`` are (key, features, finish, apart): ``finish`` turns a frame with the features into one with the columns to keep, ``apart`` adds
    the whole block in the ordinary way, for rows of hot keys. That the groups are nested is the caller's to check (``one_outer``).
    """
    outer = blocks[0][0]
    rows = df if source is None else source
    heavy = heavy_keys(rows, [outer], hot_rows)
    parts = split_hot(df, [outer], heavy)
    out = parts.cold
    for key, features, finish, _ in blocks:
        raw = _native(out.withColumns({"__us": micros(cols.ts), "__now": micros(cols.ts)}), key, features, cols, None if key == outer else outer)
        out = finish(raw, out.columns)
    if parts.hot is not None:
        hot, narrow = parts.hot, split_hot(rows, [outer], heavy).hot
        for *_, apart in blocks:
            hot = apart(hot, narrow)
        out = out.unionByName(hot.select(out.columns))
    return out


def _native(df: DataFrame, key: str, features: list, cols: Columns, outer: str | None = None) -> DataFrame:
    """Native frames; with ``outer``, a key that holds whole groups of ``key``, rows dealt by ``outer`` are not dealt again."""
    whole = W.partitionBy(*([] if outer is None else [outer]), key)
    by_row, by_time = whole.orderBy("__us", cols.id), whole.orderBy("__us")
    exprs = []
    for f in features:
        if isinstance(f, Prev):
            e = F.lag(f.col).over(by_row)
        elif isinstance(f, Running):
            e = F.sum(f.col).over(by_row.rowsBetween(W.unboundedPreceding, 0))
        elif isinstance(f, Rolling):
            e = _agg(f.fn, f.col).over(by_time.rangeBetween(-(f.lag_us + f.width_us) + 1, -f.lag_us))
        elif isinstance(f, LastRows):
            fn = F.avg if f.fn == "avg" else F.collect_list
            e = fn(f.col).over(by_row.rowsBetween(-(f.n - 1), 0))
        else:
            e = _agg(f.fn, f.col).over(whole)
        exprs.append(e.alias(f.name))
    return df.select("*", *exprs)


def _sliced(df: DataFrame, key: str, features: list, cols: Columns) -> DataFrame:
    kinds = lambda t: [f for f in features if isinstance(f, t)]
    ordered, rolling, rows, stats = kinds((Prev, Running)), kinds(Rolling), kinds(LastRows), kinds(KeyStat)
    if stats:
        df = attach(df, df.groupBy(key).agg(*[_agg(f.fn, f.col).alias(f.name) for f in stats]), key)
    if rows:
        ordered = [*ordered, Running("__rn", "__one")]
        df = df.withColumn("__one", F.lit(1))
    if ordered:
        df = _carry_over_slices(df, key, ordered, cols)
    if rolling:
        df = _frames(df, key, rolling)
    if rows:
        df = _row_blocks(df, key, rows)
    return df


def _carry_over_slices(df: DataFrame, key: str, features: list, cols: Columns) -> DataFrame:
    """Previous row and running sums: (key, slice) windows plus the carry of earlier slices."""
    prev = [f for f in features if isinstance(f, Prev)]
    run = [f for f in features if isinstance(f, Running)]
    df = df.withColumn("__s", F.floor(F.col("__us") / SLICE_US))
    last = F.struct(*[F.col(f.col).alias(f.name) for f in prev]) if prev else F.struct(F.lit(1).alias("x"))
    summary = df.groupBy(key, "__s").agg(
        F.max_by(last, F.struct("__us", cols.id)).alias("__last"),
        *[F.sum(f.col).alias(f"__sum_{f.name}") for f in run])
    # one row per (hot key, slice): the group of a key is bounded by its time span
    w = W.partitionBy(key).orderBy("__s")
    carry = summary.select(key, "__s", F.lag("__last").over(w).alias("__last"), *[
        F.sum(f"__sum_{f.name}").over(w.rowsBetween(W.unboundedPreceding, -1)).alias(f"__sum_{f.name}") for f in run])
    df = attach(df, carry, [key, "__s"])
    inside = W.partitionBy(key, "__s").orderBy("__us", cols.id)
    out = df.select("*", F.row_number().over(inside).alias("__i"), *[
        F.lag(f.col).over(inside).alias(f"__lag_{f.name}") for f in prev], *[
        F.sum(f.col).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"__run_{f.name}") for f in run])
    exprs = [F.when(F.col("__i") == 1, F.col(f"__last.{f.name}")).otherwise(F.col(f"__lag_{f.name}")).alias(f.name)
             for f in prev]
    for f in run:
        a, b = F.col(f"__sum_{f.name}"), F.col(f"__run_{f.name}")
        exprs.append(F.coalesce(a + b, a, b).alias(f.name))
    keep = [c for c in df.columns if c not in {"__s", "__last", *[f"__sum_{f.name}" for f in run]}]
    return out.select(*keep, *exprs)


def _time_slice(t: Column, size: int) -> Column:
    return ((t - F.pmod(t, F.lit(size))) / size).cast("long")


def _frames(df: DataFrame, key: str, features: list[Rolling]) -> DataFrame:
    """Rolling aggregates from partial sums of time slices (see the module text).

    A frame depends on nothing but the key and the time, so only these and the measured numbers are moved; rows get their results by one join.
    """
    number = {c: f"__x{i}" for i, c in enumerate(sorted({f.col for f in features if f.col}))}
    spread = [number[c] for c in sorted({f.col for f in features if f.fn == "std"})]
    base = df.select(F.col(key).alias("__key"), "__us", *[F.col(c).cast("double").alias(x) for c, x in number.items()])
    if spread:
        # squares are taken around the key's mean, so that they do not cancel
        clean = lambda x: F.when(~F.isnan(x), F.col(x))
        base = attach(base, base.groupBy("__key").agg(*[F.coalesce(F.avg(clean(x)), F.lit(0.0)).alias(f"__centre{x}") for x in spread]), "__key")
    measures: dict[str, Column] = {}
    for f in features:
        x = number.get(f.col)
        if f.fn == "count":
            measures["__n"] = F.lit(1).cast("long")
        elif f.fn == "size":
            measures[f"__a{x}"] = F.abs(x)
        else:
            measures |= {f"__k{x}": F.col(x).isNotNull().cast("long"), f"__v{x}": F.col(x)}
        if f.fn == "std":
            away = F.col(x) - F.col(f"__centre{x}")
            measures |= {f"__e{x}": away, f"__q{x}": away * away, f"__lo{x}": F.col(x), f"__hi{x}": F.col(x)}
    points = base.groupBy("__key", "__us").agg(*[_merge(m)(e).alias(m) for m, e in measures.items()])
    found = None
    for lag in sorted({f.lag_us for f in features}):
        for widths in _width_groups(sorted({f.width_us for f in features if f.lag_us == lag})):
            part = _frame(points, list(measures), widths, lag)
            part = part.select("__key", "__us", *[_value(f, number.get(f.col), widths.index(f.width_us)).alias(f.name)
                                                  for f in features if f.lag_us == lag and f.width_us in widths])
            found = part if found is None else attach(found, part, ["__key", "__us"])
    return attach(df, found.withColumnRenamed("__key", key), [key, "__us"])


def _merge(measure: str):
    """How partial values of a measure are put together."""
    return F.min if measure.startswith("__lo") else F.max if measure.startswith("__hi") else F.sum


def _width_groups(widths: list[int]) -> list[list[int]]:
    """Widths that share slices: a slice length that divides them all and cuts the longest into at most ``MAX_FRAME_SLICES``."""
    groups: list[list[int]] = []
    for w in widths:
        for g in groups:
            if max(w, *g) // gcd(w, *g) * FRAME_SLICES <= MAX_FRAME_SLICES:
                g.append(w)
                break
        else:
            groups.append([w])
    return groups


def _frame(points: DataFrame, measures: list[str], widths: list[int], lag: int) -> DataFrame:
    """(key, time, measures of each width): a frame ``(x, y]`` is the end of x's slice, whole slices between, the begin of y's slice. Nothing is subtracted."""
    base = gcd(*widths)
    size = base // FRAME_SLICES if base % FRAME_SLICES == 0 else base
    types = dict(points.dtypes)
    y = F.col("__us") - lag
    none = [F.lit(None).cast(types[m]).alias(m) for m in measures]
    at = lambda w, t, values: F.struct(F.lit(w).alias("__w"), t.alias("__t"), *values)
    # -2: values only, -1: a frame's end y, 0 and up: its begin x for that width
    places = [at(i, y - w, none) for i, w in enumerate(widths)]
    places += [at(-1, y, [F.col(m) for m in measures])] if lag == 0 else [at(-1, y, none), at(-2, F.col("__us"), [F.col(m) for m in measures])]
    records = points.select("__key", "__us", F.explode(F.array(*places)).alias("p")).select("__key", "__us", "p.*")
    records = records.withColumn("__s", _time_slice(F.col("__t"), size))
    slices = records.where("__w < 0 AND __s IS NOT NULL").groupBy("__key", "__s").agg(*[_merge(m)(m).alias(m) for m in measures])
    by_slice = W.partitionBy("__key").orderBy("__s")   # one row per (hot key, slice)
    whole = lambda m, w: _merge(m)(m).over(by_slice.rangeBetween(1 - w // size, -1)) if w > size else F.lit(None).cast(types[m])
    between = slices.select("__key", "__s", F.struct(*[whole(m, w).alias(f"{m}_{i}") for i, w in enumerate(widths) for m in measures]).alias("__b"))
    group = W.partitionBy("__key", "__s")
    begin = group.orderBy("__t").rangeBetween(W.unboundedPreceding, 0)
    after = group.orderBy(-F.col("__t")).rangeBetween(W.unboundedPreceding, -1)   # a growing frame in falling time
    side = records.unionByName(between, allowMissingColumns=True).select(
        "__key", "__us", "__w", "__t", F.first("__b", ignorenulls=True).over(group).alias("__b"),
        *[_merge(m)(m).over(begin).alias(f"{m}_y") for m in measures], *[_merge(m)(m).over(after).alias(f"{m}_x") for m in measures])
    # rows without a time are peers of each other and have no frame before them
    end = lambda m: F.when(F.col("__t").isNotNull(), F.col(f"{m}_x"))
    mine = lambda i: F.col("__w") == i
    parts = side.where("__w >= -1").select("__key", "__us", "__w", *[
        F.when(mine(-1), F.col(f"{m}_y")).otherwise(end(m)).alias(m) for m in measures], *[
        F.when(mine(-1), F.col(f"__b.{m}_{i}")).alias(f"{m}_{i}") for i in range(len(widths)) for m in measures])

    def total(m: str, i: int) -> Column:
        edges, inner = _merge(m)(F.when(mine(-1) | mine(i), F.col(m))), _merge(m)(f"{m}_{i}")
        both = {F.min: F.least, F.max: F.greatest}.get(_merge(m), lambda a, b: F.coalesce(a + b, a, b))
        return both(edges, inner).alias(f"{m}_{i}")

    return parts.groupBy("__key", "__us").agg(*[total(m, i) for i in range(len(widths)) for m in measures])


def _value(f: Rolling, x: str | None, i: int) -> Column:
    """The feature from the measures of the ``i``-th width."""
    get = lambda m: F.col(f"__{m}{x}_{i}")
    if f.fn == "count":
        return F.coalesce(F.col(f"__n_{i}"), F.lit(0))
    if f.fn == "size":
        return get("a")
    k, v = get("k"), get("v")
    if f.fn == "std":
        lo, hi, e, q = get("lo"), get("hi"), get("e"), get("q")
        spread = F.sqrt(F.greatest(q - e * e / k, F.lit(0.0)) / (k - 1))
        return F.when(k > 1, F.when((lo == hi) & ~F.isnan(hi), F.lit(0.0)).otherwise(spread))
    return F.when(k > 0, v if f.fn == "sum" else v / k)


def _row_blocks(df: DataFrame, key: str, features: list[LastRows]) -> DataFrame:
    """Row frames over blocks of consecutive rows; the tail of a block is copied into the next."""
    n = max(f.n for f in features)
    size = max(BLOCK_ROWS, 4 * n)
    pos = F.col("__rn") - 1
    block = F.floor(pos / size)
    tail = (pos % size) >= size - (n - 1)
    homes = F.when(tail, F.array(F.struct(block.alias("b"), F.lit(False).alias("copy")),
                                 F.struct((block + 1).alias("b"), F.lit(True).alias("copy")))
                   ).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("copy"))))
    w = W.partitionBy(key, "__h.b").orderBy("__rn")
    out = df.select("*", F.explode(homes).alias("__h")).select("*", *[
        (F.avg if f.fn == "avg" else F.collect_list)(f.col).over(w.rowsBetween(-(f.n - 1), 0)).alias(f.name)
        for f in features])
    return out.where(~F.col("__h.copy")).drop("__h", "__rn", "__one")


# ---------------------------------------------------------------- named operators

def label_us(width_us: int) -> str:
    return f"{width_us // DAY_US}d" if width_us % DAY_US == 0 else f"{width_us // HOUR_US}h"


def time_since_last(df: DataFrame, key: str, cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Minutes since the key's previous transaction, 0 on the first."""
    now = df.withColumn("__now", micros(cols.ts))
    out = over_key(now, key, [Prev("__prev", "__now")], cols, hot_rows=hot_rows, source=df)
    return out.withColumn(f"{key}_TimeSinceLast",
                          F.coalesce((F.col("__now") - F.col("__prev")) / MINUTE_US, F.lit(0.0))).drop("__now", "__prev")


def rolling_count(df: DataFrame, key: str, widths_us: tuple[int, ...] = (6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US),
                  cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Transactions of the key in ``(t - w, t]``."""
    return over_key(df, key, [Rolling(f"{key}_Count_{label_us(w)}", "count", w) for w in widths_us], cols, hot_rows=hot_rows)


def rolling_mean(df: DataFrame, key: str, days: tuple[int, ...] = (1, 7, 30), cols: Columns = DEFAULT,
                 hot_rows: int | None = None) -> DataFrame:
    """Mean amount of the key in ``(t - d days, t]``."""
    feats = [Rolling(f"{key}_Mean_{d}d", "avg", d * DAY_US, cols.amount) for d in days]
    return over_key(df, key, feats, cols, hot_rows=hot_rows)


def guarded_std(c: Column) -> Column:
    return F.coalesce(F.when(c != 0, c), F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def settled(mean: Column, size: Column) -> Column:
    """The mean, or 0 where it is below the rounding error of its own sum (``size``: the sum of absolute values).

    Amounts that cancel leave a rest that depends on the order of the sum; a ratio to it would be noise.
    """
    return F.when(F.abs(mean) < ROUNDING * size, F.lit(0.0)).otherwise(mean)


def drift_features(key: str, value: str, days: tuple[int, ...]) -> list[Rolling]:
    return [Rolling(f"__{fn}_{value}_{d}", fn, d * DAY_US, value) for d in days for fn in ("avg", "std", "size")]


def drift_columns(key: str, value: str, days: tuple[int, ...]) -> list[Column]:
    out = []
    for d in days:
        m, s, v = F.col(f"__avg_{value}_{d}"), F.col(f"__std_{value}_{d}"), F.col(value)
        out += [ratio(v, settled(m, F.col(f"__size_{value}_{d}"))).alias(f"{key}_{value}_RatioToMean_{d}d"),
                ((v - m) / guarded_std(s)).alias(f"{key}_{value}_Z_{d}d")]
    return out


def behavioral_drift(df: DataFrame, key: str, value: str | None = None, days: tuple[int, ...] = (7, 30),
                     cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Value over its rolling mean, and its rolling z-score, for each window."""
    value = value or cols.amount
    out = over_key(df, key, drift_features(key, value, days), cols, hot_rows=hot_rows)
    return out.select(*df.columns, *drift_columns(key, value, days))


def moving_average(df: DataFrame, key: str, n: int = 5, cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Mean of the last ``n`` amounts, long-term mean, and their relative difference."""
    feats = [LastRows(f"{key}_MovingAvg_{n}", "avg", n, cols.amount), KeyStat(f"{key}_LongTermAvg", "avg", cols.amount),
             KeyStat("__size", "size", cols.amount)]
    out = over_key(df, key, feats, cols, hot_rows=hot_rows)
    m, l = F.col(f"{key}_MovingAvg_{n}"), F.col(f"{key}_LongTermAvg")
    return out.withColumn(f"{key}_PctChangeFromAvg", ratio(m - l, settled(l, F.col("__size")))).drop("__size")


def cumulative(df: DataFrame, key: str, cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Running sums of amount and value, and hours since the key's first row."""
    df2 = df.withColumn("__now", micros(cols.ts))
    feats = [Running(f"{key}_CumAmount", cols.amount), Running(f"{key}_CumValue", cols.value), KeyStat("__first", "min", "__now")]
    out = over_key(df2, key, feats, cols, hot_rows=hot_rows, source=df)
    # the running sum of the gaps to the previous row telescopes to the time since the first row
    return out.withColumn(f"{key}_CumHours", (F.col("__now") - F.col("__first")) / HOUR_US).drop("__now", "__first")


def delta_to_last(df: DataFrame, key: str, cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Difference of amount and value to the key's previous row, 0 on the first."""
    out = over_key(df, key, [Prev("__pa", cols.amount), Prev("__pv", cols.value)], cols, hot_rows=hot_rows)
    return out.select(*df.columns,
                      F.coalesce(F.col(cols.amount) - F.col("__pa"), F.lit(0.0)).alias(f"{key}_AmountDelta"),
                      F.coalesce(F.col(cols.value) - F.col("__pv"), F.lit(0.0)).alias(f"{key}_ValueDelta"))


def sessionize(df: DataFrame, key: str, gap_minutes: float = 30, cols: Columns = DEFAULT,
               hot_rows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Session number per key: a new session starts when the gap exceeds ``gap_minutes``."""
    source = df if source is None else source
    now = df.withColumn("__now", micros(cols.ts))
    gaps = over_key(now, key, [Prev("__prev", "__now")], cols, hot_rows=hot_rows, source=source)
    minutes = F.coalesce((F.col("__now") - F.col("__prev")) / MINUTE_US, F.lit(0.0))
    gaps = gaps.withColumn("__start", (minutes > gap_minutes).cast("long"))
    out = over_key(gaps, key, [Running("SessionId", "__start")], cols, hot_rows=hot_rows, source=source)
    return out.select(*df.columns, "SessionId")


def spending_behaviour(df: DataFrame, key: str, days: tuple[int, ...] = (1, 7, 30), cols: Columns = DEFAULT,
                       hot_rows: int | None = None) -> DataFrame:
    """Count and ``sum / (count + 1e-8)`` of the amount in each window."""
    feats = []
    for d in days:
        feats += [Rolling(f"{key}_NB_TX_{d}d", "count", d * DAY_US), Rolling(f"__sum_{d}", "sum", d * DAY_US, cols.amount)]
    out = over_key(df, key, feats, cols, hot_rows=hot_rows)
    return out.select(*df.columns, *[c for d in days for c in (
        F.col(f"{key}_NB_TX_{d}d"),
        (F.coalesce(F.col(f"__sum_{d}"), F.lit(0.0)) / (F.col(f"{key}_NB_TX_{d}d") + 1e-8)).alias(f"{key}_AVG_AMOUNT_{d}d"))])


def delayed_risk(df: DataFrame, key: str, delay_days: int = 7, days: tuple[int, ...] = (1, 7, 30),
                 cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Transactions, frauds and fraud share of the key in ``(t - delay - d, t - delay]``."""
    feats = []
    for d in days:
        feats += [Rolling(f"{key}_NB_TX_{d}d", "count", d * DAY_US, None, delay_days * DAY_US),
                  Rolling(f"__f_{d}", "sum", d * DAY_US, cols.label, delay_days * DAY_US)]
    out = over_key(df, key, feats, cols, hot_rows=hot_rows)
    frauds = lambda d: F.coalesce(F.col(f"__f_{d}"), F.lit(0)).cast("long")
    return out.select(*df.columns, *[c for d in days for c in (
        F.col(f"{key}_NB_TX_{d}d"), frauds(d).alias(f"{key}_NB_FRAUD_{d}d"),
        ratio(frauds(d).cast("double"), F.col(f"{key}_NB_TX_{d}d")).alias(f"{key}_RISK_{d}d"))])


MAX_CATEGORY_VALUES = 200
# Values of a key that are counted beside each other when the category has more values than that.
VALUE_CHUNK = 50


def few_category_values(df: DataFrame, category: str) -> list[str] | None:
    """Sorted distinct values, or None if there are too many for columns."""
    rows = df.select(category).where(F.col(category).isNotNull()).distinct().limit(MAX_CATEGORY_VALUES + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= MAX_CATEGORY_VALUES else None


def category_values(df: DataFrame, category: str) -> list[str]:
    """Distinct values of a low-cardinality category (they become columns, so their number is checked)."""
    values = few_category_values(df, category)
    if values is None:
        raise ValueError(f"{category} has more than {MAX_CATEGORY_VALUES} values")
    return values


def counts_in_frames(df: DataFrame, key: str, value: str, widths_us: tuple[int, ...], cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """``df`` with ``__counts_<window>`` per width: (value, count) of the values that the key's (t - w, t] holds, in the order of the values.

    A frame of an ordinary key is collected, sorted and counted by its runs, which costs what the frame holds; rows of hot keys are counted value by value.
    """
    heavy = heavy_keys(df, [key], hot_rows)
    parts = split_hot(df, [key], heavy)
    names = {w: f"__counts_{label_us(w)}" for w in widths_us}
    by_time = W.partitionBy(key).orderBy("__us")
    # an explicit count keeps the frames spread out even when the rows are small
    cold = parts.cold.repartition(num_partitions(df.sparkSession), key)
    frames = cold.withColumn("__us", micros(cols.ts)).select("*", *[F.collect_list(value).over(by_time.rangeBetween(1 - w, 0)).alias(n) for w, n in names.items()])
    # one step a select: Spark does not fold in what the next one reads more than once
    frames = frames.select(*df.columns, *[F.sort_array(n).alias(n) for n in names.values()])
    first = lambda n: F.array_compact(F.transform(n, lambda x, i: F.when((i == 0) | (x != F.get(n, i - 1)), i)))
    frames = frames.select("*", *[first(n).alias(f"__first{n}") for n in names.values()])
    until = lambda n, j: F.coalesce(F.get(f"__first{n}", j + 1), F.size(n))
    counted = lambda n: F.transform(f"__first{n}", lambda i, j: F.struct(F.get(n, i).alias("value"), (until(n, j) - i).cast("long").alias("count")))
    out = frames.select(*df.columns, *[counted(n).alias(n) for n in names.values()])
    if parts.hot is not None:
        long = _counts_by_value(parts.hot, key, value, widths_us, cols, hot_rows)
        found = long.groupBy(cols.id).agg(*[F.sort_array(F.collect_list(F.when(F.col("Window") == label_us(w), F.struct(F.col("Value").alias("value"), F.col("Count").alias("count")))))
                                            .alias(n) for w, n in names.items()])
        none = F.array().cast(dict(found.dtypes)[names[widths_us[0]]])
        out = out.unionByName(attach(parts.hot, found, cols.id).withColumns({n: F.coalesce(n, none) for n in names.values()}))
    return out


def rolling_category_counts(df: DataFrame, key: str, category: str,
                            widths_us: tuple[int, ...] = (HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US),
                            cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """(id, Window, Value, Count): one row per transaction, window and value that the window holds, for any number of values."""
    d = df.select(cols.id, cols.ts, F.col(key).alias("__key"), F.col(category).alias("__value"))
    found = counts_in_frames(d, "__key", "__value", widths_us, cols, hot_rows)
    item = lambda n: lambda x: F.struct(F.lit(n).alias("Window"), x["value"].alias("Value"), x["count"].alias("Count"))
    items = F.flatten(F.array(*[F.transform(f"__counts_{n}", item(n)) for n in map(label_us, widths_us)]))
    return found.select(cols.id, F.explode(items).alias("__x")).select(cols.id, "__x.*")


def _counts_by_value(df: DataFrame, key: str, category: str, widths_us: tuple[int, ...], cols: Columns, hot_rows: int | None) -> DataFrame:
    """(id, Window, Value, Count) without collecting a frame.

    The values of a key are numbered and dealt in chunks; a row goes once to every chunk of its key, where one rolling sum per value counts.
    """
    d = df.select(cols.id, cols.ts, F.col(key).alias("__key"), F.col(category).alias("__value"))
    # one row per (key, value)
    number = F.row_number().over(W.partitionBy("__key").orderBy("__value")) - 1
    values = d.where("__value IS NOT NULL").select("__key", "__value").distinct().withColumn("__v", number)
    chunks = values.select("__key", F.floor(F.col("__v") / VALUE_CHUNK).alias("__chunk")).distinct()
    d = attach(attach(d, values, ["__key", "__value"]), chunks, "__key", "inner")
    d = d.select("*", F.concat(F.col("__chunk").cast("string"), F.coalesce(F.concat(F.lit("="), F.col("__key").cast("string")), F.lit(""))).alias("__part"),
                 *[(F.col("__v") == F.col("__chunk") * VALUE_CHUNK + i).cast("long").alias(f"__is_{i}") for i in range(VALUE_CHUNK)])
    feats = [Rolling(f"__n_{w}_{i}", "sum", w, f"__is_{i}") for w in widths_us for i in range(VALUE_CHUNK)]
    out = over_key(d, "__part", feats, cols, hot_rows=hot_rows)
    items = F.array(*[F.struct(F.lit(label_us(w)).alias("Window"), (F.col("__chunk") * VALUE_CHUNK + i).alias("__v"),
                               F.coalesce(F.col(f"__n_{w}_{i}"), F.lit(0)).cast("long").alias("Count")) for w in widths_us for i in range(VALUE_CHUNK)])
    long = out.select(cols.id, "__key", F.explode(F.filter(items, lambda x: x["Count"] > 0)).alias("__x")).select(cols.id, "__key", "__x.*")
    return attach(long, values, ["__key", "__v"]).select(cols.id, "Window", F.col("__value").alias("Value"), "Count")


def _many_category_stats(df: DataFrame, key: str, category: str, widths_us: tuple[int, ...], cols: Columns, hot_rows: int | None) -> DataFrame:
    """The same statistics from long counts; the counts per value are a map."""
    feats = [Rolling(f"__n_{w}", "count", w) for w in widths_us]
    out = counts_in_frames(over_key(df, key, feats, cols, hot_rows=hot_rows), key, category, widths_us, cols, hot_rows)
    mode = lambda c: F.array_min(F.transform(c, lambda x: F.struct((-x["count"]).alias("n"), x["value"].alias("v"))))["v"]
    return out.select(*df.columns, *[e for w in widths_us for n in [label_us(w)] for e in (
        F.col(f"__n_{w}").alias(f"{category}_Count_{n}"), F.size(f"__counts_{n}").alias(f"{category}_Distinct_{n}"),
        mode(f"__counts_{n}").alias(f"{category}_Mode_{n}"), F.map_from_entries(f"__counts_{n}").alias(f"{category}_Counts_{n}"))])


def rolling_category_stats(df: DataFrame, key: str, category: str,
                           widths_us: tuple[int, ...] = (HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US),
                           cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Rolling count, distinct count, mode (smallest on ties) and count per value of the key's ``category``.

    One rolling sum per category value gives all four, so nothing is collected inside a frame. With more values than
    ``MAX_CATEGORY_VALUES`` the counts per value are one map column ``<category>_Counts_<window>`` of the values present.
    """
    values = few_category_values(df, category)
    if values is None:
        return _many_category_stats(df, key, category, widths_us, cols, hot_rows)
    flagged = df.select("*", *[(F.col(category) == v).cast("long").alias(f"__is_{i}") for i, v in enumerate(values)])
    feats = [Rolling(f"__n_{w}", "count", w) for w in widths_us]
    feats += [Rolling(f"__n_{w}_{i}", "sum", w, f"__is_{i}") for w in widths_us for i in range(len(values))]
    out = over_key(flagged, key, feats, cols, hot_rows=hot_rows)
    exprs = []
    for w in widths_us:
        n = label_us(w)
        counts = [F.coalesce(F.col(f"__n_{w}_{i}"), F.lit(0)).cast("long") for i in range(len(values))]
        # the first value with the highest count is the smallest one because values are sorted
        best = reduce(lambda a, b: F.greatest(a, b), counts) if len(counts) > 1 else counts[0]
        mode = F.coalesce(*[F.when((c == best) & (best > 0), F.lit(v)) for c, v in zip(counts, values)])
        exprs += [F.col(f"__n_{w}").alias(f"{category}_Count_{n}"),
                  reduce(lambda a, b: a + b, [(c > 0).cast("int") for c in counts]).alias(f"{category}_Distinct_{n}"),
                  mode.alias(f"{category}_Mode_{n}"),
                  *[c.alias(f"{category}_{v}_Count_{n}") for c, v in zip(counts, values)]]
    return out.select(*df.columns, *exprs)


def fraud_cumsum(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Running number of frauds over the whole table in (time, id) order.

    Totals of days and minutes are prefix-summed; the rest runs inside minutes.
    """
    d = df.withColumn("__us", micros(cols.ts)).withColumn("__minute", F.floor(F.col("__us") / MINUTE_US))
    inside = W.partitionBy("__minute").orderBy("__us", cols.id).rowsBetween(W.unboundedPreceding, 0)
    return attach(d, time_offsets(d, "__us", cols.label), "__minute").select(
        *df.columns, (F.col("__off") + F.sum(cols.label).over(inside)).alias("CumFrauds"))


def sequence_windows(df: DataFrame, key: str, features: list[str], seq_len: int = 10, overlap: float = 0.5,
                     cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """Full ordered sequences of ``seq_len`` rows per key, one every ``seq_len * (1 - overlap)`` rows.

    A row is sent to the few sequences that contain it, so a task holds one sequence, never a key.
    """
    step = max(1, int(seq_len * (1 - overlap)))
    one = df.withColumn("__one", F.lit(1))
    numbered = over_key(one, key, [Running("__rn", "__one")], cols, hot_rows=hot_rows)
    pos = F.col("__rn") - 1
    first = F.greatest(F.lit(0), F.ceil((pos - (seq_len - 1)) / step)).cast("long")
    spread = numbered.select(key, pos.alias("pos"), F.struct("__rn", *features).alias("item"),
                             F.explode(F.sequence(first, F.floor(pos / step).cast("long"))).alias("seq"))
    grouped = spread.groupBy(key, "seq").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return grouped.where(F.size("items") == seq_len).select(
        key, F.col("seq").alias("SequenceId"), (F.col("seq") * step).alias("StartRow"),
        *[F.col(f"items.{c}").alias(c) for c in features])


def padded_history(df: DataFrame, key: str, value: str, window: int = 5, pad: float = -1.0,
                   cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """The last ``window`` values of the key, left-padded."""
    out = over_key(df, key, [LastRows("__hist", "list", window, value)], cols, hot_rows=hot_rows)
    fill = F.array_repeat(F.lit(pad), (F.lit(window) - F.size("__hist")).cast("int"))
    return out.select(*df.columns, F.concat(fill, F.col("__hist").cast("array<double>")).alias("History"))
