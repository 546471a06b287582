"""Building blocks that keep grouped work balanced when one key or value dominates the data."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from functools import reduce
from math import isfinite

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# A key with more rows than this is processed in slices instead of one window group.
HOT_ROWS = 50_000
# Largest hot-key list that is broadcast; beyond it the split is an ordinary shuffle join.
MAX_BROADCAST_KEYS = 10_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(df: DataFrame, stats: DataFrame, keys: str | list[str], how: str = "left") -> DataFrame:
    """Join per-group columns back to rows.

    No hint is given: the statistics are broadcast when Spark measures them below its threshold,
    otherwise a sort-merge join runs, whose oversized row partitions AQE splits.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    right = stats.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                         *[c for c in stats.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"__k{i}"]) for i, k in enumerate(keys)])
    return df.join(right, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


@dataclass
class HotSplit:
    """Rows of ordinary keys and rows of hot keys (``hot`` is None when there are none)."""

    cold: DataFrame
    hot: DataFrame | None


def heavy_keys(df: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame | None:
    """Keys that own more than ``max_rows`` rows, or None when there are none.

    One narrow aggregate (combined map-side) finds them. At most ``MAX_BROADCAST_KEYS`` keys are held on the
    driver and broadcast; a longer list stays a DataFrame and is shuffle-joined.
    """
    limit = HOT_ROWS if max_rows is None else max_rows
    heavy = df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)
    rows = heavy.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not rows:
        return None
    if len(rows) <= MAX_BROADCAST_KEYS:
        return F.broadcast(df.sparkSession.createDataFrame(rows, heavy.schema))
    return heavy


def split_hot(df: DataFrame, keys: list[str], heavy: DataFrame | None) -> HotSplit:
    """Separate the rows of the ``heavy`` keys from the others."""
    if heavy is None:
        return HotSplit(df, None)
    heavy = heavy.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(heavy[f"__h{i}"]) for i, k in enumerate(keys)])
    return HotSplit(df.join(heavy, cond, "left_anti"), df.join(heavy, cond, "left_semi"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where it is unset and the session is local (tests) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="txrisk-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that an iterative algorithm reads many times."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def hash_unit(id_col: str | Column, seed: int | str) -> Column:
    """Reproducible pseudo-random number in [0, 1) from the row id and a seed."""
    return hash_u32(id_col, seed) / F.lit(4294967296.0)


def hash_u32(id_col: str | Column, seed: int | str) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _buckets(df: DataFrame, cols: list[str], n: int | None) -> DataFrame:
    """Add ``__b_<col>``: the index of an approximate-quantile bucket, monotone in the value.

    By default there are twice as many buckets as shuffle partitions, so they spread over the cluster.
    """
    n = n or max(16, 2 * num_partitions(df.sparkSession))
    probs = [i / n for i in range(1, n)]
    # the sketch keeps a bounded summary per column; only n boundaries reach the driver
    bounds = df.approxQuantile(cols, probs, 1.0 / (4 * n))
    # a column without finite values still has two buckets
    splits = [[float("-inf"), *(sorted({float(x) for x in b if isfinite(x)}) or [0.0]), float("inf")] for b in bounds]
    outs = [f"__b_{c}" for c in cols]
    return Bucketizer(inputCols=cols, outputCols=outs, splitsArray=splits).setHandleInvalid("keep").transform(df)


def prefix_sums(df: DataFrame, value: str, sums: list[str], descending: bool = False,
                groups: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sums`` in the order of ``value`` over the whole table.

    The order is global, yet no task sees the whole table: rows fall into value buckets, bucket
    totals (at most ``n_buckets`` per group) are prefix-summed, and the rest runs inside buckets.
    Rows with equal ``value`` are peers, so pre-aggregate by value before calling. ``groups`` must
    have few distinct values. Adds ``cum_<name>`` columns.
    """
    groups = groups or []
    tagged = _buckets(df.withColumn("__v", F.col(value).cast("double")), ["__v"], n_buckets)
    sign = -1 if descending else 1
    tagged = tagged.withColumn("__o", sign * F.col("__b___v"))
    totals = tagged.groupBy(*groups, "__o").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = W.partitionBy(*groups).orderBy("__o").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*groups, "__o", *[
        F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums])
    order = F.col("__v").desc() if descending else F.col("__v").asc()
    inside = W.partitionBy(*groups, "__o").orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    out = attach(tagged, offsets, [*groups, "__o"])
    out = out.select("*", *[(F.col(f"__off_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums])
    return out.drop("__v", "__b___v", "__o", *[f"__off_{s}" for s in sums])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    groups: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Exact interpolated quantiles: one row per (group, column, q) with its ``value``.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer. Here rows are counted per value bucket
    first (combined map-side), which tells the buckets that hold the wanted ranks; only values of those buckets are
    shuffled and ranked. Nulls are ignored. ``groups`` must have few distinct values.
    """
    groups = groups or []
    by = [*groups, "column"]
    base = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in cols])
    tagged = _buckets(base, cols, n_buckets)
    long = tagged.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__b_{c}").alias("b"), F.col(c).alias("v")) for c in cols
    ])).alias("x")).select(*groups, "x.*").where("v IS NOT NULL AND NOT isnan(v)")
    w = W.partitionBy(*by)
    counts = long.groupBy(*by, "b").agg(F.count("*").alias("n")).select(
        *by, "b", (F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("off"), "n", F.sum("n").over(w).alias("total"))
    wanted = counts.select(*by, "b", "off", "n", "total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    rank = F.col("q") * (F.col("total") - 1)
    # 0-based ranks off .. off + n - 1 lie in the bucket
    holds = lambda r: (F.col("off") <= r) & (r < F.col("off") + F.col("n"))
    low, high = F.floor(rank), F.ceil(rank)
    wanted = wanted.select(*by, "b", "off", "q", *[F.when(holds(r), r - F.col("off")).alias(n) for n, r in (("low", low), ("high", high))],
                           (rank - low).alias("f")).where("low IS NOT NULL OR high IS NOT NULL")
    # at most two buckets per quantile, column and group
    edge = F.broadcast(wanted.select(*by, "b").distinct())
    named = edge.select(*[F.col(c).alias(f"__e_{c}") for c in (*by, "b")])
    match = reduce(lambda x, y: x & y, [long[c].eqNullSafe(named[f"__e_{c}"]) for c in (*by, "b")])
    counted = long.join(named, match, "left_semi").groupBy(*by, "b", "v").agg(F.count("*").alias("n"))
    until = F.sum("n").over(W.partitionBy(*by, "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.select(*by, "b", "v", "n", until.alias("until"))
    keys = wanted.select(*[F.col(c).alias(f"__e_{c}") for c in (*by, "b")], "q", "low", "high", "f")
    match = reduce(lambda x, y: x & y, [ranked[c].eqNullSafe(keys[f"__e_{c}"]) for c in (*by, "b")])
    at = lambda r: (F.col("until") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("until"))
    return (ranked.join(F.broadcast(keys), match).groupBy(*by, "q")
            .agg(F.max(F.when(at("low"), F.col("v"))).alias("a"), F.max(F.when(at("high"), F.col("v"))).alias("z"), F.max("f").alias("f"))
            .select(*by, "q", (F.col("a") + (F.col("z") - F.col("a")) * F.col("f")).alias("value")))


def exact_quantile_row(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Driver-side dictionary of ``exact_quantiles`` (columns x probabilities numbers)."""
    got = {(r["column"], r["q"]): r["value"] for r in exact_quantiles(df, cols, probs).collect()}
    return {c: [got.get((c, float(p))) for p in probs] for c in cols}


def top_share_cut(df: DataFrame, score: str, share: float) -> float:
    """The exact ``1 - share`` quantile of a score column."""
    return exact_quantile_row(df, [score], [1.0 - share])[score][0]


def row_positions(df: DataFrame, ts_us: str, tie: str, name: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """0-based position of every row in (time, id) order without a single-partition window."""
    tagged = _buckets(df.withColumn("__v", F.col(ts_us).cast("double")), ["__v"], n_buckets)
    totals = tagged.groupBy("__b___v").agg(F.count("*").alias("__n"))
    before = W.orderBy("__b___v").rowsBetween(W.unboundedPreceding, -1)   # at most n_buckets rows
    offsets = totals.select("__b___v", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy("__b___v").orderBy(ts_us, tie)
    out = attach(tagged, offsets, "__b___v")
    return (out.withColumn(name, F.col("__off") + F.row_number().over(inside) - 1)
            .drop("__v", "__b___v", "__off"))


def time_offsets(df: DataFrame, us: str, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, __day, __minute, __off): what ``value`` sums to before each minute that has rows.

    Days and the minutes inside a day are summed apart, so that no window holds more than the days of the period or 1,440 minutes.
    """
    groups = groups or []
    day, minute = (F.floor(F.col(us) / n) for n in (86_400_000_000, 60_000_000))
    minutes = df.groupBy(*groups, day.alias("__day"), minute.alias("__minute")).agg(F.sum(value).alias("__n"))
    inside = W.partitionBy(*groups, "__day").orderBy("__minute").rowsBetween(W.unboundedPreceding, -1)
    days = minutes.groupBy(*groups, "__day").agg(F.sum("__n").alias("__n"))
    before = W.partitionBy(*groups).orderBy("__day").rowsBetween(W.unboundedPreceding, -1)
    days = days.select(*groups, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    minutes = minutes.select(*groups, "__day", "__minute", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__inside"))
    return attach(minutes, days, [*groups, "__day"]).select(*groups, "__minute", (F.col("__before") + F.col("__inside")).alias("__off"))


def num_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cpu_threads() -> int:
    """How many model fits the driver submits at once."""
    return int(os.environ.get("TXRISK_FIT_THREADS", "4"))
