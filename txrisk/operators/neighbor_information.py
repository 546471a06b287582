"""Mutual information of a continuous feature and a class label from nearest-neighbour distances, without bins.

For every row the distance to its k-th neighbour of the same class is compared with the number of rows of all classes that lie nearer. Equal values are counted first; values fall into buckets, a bucket
borrows the k values next to it of each side, and counts below a bound are bucket totals plus a running sum inside a bucket. Everything stays in DataFrame functions, nothing compares rows with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, checkpoint, num_partitions


def digamma(x: Column) -> Column:
    """Digamma of a positive whole number, to about 1e-13: ten steps of the recurrence, then the asymptotic series."""
    y = x.cast("double") + 10
    q = 1 / (y * y)
    out = F.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240)))
    for i in range(10):
        out = out - 1 / (x.cast("double") + i)
    return out


def _bucketed(df: DataFrame, cuts: DataFrame, value: str, steps: list[int]) -> DataFrame:
    """Add ``b``: how many cuts of the row's feature are at most the value (binary search, largest step first)."""
    joined = df.join(F.broadcast(cuts), "feature")   # features x buckets numbers
    halve = lambda at, step: F.when(F.get("cuts", at + step - 1) <= F.col(value), at + step).otherwise(at)
    return joined.withColumn("b", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)).drop("cuts")


def neighbor_information(df: DataFrame, features: list[str], label: str, k: int = 3, discrete: list[str] = (), n_buckets: int | None = None) -> DataFrame:
    """(feature, mi): nearest-neighbour estimate for continuous features, contingency estimate for ``discrete`` ones; never below 0.

    Null labels and null or non-finite values are left out feature by feature, and so are classes of a single row. A class of at most k rows uses its size less one for k. Ties are taken as they are: a row
    with k equal rows in its class has radius 0 and counts all rows of its value. A feature without usable rows has 0.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    found = []
    if discrete:
        from txrisk.operators.selection import information
        found.append(information(df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("b")) for c in discrete])).alias("x")).select("y", "x.*").where("b IS NOT NULL")))
    cont = [c for c in features if c not in discrete]
    if cont:
        found.append(_continuous(df, cont, label, k, n_buckets))
    scores = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    names = spark.createDataFrame([(c,) for c in features], "feature string")
    return attach(names, scores, "feature").select("feature", F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))


def _continuous(df: DataFrame, features: list[str], label: str, k: int, n_buckets: int | None) -> DataFrame:
    spark = df.sparkSession
    wide = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(features)])
    cells = checkpoint(wide.select("y", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("v")) for i, c in enumerate(features)])).alias("x"))
                       .select("y", "x.*").where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
                       .groupBy("feature", "y", (F.col("v") + 0.0).alias("v")).agg(F.count("*").alias("c")))
    sizes = cells.groupBy("feature", "y").agg(F.sum("c").alias("size")).where("size > 1")
    totals = sizes.groupBy("feature").agg(F.sum("size").alias("total"))
    n = n_buckets or max(16, 2 * num_partitions(spark))
    # sketches: n cuts per feature reach the driver
    got = wide.approxQuantile([f"v{i}" for i in range(len(features))], [i / n for i in range(1, n)], 1.0 / (4 * n))
    cuts = spark.createDataFrame([(c, sorted({float(x) for x in b})) for c, b in zip(features, got)], "feature string, cuts array<double>")
    steps = [1 << i for i in reversed(range(n.bit_length()))]

    rows = _bucketed(attach(cells, sizes, ["feature", "y"], "inner"), cuts, "v", steps)
    rows = rows.select("feature", "y", "b", "v", "c", "size", F.least(F.lit(k), F.col("size") - 1).alias("k"))
    points = _radii(rows, k)
    counted = _within(rows, points, cuts, steps)
    each = digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.greatest("m", F.lit(1)))
    return (attach(counted.groupBy("feature").agg(F.sum(F.col("c") * each).alias("s")), totals, "feature")
            .select("feature", (digamma(F.col("total")) + F.col("s") / F.col("total")).alias("mi")))


def _radii(rows: DataFrame, k: int) -> DataFrame:
    """Add ``r``: distance to the k-th neighbour of the same class."""
    inside = W.partitionBy("feature", "y", "b")
    item = F.struct("v", "c")
    first, last = (F.row_number().over(inside.orderBy(o)) for o in (F.col("v"), F.col("v").desc()))
    edge = (rows.select("feature", "y", "b", item.alias("x"), first.alias("i"), last.alias("j")).where((F.col("i") <= k) | (F.col("j") <= k))
            .groupBy("feature", "y", "b").agg(F.collect_list(F.when(F.col("i") <= k, F.col("x"))).alias("low"), F.collect_list(F.when(F.col("j") <= k, F.col("x"))).alias("high")))
    # every bucket of this table holds a value, so k buckets of a side hold the k values needed
    by = W.partitionBy("feature", "y").orderBy("b")
    beside = F.flatten(F.concat(F.collect_list("high").over(by.rowsBetween(-k, -1)), F.collect_list("low").over(by.rowsBetween(1, k))))
    halo = edge.select("feature", "y", "b", beside.alias("x")).select("feature", "y", "b", F.explode("x").alias("x")).select("feature", "y", "b", "x.v", "x.c")
    both = rows.withColumn("own", F.lit(True)).unionByName(halo.withColumn("own", F.lit(False)), allowMissingColumns=True)
    line = inside.orderBy("v")
    around = F.concat(F.collect_list(item).over(line.rowsBetween(-k, -1)), F.collect_list(item).over(line.rowsBetween(1, k)))
    near = both.withColumn("near", around).where("own").withColumn("near", F.array_sort(F.transform("near", lambda x: F.struct(F.abs(x["v"] - F.col("v")).alias("d"), x["c"].alias("c")))))
    # equal rows come first, at distance 0
    start = F.struct((F.col("c") - 1).alias("seen"), F.lit(0.0).alias("r"))
    step = lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.when(a["seen"] >= F.col("k"), a["r"]).otherwise(x["d"]).alias("r"))
    return near.select("feature", "y", "v", "c", "size", "k", F.aggregate("near", start, step)["r"].alias("r"))


def _within(rows: DataFrame, points: DataFrame, cuts: DataFrame, steps: list[int]) -> DataFrame:
    """Add ``m``: rows strictly between v - r and v + r, or of value v where r is 0."""
    tie = F.col("r") == 0
    # kind 0 counts the values below the bound, kind 2 those up to it; data rows (kind 1) lie between
    ask = points.select("feature", "y", "v", "c", "size", "k", F.explode(F.array(
        F.struct((F.col("v") + F.col("r")).alias("q"), F.when(tie, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign")),
        F.struct((F.col("v") - F.col("r")).alias("q"), F.when(tie, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")))).alias("x")).select("*", "x.*").drop("x")
    ask = _bucketed(ask, cuts, "q", steps).withColumn("here", F.lit(0).cast("long"))
    data = rows.groupBy("feature", "b", F.col("v").alias("q")).agg(F.sum("c").alias("here")).withColumn("kind", F.lit(1))
    events = ask.unionByName(data, allowMissingColumns=True)
    totals = events.groupBy("feature", "b").agg(F.sum("here").alias("t"))
    before = W.partitionBy("feature").orderBy("b").rowsBetween(W.unboundedPreceding, -1)   # a row per bucket
    offsets = totals.select("feature", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"))
    inside = W.partitionBy("feature", "b").orderBy("q", "kind").rowsBetween(W.unboundedPreceding, 0)
    placed = attach(events.withColumn("upto", F.sum("here").over(inside)).where("kind <> 1"), offsets, ["feature", "b"])
    return placed.groupBy("feature", "y", "v").agg(F.max("c").alias("c"), F.max("size").alias("size"), F.max("k").alias("k"),
                                                  F.sum(F.col("sign") * (F.col("off") + F.col("upto"))).alias("m"))
