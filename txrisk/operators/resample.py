"""Rebalancing of the rare class. Sampling applies to training rows only.

Every random choice hashes the row id with a seed, so results do not depend on partitioning. Synthetic rows
carry the feature columns, the label 1 and the ids of the two rows they lie between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.functions.scale import attach, hash_u32, hash_unit, keep, row_positions
from txrisk.operators.neighbors import knn_join, vector
from txrisk.operators.splits import class_sizes, random_undersample
from txrisk.schema import DEFAULT, Columns


def _points(df: DataFrame, features: list[str], cols: Columns) -> DataFrame:
    return df.select(F.col(cols.id).alias("id"), F.col(cols.label).alias("y"), vector(features).alias("vec"))


def _wanted(df: DataFrame, ratio: float, cols: Columns) -> tuple[int, int, int]:
    """(new rows, positives, negatives) so that positives reach ``ratio`` of negatives."""
    pos, neg = class_sizes(df, cols)
    return max(0, round(ratio * neg) - pos), pos, neg


def near_miss(df: DataFrame, features: list[str], ratio: float = 0.1, k: int = 3, version: int = 1,
              cols: Columns = DEFAULT) -> DataFrame:
    """All positives and the negatives closest on average to their k nearest positives."""
    if version != 1:
        raise ValueError("only version 1 is supported")
    pts = _points(df, features, cols)
    pos, neg = class_sizes(df, cols)
    nn = knn_join(pts.where("y = 0"), pts.where("y = 1"), k, "id", "id")
    # rounded, so that equal averages tie and the id decides
    mean = nn.groupBy(F.col("qid").alias(cols.id)).agg(F.round(F.avg("distance"), 9).alias("__md"))
    kept = row_positions(mean, "__md", cols.id, "__pos").where(F.col("__pos") < int(pos / ratio)).select(cols.id)
    return df.where(F.col(cols.label) == 1).unionByName(df.where(F.col(cols.label) == 0).join(kept, cols.id, "left_semi"))


def _shares(base: DataFrame, n_new: int, n_base: int) -> DataFrame:
    """Equal shares of ``n_new`` over base points; the rest goes to the first ones in hash order."""
    ranked = row_positions(base.withColumn("__h", hash_u32("id", "base")), "__h", "id", "__pos")
    share = F.lit(n_new // n_base) + (F.col("__pos") < n_new % n_base).cast("int")
    return ranked.withColumn("copies", share).drop("__h", "__pos")


def _interpolate(base: DataFrame, neighbours: DataFrame, refs: DataFrame, k: int, seed: int, step: Column | None = None) -> DataFrame:
    """Points ``x + step * lambda * (n - x)`` for each copy of a base point; n is one of its neighbours."""
    step = F.lit(1.0) if step is None else step
    base = base.withColumn("step", step)
    copies = base.where("copies > 0").select("id", "vec", "step", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("j"))
    tag = F.concat_ws("#", F.col("id").cast("string"), F.col("j").cast("string"))
    found = neighbours.groupBy("qid").agg(F.max("rank").alias("m"))
    # a point without neighbours is its own: its synthetic rows are copies
    copies = attach(copies.withColumnRenamed("id", "qid"), found, "qid").withColumnRenamed("qid", "id")
    alone = copies.where("m IS NULL").select(F.col("id").alias("base_id"), F.col("id").alias("neighbour_id"), "j", F.lit(0.0).alias("lam"), "vec")
    copies = copies.where("m IS NOT NULL")
    copies = copies.withColumn("rank", (F.pmod(hash_u32(tag, f"{seed}n"), F.col("m")) + 1).cast("int"))
    copies = copies.withColumn("lam", hash_unit(tag, f"{seed}l"))
    pick = neighbours.select(F.col("qid").alias("id"), "rank", "neighbour")
    joined = copies.join(pick, ["id", "rank"]).join(
        refs.select(F.col("id").alias("neighbour"), F.col("vec").alias("nvec")), "neighbour")
    scale = F.col("lam") * F.col("step")
    return joined.select(F.col("id").alias("base_id"), F.col("neighbour").alias("neighbour_id"), "j", "lam",
                         F.zip_with("vec", "nvec", lambda a, b: a + scale * (b - a)).alias("vec")).unionByName(alone)


def _rows(points: DataFrame, features: list[str], cols: Columns) -> DataFrame:
    return points.select("base_id", "neighbour_id", "j", "lam", *[F.col("vec")[i].alias(c) for i, c in enumerate(features)],
                         F.lit(1).alias(cols.label))


def smote_rows(df: DataFrame, features: list[str], ratio: float, k: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """Only the synthetic rows: on segments between a positive and one of its k nearest positives."""
    n_new, n_pos, _ = _wanted(df, ratio, cols)
    pos = _points(df, features, cols).where("y = 1")
    nn = knn_join(pos, pos, k, "id", "id", exclude_self=True)
    return _rows(_interpolate(_shares(pos, n_new, n_pos), nn, pos, k, seed), features, cols)


def with_synthetic(df: DataFrame, synthetic: DataFrame, features: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """Original rows (id, features, label) and synthetic ones, whose id is ``syn-<base>-<j>``."""
    real = df.select(F.col(cols.id).cast("string").alias(cols.id), *[F.col(c).cast("double").alias(c) for c in features],
                     F.col(cols.label).cast("int").alias(cols.label))
    fake = synthetic.select(F.concat_ws("-", F.lit("syn"), F.col("base_id").cast("string"), F.col("j").cast("string")).alias(cols.id),
                            *features, F.col(cols.label).cast("int").alias(cols.label))
    return real.unionByName(fake)


def smote(df: DataFrame, features: list[str], ratio: float, k: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    return with_synthetic(df, smote_rows(df, features, ratio, k, seed, cols), features, cols)


def _danger(df: DataFrame, features: list[str], m: int, cols: Columns) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, positives, (id, negatives among the m nearest rows, neighbours found))."""
    pts = _points(df, features, cols)
    pos = pts.where("y = 1")
    nn = knn_join(pos, pts, m, "id", "id", exclude_self=True)
    labelled = nn.join(pts.select(F.col("id").alias("neighbour"), F.col("y").alias("ny")), "neighbour")
    count = labelled.groupBy(F.col("qid").alias("id")).agg(F.sum((F.col("ny") == 0).cast("int")).alias("n_neg"), F.count("*").alias("m"))
    return pts, pos, keep(count)


def adasyn_rows(df: DataFrame, features: list[str], ratio: float, k: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """As SMOTE, with shares proportional to the part of negatives among the k nearest rows."""
    n_new, _, _ = _wanted(df, ratio, cols)
    _, pos, count = _danger(df, features, k, cols)
    hard = count.withColumn("r", F.col("n_neg") / F.col("m"))
    total = hard.agg(F.sum("r")).first()[0]
    if not total:
        raise ValueError("no positive has a negative neighbour")
    base = attach(pos, hard.select("id", F.rint(F.col("r") / total * n_new).cast("int").alias("copies")), "id")
    nn = knn_join(pos, pos, k, "id", "id", exclude_self=True)
    return _rows(_interpolate(base, nn, pos, k, seed), features, cols)


def borderline_smote_rows(df: DataFrame, features: list[str], ratio: float, k: int = 5, m: int = 10, kind: int = 1,
                          seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """SMOTE from positives with at least half but not all negatives among the m nearest rows.

    Kind 2 lets about half of the copies point to negatives, at no more than half the way.
    """
    n_new, _, _ = _wanted(df, ratio, cols)
    pts, pos, count = _danger(df, features, m, cols)
    danger = pos.join(count.where("n_neg * 2 >= m AND n_neg < m").select("id"), "id", "left_semi")
    danger = keep(danger)
    n = danger.count()
    if n == 0:
        raise ValueError("no borderline positives")
    if kind == 1:
        nn = knn_join(danger, pos, k, "id", "id", exclude_self=True)
        return _rows(_interpolate(_shares(danger, n_new, n), nn, pos, k, seed), features, cols)
    half = n_new // 2
    nn_pos = knn_join(danger, pos, k, "id", "id", exclude_self=True)
    nn_neg = knn_join(danger, pts.where("y = 0"), k, "id", "id")
    a = _interpolate(_shares(danger, n_new - half, n), nn_pos, pos, k, seed)
    b = _interpolate(_shares(danger, half, n), nn_neg, pts, k, seed + 1, F.lit(0.5))
    return _rows(a.unionByName(b.withColumn("j", F.col("j") + 1_000_000)), features, cols)


def kmeans_smote_rows(df: DataFrame, features: list[str], ratio: float, k: int = 5, n_clusters: int = 8,
                      balance: float | None = None, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """SMOTE inside clusters whose share of positives reaches ``balance`` (default: the table's share)."""
    n_new, n_pos, n_neg = _wanted(df, ratio, cols)
    pts = _points(df, features, cols).withColumn("features", array_to_vector("vec"))
    model = KMeans(k=n_clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(pts)
    pts = keep(model.transform(pts).drop("features"))
    share = balance if balance is not None else n_pos / (n_pos + n_neg)
    stats = pts.groupBy("cluster").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()   # one row per cluster
    good = {r["cluster"]: r["p"] for r in stats if r["p"] > 1 and r["p"] / r["n"] >= share}
    if not good:
        raise ValueError("no cluster has enough positives")
    out = None
    total = sum(good.values())
    for c, p in sorted(good.items()):
        part = pts.where((F.col("y") == 1) & (F.col("cluster") == c)).drop("cluster")
        nn = knn_join(part, part, min(k, p - 1), "id", "id", exclude_self=True)
        rows = _interpolate(_shares(part, round(n_new * p / total), p), nn, part, k, seed)
        out = rows if out is None else out.unionByName(rows)
    return _rows(out, features, cols)


def svm_smote_rows(df: DataFrame, features: list[str], ratio: float, k: int = 5, m: int = 10, out_step: float = 0.5,
                   seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """SMOTE from positives inside the margin of a balanced linear SVM.

    Positives among mostly negative rows move towards other positives; safe ones move away by ``out_step``.
    """
    n_new, n_pos, n_neg = _wanted(df, ratio, cols)
    pts, pos, count = _danger(df, features, m, cols)
    train = pts.withColumn("features", array_to_vector("vec")).withColumn(
        "w", F.when(F.col("y") == 1, n_neg / n_pos).otherwise(1.0)).withColumn("y", F.col("y").cast("double"))
    svm = LinearSVC(featuresCol="features", labelCol="y", weightCol="w", maxIter=30, regParam=0.01).fit(train)
    raw = svm.transform(pos.withColumn("features", array_to_vector("vec"))).withColumn("s", vector_to_array("rawPrediction")[1])
    support = attach(raw.where("s <= 1").select("id", "y", "vec"), count, "id").where("n_neg < m")   # all-negative: noise
    support = keep(support)
    n = support.count()
    if n == 0:
        raise ValueError("no positive lies inside the margin")
    nn = knn_join(support, pos, k, "id", "id", exclude_self=True)
    step = F.when(F.col("n_neg") * 2 >= F.col("m"), 1.0).otherwise(-out_step)
    return _rows(_interpolate(_shares(support, n_new, n), nn, pos, k, seed, step), features, cols)


def edited_nearest_neighbours(df: DataFrame, features: list[str], k: int = 5, cols: Columns = DEFAULT) -> DataFrame:
    """Drop negatives whose k nearest rows are not all negatives."""
    pts = _points(df, features, cols)
    nn = knn_join(pts.where("y = 0"), pts, k, "id", "id", exclude_self=True)
    labelled = nn.join(pts.select(F.col("id").alias("neighbour"), F.col("y").alias("ny")), "neighbour")
    bad = labelled.where("ny = 1").select(F.col("qid").alias(cols.id)).distinct()
    return df.join(bad, cols.id, "left_anti")


def tomek_links(df: DataFrame, features: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """(negative, positive) pairs that are each other's nearest row."""
    pts = _points(df, features, cols)
    nn = knn_join(pts, pts, 1, "id", "id", exclude_self=True).select("qid", "neighbour")
    y = pts.select("id", "y")
    a = nn.join(y.withColumnRenamed("id", "qid").withColumnRenamed("y", "qy"), "qid")
    back = nn.select(F.col("qid").alias("neighbour"), F.col("neighbour").alias("qid"))
    mutual = a.join(back, ["qid", "neighbour"])
    mutual = mutual.join(y.withColumnRenamed("id", "neighbour").withColumnRenamed("y", "ny"), "neighbour")
    return mutual.where("qy = 0 AND ny = 1").select(F.col("qid").alias("negative"), F.col("neighbour").alias("positive"))


def remove_tomek_links(df: DataFrame, features: list[str], cols: Columns = DEFAULT) -> DataFrame:
    links = tomek_links(df, features, cols).select(F.col("negative").alias(cols.id))
    return df.join(links, cols.id, "left_anti")


def smote_enn(df: DataFrame, features: list[str], ratio: float, k: int = 5, enn_k: int = 5, seed: int = 0,
              cols: Columns = DEFAULT) -> DataFrame:
    return edited_nearest_neighbours(keep(smote(df, features, ratio, k, seed, cols)), features, enn_k, cols)


def smote_tomek(df: DataFrame, features: list[str], ratio: float, k: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    return remove_tomek_links(keep(smote(df, features, ratio, k, seed, cols)), features, cols)


SAMPLERS: dict[str, Callable[..., DataFrame]] = {
    "undersample": lambda df, features, ratio, cols=DEFAULT, **p: random_undersample(df, ratio, cols=cols, **p),
    "nearmiss": near_miss,
    "smote": smote,
    "adasyn": lambda df, f, ratio, cols=DEFAULT, **p: with_synthetic(df, adasyn_rows(df, f, ratio, cols=cols, **p), f, cols),
    "borderline": lambda df, f, ratio, cols=DEFAULT, **p: with_synthetic(df, borderline_smote_rows(df, f, ratio, cols=cols, **p), f, cols),
    "kmeans": lambda df, f, ratio, cols=DEFAULT, **p: with_synthetic(df, kmeans_smote_rows(df, f, ratio, cols=cols, **p), f, cols),
    "svm": lambda df, f, ratio, cols=DEFAULT, **p: with_synthetic(df, svm_smote_rows(df, f, ratio, cols=cols, **p), f, cols),
    "smoteenn": smote_enn,
    "smotetomek": smote_tomek,
}


def sampler_chain(df: DataFrame, features: list[str], steps: list[tuple[str, dict]], cols: Columns = DEFAULT) -> DataFrame:
    """Apply several samplers in order, e.g. ``[("smote", {"ratio": 0.01}), ("undersample", {"ratio": 0.1})]``."""
    for name, params in steps:
        if name not in SAMPLERS:
            raise ValueError(f"unknown sampler {name}; known are {sorted(SAMPLERS)}")
        df = SAMPLERS[name](df, features, cols=cols, **params)
    return df
