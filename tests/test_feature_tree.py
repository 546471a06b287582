"""Clustering features: conserved sums, bounded leaves, radius, order of arrival, clusters of planted groups."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txrisk.operators import models as M
from txrisk.operators.feature_tree import FeatureTree, Leaves, leaf_table, ward


def blobs(n=3000, p=3, k=4, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    which = rng.integers(0, k, n)
    return which, np.eye(k, p)[which] * 20 + 1000.0 + rng.normal(size=(n, p)) * spread


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(8)


def leaves_of(rows):
    return np.array([r.n for r in rows]), np.array([r.mean for r in rows]), np.array([r.spread for r in rows])


@pytest.mark.parametrize("limit", [1000, 20, 2, 1])
def test_leaves_keep_all_rows(spark, limit):
    _, x = blobs()
    rows = leaf_table(table(spark, x), F.col("v"), 0.5, limit).collect()
    n, mean, spread = leaves_of(rows)
    assert 0 < len(rows) <= limit and n.sum() == len(x)
    assert np.allclose(n @ mean / n.sum(), x.mean(0), rtol=0, atol=1e-9)
    total = spread.sum() + n @ ((mean - x.mean(0)) ** 2).sum(1)
    assert np.isclose(total, ((x - x.mean(0)) ** 2).sum(), rtol=1e-9)
    reached = max(r.threshold for r in rows)
    assert (np.sqrt(spread / n) <= reached + 1e-9).all()
    assert reached == 0.5 or limit < 1000


@pytest.mark.parametrize("seed", range(4))
def test_any_order_and_any_split_keep_sums_and_radius(seed):
    _, x = blobs(2000, seed=seed)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    parts = []
    for piece in np.array_split(x, rng.integers(1, 6)):
        one = Leaves(0.4, 300)
        one.add(np.ones(len(piece), np.int64), piece, np.zeros(len(piece)))
        parts.append(one)
    merged = Leaves(max(np.sqrt(p.t2) for p in parts), 300)
    for p in parts:
        merged.add(p.n, p.mean, p.spread)
    assert merged.n.sum() == len(x) and np.allclose(merged.n @ merged.mean / len(x), x.mean(0))
    assert (merged.spread / merged.n <= merged.t2 + 1e-9).all()
    # a row is never much farther from its nearest leaf than leaves may reach
    gap = np.sqrt(((x[:, None] - merged.mean) ** 2).sum(2)).min(1)
    assert gap.mean() <= np.sqrt(merged.t2)


def test_clusters_of_planted_groups_and_reruns(spark):
    which, x = blobs()
    df = table(spark, x).select("id", array_to_vector("v").alias("features"))
    model = FeatureTree(4).fit(df)
    got = {r.id: r.cluster for r in model.transform(df).collect()}
    label = np.array([got[i] for i in range(len(x))])
    assert len(set(zip(which, label))) == 4 and set(label) == {0, 1, 2, 3}
    assert (np.bincount(label) == model.sizes).all() and (np.diff(model.sizes) <= 0).all()
    again = FeatureTree(4).fit(df.repartition(3))
    assert (again.leaves == model.leaves).all() and (again.labels == model.labels).all()


def test_ward_matches_plain_search():
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(25, 2)), rng.integers(1, 9, 25).astype(float)
    groups = [[i] for i in range(25)]

    def error(g):
        m = np.average(x[g], axis=0, weights=w[g])
        return (w[g] * ((x[g] - m) ** 2).sum(1)).sum()

    while len(groups) > 4:
        _, a, b = min((error(g + h) - error(g) - error(h), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    owner = ward(x, w, 4)
    assert {frozenset(np.flatnonzero(owner == o)) for o in np.unique(owner)} == {frozenset(g) for g in groups}


def test_hot_vector_nulls_and_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(500)] + [(500 + i, [float(i), -0.0]) for i in range(20)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan"), 1.0]), (903, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = leaf_table(df, F.col("v"), 0.0).collect()
    assert sum(r.n for r in got) == 520 and len(got) == 21
    assert leaf_table(df.limit(0), F.col("v")).count() == 0
    vec = df.select("id", F.when(F.col("id") != 901, array_to_vector(F.when(F.col("id") != 901, F.col("v")))).alias("features")).where("id != 901 AND id != 900")
    out = {r.id: r.cluster for r in FeatureTree(2).fit(vec).transform(vec).collect()}
    assert out[902] is None and out[903] is None and out[0] is not None
    empty = vec.limit(0)
    assert FeatureTree(2).fit(empty).transform(vec).where("cluster IS NOT NULL").count() == 0
    # fewer places than clusters
    one = vec.where("id < 500")
    assert {r.cluster for r in FeatureTree(3).fit(one).transform(one).collect()} == {0}


def test_clients_and_clusterwise_classifier(spark):
    which, x = blobs(600)
    rows = [(i, f"c{i}", *map(float, r), int(c == 0 or r[1] > 1010 and r[2] > 1000)) for i, (c, r) in enumerate(zip(which, x))]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, k string, a double, b double, c double, TX_FRAUD int")
    got = M.client_clusters(df, "k", ["a", "b", "c"], (), 4, "tree").toPandas()
    label = got.set_index("k").CustomerCluster.loc[[f"c{i}" for i in range(600)]].to_numpy()
    assert len(set(zip(which, label))) == 4
    z = M.assemble(df, ["a", "b", "c"])
    out = M.ClusterwiseClassifier(3, method="tree").fit(z).transform(z)
    assert out.count() == 600 and out.where("prediction = TX_FRAUD").count() > 550
