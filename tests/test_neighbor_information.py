"""Nearest-neighbour mutual information against a comparison of all rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import selection as S
from txrisk.operators.neighbor_information import digamma, neighbor_information


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def brute(x, y, k):
    ok = np.isfinite(x)
    x, y = x[ok], y[ok]
    classes = [c for c in set(y) if (y == c).sum() > 1]
    on = np.isin(y, classes)
    x, y = x[on], y[on]
    total = 0.0
    for v, c in zip(x, y):
        mine = np.sort(np.abs(x[y == c] - v))
        kk = min(k, len(mine) - 1)
        r = mine[kk]   # the first is the row itself
        m = (x == v).sum() if r == 0 else ((x > v - r) & (x < v + r)).sum()
        total += psi(kk) - psi(len(mine)) - psi(max(int(m), 1))
    return max(0.0, psi(len(x)) + total / len(x)) if len(x) else 0.0


def made(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    cols = {"plain": rng.normal(size=n) + (y == "b") * 2, "tied": np.round(rng.normal(size=n) + (y == "c"), 1), "whole": rng.integers(0, 4, n).astype(float),
            "noise": rng.normal(size=n) * 1e6, "hot": np.where(rng.random(n) < 0.4, 7.25, rng.normal(size=n)), "constant": np.full(n, -0.0)}
    return y, cols


@pytest.mark.parametrize("n, k, buckets", [(400, 3, None), (400, 5, 3), (150, 1, 40), (60, 3, 200), (7, 3, None)])
def test_equals_comparison_of_all_rows(spark, n, k, buckets):
    y, cols = made(n, n + k)
    # one class of a single row, one of two rows
    y[0], y[1:3] = "lone", "pair"
    df = spark.createDataFrame([(str(c), *map(float, v)) for c, *v in zip(y, *cols.values())], "y string, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {r.feature: r.mi for r in neighbor_information(df, list(cols), "y", k, n_buckets=buckets).collect()}
    assert got.keys() == cols.keys()
    for c, x in cols.items():
        assert abs(got[c] - brute(x, y, k)) < 1e-9, c


def test_nulls_discrete_features_and_empty(spark):
    rows = [("a", 1.0, "p"), ("a", 1.5, "p"), ("a", None, "q"), ("b", 5.0, "q"), ("b", float("nan"), None), ("b", 5.5, "q"), ("b", float("inf"), "q"), (None, 1.2, "p")]
    df = spark.createDataFrame(rows, "y string, x double, d string")
    got = {r.feature: r.mi for r in neighbor_information(df, ["x", "d"], "y", 3, ["d"]).collect()}
    assert abs(got["x"] - brute(np.array([1.0, 1.5, 5.0, 5.5]), np.array(list("aabb")), 3)) < 1e-9
    plain = S.information(df.where("y IS NOT NULL AND d IS NOT NULL").select("y", F.lit("d").alias("feature"), F.col("d").alias("b"))).first()["mi"]
    assert abs(got["d"] - plain) < 1e-12
    for part in (df.limit(0), df.where("x IS NULL")):
        assert [r.mi for r in neighbor_information(part, ["x"], "y").collect()] == [0.0]
    with pytest.raises(ValueError):
        neighbor_information(df, ["x"], "y", 0)


def test_ranks_features_and_compares_no_rows(spark):
    y, cols = made(500, 9)
    df = spark.createDataFrame([(str(c), *map(float, v)) for c, *v in zip(y, *cols.values())], "y string, " + ", ".join(f"{c} double" for c in cols))
    assert S.select_k_best(df, ["noise", "plain", "constant"], "y", 1, "neighbors") == ["plain"]
    plan = neighbor_information(df, ["plain", "noise"], "y")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_digamma(spark):
    got = spark.range(1, 2000).select("id", digamma(F.col("id")).alias("p")).collect()
    assert max(abs(r.p - psi(r.id)) for r in got) < 1e-12
