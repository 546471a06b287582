"""Moments of many columns equal Spark's own aggregates, with nulls, constants and numbers that are far from 0."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import outliers as O


@pytest.mark.parametrize("odd", [None, float("nan"), float("inf")])
def test_many_columns_equal_the_aggregates(spark, monkeypatch, odd):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 9)) * np.array([1, 1e6, 1e-6, 1, 1, 0, 1, 1, 1]) + np.array([0, 1e9, 0, 5, 0, 7, 0, 0, 0])
    rows = [[None if (i + 3 * j) % 11 == 0 and j > 5 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    if odd is not None:
        rows[4][2] = odd
    names = [f"c{j}" for j in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    mean, cov, n = O.moments(df, names)
    monkeypatch.setattr(O, "WIDE", 99)
    want_mean, want_cov, want_n = O.moments(df, names)
    assert n == want_n == 300 and np.allclose(mean, want_mean, rtol=1e-12, equal_nan=True)
    spread = np.where(np.isfinite(np.diag(want_cov)), np.sqrt(np.abs(np.diag(want_cov))), 1.0)
    spread = np.maximum(spread, 1e-7 * np.maximum(1.0, np.abs(np.nan_to_num(want_mean, posinf=0.0))))   # constants round too
    off = np.where(np.isfinite(want_cov), np.abs(cov - want_cov) / np.outer(spread, spread), 0.0)
    assert (np.isfinite(cov) == np.isfinite(want_cov)).all() and off.max() < 1e-9, off
    assert O.moments(df.limit(0), names)[2] == 0 and not O.moments(df.limit(0), names)[1].any()


def test_many_columns_are_not_one_wide_aggregate(spark, monkeypatch):
    df = spark.range(20).select(*[(F.col("id") * (j + 1) % 7).cast("double").alias(f"c{j}") for j in range(9)])
    monkeypatch.setattr(F, "covar_pop", lambda *_: pytest.fail("an aggregate per pair"))
    assert O.moments(df, df.columns)[1].shape == (9, 9)
