"""Rank correlation: ties, copies, constants, and work that follows distinct values."""
import math

import pandas as pd
import pytest

from txrisk.operators import aggregates as A


def test_ties_and_copies(spark):
    rows = [(float(i * 7 % 11), float(i * i % 13), -float(i % 5)) for i in range(300)] * 4
    got = {(r["x"], r["y"]): r["corr"] for r in A.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), list("abc"), "spearman").collect()}
    want = pd.DataFrame(rows, columns=list("abc")).rank().corr()
    assert got == {(x, y): pytest.approx(want.loc[x, y], abs=1e-12) for x, y in [("a", "b"), ("a", "c"), ("b", "c")]}


def test_constant_column_and_nulls(spark):
    got = A.correlation_matrix(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double"), ["a", "b"], "spearman").first()
    assert math.isnan(got["corr"])
    with pytest.raises(ValueError):
        A.correlation_matrix(spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double"), ["a", "b"], "spearman")


def test_rows_are_counted_before_they_are_sorted(spark, monkeypatch):
    seen = []
    plain = A.prefix_sums
    monkeypatch.setattr(A, "prefix_sums", lambda df, *args: seen.append(df.count()) or plain(df, *args))
    A.correlation_matrix(spark.range(2000).selectExpr("id % 3 AS a", "id % 4 AS b"), ["a", "b"], "spearman")
    assert seen == [3, 4]
