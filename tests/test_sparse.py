"""Sparse category vectors: dictionary, nulls, unknown values, one schema whatever the number of values."""
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from txrisk.operators import encoders as E, sparse as Z
from txrisk.operators.aggregates import client_value_counts
from txrisk.operators.windows import rolling_category_stats
from txrisk.schema import DAY_US, HOUR_US


def numbers(d, column):
    return {r.category: r.number for r in d.table.where(F.col("column") == column).collect()}


@pytest.mark.parametrize("n", [3, 2500])
def test_numbers_are_gapless_and_vectors_keep_their_schema(spark, n, tmp_path):
    df = spark.range(3 * n).select(F.col("id").alias("TRANSACTION_ID"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % n)).alias("c"))
    d = Z.category_dictionary(df, ["c"], str(tmp_path / "d"))
    got = numbers(d, "c")
    assert sorted(got.values()) == list(range(d.sizes["c"])) and got == numbers(Z.category_dictionary(df.repartition(3), ["c"]), "c")
    out = Z.one_hot_vectors(df, ["c"], Z.load_dictionary(spark, str(tmp_path / "d"), ["c"]))
    assert out.dtypes == [("TRANSACTION_ID", "bigint"), ("c", "string"), ("c_OneHot", "vector")]
    for r in out.collect():
        assert r.c_OneHot == SparseVector(d.sizes["c"], {} if r.c is None else {got[r.c]: 1.0})


def test_unknown_values_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "TRANSACTION_ID long, c string")
    d = Z.category_dictionary(df, ["c"])
    new = spark.createDataFrame([(4, "zz"), (5, "a"), (6, None)], df.schema)
    got = {r.TRANSACTION_ID: r.c_OneHot.numNonzeros() for r in Z.one_hot_vectors(new, ["c"], d).collect()}
    assert got == {4: 0, 5: 1, 6: 0}
    none = Z.category_dictionary(df.limit(0), ["c"])
    assert none.sizes == {"c": 0} and all(r.c_OneHot.size == 0 for r in Z.one_hot_vectors(new, ["c"], none).collect())
    assert Z.client_count_vectors(df.limit(0), "TRANSACTION_ID", ["c"], d).collect() == []
    assert Z.client_count_vectors(df, "TRANSACTION_ID", ["c"], d).count() == 3


def test_client_counts_equal_the_columns(tx):
    names = ["ProductCategory", "ChannelId"]
    d = Z.category_dictionary(tx, names)
    wide = {r.CustomerUID: r for r in client_value_counts(tx, "CustomerUID", names).collect()}
    got = Z.client_count_vectors(tx, "CustomerUID", names, d).collect()
    assert len(got) == len(wide)
    for c in names:
        n = numbers(d, c)
        assert all(r[f"{c}_perClient"][i] == wide[r.CustomerUID][f"{c}_perClient_{v}"] for r in got for v, i in n.items())


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_rolling_counts_equal_the_columns(tx, hot_rows):
    d = Z.category_dictionary(tx, ["ProductCategory"])
    widths, n = (HOUR_US, 7 * DAY_US), numbers(d, "ProductCategory")
    wide = {r.TRANSACTION_ID: r for r in rolling_category_stats(tx, "AccountId", "ProductCategory", widths).collect()}
    got = Z.rolling_category_vectors(tx, "AccountId", "ProductCategory", d, widths, hot_rows=hot_rows).collect()
    assert len(got) == len(wide)
    for label in ("1h", "7d"):
        assert all(r[f"ProductCategory_Counts_{label}"][i] == wide[r.TRANSACTION_ID][f"ProductCategory_{v}_Count_{label}"] for r in got for v, i in n.items())


def test_string_similarities_above_a_ratio(spark):
    names = ["order", "orders", "border", "a", "", "card payment", "card payments", "zzz"]
    df = spark.createDataFrame(list(enumerate(names)), "TRANSACTION_ID long, c string")
    d = Z.category_dictionary(df, ["c"])
    n = numbers(d, "c")
    for least in (0.0, 0.6):
        for r in Z.similarity_vectors(df, "c", d, least=least).collect():
            want = np.zeros(len(names))
            for other, i in n.items():
                ratio = SequenceMatcher(None, r.c, other).ratio()
                want[i] = ratio if ratio > least else 0.0
            assert np.array_equal(r.c_Similarity.toArray(), want)
    # pairs that the lengths rule out do not reach the ratio
    assert E.similarity_table(df, "c", least=0.6).count() < E.similarity_table(df, "c").count()
