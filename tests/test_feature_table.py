"""The feature table moves narrow rows: nested keys share a shuffle, what a row tells by itself is added after the last one."""
import re

import pytest
from pyspark.sql import functions as F

from txrisk.functions import rows as R
from txrisk.operators import series as S, windows as W
from txrisk.plans import features as P
from txrisk.schema import DAY_US, DEFAULT, micros, transaction_view
from tests.conftest import SF

SMALL = P.FeatureOptions(seasonal=False, fft=False, rate_columns=("ProductCategory",))


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("hot_rows", [None, 15])
def test_nested_keys_equal_keys_by_themselves(spark, hot_rows):
    df = R.add_client_key(transaction_view(spark, SF)).select("TRANSACTION_ID", "TX_DATETIME", "AccountId", "CustomerUID")
    assert W.one_outer(df, "CustomerUID", "AccountId")
    feats = lambda k: [W.Prev(f"{k}_before", "__now"), W.Rolling(f"{k}_n", "count", DAY_US), W.KeyStat(f"{k}_all", "count")]
    names = lambda k: [f.name for f in feats(k)]
    alone = lambda k: lambda rows, source: W.over_key(rows.withColumn("__now", micros("TX_DATETIME")), k, feats(k), hot_rows=hot_rows, source=source).drop("__now")
    keys = ["AccountId", "CustomerUID"]
    blocks = [(k, feats(k), lambda raw, kept, k=k: raw.select(*kept, *names(k)), alone(k)) for k in keys]
    out = W.over_nested_keys(df, blocks, hot_rows=hot_rows, source=df)
    if hot_rows is None:
        assert len(exchanges(out)) == 1 and "AccountId" in exchanges(out)[0]
    want = alone(keys[1])(alone(keys[0])(df, df), df)
    assert {r.TRANSACTION_ID: r.asDict() for r in out.collect()} == {r.TRANSACTION_ID: r.asDict() for r in want.collect()} and out.count() == df.count()


def test_groups_that_are_not_nested_are_found(spark):
    rows = [(1, "c", "a"), (2, "c", "b"), (3, "d", "a")]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, CustomerUID string, AccountId string")
    assert not W.one_outer(df, "CustomerUID", "AccountId") and W.one_outer(df.where("TRANSACTION_ID > 1"), "CustomerUID", "AccountId")
    # null is an account of its own
    assert not W.one_outer(df.where("TRANSACTION_ID > 1").unionByName(df.limit(1).selectExpr("9L AS TRANSACTION_ID", "'c' AS CustomerUID", "CAST(NULL AS STRING) AS AccountId")), "CustomerUID", "AccountId")


def test_clients_across_accounts_keep_their_features(spark):
    """A client may be named by its customer alone; then its groups cross accounts."""
    cols = DEFAULT.with_names(uid_parts=("CUSTOMER_ID",))
    df = transaction_view(spark, SF).withColumn("AccountId", F.concat("AccountId", F.lit("-"), F.col("TRANSACTION_ID") % 2))
    out = P.build_features(df, P.fit_features(df, SMALL, cols), SMALL, cols).select("TRANSACTION_ID", "CustomerUID_Count_7d", "CUSTOMER_ID_Count_7d", "Daily_CustomerUID_TxnCount").toPandas()
    assert len(out) == df.count() and (out.CustomerUID_Count_7d == out.CUSTOMER_ID_Count_7d).all() and out.Daily_CustomerUID_TxnCount.max() > 1


def test_rows_are_moved_before_they_grow(spark):
    """By batch, by customer and by account; what else is moved are counts."""
    df = transaction_view(spark, SF)
    out = P.build_features(df, P.fit_features(df, SMALL), SMALL)
    by = lambda name: sum(name in x for x in exchanges(out))
    assert (by("AccountId"), by("CUSTOMER_ID"), by("CustomerUID"), by("ProductCategory")) == (1, 1, 0, 1)   # the last are counts
    series = S.seasonal_table(df, "AccountId")
    assert len(exchanges(series)) == 2 and "Join" not in series._jdf.queryExecution().executedPlan().toString()


def test_daily_series_fill_gaps_and_skip_rows_without_a_day(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-01", 2.0), ("a", "2024-01-04", None), ("a", None, 9.0), (None, "2024-01-02", 5.0), (None, "2024-01-03", 7.0), ("n", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("TX_DATETIME", F.to_timestamp("t"))
    got = sorted(map(tuple, S.resample_daily(df, "k", ["v"]).select("k", F.col("day").cast("string"), "i", "n", "v").collect()), key=str)
    assert got == sorted([("a", "2024-01-01", 0, 4, 3.0), ("a", "2024-01-02", 1, 4, 0.0), ("a", "2024-01-03", 2, 4, 0.0), ("a", "2024-01-04", 3, 4, 0.0),
                          (None, "2024-01-02", 0, 2, 5.0), (None, "2024-01-03", 1, 2, 7.0)], key=str)
