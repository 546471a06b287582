"""Counts per value of rolling frames: any number of values, repeated values, nulls, peers; a row is not copied for the values of its key."""
from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from txrisk.operators import sparse as Z, windows as W
from txrisk.schema import DAY_US, HOUR_US


@pytest.mark.parametrize("hot_rows", [None, 60])
def test_counts_equal_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(W, "VALUE_CHUNK", 20)
    rng, start = random.Random(5), datetime(2024, 1, 1)
    data = [(i, rng.choice(["a", "b", "b", None]), start + timedelta(hours=rng.randrange(72)), rng.choice([None, "v0", "v0", *[f"v{j}" for j in range(130)]])) for i in range(260)]
    df = spark.createDataFrame(data, "TRANSACTION_ID long, AccountId string, TX_DATETIME timestamp, c string").repartition(5)
    widths = (HOUR_US, DAY_US)
    want = {}
    for i, k, t, _ in data:
        for w, n in zip(widths, ("1h", "1d")):
            for _, k2, t2, v in data:
                if k2 == k and v is not None and t - timedelta(microseconds=w) < t2 <= t:
                    want[i, n, v] = want.get((i, n, v), 0) + 1
    got = W.rolling_category_counts(df, "AccountId", "c", widths, hot_rows=hot_rows).collect()
    assert {(r.TRANSACTION_ID, r.Window, r.Value): r.Count for r in got} == want and len(got) == len(want)
    known = df.where("c IS NULL OR c != 'v0'")   # the dictionary does not know v0
    d = Z.category_dictionary(known, ["c"])
    names = {r.number: r.category for r in d.table.collect()}
    rows = Z.rolling_category_vectors(df, "AccountId", "c", d, widths, hot_rows=hot_rows)
    assert rows.count() == len(data)
    found = {(r.TRANSACTION_ID, n, names[int(i)]): v for r in rows.collect() for n in ("1h", "1d") for i, v in zip(r[f"c_Counts_{n}"].indices, r[f"c_Counts_{n}"].values)}
    assert found == {k: v for k, v in want.items() if k[2] != "v0"}


def test_rows_are_not_dealt_by_value(spark):
    df = spark.range(200).select(F.col("id").alias("TRANSACTION_ID"), F.lit("a").alias("AccountId"), F.timestamp_seconds(F.col("id") * 3600).alias("TX_DATETIME"), F.col("id").cast("string").alias("c"))
    d = Z.category_dictionary(df, ["c"])
    text = Z.rolling_category_vectors(df, "AccountId", "c", d, (HOUR_US,))._jdf.queryExecution().executedPlan().toString()
    # neither copied for chunks of values nor put together by id again
    assert "__chunk" not in text and "hashpartitioning(TRANSACTION_ID" not in text
