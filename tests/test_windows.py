import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import aggregates as A, windows as W
from txrisk.schema import DAY_US


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("TRANSACTION_ID").collect()]


@pytest.mark.parametrize("hot", [None, 0])
def test_micro_fixture(micro, hot):
    k = "AccountId"
    assert [round(r[0], 6) for r in rows(W.time_since_last(micro, k, hot_rows=hot), f"{k}_TimeSinceLast")] == [0, 1440, 8640, 1440.016667, 0]
    assert [r[0] for r in rows(W.rolling_count(micro, k, (7 * DAY_US,), hot_rows=hot), f"{k}_Count_7d")] == [1, 2, 2, 2, 1]
    assert [r[0] for r in rows(W.rolling_mean(micro, k, (7,), hot_rows=hot), f"{k}_Mean_7d")] == [10, 20, 25, 10, 5]
    z = [round(r[0], 6) for r in rows(W.behavioral_drift(micro, k, days=(7,), hot_rows=hot), f"{k}_TX_AMOUNT_Z_7d")]
    assert z == [0, 0.707107, -0.707107, -0.707107, 0]
    risk = rows(W.delayed_risk(micro, k, 1, (7,), hot_rows=hot), f"{k}_NB_TX_7d", f"{k}_NB_FRAUD_7d")
    assert risk == [(0, 0), (1, 0), (2, 1), (2, 1), (0, 0)]


def test_entity_stats(micro):
    got = rows(A.entity_amount_stats(micro, "AccountId", ["TX_AMOUNT"]), "AccountId_TX_AMOUNT_Mean", "AccountId_TX_AMOUNT_Std")
    assert [(m, round(s, 6)) for m, s in got] == [(15, 12.909944)] * 4 + [(5, 1)]


@pytest.mark.parametrize("hot", [None, 0])
def test_session_gap_equal_to_threshold_continues(micro, hot):
    got = rows(W.sessionize(micro, "AccountId", 1440, hot_rows=hot), "SessionId")
    assert [r[0] for r in got] == [0, 0, 1, 2, 0]


def test_tied_mode_is_smallest(spark):
    df = spark.createDataFrame([(1, "k", "b"), (2, "k", "a"), (3, "k", "b"), (4, "k", "a")], "id int, k string, v string")
    assert df.groupBy("k").agg(F.mode("v", True).alias("m")).first()["m"] == "a"


def test_constant_amounts_have_no_spread_when_sliced(spark):
    df = spark.createDataFrame([(i, "k", float(i), 0.1) for i in range(200)], "TRANSACTION_ID int, k string, s double, TX_AMOUNT double")
    df = df.withColumn("TX_DATETIME", F.timestamp_seconds(F.col("s") * 1800))
    out = W.over_key(df, "k", [W.Rolling("s1", "std", DAY_US, "TX_AMOUNT")], hot_rows=0)
    assert {r["s1"] for r in out.where("TRANSACTION_ID > 0").collect()} == {0.0}


def test_one_key_with_a_third_of_all_rows(tx):
    """The hot key is sliced, the others are not; the union equals native frames."""
    big = tx.withColumn("AccountId", F.when(F.col("TRANSACTION_ID") % 3 == 0, "HOT").otherwise(F.col("AccountId")))
    feats = [W.Prev("p", "TX_AMOUNT"), W.Running("r", "Value"), W.Rolling("c", "count", 3 * DAY_US), W.Rolling("m", "avg", 7 * DAY_US, "TX_AMOUNT"),
             W.Rolling("d", "std", 7 * DAY_US, "Value"), W.LastRows("l", "avg", 5, "TX_AMOUNT"), W.KeyStat("g", "std", "TX_AMOUNT")]
    cols = ["TRANSACTION_ID", *[f.name for f in feats]]
    a = W.over_key(big, "AccountId", feats).select(cols).toPandas().set_index("TRANSACTION_ID").sort_index()
    b = W.over_key(big, "AccountId", feats, hot_rows=200).select(cols).toPandas().set_index("TRANSACTION_ID").sort_index()
    for c in cols[1:]:
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_row_order_and_partitioning_do_not_matter(tx):
    f = lambda d: sorted(map(tuple, W.behavioral_drift(d, "AccountId").select("TRANSACTION_ID", F.round("AccountId_TX_AMOUNT_Z_7d", 9)).collect()))
    assert f(tx) == f(tx.orderBy(F.rand(1)).repartition(13))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_velocity_block_shuffles_once_per_key(tx, spark):
    from txrisk.plans.features import FeatureOptions, key_features
    from txrisk.schema import DEFAULT, micros, transaction_view
    from tests.conftest import SF
    raw = transaction_view(spark, SF).withColumn("__now", micros("TX_DATETIME"))
    out = W.over_key(raw, "AccountId", key_features("AccountId", FeatureOptions(cumulative=True), DEFAULT))
    assert len(re.findall(r"Exchange hashpartitioning", plan(out))) == 1


def test_no_single_partition_window_over_rows(spark):
    """Global orders only ever collect bucket totals in one task."""
    from txrisk.functions.scale import row_positions
    from txrisk.schema import micros, transaction_view
    from tests.conftest import SF
    out = row_positions(transaction_view(spark, SF).withColumn("us", micros("TX_DATETIME")), "us", "TRANSACTION_ID")
    lines = plan(out).splitlines()
    above = [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(above) == 1 and "HashAggregate" in above[0]


def test_scan_reads_only_needed_columns(spark):
    from txrisk.schema import transaction_view
    from tests.conftest import SF
    text = plan(W.rolling_count(transaction_view(spark, SF), "AccountId").select("TRANSACTION_ID", "AccountId_Count_7d"))
    assert "value" not in re.search(r"ReadSchema: (\S+)", text).group(1)


@pytest.mark.parametrize("lag", [0, DAY_US])
def test_hot_route_keeps_small_huge_null_and_nan_amounts(spark, lag):
    """The sliced route gives the native numbers for any double, whatever its decimals or size."""
    import math
    import random
    from datetime import datetime, timedelta
    rng = random.Random(lag)
    kinds = {"small": lambda: rng.random() * 1e-5, "huge": lambda: 3e15 + rng.random() * 1e13, "odd": lambda: rng.choice([None, float("nan"), 1.25, -7.123456789])}
    data = [(i, name, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(5 * 86400), microseconds=rng.randrange(10 ** 6)), make())
            for name, make in kinds.items() for i in range(150)]
    df = spark.createDataFrame(data, "TRANSACTION_ID long, AccountId string, TX_DATETIME timestamp, TX_AMOUNT double")
    feats = [W.Rolling(f"{fn}_{w}", fn, w, None if fn == "count" else "TX_AMOUNT", lag) for fn in ("count", "sum", "avg", "std") for w in (DAY_US, 7_000_000_001, 3 * DAY_US)]
    names = ["AccountId", "TRANSACTION_ID", *[f.name for f in feats]]
    native = sorted(W.over_key(df, "AccountId", feats, hot_rows=10 ** 9).select(names).collect(), key=str)
    sliced = sorted(W.over_key(df, "AccountId", feats, hot_rows=0).select(names).collect(), key=str)
    by = {(r[0], r[1]): r for r in sliced}
    for r in native:
        for name, a, b in zip(names[2:], r[2:], by[r[0], r[1]][2:]):
            if a is None or b is None:
                assert a is None and b is None, (name, r)
            else:
                assert math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-20 if r[0] == "small" else 1e-9), (name, a, b)


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_many_category_values_equal_the_columns(tx, monkeypatch, hot_rows):
    df = tx.select("TRANSACTION_ID", "TX_DATETIME", "AccountId", F.when(F.col("ProductId") != "PR3", F.col("ProductId")).alias("P"))
    widths = (DAY_US, 7 * DAY_US)
    want = {r.TRANSACTION_ID: r.asDict() for r in W.rolling_category_stats(df, "AccountId", "P", widths).collect()}
    monkeypatch.setattr(W, "MAX_CATEGORY_VALUES", 3)
    monkeypatch.setattr(W, "VALUE_CHUNK", 5)
    got = W.rolling_category_stats(df, "AccountId", "P", widths, hot_rows=hot_rows).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.TRANSACTION_ID]
        for n in ("1d", "7d"):
            assert all(r[f"P_{x}_{n}"] == w[f"P_{x}_{n}"] for x in ("Count", "Distinct", "Mode"))
            counts = {c[2:-len(f"_Count_{n}")]: v for c, v in w.items() if c.startswith("P_PR") and c.endswith(f"_Count_{n}") and v}
            assert r[f"P_Counts_{n}"] == counts
