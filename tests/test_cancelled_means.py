"""A ratio to a mean of amounts that cancel is 0, in whatever order they are summed."""
import itertools
from datetime import datetime, timedelta
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from txrisk.operators import aggregates as A, windows as W

AMOUNTS = (0.1, 0.7, 29.27, -30.07)   # sums to 0; as doubles to a rest that depends on the order


@pytest.fixture(scope="module")
def cancelling(spark):
    t0 = datetime(2024, 1, 1)
    data = [(4 * i + j, f"A{i}", t0 + timedelta(hours=j), x) for i, p in enumerate(itertools.permutations(AMOUNTS)) for j, x in enumerate(p)]
    return spark.createDataFrame(data, "TRANSACTION_ID int, AccountId string, TX_DATETIME timestamp, TX_AMOUNT double")


def test_some_orders_leave_a_rest():
    rests = {reduce(add, p) for p in itertools.permutations(AMOUNTS)}
    assert len(rests) > 1 and max(map(abs, rests)) < 1e-13


def test_entity_ratio(cancelling):
    got = A.entity_amount_stats(cancelling, "AccountId", ["TX_AMOUNT"]).select("AccountId_TX_AMOUNT_Ratio").distinct().collect()
    assert [r[0] for r in got] == [0.0]


@pytest.mark.parametrize("hot", [None, 0])
def test_drift_ratio_and_change_from_average(cancelling, hot):
    last = F.col("TRANSACTION_ID") % 4 == 3
    got = W.behavioral_drift(cancelling, "AccountId", hot_rows=hot).where(last).select("AccountId_TX_AMOUNT_RatioToMean_7d").distinct().collect()
    assert [r[0] for r in got] == [0.0]
    got = W.moving_average(cancelling, "AccountId", hot_rows=hot).select("AccountId_PctChangeFromAvg").distinct().collect()
    assert [r[0] for r in got] == [0.0]


def test_small_means_stay(spark):
    """A rest that amounts really have is no rounding error."""
    t0 = datetime(2024, 1, 1)
    for amounts in ((560.21, -560.2), (1e-9, 2e-9), (float("nan"), 1.0), (float("inf"), 1.0)):
        df = spark.createDataFrame([(i, "A", t0, x) for i, x in enumerate(amounts)], "TRANSACTION_ID int, AccountId string, TX_DATETIME timestamp, TX_AMOUNT double")
        r = A.entity_amount_stats(df, "AccountId", ["TX_AMOUNT"]).orderBy("TRANSACTION_ID").first()
        want = amounts[0] / (sum(amounts) / 2)
        assert r["AccountId_TX_AMOUNT_Ratio"] == pytest.approx(want, nan_ok=True)
