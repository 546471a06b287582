"""The sliced route moves only keys, times and measured numbers."""
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txrisk.operators import windows as W
from txrisk.schema import DAY_US, HOUR_US


def test_widths_share_their_slices(tx):
    """All widths cost the exchanges of one, and the row itself is not among what they move."""
    plan = lambda widths: W.rolling_count(tx, "AccountId", widths, hot_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    one, four = (plan(w) for w in ((DAY_US,), (6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US)))
    assert len(re.findall(r"Window \[", four)) == len(re.findall(r"Window \[", one))
    assert "__row" not in four


def test_width_groups_bound_the_slices_of_a_frame():
    assert W._width_groups([6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US]) == [[6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US]]
    assert W._width_groups([60_000_000, 365 * DAY_US]) == [[60_000_000], [365 * DAY_US]]


@pytest.mark.parametrize("lag", [0, 2 * HOUR_US])
def test_rows_without_key_time_or_unique_id(spark, lag):
    t0 = datetime(2024, 1, 1)
    data = [(i % 5, k, None if i % 11 == 0 else t0 + timedelta(hours=i * 7 % 50), float(i)) for k in ("A", None) for i in range(60)]
    df = spark.createDataFrame(data, "TRANSACTION_ID int, AccountId string, TX_DATETIME timestamp, TX_AMOUNT double")
    feats = [W.Rolling(f"{fn}_{w}", fn, w, None if fn == "count" else "TX_AMOUNT", lag) for fn in ("count", "sum") for w in (DAY_US, 10 * HOUR_US)]
    got = [sorted(map(tuple, W.over_key(df, "AccountId", feats, hot_rows=h).select("*").collect()), key=str) for h in (10 ** 9, 0)]
    assert got[0] == got[1]
