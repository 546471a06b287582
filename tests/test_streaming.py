"""Exact live velocity: equal to the batch form whatever the order of arrival, late rows, and what state is kept."""
import glob
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from txrisk.operators.windows import rolling_count, rolling_mean
from txrisk.schema import DAY_US, HOUR_US
from txrisk.streaming.velocity import CHUNK_ROWS, Window, packed, run_available, streaming_exact_velocity, unpacked

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "TRANSACTION_ID long, AccountId string, TX_DATETIME timestamp, TX_AMOUNT double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out, at = [], 0
    for i in range(400):
        at += rng.choice([0, 1, 60_000_000, HOUR_US * 5, DAY_US])   # some rows share a microsecond
        out.append((i, rng.choice(["A", "B", None]), START + timedelta(microseconds=at), rng.choice([None, 0.1, 7.25, -3.0])))
    return out


def drained(spark, tmp_path, batches, delay="2 hours"):
    """Rows after a stream read one file after the other."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i:03d}")
        for f in glob.glob(f"{tmp_path}/in/b={i:03d}/*.parquet"):
            os.utime(f, (1_700_000_000 + 10 * i,) * 2)   # the source takes files by age
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    result = streaming_exact_velocity(stream, "AccountId", delay=delay)
    run_available(result, f"{tmp_path}/out", f"{tmp_path}/state", closed_only=True)
    return spark.read.schema(result.schema).parquet(f"{tmp_path}/out")


def batch_form(spark, rows):
    return rolling_mean(rolling_count(spark.createDataFrame(rows, SCHEMA), "AccountId"), "AccountId")


def as_dict(df):
    names = [c for c in df.columns if "_Count_" in c or "_Mean_" in c]
    return {str(r["TRANSACTION_ID"]): [None if r[c] is None else round(r[c], 9) for c in sorted(names)] for r in df.collect()}


def test_shuffled_batches_equal_the_batch_form(spark, tmp_path, rows):
    # every file holds a stretch of time with its rows shuffled, and swaps rows with the next one within the delay
    rng = random.Random(7)
    batches = []
    for i in range(0, len(rows), 80):
        part = rows[i:i + 80]
        rng.shuffle(part)
        batches.append(part)
    got, want = as_dict(drained(spark, tmp_path, batches)), as_dict(batch_form(spark, rows))
    closed = max(r[2] for r in rows) - timedelta(hours=2)
    assert set(got) == {str(r[0]) for r in rows if r[2] <= closed} and len(got) > 350
    assert all(got[i] == want[i] for i in got)


def test_late_rows_are_left_out(spark, tmp_path):
    day = lambda i, d, a: (i, "A", START + timedelta(days=d), a)
    batches = [[day(1, 1, 1.0), day(2, 2, 2.0)], [day(3, 10, 3.0)], [day(7, 10.5, 5.0)], [day(4, 3, 50.0), day(8, 10.2, 6.0), day(5, 11, 4.0)], [day(6, 40, 0.0)]]
    got = as_dict(drained(spark, tmp_path, batches))
    # row 4 is behind the watermark of the batch before and counts nowhere; row 8 is not
    want = as_dict(batch_form(spark, [r for b in batches for r in b if r[0] != 4]))
    assert got == {i: v for i, v in want.items() if i != "6"}


def test_window_drops_without_subtracting():
    rng, w, held, at = random.Random(8), Window(), [], 0
    for _ in range(2000):
        at += rng.randrange(3)
        amount = rng.choice([None, 1e16, 1.0, -1e16, 0.5])
        w.push(at, amount)
        held.append((at, amount))
        w.drop(at - 7)
        held = [h for h in held if h[0] > at - 7]
        n, mean = w.count_and_mean()
        known = [a for _, a in held if a is not None]
        assert n == len(held) == len(w.new) + len(w.old) and (mean is None) == (not known)
        if known and all(abs(a) < 2 for a in known):
            assert abs(mean - sum(known) / len(known)) < 1e-12
    w.drop(at)
    assert w.count_and_mean() == (0, None) and not w.new and not w.old


def test_state_holds_chunks_of_rows():
    nan = float("nan")
    rows = [(i, None if i % 5 == 0 else f"r{i}", [None, 0.1, -1e300, nan][i % 4]) for i in range(2 * CHUNK_ROWS + 3)]
    chunks = packed(rows)
    assert len(chunks) == 3 and all(isinstance(c, bytes) for c, in chunks) and packed([]) == []
    assert str(unpacked(iter(chunks))) == str(rows) and unpacked(iter([])) == []
