"""Live forms of the velocity and session features on Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor

from txrisk.operators.windows import label_us
from txrisk.schema import DAY_US, DEFAULT, HOUR_US, MINUTE_US, Columns, micros


def streaming_velocity(stream: DataFrame, key: str, width: str = "7 days", slide: str = "1 day", delay: str = "1 hour",
                       cols: Columns = DEFAULT) -> DataFrame:
    """Count, sum and mean of the amount per key in sliding event-time windows.

    State is one partial aggregate per (key, window) and is dropped once the watermark passes the window.
    """
    w = F.window(cols.ts, width, slide)
    return stream.withWatermark(cols.ts, delay).groupBy(w, key).agg(
        F.count("*").alias("n_tx"), F.sum(cols.amount).alias("amount"), F.avg(cols.amount).alias("mean_amount")
    ).select(key, F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"),
             "n_tx", "amount", "mean_amount")


class Window:
    """Rows of a time window as two stacks of partial sums: they enter at one end and leave at the other, and nothing is subtracted."""

    def __init__(self):
        self.new, self.old, self.total = [], [], (0, 0, 0.0)   # rows; (us, rows, amounts, sum) of the rest of the stack; what is new in sum

    def push(self, us: int, amount: float | None) -> None:
        n, known, total = self.total
        self.new.append((us, amount))
        self.total = (n + 1, known + (amount is not None), total + (amount or 0.0))

    def drop(self, us: int) -> None:
        """Rows up to ``us`` leave."""
        while (self.old[-1][0] if self.old else self.new[0][0] if self.new else us + 1) <= us:
            if not self.old:
                n, known, total = 0, 0, 0.0
                for at, amount in reversed(self.new):
                    n, known, total = n + 1, known + (amount is not None), total + (amount or 0.0)
                    self.old.append((at, n, known, total))
                self.new, self.total = [], (0, 0, 0.0)
            self.old.pop()

    def count_and_mean(self) -> tuple[int, float | None]:
        _, n, known, total = self.old[-1] if self.old else (0, 0, 0, 0.0)
        n, known, total = n + self.total[0], known + self.total[1], total + self.total[2]
        return n, total / known if known else None


# Rows of a key that make one entry of its state: entries are written and read one by one, which costs more than what they hold.
CHUNK_ROWS = 4096


def packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(tuple(zip(*rows[a:a + CHUNK_ROWS])), 4),) for a in range(0, len(rows), CHUNK_ROWS)]


def unpacked(chunks: Iterator[tuple[bytes]]) -> list[tuple]:
    return [row for chunk, in chunks for row in zip(*pickle.loads(chunk))]


class ExactVelocity(StatefulProcessor):
    """State of a key: rows that wait for the watermark, and released rows that later windows still reach, both in chunks."""

    def __init__(self, key: str, counts: tuple[int, ...], means: tuple[int, ...]):
        self.key, self.counts, self.means = key, counts, means
        self.widths = sorted({*counts, *means})

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "chunk binary")
        self.released = handle.getListState("released", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["us"], r["id"], r["amount"]) for r in rows]
        self.waiting.appendList(packed(new))
        self.handle.registerTimer(min(us for us, _, _ in new) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, reach = unpacked(self.waiting.get()), unpacked(self.released.get())
        ready = sorted((r for r in waiting if r[0] <= closed), key=lambda r: (r[0], r[1] or ""))
        later = [r for r in waiting if r[0] > closed]
        windows = {w: Window() for w in self.widths}
        for us, _, amount in reach:
            for w in windows.values():
                w.push(us, amount)
        result = Row(self.key, "id", "us", *(f"n{w}" for w in self.counts), *(f"m{w}" for w in self.means))
        out, i = [], 0
        while i < len(ready):
            us, j = ready[i][0], i
            while j < len(ready) and ready[j][0] == us:   # rows of one microsecond are peers
                for w in windows.values():
                    w.push(us, ready[j][2])
                j += 1
            found = {}
            for width, w in windows.items():
                w.drop(us - width)
                found[width] = w.count_and_mean()
            numbers = [*(found[w][0] for w in self.counts), *(found[w][1] for w in self.means)]
            out += [result(key[0], r[1], us, *numbers) for r in ready[i:j]]
            i = j
        # a later row lies beyond the watermark, so its windows reach back no further than this
        left = [r for r in [*reach, *ready] if r[0] > closed - self.widths[-1]]
        for state, rows, before in ((self.waiting, later, waiting), (self.released, left, reach)):
            if rows != before:
                state.put(packed(rows)) if rows else state.clear()
        if later:
            self.handle.registerTimer(min(us for us, _, _ in later) // 1000)
        if left:   # an idle key forgets its rows
            self.handle.registerTimer((left[-1][0] + self.widths[-1]) // 1000 + 1)
        return iter(out)


def streaming_exact_velocity(stream: DataFrame, key: str, counts_us: tuple[int, ...] = (6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US),
                             mean_days: tuple[int, ...] = (1, 7, 30), delay: str = "1 hour", cols: Columns = DEFAULT) -> DataFrame:
    """Every transaction with its counts and mean amounts of the key in ``(t - w, t]``, as in ``rolling_count`` and ``rolling_mean``.

    A row comes out once the watermark has reached its time, when no row of its windows can be missing any more, whatever the order of arrival within ``delay``. Rows behind
    the watermark that the batch before began with are late and left out. The state of a key is its rows within the widest window and the delay; timers release rows and
    clear what no later window reaches. A null amount counts but is left out of means; rows with a null time are left out. The state store has to be RocksDB.
    """
    means = tuple(d * DAY_US for d in mean_days)
    rows = stream.where(F.col(cols.ts).isNotNull()).withWatermark(cols.ts, delay).select(
        F.col(key), F.col(cols.ts), F.col(cols.id).cast("string").alias("id"), micros(cols.ts).alias("us"), F.col(cols.amount).cast("double").alias("amount"))
    schema = ", ".join([f"`{key}` {dict(rows.dtypes)[key]}", "id string", "us long", *(f"n{w} long" for w in counts_us), *(f"m{w} double" for w in means)])
    out = rows.groupBy(key).transformWithState(ExactVelocity(key, tuple(counts_us), means), schema, "Append", "EventTime")
    return out.select(key, F.col("id").alias(cols.id), "us", *[F.col(f"n{w}").alias(f"{key}_Count_{label_us(w)}") for w in counts_us],
                      *[F.col(f"m{d * DAY_US}").alias(f"{key}_Mean_{d}d") for d in mean_days])


def streaming_sessions(stream: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour",
                       cols: Columns = DEFAULT) -> DataFrame:
    """Gap sessions per key: start, size, amount, value and duration in minutes."""
    us = micros(cols.ts)
    return stream.withWatermark(cols.ts, delay).groupBy(F.session_window(cols.ts, gap), key).agg(
        F.count("*").alias("n_tx"), F.sum(cols.amount).alias("amount"), F.sum(cols.value).alias("value"),
        ((F.max(us) - F.min(us)) / MINUTE_US).alias("minutes")
    ).select(key, F.unix_micros("session_window.start").alias("start_us"), "n_tx", "amount", "value", "minutes")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(result: DataFrame, path: str, checkpoint_dir: str, closed_only: bool = False) -> None:
    """Process what is available now, write parquet, and stop.

    By default the output is what the batch form gives: windows still open at the end come out too, and no row counts as late. With ``closed_only`` windows are
    appended once the watermark has passed them, as in a job that goes on.
    """
    writer = result.writeStream.option("checkpointLocation", checkpoint_dir).trigger(availableNow=True)
    if closed_only:
        result.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        q = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        q = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    q.awaitTermination()
