"""Shards of nearly equal bytes by a minimax contiguous partition of atomic groups.

Groups of equal texts lie in the order of their content digest. The smallest capacity for which greedy filling needs no more than the
given number of shards is found by binary search over a bounded summary: cells of the digest space with their bytes. Only cells in which
a cut can fall are refined, digit by digit, until those that matter hold single groups. The cuts are digests, so that a row finds its shard
by comparing its own digest; rows are never joined or gathered for it. DataFrame functions only.

A group above the mean of the shards left has a shard of its own, so that it does not raise the capacity of the others. Inside the capacity of the
rest, the cuts lie as near as possible to equal shares, so that the last shards do not take the slack of greedy filling.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.llm.common import discard, store, text_of

ROW_BYTES = 16
# Rows that one numbering group holds on average.
SLOT_ROWS = 20_000
# Hex digits of the first summary (16^3 cells).
FIRST_DIGITS = 3


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def size_of(text: Column, row_bytes: int = ROW_BYTES) -> Column:
    return F.octet_length(text).cast("long") + F.lit(row_bytes)


class Cells:
    """Ordered digest ranges: (prefix, bytes, groups, largest group)."""

    def __init__(self, rows):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))

    def fill(self, capacity: int, shards: int, divisible: bool) -> tuple[list[int], bool]:
        """Greedy filling: the cells at which shards 1, 2, ... begin, and whether all cells fit.

        A cell of several groups counts as one block, or if ``divisible`` as one that can be cut anywhere.
        """
        total, cuts, start = (self.ends[-1] if self.ends else 0), [], 0
        for _ in range(shards):
            k = bisect_right(self.ends, start + capacity)
            if k >= len(self.ends):
                return cuts, True
            whole = self.ends[k - 1] if k else 0
            split = divisible and self.rows[k][2] > 1
            if not split and whole <= start:
                break
            cuts.append(k)
            start = start + capacity if split else whole
        return cuts, start >= total

    def smallest(self, shards: int, divisible: bool) -> int:
        total, largest = (self.ends[-1] if self.ends else 0), max([r[3] for r in self.rows], default=0)
        low, high = max(largest, -(-total // shards)), max(total, largest)
        while low < high:
            mid = (low + high) // 2
            if not self.fill(mid, shards, divisible)[1]:
                low = mid + 1
            else:
                high = mid
        return low


class Summary:
    """Cells of ``groups`` (key, bytes), refined where that is asked for."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.cells = Cells(self.read(FIRST_DIGITS, None))

    def read(self, digits: int, within: list[str] | None):
        df = self.groups if within is None else self.groups.where(F.substring("key", 1, len(within[0])).isin(within))
        rows = df.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("bytes"), F.count("*"), F.max("bytes"), F.min("key")).collect()
        # a cell of one group takes the whole key as its name, so it is never refined again
        return [(r[4] if r[2] == 1 else r[0], r[1], r[2], r[3]) for r in rows]

    def refine(self, wide: set[int]) -> None:
        fine = [r for i, r in enumerate(self.cells.rows) if i not in wide]
        by_length: dict[int, list[str]] = {}
        for i in wide:
            by_length.setdefault(len(self.cells.rows[i][0]), []).append(self.cells.rows[i][0])
        for digits, names in by_length.items():
            fine += self.read(digits + 1, names)
        self.cells = Cells(fine)

    def minimax(self, shards: int) -> int:
        """The smallest feasible capacity; cells in which a cut of greedy filling can fall are refined."""
        while True:
            cells = self.cells
            low, high = cells.smallest(shards, True), cells.smallest(shards, False)
            # for every capacity between, the k-th cut lies between those of whole blocks at the low end and of divisible ones at the high end
            early, late = cells.fill(low, shards, False)[0], cells.fill(high, shards, True)[0]
            block = max([r[1] for r in cells.rows], default=0)
            wide = set()
            for k in range(1, shards):
                to = late[k - 1] if k <= len(late) else len(cells.rows) - 1
                since = early[k - 1] if k <= len(early) else bisect_right(cells.ends, max(0, k * (low - block)))
                wide.update(i for i in range(max(0, min(since, to) - 1), to + 1) if i < len(cells.rows) and cells.rows[i][2] > 1)
            wide.update(i for i, r in enumerate(cells.rows) if r[2] > 1 and 64 * r[3] > high)
            if not wide:
                return high
            self.refine(wide)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest feasible capacity and the digests at which greedy shards 1, 2, ... begin; ``groups`` has (key, bytes)."""
    summary = Summary(groups)
    capacity = summary.minimax(shards)
    return capacity, [summary.cells.rows[k][0] for k in summary.cells.fill(capacity, shards, False)[0]]


def level_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digests at which shards 1, 2, ... begin: no shard above the minimax capacity, every cut as near to its equal share as that allows.

    From the last cut back: any place up to the greedy cut leaves a start that fits, and the next cut must be within the capacity.
    """
    summary = Summary(groups)
    capacity = summary.minimax(shards)
    while True:
        cells, wide = summary.cells, set()
        starts = [0, *cells.ends]
        total, furthest = starts[-1], cells.fill(capacity, shards, False)[0]
        cuts, after = [], total
        for k in range(shards - 1, 0, -1):
            share = total * k / shards
            at = bisect_left(starts, share)
            if at and share - starts[at - 1] <= starts[at] - share:
                at -= 1
            least = bisect_left(starts, after - capacity)
            for place in [share] + [after - capacity] * (starts[at] < after - capacity):
                i = bisect_right(starts, place) - 1
                if 0 <= i < len(cells.rows) and starts[i] < place and cells.rows[i][2] > 1:
                    wide.add(i)
            at = min(max(at, least), furthest[k - 1] if k <= len(furthest) else len(cells.rows))
            cuts.append(at)
            after = starts[at]
        if not wide:
            return [cells.rows[k][0] for k in reversed(cuts) if k < len(cells.rows)]
        summary.refine(wide)


def alone(groups: DataFrame, shards: int) -> list[str]:
    """Digests, in order, of the groups above the mean of the shards that larger groups leave; fewer than ``shards``."""
    left, out = groups.agg(F.sum("bytes")).first()[0] or 0, []
    for key, size in groups.orderBy(F.desc("bytes"), "key").limit(shards).select("key", "bytes").collect():
        if size * (shards - len(out)) <= left:
            break
        out.append(key)
        left -= size
    return sorted(out)


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): equal texts share a shard.

    A group of equal texts above the mean of the shards left is a shard of its own, numbered after the others. These hold contiguous digests; the largest
    of them is as small as that allows and their sizes differ by less than two of their largest groups.
    Null text counts as empty. Slots number the rows of a shard without gaps; their order follows hashes of id and text. Fewer groups than shards leave
    shards empty, an empty table gives no rows, repeated rows each get a slot.
    """
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias(id_col), size_of(text, row_bytes).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest(text).alias("key"))
    groups, path = store(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    n_rows = groups.agg(F.sum("rows")).first()[0] or 0
    groups = groups.select("key", "bytes")
    own = alone(groups, shards)
    cuts = level_cuts(groups.where(~F.col("key").isin(own)), shards - len(own))
    discard(docs.sparkSession, path)
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<string>"), lambda c: F.rpad(c, 64, "0") <= F.col("key")))
    if own:
        place = F.array_position(F.array(*[F.lit(k) for k in own]), F.col("key")).cast("int")
        shard = F.when(place > 0, place + F.lit(shards - len(own) - 1)).otherwise(shard)
    lots = max(1, -(-n_rows // (shards * SLOT_ROWS)))
    rows = rows.withColumn("shard", shard).withColumn("lot", F.pmod(F.xxhash64(id_col, "key"), F.lit(lots)))
    first = rows.groupBy("shard", "lot").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("lot").rowsBetween(W.unboundedPreceding, -1)
    first = first.select("shard", "lot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "lot").orderBy(id_col, "key")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(first, ["shard", "lot"]).select(
        id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
