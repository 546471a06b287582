"""Exact duplicates by Patricia-trie owners.

Texts are partitioned by byte length and content hash. Inside a partition a compressed radix trie holds whole byte strings under their
hash; a terminal node keeps the owner of its text and the number of copies. Tries run twice: over each task's own rows first, so that a
text of many copies leaves a task once, then over what is left of every partition.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txrisk.llm.common import text_of

# Bytes of text that a task holds in its trie before it emits (first pass) or spills a subtree (second pass).
TRIE_BYTES = 48 << 20
PART = "len long, hash long, text binary, owner long, copies long"
OWNERS = "text_sha256 string, keep_id long, group_size long"


class RadixTrie:
    """Compressed trie over byte strings. Nodes are [label, children by first byte, owner, copies]; copies is 0 inside."""

    def __init__(self, largest: bool):
        self.root = [b"", {}, None, 0]
        self.better = max if largest else min
        self.bytes = 0

    def insert(self, key: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None, 0]
                self.bytes += len(key) - at + 200
                node = child
                break
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            middle = [label[:same], {label[same]: child}, None, 0]
            child[0] = label[same:]
            node[1][key[at]] = middle
            self.bytes += 200
            node, at = middle, at + same
        if owner is not None:
            node[2] = owner if node[2] is None else self.better(node[2], owner)
        node[3] += copies

    def items(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """(key, owner, copies) of every terminal node, of one branch of the root if ``first`` names it."""
        if first is None and self.root[3]:
            yield b"", self.root[2], self.root[3]
        stack = [(b"", n) for n in ([self.root[1][first]] if first is not None else self.root[1].values())]
        while stack:
            before, node = stack.pop()
            key = before + node[0]
            if node[3]:
                yield key, node[2], node[3]
            stack.extend((key, n) for n in node[1].values())


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by bisection on slices."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _first_pass(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(largest)
        for batch in batches:
            for i, h, text in zip(batch["id"].to_pylist(), batch["hash"].to_pylist(), batch["text"]):
                trie.insert(_key(h, text.as_py()), i, 1)
                if trie.bytes > TRIE_BYTES:
                    yield from _parts(trie)
                    trie = RadixTrie(largest)
        yield from _parts(trie)
    return run


def _key(h: int, text: bytes) -> bytes:
    return h.to_bytes(8, "big", signed=True) + text


def _parts(trie: RadixTrie) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(trie.items(), 4 << 20):
        yield pa.RecordBatch.from_arrays([
            pa.array([len(k) - 8 for k, _, _ in rows], pa.int64()), pa.array([int.from_bytes(k[:8], "big", signed=True) for k, _, _ in rows], pa.int64()),
            pa.array([k[8:] for k, _, _ in rows], pa.binary()), pa.array([o for _, o, _ in rows], pa.int64()),
            pa.array([n for _, _, n in rows], pa.int64())], names=["len", "hash", "text", "owner", "copies"])


def _grouped(items, most: int):
    rows, size = [], 0
    for item in items:
        rows.append(item)
        size += len(item[0])
        if size >= most or len(rows) >= 20_000:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def owners_of(entries, largest: bool, limit: int = TRIE_BYTES, depth: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
    """Owner and copies of every distinct key; the largest subtree goes to a file when the trie outgrows ``limit``.

    A spilled subtree holds the keys of one byte value at ``depth``; it is read back alone, with one byte more to split on.
    """
    trie, spilled, weight = RadixTrie(largest), {}, {}
    for key, owner, copies in entries:
        first = key[depth] if depth < len(key) else -1
        if first in spilled:
            pickle.dump((key, owner, copies), spilled[first])
            continue
        before = trie.bytes
        trie.insert(key[depth:], owner, copies)
        weight[first] = weight.get(first, 0) + trie.bytes - before
        if trie.bytes > limit and len(weight) > 1:
            worst = max((w, f) for f, w in weight.items() if f >= 0)[1]
            spilled[worst] = tempfile.TemporaryFile()
            for rest, o, n in trie.items(worst):
                pickle.dump((key[:depth] + rest, o, n), spilled[worst])
            del trie.root[1][worst]
            trie.bytes -= weight.pop(worst)
    prefix = None
    for rest, o, n in trie.items():
        prefix = key[:depth] if prefix is None else prefix
        yield prefix + rest, o, n
    del trie
    for file in spilled.values():
        file.seek(0)
        yield from owners_of(_unpickled(file), largest, limit, depth + 1)
        file.close()


def _unpickled(file):
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _second_pass(largest: bool, limit: int):
    def entries(batches):
        for batch in batches:
            for h, text, o, n in zip(batch["hash"].to_pylist(), batch["text"], batch["owner"].to_pylist(), batch["copies"].to_pylist()):
                yield _key(h, text.as_py()), o, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(owners_of(entries(batches), largest, limit), 4 << 20):
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.sha256(k[8:]).hexdigest() for k, _, _ in rows]), pa.array([o for _, o, _ in rows], pa.int64()),
                pa.array([n for _, _, n in rows], pa.int64())], names=["text_sha256", "keep_id", "group_size"])
    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: (text_sha256, keep_id, group_size)."""
    largest = keep == "largest"
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    parts = rows.mapInArrow(_first_pass(largest), PART)
    return parts.repartition("len", "hash").mapInArrow(_second_pass(largest, trie_bytes), OWNERS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every row with its owner: (id, keep_id, group_size, kept, text_sha256, *extra).

    Null text counts as empty. Of equal texts the smallest (or largest) id stays; rows that repeat id and text are all marked as kept;
    a null id never wins over another one. Columns named in ``extra`` pass through. An empty table gives no rows.
    """
    table = owners(docs, id_col, text_col, keep)
    rows = docs.select(docs[id_col].alias(id_col), F.sha2(text_of(docs, text_col), 256).alias("text_sha256"), *[docs[c] for c in extra])
    # both sides are plain exchanges: AQE splits the partition of a text that very many rows share
    return rows.join(table, "text_sha256").select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
                                                  "text_sha256", *extra)
