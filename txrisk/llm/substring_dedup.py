"""Repeated passages by difference-cover anchors.

Word positions of a document that fall into a difference cover modulo a period are anchors. For any two equal windows there is a shift below the
period at which both positions are cover positions, so equal windows always share an anchor of ``window - period + 1`` words. Anchors that occur in two
documents are found first, from short hashes; only windows around such anchors are hashed whole, and the smallest document of each is found.

Documents lie in chunks (a hash of id and text, so that many rows of one id or of none spread), shuffled once and read three times: anchors, windows, removal. What chunks exchange are hash lists packed by bucket,
without repeats, so that a passage of very many copies counts once per chunk.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.llm.common import text_of, total_bytes

WINDOW = 13
# A perfect difference cover: every residue modulo 7 is a difference of two of its elements.
PERIOD, COVER = 7, (1, 2, 4)
CHUNK_BYTES = 8 << 20
# Text bytes per bucket of anchors; a bucket holds about a thirteenth as many anchors.
BUCKET_BYTES = 4 << 20
SLICE = 4 << 20
MISSING = (1 << 63) - 1
SPREAD = 0x9E3779B97F4A7C15


def word_hashes(data: bytes) -> np.ndarray:
    """128-bit hashes of the words between ASCII white space, as two columns; long texts are cut at white space first."""
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        parts.append(b"".join(map(xxhash.xxh3_128_digest, data[at:end].split())))
        at = end
    return np.frombuffer(b"".join(parts), "<u8").reshape(-1, 2)


def _combined(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive words from each start."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out += words[starts + k] * np.uint64(pow(SPREAD, k, 1 << 64))
    return out ^ (out >> np.uint64(29))


class Chunk:
    """The documents of a chunk: words end to end, ``doc[i]`` the row of word i."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = np.array([MISSING if x is None else x for x in table["id"].to_pylist()], np.int64)
        hashes = [word_hashes(t.as_py()) for t in table["text"]]
        self.lengths = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate(hashes) if hashes else np.empty((0, 2), np.uint64)
        self.low, self.high = np.ascontiguousarray(self.words[:, 0]), np.ascontiguousarray(self.words[:, 1])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.at = np.arange(len(self.row)) - self.first[self.row]
        self.left = self.lengths[self.row] - self.at
        self.window = window

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys (bucket, 32 bits) of the anchors of documents that have a window."""
        width = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.at % PERIOD, COVER) & (self.left >= width) & (self.lengths[self.row] >= self.window))
        h = _combined(self.low, at, width)
        return at, (((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """96-bit hashes of whole windows."""
        out = np.empty(len(starts), [("h", "<u8"), ("g", "<u4")])
        out["h"], out["g"] = _combined(self.low, starts, self.window), _combined(self.high, starts, self.window) & np.uint64(0xFFFFFFFF)
        return out


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def _packed(chunk: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per bucket with the values of each column as bytes; ``bucket`` is sorted."""
    starts = _runs(bucket)
    ends = np.append(starts[1:], len(bucket))
    return pa.table({"chunk": pa.array(np.full(len(starts), chunk), pa.int64()), "bucket": pa.array(bucket[starts].astype(np.int64), pa.int64()),
                     **{c: pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()) for c, v in columns.items()}})


def _emit_anchors(buckets: int, window: int):
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        at, key = chunk.anchors(buckets)
        doc = chunk.ids[chunk.row[at]]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        starts = _runs(key)
        several = (np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)) if len(starts) else np.empty(0, bool)
        key = key[starts]
        return _packed(keys[0].as_py(), key >> np.uint64(32), {"keys": key.astype(np.uint32), "several": several.astype(np.uint8)})
    return run


def _shared_anchors(keys: tuple, table: pa.Table) -> pa.Table:
    """Anchors of a bucket that two documents have, for each chunk that has them."""
    lists = [np.frombuffer(b.as_py(), np.uint32) for b in table["keys"]]
    flags = [np.frombuffer(b.as_py(), np.uint8) for b in table["several"]]
    every, times = np.unique(np.concatenate(lists), return_counts=True)
    several = np.unique(np.concatenate([k[f > 0] for k, f in zip(lists, flags)]))
    shared = np.union1d(every[times > 1], several)
    hits = [k[np.isin(k, shared, assume_unique=True)] for k in lists]
    keep = [i for i, h in enumerate(hits) if len(h)]
    return pa.table({"chunk": pa.array([table["chunk"][i].as_py() for i in keep], pa.int64()), "bucket": pa.array([keys[0].as_py()] * len(keep), pa.int64()),
                     "keys": pa.array([hits[i].tobytes() for i in keep], pa.binary())})


def _emit_windows(buckets: int, window: int):
    def run(keys: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        known = np.concatenate([np.frombuffer(k.as_py(), np.uint32).astype(np.uint64) | np.uint64(b.as_py() << 32)
                                for k, b in zip(shared["keys"], shared["bucket"])] or [np.empty(0, np.uint64)])
        at, key = chunk.anchors(buckets)
        at = at[np.isin(key, known)]
        near = np.zeros(len(chunk.row) + 1, np.int64)
        np.add.at(near, np.maximum(at - PERIOD + 1, chunk.first[chunk.row[at]]), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (chunk.left >= window))
        hashes, doc = chunk.windows(starts), chunk.ids[chunk.row[starts]]
        bucket = (hashes["h"] >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((hashes["g"], hashes["h"], bucket))
        hashes, doc, bucket = hashes[order], doc[order], bucket[order]
        runs = _runs(hashes)
        low = np.minimum.reduceat(doc, runs) if len(runs) else doc[:0]
        high = np.maximum.reduceat(doc, runs) if len(runs) else doc[:0]
        return _packed(keys[0].as_py(), bucket[runs], {"hashes": hashes[runs], "low": low, "several": (low != high).astype(np.uint8)})
    return run


def _first_documents(keys: tuple, table: pa.Table) -> pa.Table:
    """The smallest document of every window of a bucket, for each chunk that has a later one."""
    kind = np.dtype([("h", "<u8"), ("g", "<u4")])
    lists = [np.frombuffer(b.as_py(), kind) for b in table["hashes"]]
    lows = [np.frombuffer(b.as_py(), np.int64) for b in table["low"]]
    several = [np.frombuffer(b.as_py(), np.uint8) for b in table["several"]]
    every, low = np.concatenate(lists), np.concatenate(lows)
    order = np.lexsort((low, every["g"], every["h"]))
    runs = _runs(every[order])
    smallest = np.empty(len(every), np.int64)
    smallest[order] = np.repeat(low[order][runs], np.diff(np.append(runs, len(every))))
    out, at = {"chunk": [], "hashes": [], "low": []}, 0
    for c, h, mine, more in zip(table["chunk"].to_pylist(), lists, lows, several):
        best = smallest[at:at + len(h)]
        at += len(h)
        hit = (best < mine) | (more > 0)
        if hit.any():
            out["chunk"].append(c)
            out["hashes"].append(h[hit].tobytes())
            out["low"].append(best[hit].tobytes())
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()), "hashes": pa.array(out["hashes"], pa.binary()), "low": pa.array(out["low"], pa.binary())})


def _remove(window: int, with_text: bool):
    kind = np.dtype([("h", "<u8"), ("g", "<u4")])

    def run(keys: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        hashes = np.concatenate([np.frombuffer(b.as_py(), kind) for b in known["hashes"]] or [np.empty(0, kind)])
        low = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in known["low"]] or [np.empty(0, np.int64)])
        order = np.lexsort((hashes["g"], hashes["h"]))
        hashes, low = hashes[order], low[order]
        starts = np.flatnonzero(chunk.left >= window)
        if len(hashes):
            starts = starts[np.isin(_combined(chunk.low, starts, window), hashes["h"])]
            mine = chunk.windows(starts)
            # the few windows left are looked up by the whole hash
            first = dict(zip(hashes.tolist(), low.tolist()))
            best = np.array([first.get(m, MISSING) for m in mine.tolist()], np.int64)
            starts = starts[best < chunk.ids[chunk.row[starts]]]
        else:
            starts = starts[:0]
        cover = np.zeros(len(chunk.row) + 1, np.int64)
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + window, -1)
        stays = np.cumsum(cover[:-1]) == 0
        texts = []
        for t, a, n in zip(table["text"], chunk.first.tolist(), chunk.lengths.tolist()):
            texts.append(b" ".join(compress(t.as_py().split(), stays[a:a + n].tolist())))
        removed = np.add.reduceat(np.append(~stays, False), np.minimum(chunk.first, len(stays))) if len(chunk.first) else chunk.first
        removed = np.where(chunk.lengths > 0, removed, 0)
        out = {"id": table["id"], "n_words": pa.array(chunk.lengths), "n_removed": pa.array(removed.astype(np.int64)),
               "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        return pa.table(out | ({"kept": pa.array([t.decode() for t in texts], pa.string())} if with_text else {}))
    return run


def chunk_of(chunks: int) -> Column:
    return F.pmod(F.xxhash64("id", "text"), F.lit(chunks))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): words covered by a window that also starts in a document of a smaller id are gone.

    Words are what lies between ASCII white space; windows are judged on the input. Null text has no words. Rows that repeat an id count as one document
    to each other and are all returned; a null id counts as the largest. Texts of fewer than ``window`` words stay whole. An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"window must have at least {PERIOD} words")
    size = total_bytes(docs, text_col)
    chunks, buckets = max(16, -(-size // CHUNK_BYTES)), max(16, -(-size // BUCKET_BYTES))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = rows.withColumn("chunk", chunk_of(chunks))
    by_chunk = lambda: rows.groupBy("chunk")  # noqa: E731  the same exchange each time, run once
    anchors = by_chunk().applyInArrow(_emit_anchors(buckets, window), "chunk long, bucket long, keys binary, several binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors, "chunk long, bucket long, keys binary")
    windows = by_chunk().cogroup(shared.groupBy("chunk")).applyInArrow(_emit_windows(buckets, window), "chunk long, bucket long, hashes binary, low binary, several binary")
    known = windows.groupBy("bucket").applyInArrow(_first_documents, "chunk long, hashes binary, low binary")
    out = by_chunk().cogroup(known.groupBy("chunk")).applyInArrow(_remove(window, with_text), "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
    return out.withColumnRenamed("id", id_col)
