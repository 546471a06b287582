"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a nonzero code of ``radius + 1`` bits. Each nonzero vector v gives a table that keeps the positions whose code has an odd inner
product with v. At most ``radius`` differing positions have at most ``radius`` codes, and some nonzero v is orthogonal to all of them: the
table of that v keeps no differing bit, so every pair within the radius meets there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from txrisk.llm.common import components, store, text_of

BITS = 64
SEED = 42
# Members of a table bucket that are compared in one piece; a larger bucket is compared piece against piece in many tasks.
PIECE = 4096


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words (A-Z lower-cased, split at ASCII white space), repeats included; shorter texts give one run."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:n - 1].tolist()]
    stops = (ends[min(width, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, text_sha256, fp): the 64-bit fingerprint as a signed long; no words give zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["text_sha256"], pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())],
                                             names=["id", "text_sha256", "fp"])
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    return rows.mapInArrow(run, "id long, text_sha256 string, fp long")


def masks(radius: int) -> list[int]:
    """The masks of all tables as signed longs; position i has code 1 + i mod (2^(radius+1) - 1)."""
    top = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, top + 1):
        bits = sum(1 << i for i in range(BITS) if (v & (1 + i % top)).bit_count() % 2)
        out.append(bits - (1 << 64) if bits >> 63 else bits)
    return out


def links(distinct: DataFrame, radius: int = 4, piece: int = PIECE) -> DataFrame:
    """Edges (a, b) between fingerprints at most ``radius`` bits apart that connect what all such pairs connect.

    ``distinct`` has one row per fingerprint (``fp``). Each table bucket gives the star edges of its own components, not its pairs. Buckets of
    one are dropped; larger ones than ``piece`` are dealt as pairs of pieces, so that none is gathered in a task.
    """
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks(radius))]))
    rows = distinct.select("fp", table.alias("e")).select(F.col("e.t").alias("t"), F.col("e.k").alias("k"), "fp")
    counts = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    # sorted and merged at every size: Spark takes an explode for one row a row, so it would broadcast tables many times its threshold
    rows = rows.join(counts.hint("merge"), ["t", "k"]).withColumn("pieces", F.ceil(F.col("n") / piece).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j")))
    dealt = rows.select("t", "k", "fp", F.explode(pair).alias("p"))
    dealt = dealt.groupBy("t", "k", "p")

    def connect(keys: tuple, table: pa.Table) -> pa.Table:
        fps = np.unique(table["fp"].to_numpy()).view(np.uint64)
        a, b = star_edges(fps, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})
    return dealt.applyInArrow(connect, "a long, b long").distinct()


def star_edges(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest member of each component to its other members; a search only looks at members not reached yet."""
    rest, a, b = np.sort(fps.view(np.int64)).view(np.uint64), [], []
    while len(rest) > 1:
        seed, rest, queue = rest[0], rest[1:], [rest[0]]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                queue.extend(found)
                b.append(found)
                a.append(np.full(len(found), seed))
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def simhash_groups(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                   with_digest: bool = False) -> DataFrame:
    """(id, fingerprint, component_id[, text_sha256]): one row per document with the smallest id reachable over links of at most ``radius`` differing bits.

    Null text counts as empty; texts without words have fingerprint zero and link like any other. Rows that repeat an id each count; a null id never
    names a component unless it has no other. An empty table gives no rows.
    """
    prints = fingerprints(docs, id_col, text_col, width)
    prints, _ = store(prints if with_digest else prints.drop("text_sha256"), "simhash")
    distinct, _ = store(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes, _ = store(named.select("fp", "root").join(lows, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                                             *["text_sha256"] * with_digest)
