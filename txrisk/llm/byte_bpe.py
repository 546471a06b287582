"""Byte-level BPE encoding and decoding.

Spark's higher-order functions fold the ranked merges over the byte arrays of distinct words, with the ranks of all mergeable pairs in a literal map. The
words reach that fold once each: documents lie in chunks (a hash of the id, shuffled once, compressed), a chunk sends its distinct words by
bucket, each bucket folds what is new to it and answers every chunk with the ids in the order of the question. Decoding joins the pieces of the ids.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txrisk.llm.common import text_of, total_bytes

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 16 << 20
WIDTH = 1 << 20
# Longer words are merged in the task by the same rule: array folding copies the word once per merge.
FOLD_BYTES = 128


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a rank file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# ------------------------------------------------------------------------------------------------ words

@lru_cache(maxsize=1)
def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as character classes of the re module."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)

    def ranges(pattern: str) -> str:
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for run in regex.finditer(pattern, every) for m in _consecutive(run[0]))
    return ranges(r"\p{L}+"), ranges(r"\p{N}+"), ranges(r"\s+")


def _consecutive(run: str) -> Iterator[tuple[str]]:
    """A run over the list of all characters is consecutive but for the surrogate gap."""
    at = next((i for i in range(1, len(run)) if ord(run[i]) != ord(run[i - 1]) + 1), len(run))
    yield (run[:at],)
    if at < len(run):
        yield (run[at:],)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> re.Pattern:
    """The words pattern for the re module: the property classes are written out, which runs faster than the regex module."""
    letters, numbers, space = _classes()
    inside = {r"[^\s\p{L}\p{N}]": f"[^{space}{letters}{numbers}]", r"\p{L}": f"[{letters}]", r"\p{N}": f"[{numbers}]", r"\S": f"[^{space}]", r"\s": f"[{space}]"}
    return re.compile("".join(inside.get(t, t) for t in re.split(r"(\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{L\}|\\p\{N\}|\\S|\\s)", pattern)))


@lru_cache(maxsize=1)
def _gap() -> re.Pattern:
    space = _classes()[2]
    return re.compile(f"(?<=[^{space}]) (?=[^{space}])")


class Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _ragged(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``pick`` of a list array, end to end, with their offsets."""
    lengths = offsets[pick + 1] - offsets[pick]
    out = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.arange(out[-1]) + np.repeat(offsets[pick] - out[:-1], lengths)], out


class ChunkWords:
    """The words of a chunk's texts: distinct ones by number, and every text as numbers.

    A text is cut before each single space between two characters that are no white space, which no word of the pattern crosses; only
    distinct spans are then split into words.
    """

    def __init__(self, texts: pa.Array, pattern: str):
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        named, ids, ends = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), cut.offsets.to_numpy().astype(np.int64)
        # str.isspace holds for all white space of the pattern and a little more; such texts are cut by the exact rule instead
        after = np.array([not x or x[-1].isspace() for x in named], bool)
        before = np.array([not x or x[0].isspace() for x in named], bool)
        broken = after[ids[:-1]] | before[ids[1:]]
        broken[ends[1:-1] - 1] = False
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(broken), "right") - 1)
        # the span that begins a text has no blank before it and is kept apart
        first = Numbers()
        heads = np.array([first[named[i]] for i in ids[ends[:-1]].tolist()], np.int64)
        ids[ends[:-1]] = heads + len(named)
        spans = np.split(ids, ends[1:-1])
        more = Numbers()
        for i in odd.tolist():
            head, *rest = _gap().split(texts[i].as_py())
            spans[i] = np.array([more[(head,)], *map(more.__getitem__, rest)], np.int64) + len(named) + len(first)
        self.spans = [*named, *((x,) for x in first), *more]
        self.words, parts, offsets = Numbers(), [], [0]
        find, number = splitter(pattern).findall, self.words.__getitem__
        for x in self.spans:
            if isinstance(x, tuple):
                parts += map(number, find(x[0]))
            elif x.isalpha():
                parts.append(number(" " + x))
            elif x[-1:] in (".", ",") and x[:-1].isalpha():
                parts += (number(" " + x[:-1]), number(x[-1]))
            else:
                parts += map(number, find(" " + x))
            offsets.append(len(parts))
        self.parts, self.offsets = np.array(parts, np.int32), np.array(offsets, np.int64)
        self.texts = spans

    def by_bucket(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct words as bytes, and their order and buckets by (bucket, hash, bytes)."""
        raw = [w.encode() for w in self.words]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        bucket, order = hashes % np.uint64(buckets), np.argsort(hashes, kind="stable")
        if (hashes[order[1:]] == hashes[order[:-1]]).any():
            order = np.array(sorted(range(len(raw)), key=lambda i: (hashes[i], raw[i])), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        return raw, order, bucket[order]


# ------------------------------------------------------------------------------------------------ merges

def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank of every pair of tokens whose bytes together are a token."""
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _prime(n: int) -> int:
    """The first prime from n on."""
    while any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def rank_slots(pairs: dict[int, int]) -> tuple[list[int], list[int], int]:
    """A literal rank map without search: (shifts, slots, step). Key k lies in the slot (k % slots + shift * (k % step + 1)) % slots with the shift of k % shifts."""
    n = _prime(max(7, len(pairs) * 4 // 3))
    step, groups = _prime(n // 2), _prime(max(5, n // 5))
    together: list[list[int]] = [[] for _ in range(groups)]
    for k in pairs:
        together[k % groups].append(k)
    shifts, slots = [0] * groups, [-1] * n
    for g in sorted(range(groups), key=lambda g: -len(together[g])):
        own = together[g]
        shift = next((d for d in range(n) if len(at := {(k % n + d * (k % step + 1)) % n for k in own}) == len(own) and all(slots[i] < 0 for i in at)), None)
        if shift is None:
            raise ValueError("no shift for a group of pairs")
        shifts[g] = shift
        for k in own:
            slots[(k % n + shift * (k % step + 1)) % n] = k * WIDTH + pairs[k]
    return shifts, slots, step


def folded(symbols: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of a word from the ids of its bytes: the leftmost pair of the smallest rank merges until none is left.

    The rank map is one literal, bound once and read by all lookups, since every plan that shows it costs the driver its length.
    """
    shifts, slots, step = rank_slots({a * WIDTH + b: r for (a, b), r in pair_ranks(ranks).items()})
    starts = [ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
    place = {ranks[bytes([b])]: b for b in range(256)}
    size, groups = len(slots), len(shifts)
    literal = F.from_json(F.lit(json.dumps({"shifts": shifts, "slots": slots, "starts": starts, "bytes": [place.get(i) for i in range(max(place) + 1)]}, separators=(",", ":"))),
                          "struct<shifts:array<int>,slots:array<bigint>,starts:array<int>,bytes:array<int>>")
    del shifts, slots, starts
    none = F.array().cast("array<bigint>")

    def word(table: Column) -> Column:
        def rank(k: Column) -> Column:
            slot = (k % size + F.get(table["shifts"], (k % groups).cast("int")) * (k % step + 1)) % size
            return _let(F.get(table["slots"], slot.cast("int")), lambda e: F.when(F.shiftright(e, 20) == k, e.bitwiseAND(WIDTH - 1).cast("int")))

        def merge(s: Column, r: Column, m: Column, k: Column) -> Column:
            left = F.when(k > 1, F.array(F.get(s, k - 2).cast("bigint") * WIDTH + m)).otherwise(none)
            right = F.when(k < F.size(r), F.array(m.cast("bigint") * WIDTH + F.get(s, k + 1))).otherwise(none)
            return F.struct(F.concat(F.slice(s, 1, k - 1), F.array(m), F.slice(s, k + 2, F.size(s))).alias("s"),
                            F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), F.transform(F.concat(left, right), rank), F.slice(r, k + 2, F.size(r))).alias("r"))

        def step_(state: Column, _: Column) -> Column:
            s, r = state["s"], state["r"]
            return _let(F.array_min(r), lambda m: F.when(m.isNull(), state).otherwise(
                _let(F.array_position(r, m).cast("int"), lambda k: merge(s, r, m, k))))
        first = lambda i: F.get(table["starts"], F.get(table["bytes"], F.get(symbols, i - 1)) * 256 + F.get(table["bytes"], F.get(symbols, i)))
        pairs = F.transform(F.sequence(F.lit(1), F.size(symbols) - 1), first)
        start = F.struct(symbols.alias("s"), pairs.alias("r"))
        return F.aggregate(F.sequence(F.lit(2), F.size(symbols)), start, step_, lambda state: state["s"])
    return F.when(F.size(symbols) < 2, symbols).otherwise(_let(literal, word))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one long word: a heap of pairs over a linked list."""
    from heapq import heapify, heappop, heappush
    n = len(word)
    parts, after, before = [word[i:i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, p) for i in range(n - 1) if (p := word[i:i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, whole = heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], after[i] = whole, None, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (p := parts[a] + parts[after[a]]) in ranks:
                heappush(heap, (ranks[p], a, p))
    return [ranks[p] for p in parts if p is not None]


# ------------------------------------------------------------------------------------------------ encoding

def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["id"], batch["chunk"], pa.array([pack.compress(t.as_py()) for t in batch["text"]], pa.binary())], names=["id", "chunk", "text"])


def _texts(table: pa.Table) -> pa.Array:
    pa.default_memory_pool().release_unused()   # a worker keeps what its earlier chunks needed otherwise
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(t.as_py()) for t in table["text"]], pa.large_binary()).cast(pa.large_string())


def _pack(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words), 3)


def _unpack(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    ends = np.cumsum(np.frombuffer(data[4:4 + 4 * n], np.uint32), dtype=np.int64) + 4 + 4 * n
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist())]


def _ask(pattern: str, buckets: int):
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        raw, order, bucket = ChunkWords(_texts(table), pattern).by_bucket(buckets)
        names, starts = np.unique(bucket, return_index=True)
        packed = [_pack([raw[i] for i in own.tolist()]) for own in np.split(order, starts[1:])] if len(order) else []
        return pa.table({"chunk": pa.array([keys[0].as_py()] * len(packed), pa.int64()), "bucket": pa.array(names.astype(np.int64)), "words": pa.array(packed, pa.binary())})
    return run


def _lists(values: np.ndarray, offsets: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=None if missing is None else np.append(missing, False)), pa.array(values, pa.int32()))


def _distinct(ranks: dict[bytes, int]):
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        words = sorted(set().union(*(_unpack(b.as_py()) for b in table["words"])))
        known = [[ranks[w]] if w in ranks else merged(w, ranks) if len(w) > FOLD_BYTES else None for w in words]
        done = np.array([k is not None for k in known])
        offsets = np.concatenate([[0], np.cumsum(np.where(done, 0, np.fromiter(map(len, words), np.int64, len(words))))])
        symbols = single[np.frombuffer(b"".join(w for w, k in zip(words, known) if k is None), np.uint8)]
        return pa.table({"bucket": pa.array(np.full(len(words), keys[0].as_py()), pa.int64()), "word": pa.array(words, pa.binary()),
                         "symbols": _lists(symbols, offsets, done), "known": pa.array(known, pa.list_(pa.int32()))})
    return run


def _answer(keys: tuple, asked: pa.Table, found: pa.Table) -> pa.Table:
    ids = found["ids"].combine_chunks()
    values, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int64)
    number, blobs = {w: i for i, w in enumerate(found["word"].to_numpy().tolist())}, []
    for blob in asked["words"]:
        pick = np.array([number[w] for w in _unpack(blob.as_py())], np.int64)
        flat, ends = _ragged(values, offsets, pick)
        blobs.append(zstandard.compress(np.uint32(len(pick)).tobytes() + np.diff(ends).astype(np.uint32).tobytes() + flat.astype(np.int32).tobytes(), 3))
    return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "ids": pa.array(blobs, pa.binary())})


def _assemble(pattern: str, buckets: int):
    def run(keys: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = ChunkWords(_texts(table), pattern)
        _, order, _ = chunk.by_bucket(buckets)
        lengths, values = [], []
        for _, blob in sorted(zip(answers["bucket"].to_pylist(), answers["ids"].to_pylist())):
            data = zstandard.decompress(blob)
            n = int(np.frombuffer(data[:4], np.uint32)[0])
            lengths.append(np.frombuffer(data[4:4 + 4 * n], np.uint32))
            values.append(np.frombuffer(data[4 + 4 * n:], np.int32))
        if not lengths:
            return pa.table({"id": table["id"], "ids": pa.array([[]] * len(table), pa.list_(pa.int32()))})
        # the answers come in the order of the question: back to the numbers of the words, then spans, then texts
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, at = _ragged(np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)]), place)
        per_span, ends = _ragged(ids, at, chunk.parts)
        span_at = ends[chunk.offsets]
        rows = [_ragged(per_span, span_at, own)[0] for own in chunk.texts]
        return pa.table({"id": table["id"], "ids": _lists(np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))})
    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, ids): token ids of every whole text, each match of ``pattern`` by itself, without special tokens.

    Null text counts as empty and gives an empty list; rows that repeat an id are all encoded; an empty table gives no rows. ``ranks`` must hold all
    single bytes. The distinct words of a chunk, not of the corpus, are held by a task:
    a smaller ``chunk_bytes`` takes less memory and moves more words.
    """
    size = total_bytes(docs, text_col)
    chunks, buckets = max(12, -(-size // chunk_bytes)), max(12, -(-size // BUCKET_BYTES))
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text")), F.lit(chunks)))
    packed = rows.mapInArrow(_compress, "id long, chunk long, text binary")
    asked = packed.groupBy("chunk").applyInArrow(_ask(pattern, buckets), "chunk long, bucket long, words binary")
    distinct = asked.groupBy("bucket").applyInArrow(_distinct(ranks), "bucket long, word binary, symbols array<int>, known array<int>")
    found = distinct.select("bucket", "word", F.coalesce("known", folded(F.col("symbols"), ranks)).alias("ids"))
    answers = asked.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_answer, "chunk long, bucket long, ids binary")
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assemble(pattern, buckets), "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decoded(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a list of ids: the pieces of the ids, from a literal list, put together. An id without a piece gives null."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, r in ranks.items():
        pieces[r] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    # a missing piece leaves a character that is no hexadecimal digit
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), "", "?"))
