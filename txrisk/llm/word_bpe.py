"""Word BPE encoding and decoding through a table of distinct words.

Texts lie in chunks (a hash of the id and the length, shuffled once, compressed). A chunk splits its texts into words and asks for its distinct words by bucket;
a bucket encodes every distinct word once and answers with the ids in the order of the question; the chunk joins the ids back by position. Decoding joins
the table of ids and pieces. A frequent word is one entry of a chunk's question however often it stands there, so no bucket grows with its frequency.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from txrisk.llm.byte_bpe import Numbers, _compress, _lists, _pack, _ragged, _unpack
from txrisk.llm.common import text_of, total_bytes

CHUNK_BYTES = 10 << 20
# A chunk asks about this many buckets times the root of the number of chunks: questions stay large and buckets bounded.
BUCKETS = 8
# A bucket forgets its words after so many; a forgotten one is encoded again.
REMEMBERED = 1 << 18
# Rows that are decoded together.
DECODED = 256
# Letters of these blocks have not changed in any version of Unicode that a library may follow.
SETTLED = "ɏ"


class WordTokenizer:
    """What a tokenizer file states: normalization, words pattern, special tokens, vocabulary and ranked merges."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbols = [self.vocab.get(c) for c in byte_letters()]
        self.last = [self.vocab.get(c + self.end) for c in byte_letters()]

    @classmethod
    def read(cls, path: str) -> WordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def pieces(self) -> list[str]:
        """Piece of every id."""
        both = {**self.vocab, **self.special}
        out = [""] * (max(both.values(), default=-1) + 1)
        for piece, i in both.items():
            out[i] = piece
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word: of all neighbours that may merge, the leftmost of the smallest rank merge until none is left."""
        n = len(word)
        ids = [self.symbols[b] for b in word]
        ids[-1] = self.last[word[-1]]
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), self.merges
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        while heap:
            _, i, whole, a, b = heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merges.get((whole, ids[after[i]])):
                    heappush(heap, (m[0], i, m[1], whole, ids[after[i]]))
            p = before[i]
            if p >= 0 and (m := merges.get((ids[p], whole))):
                heappush(heap, (m[0], p, m[1], ids[p], whole))
        return [i for i in ids if i is not None and i >= 0]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


@lru_cache(maxsize=2)
def _normalizer(text: str) -> tuple[Callable[[str], str], Callable[[str], list]]:
    """The file's normalization and words pattern, as the library runs them."""
    from tokenizers import Regex, Tokenizer, pre_tokenizers
    spec = json.loads(text)
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    # the vocabulary is not needed for it
    normal = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}})).normalizer
    return normal.normalize_str, split.pre_tokenize_str


class Splitter:
    """Words of a span: what stands between two ASCII white spaces, which no word and no normalization crosses."""

    def __init__(self, tokenizer: WordTokenizer):
        self.text = tokenizer.text
        self.special = re.compile("|".join(map(re.escape, sorted(tokenizer.special, key=len, reverse=True)))) if tokenizer.special else None
        self.marks = {t[0].encode() for t in tokenizer.special}
        self.ascii = re.compile(tokenizer.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)

    def words(self, span: bytes) -> list[bytes]:
        """Words as bytes; a special token has the byte 0xFF before it, which no other word can hold."""
        if span.isalpha():
            return [span.lower()]
        if span[-1] in b".,;:!?" and span[:-1].isalpha():
            return [span[:-1].lower(), span[-1:]]
        text = span.decode()
        if not any(m in span for m in self.marks) or not self.special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain(text[at:m.start()])
            out.append(b"\xff" + m[0].encode())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[bytes]:
        if text.isascii():
            return [w.encode() for w in self.ascii.findall(text.lower())]
        # no letter of these blocks takes part in a composition unless a combining mark follows, and such a mark is beyond them
        if max(text) <= SETTLED:
            stem, mark = (text[:-1], [text[-1].encode()]) if text[-1] in ".,;:!?" else (text, [])
            if stem.isalpha() and (low := stem.lower()).isalpha() and len(low) == len(stem):
                return [low.encode(), *mark]
        normal, split = _normalizer(self.text)
        return [w.encode() for w, _ in split(normal(text))]


class ChunkSpans:
    """The texts of a chunk as numbers of its distinct spans, which are numbered in the order of their bytes, however the rows are ordered."""

    def __init__(self, table: pa.Table):
        pa.default_memory_pool().release_unused()   # a worker keeps what its earlier chunks needed otherwise
        unpack, spans = zstandard.ZstdDecompressor(), Numbers()
        number = spans.__getitem__
        texts = [np.fromiter(map(number, unpack.decompress(t.as_py()).split()), np.int32) for t in table["text"]]
        self.spans = sorted(spans)
        place = np.empty(len(spans), np.int32)
        place[np.fromiter(map(number, self.spans), np.int64, len(spans))] = np.arange(len(spans), dtype=np.int32)
        self.texts = [place[t] for t in texts]


def _ask(tokenizer, buckets: int):
    def run(keys: tuple, table: pa.Table) -> pa.Table:
        words, parts, lengths, split = Numbers(), [], [], Splitter(tokenizer.value).words
        for span in ChunkSpans(table).spans:
            own = split(span)
            parts += map(words.__getitem__, own)
            lengths.append(len(own))
        named = list(words)
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, named), np.uint64, len(named)) % np.uint64(buckets)
        order = np.array(sorted(range(len(named)), key=named.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        # the spans' words are named by the place of their answer
        place = np.empty(len(named), np.uint32)
        place[order] = np.arange(len(named), dtype=np.uint32)
        # and pass through, under a bucket of their own below zero
        spans = np.uint32(len(lengths)).tobytes() + np.array(lengths, np.uint32).tobytes() + place[np.array(parts, np.int64)].tobytes()
        asked, starts = np.unique(bucket[order], return_index=True)
        packed = [_pack([named[i] for i in own.tolist()]) for own in np.split(order, starts[1:])] if len(order) else []
        return pa.table({"chunk": pa.array([keys[0].as_py()] * (len(packed) + 1), pa.int64()), "bucket": pa.array([*asked.tolist(), -1 - keys[0].as_py()], pa.int64()),
                         "words": pa.array([*packed, zstandard.compress(spans, 3)], pa.binary())})
    return run


def _answer(tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, bucket = tokenizer.value, {}, None
        for batch in batches:
            for chunk, at, blob in zip(batch["chunk"].to_pylist(), batch["bucket"].to_pylist(), batch["words"]):
                if at < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([blob.as_py()], pa.binary())], names=["chunk", "bucket", "ids"])
                    continue
                if at != bucket or len(known) > REMEMBERED:
                    known, bucket = {}, at
                found = []
                for w in _unpack(blob.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = np.array([own.special[w[1:].decode()]] if w[0] == 0xFF else own.encode_word(w), np.uint32)
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                answer = zstandard.compress(np.uint32(len(found)).tobytes() + lengths.tobytes() + np.concatenate(found).tobytes(), 3)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([at], pa.int64()), pa.array([answer], pa.binary())], names=["chunk", "bucket", "ids"])
    return run


def _numbers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists and what is in them."""
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data[:4], np.uint32)[0])
    return np.frombuffer(data[4:4 + 4 * n], np.uint32), np.frombuffer(data[4 + 4 * n:], np.uint32)


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _assemble(keys: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
    """The ids of every text: those of its spans, which are those of their words, which come in the order of the questions."""
    blobs = sorted(zip(answers["bucket"].to_pylist(), answers["ids"].to_pylist()))
    n_parts, parts = _numbers(blobs[0][1])
    found = [_numbers(b) for _, b in blobs[1:]] or [(np.zeros(0, np.uint32), np.zeros(0, np.uint32))]
    ids, ends = _ragged(np.concatenate([v for _, v in found]), _ends(np.concatenate([n for n, _ in found])), parts)
    at = ends[_ends(n_parts)]
    rows = [_ragged(ids, at, t)[0] for t in ChunkSpans(table).texts]
    return pa.table({"id": table["id"], "ids": _lists(np.concatenate(rows).astype(np.int32), _ends(np.array([len(r) for r in rows])))})


def encode_words(docs: DataFrame, tokenizer: WordTokenizer, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, ids): token ids of every whole text, special tokens recognised where their strings stand, none added.

    Null text counts as empty and gives an empty list; rows that repeat an id, and rows without one, are all encoded; an empty table gives no rows; other
    columns are not read. A task holds the distinct words of a chunk or up to ``REMEMBERED`` of a bucket, never those of the corpus.
    """
    size = total_bytes(docs, text_col)
    chunks = max(12, -(-size // chunk_bytes))
    buckets = max(12, round(BUCKETS * chunks ** 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)   # bounded by the vocabulary
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).cast("binary").alias("text"))
    # the length and a digest of the text spread rows that repeat an id
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text"), F.crc32("text")), F.lit(chunks)))
    packed = rows.mapInArrow(_compress, "id long, chunk long, text binary")
    asked = packed.groupBy("chunk").applyInArrow(_ask(shared, buckets), "chunk long, bucket long, words binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(shared), "chunk long, bucket long, ids binary")
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_assemble, "id long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_words(encoded: DataFrame, tokenizer: WordTokenizer, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids: their pieces, special ones too, joined by one space.

    The table of ids and pieces, one row per id, is bounded by the vocabulary: every task holds it and joins it to the ids of a batch. An id
    without a piece, or no list, gives null.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(tokenizer.pieces())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.string())
        for batch in (whole.slice(i, DECODED) for whole in batches for i in range(0, len(whole), DECODED)):
            lists = batch[ids_col].cast(pa.large_list(pa.int32()))
            ids = lists.flatten()
            ids = pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(table))), ids, None)
            # a list with an id that has no piece has a null in it, which makes the whole text null
            ends = pc.subtract(lists.offsets, lists.offsets[0])
            text = pc.binary_join(pa.LargeListArray.from_arrays(ends, table.take(ids)), " ")
            if lists.null_count:
                text = pc.if_else(lists.is_valid(), text, None)
            yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], schema=batch.schema.append(pa.field(into, pa.string())))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema), f"`{into}` string"])
    return encoded.mapInArrow(join, schema)
