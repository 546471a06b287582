"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax on that mean gives the languages. Both are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows. A held-back part of the sample calibrates the probabilities with one temperature
and sets the score under which a text counts as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

# Documented bounds of the sample that the fit may see: rows, n-grams per row (drawn by hash from the whole text), n-grams per row and step.
SAMPLE_ROWS = 4000
ROW_GRAMS = 8192
STEP_GRAMS = 256
BUCKETS = 1 << 16
SIZE = 16
GRAMS = (1, 2, 3, 4)
BLOCK = 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _gram_buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of one stretch; white space and ASCII punctuation count as one blank, A-Z as lower case."""
    for n in GRAMS:
        if len(data) >= n:
            code = np.full(len(data) - n + 1, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ data[k:len(data) - n + 1 + k]
            code *= np.uint32(0x9E3779B1)
            yield code >> np.uint32(32 - 16)


_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def stretches(text: str) -> Iterator[np.ndarray]:
    """The folded bytes of the whole text, in blocks that overlap by what an n-gram needs."""
    data = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, len(data), BLOCK):
        yield _FOLD[data[max(0, at - max(GRAMS) + 1):at + BLOCK]]


def drawn_grams(text: str, most: int = ROW_GRAMS) -> np.ndarray:
    """Buckets of the text's n-grams in their order; of more than ``most``, those with the smallest hashes of their number. Memory is bounded by a block."""
    kept, at, n = np.zeros(0, np.uint16), np.zeros(0, np.uint64), 0
    for data in stretches(text):
        for buckets in _gram_buckets(data):
            kept = np.concatenate([kept, buckets.astype(np.uint16)])
            at = np.concatenate([at, np.arange(n, n + len(buckets), dtype=np.uint64)])
            n += len(buckets)
            if len(kept) > most:
                draw = (at + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                draw = (draw ^ (draw >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                stay = np.sort(np.argpartition(draw, most)[:most])
                kept, at = kept[stay], at[stay]
    return kept


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray      # bucket x language: embedding times weights
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for data in stretches(text):
            for buckets in _gram_buckets(data):
                total += self.scores[buckets].sum(axis=0, dtype=np.float64)
                n += len(buckets)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether that is high enough to be relied on."""
        if text is None or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(text)[None, :] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(grams: list[np.ndarray], langs: list[str], epochs: int = 6, rate: float = 0.5, batch: int = 32, steps: int = 500, seed: int = 7, accept: float = 0.995) -> LanguageModel:
    """Fit on the n-gram buckets of four of five texts, calibrate on the fifth; few texts get more epochs, up to ``steps``. They come in a fixed order, so that equal samples give equal models."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    usable = np.flatnonzero([len(g) > 0 for g in grams])
    fold = rng.permutation(usable)
    held, own = (fold[::5], np.setdiff1d(fold, fold[::5])) if len(fold) >= 10 else (fold, fold)
    emb = (rng.normal(size=(BUCKETS, SIZE)) / SIZE).astype(np.float32)
    weights, bias = np.zeros((SIZE, len(names)), np.float32), np.zeros(len(names), np.float32)
    per_epoch = max(1, -(-len(own) // batch))
    epochs = max(epochs, -(-steps // per_epoch))
    steps, at = epochs * per_epoch, 0
    balance = len(own) / (len(names) * np.maximum(1, np.bincount(y[own], minlength=len(names))))
    for _ in range(epochs):
        order = rng.permutation(own)
        for s in range(0, len(order), batch):
            rows = order[s:s + batch]
            lr = rate * (1 - at / steps)
            at += 1
            idx = np.stack([rng.choice(grams[r], STEP_GRAMS) for r in rows]).astype(np.int32)
            mean = emb[idx].mean(axis=1)
            gap = _softmax(mean @ weights + bias)
            gap[np.arange(len(rows)), y[rows]] -= 1
            gap = (gap * balance[y[rows]][:, None] / len(rows)).astype(np.float32)
            back = gap @ weights.T * np.float32(lr * batch / STEP_GRAMS)
            weights -= np.float32(lr * batch) * (mean.T @ gap)
            bias -= np.float32(lr) * gap.sum(axis=0)
            np.subtract.at(emb, idx.ravel(), np.repeat(back, STEP_GRAMS, axis=0))
    model = LanguageModel(names, (emb @ weights).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    if len(held):
        z = np.stack([model.scores[grams[i]].mean(axis=0, dtype=np.float64) + model.bias for i in held])
        loss = [(-np.log(np.maximum(_softmax(z / t)[np.arange(len(held)), y[held]], 1e-300)).mean(), t) for t in np.geomspace(0.05, 20, 60)]
        model.temperature = float(min(loss)[1])
        p = _softmax(z / model.temperature)
        right, top = p.argmax(axis=1) == y[held], p.max(axis=1)
        # the lowest score from which on enough of the held-back texts are right
        for cut in np.sort(top):
            if right[top >= cut].mean() >= accept:
                model.reject_below = float(cut)
                break
        else:
            model.reject_below = 1.0
    return model


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> list:
    """(id, lang, grams) of at most ``rows`` labelled rows that are not held out, about as many of every language, chosen by hash of the id.

    The tasks draw at most ``ROW_GRAMS`` n-grams of a text, two bytes each, so the driver holds a bounded number of bytes whatever the texts.
    """
    own = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~F.coalesce(held_out(docs[id_col]), F.lit(False)))
    own = own.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not counts:
        return []
    share = max(1, rows // len(counts))
    table = own.sparkSession.createDataFrame([(r["lang"], min(1.0, share / r["count"])) for r in counts], "lang string, rate double")
    unit = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.join(F.broadcast(table), "lang").where(unit < F.col("rate")).select("id", "lang", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([drawn_grams(t.as_py()).tobytes() for t in batch["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["lang"], grams], names=["id", "lang", "grams"])
    small = drawn.mapInArrow(run, f"id {dict(drawn.dtypes)['id']}, lang {dict(drawn.dtypes)['lang']}, grams binary")
    return small.orderBy(F.xxhash64("id", F.lit("language")), "id", "lang", "grams").limit(rows).orderBy("id", "lang", "grams").collect()


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    sample = training_sample(docs, id_col, text_col, lang_col, rows)
    return train([np.frombuffer(r.grams, np.uint16) for r in sample], [r.lang for r in sample])


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, relied_on), one row per input row; only the text is read for the prediction.

    ``und`` with score 0 where the text is null or has no letter, or nothing could be learned. ``relied_on`` is false below the calibrated rejection score. A null
    id is not held out. Rows that repeat are predicted each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["held_out"], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                                              pa.array([o[2] for o in out], pa.bool_())], names=["id", "held_out", "lang_pred", "score", "relied_on"])
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double, relied_on boolean").withColumnRenamed("id", id_col)
