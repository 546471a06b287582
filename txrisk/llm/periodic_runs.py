"""Periodic run detection by seeds and extended diagonals.

A run is a stretch of words with smallest period q, at least ``max(least, times * q)`` long, that no neighbouring word extends. Lags are taken in classes
[2^t, 2^(t+1)): every run of such a lag holds one of its (times-1) * 2^t-grams twice at distance q, and since the gram is longer than q, its next
occurrence in the document is exactly q words on. So only neighbouring occurrences are seeds, which are at most as many as words, never all pairs of a gram's places.
Grams are named exactly, by pairs of the names of half their length, and places whose gram stands once in their document are left behind.
A table of the furthest word covered at each lag suppresses seeds inside a stretch that is extended already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.llm.byte_bpe import Numbers
from txrisk.llm.common import text_of

# Words that are looked at together; a longer document is looked at by itself.
BATCH_WORDS = 1 << 20


def _names(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal numbers, a key that stands once gets -1."""
    _, name, count = np.unique(key, return_inverse=True, return_counts=True)
    alive = count > 1
    number = np.where(alive, np.cumsum(alive) - 1, -1)
    return number[name], int(alive.sum())


class _Grams:
    """Names of the words and of the grams of 2, 4, 8, ... words by place; -1 where a gram stands once in its document."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.n = len(words)
        name, self.many = _names(document * (int(words.max()) + 1) + words) if self.n else (words, 0)
        self.levels = [name]

    def __getitem__(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            half, width = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self.pair(half, half, width))
        return self.levels[level]

    def pair(self, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
        """Names of grams from the names of their parts, the right one ``width`` words on."""
        out = np.full(self.n, -1, np.int64)
        at = np.flatnonzero(left[:max(self.n - width, 0)] >= 0)
        at = at[right[at + width] >= 0]
        if len(at):
            out[at], _ = _names(left[at] * (self.n + 1) + right[at + width])
        return out


def _seeds(grams: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place) of neighbouring occurrences of a gram at lags in [low, high), the first place of each row of adjoining ones, ordered."""
    at = np.flatnonzero(grams >= 0)
    at = at[np.argsort(grams[at], kind="stable")]
    lag = at[1:] - at[:-1]
    hit = (grams[at[1:]] == grams[at[:-1]]) & (lag >= low) & (lag < high)
    place, lag = at[:-1][hit], lag[hit]
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    head = np.ones(len(place), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    return lag[head], place[head]


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two stretches have in common from their start."""
    done, step = 0, 64
    while done < len(a):
        differ = np.flatnonzero(a[done:done + step] != b[done:done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, step * 2
    return len(a)


def find_runs(words: np.ndarray, starts: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of documents that stand end to end, document d from ``starts[d]`` to ``starts[d + 1]``; ``times`` is 3 at least."""
    grams, found, longest = _Grams(words, starts), [], int(np.diff(starts).max()) if len(starts) > 1 else 0
    t = 0
    while times << t <= longest:
        # the overlap of a run with itself one period on is at least this long for every period of the class
        overlap = max(least - 1, times - 1) if t == 0 else (times - 1) << t
        level = overlap.bit_length() - 1
        if not (grams[level] >= 0).any():
            break
        # two grams of a power of two words that together make up the overlap
        seeds = _seeds(grams.pair(grams[level], grams[level], overlap - (1 << level)), 1 << t, 2 << t)
        furthest: dict[int, int] = {}
        for q, i in zip(*map(np.ndarray.tolist, seeds)):
            if i < furthest.get(q, 0):
                continue
            d = int(np.searchsorted(starts, i, "right")) - 1
            first, end = int(starts[d]), int(starts[d + 1])
            right = _equal_ahead(words[i:end - q], words[i + q:end])
            left = _equal_ahead(words[first:i][::-1], words[first + q:i + q][::-1])
            furthest[q] = i + right
            if left + right + q >= max(least, times * q):
                found.append((i - left, left + right + q, q))
        t += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with their words, about ``BATCH_WORDS`` words at a time."""
    held, n = [], 0
    for batch in batches:
        ids, texts = batch["id"].to_pylist(), batch["text"]
        for i, text in zip(ids, texts):
            # bytes split at the six ASCII white spaces and nothing else
            own = text.as_py().encode().split()
            if held and n + len(own) > BATCH_WORDS:
                yield held
                held, n = [], 0
            held.append((i, own))
            n += len(own)
    if held:
        yield held


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): the runs of every whole text by (start, period), and the text without what repeats.

    Words are what stands between ASCII white space, numbered from 0. ``collapsed`` drops each word that a run holds after its first period, the others are joined by
    one space. Null text counts as empty and has no runs; rows that repeat an id, or have none, are each looked at; an empty table gives no rows;
    other columns are not read. No row meets another, so nothing is shuffled; a task holds about ``BATCH_WORDS`` words, or one longer document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for rows in _documents(batches):
            number = Numbers()
            flat = np.fromiter((number[w] for _, own in rows for w in own), np.int64)
            starts = np.concatenate([[0], np.cumsum([len(own) for _, own in rows])]).astype(np.int64)
            runs: list[list[tuple]] = [[] for _ in rows]
            gone = np.zeros(len(flat) + 1, np.int64)
            for s, n, q in find_runs(flat, starts, least, times):
                d = int(np.searchsorted(starts, s, "right")) - 1
                runs[d].append((s - int(starts[d]), n, q))
                gone[s + q] += 1
                gone[s + n] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            texts = [b" ".join(own if not r else [w for w, g in zip(own, gone[a:b].tolist()) if not g]).decode()
                     for (_, own), r, a, b in zip(rows, runs, starts, starts[1:])]
            lists = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([len(own) for _, own in rows], pa.int64()),
                                              pa.array(lists, kind), pa.array(texts, pa.string())], names=["id", "n_words", "runs", "collapsed"])
    rows = docs.select(docs[id_col].cast("long").alias("id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: str) -> Column:
    """The run of a column of runs with the greatest exact length / period; ties: smallest start, then period. Null where there is none."""
    def order(x, y):
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    return F.get(F.array_sort(F.col(runs), order), F.lit(0))
