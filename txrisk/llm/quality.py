"""Quality by hierarchical empirical Bayes.

A logistic classifier on features of the whole text gives each document's own evidence. Hosts and paths below them get posterior quality rates: their
documents' probabilities shrink towards the global rate (hosts) or the host's (paths), the more the fewer they are and the less sites differ. A document's score adds
its own log odds and its path's, to which it does not itself contribute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.llm.common import store, text_of

# Documented bound of the labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 20_000
_KIND = np.array([0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t\n\r\x0b\x0c" else 4 if c in b".,;:'\"()-?" else 5 if c < 128 else 6
                  for c in range(256)])
N_FEATURES = 11


def features(text: str) -> np.ndarray:
    """Shares of capitals, digits, blanks, usual punctuation, symbols and characters beyond ASCII, then of repeated neighbours, of the most frequent word, of distinct
    words beyond what the length explains, mean word length and length."""
    data = text.encode()
    if not data.strip():
        return np.zeros(N_FEATURES)
    by = np.bincount(_KIND, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=7)
    words = data.split()
    n = len(words)
    letters = by[0] + by[1] + by[6]
    ids, known = np.empty(n, np.int64), {}
    for i, w in enumerate(words):
        ids[i] = known.setdefault(w, len(known))
    top = np.bincount(ids).max()
    return np.array([by[1] / max(letters, 1), by[2] / len(data), by[3] / len(data), by[4] / len(data), by[5] / len(data), by[6] / len(data),
                     (ids[1:] == ids[:-1]).sum() / n, top / n, np.log(len(known)) / np.log(n + 1), min(len(data) / n, 50) / 10, np.log1p(n) / 10])


def _expanded(x: np.ndarray) -> np.ndarray:
    """Square roots and squares beside the shares, so that rare symbols weigh."""
    return np.hstack([x, np.sqrt(np.maximum(x, 0)), x * x])


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return (_expanded(x) - self.mean) / self.scale @ self.weights + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> Classifier:
    """Ridge logistic regression by Newton steps. Without both labels it only knows the rate."""
    rate = (y.sum() + 1) / (len(y) + 2)
    z = _expanded(x) if len(x) else np.zeros((0, 3 * N_FEATURES))
    mean, scale = (z.mean(axis=0), z.std(axis=0)) if len(z) else (np.zeros(3 * N_FEATURES), np.ones(3 * N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    out = Classifier(mean, scale, np.zeros(z.shape[1]), float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return out
    design = np.hstack([(z - mean) / scale, np.ones((len(z), 1))])
    beta = np.append(out.weights, out.bias)
    penalty = np.append(np.full(z.shape[1], ridge * len(z)), 0.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + np.diag(penalty + 1e-9), design.T @ (y - p) - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    out.weights, out.bias = beta[:-1], float(beta[-1])
    return out


def text_features(docs: DataFrame, text_col: str, carry: dict[str, Column]) -> DataFrame:
    """(carry..., features) of every row."""
    names = list(carry)
    rows = docs.select(*[c.alias(n) for n, c in carry.items()], text_of(docs, text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t.as_py()) for t in batch["__text"]]).reshape(-1)
            offsets = pa.array(np.arange(0, len(values) + 1, N_FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.ListArray.from_arrays(offsets, pa.array(values))], names=[*names, "features"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", features array<double>")


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled documents, the first by hash of the id."""
    sample = training_rows(docs, labels, id_col, text_col, label_col, rows)
    return fit_logistic(np.array([r.features for r in sample]).reshape(-1, N_FEATURES), np.array([r.y for r in sample]))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> list:
    """(id, y, features) of at most ``rows`` rows, also where many rows repeat a labelled id; only features reach the driver."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).cast("double").alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__y").limit(rows)
    own = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("text")).join(F.broadcast(known), "__id")   # at most ``rows`` narrow rows
    sample = text_features(own, "text", {"id": own["__id"].cast("string"), "y": own["__y"]})
    return sample.orderBy(F.xxhash64("id"), "id", "y", "features").limit(rows).orderBy("id", "y", "features").collect()


def _strength(groups: DataFrame, centre: Column) -> float:
    """Prior strength: variance inside groups over variance between their means and ``centre`` (analysis of variance); at least 1."""
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")).alias("inside"),
                   F.sum(F.col("n") * F.pow(F.col("s1") / F.col("n") - centre, 2)).alias("between")).first()
    if not r.n or r.n <= r.k or r.k < 2:
        return 100.0
    inside = max(r.inside / (r.n - r.k), 1e-9)
    between = (r.between - (r.k - 1) * inside) / max(r.n - r.n2 / r.n, 1.0)
    return float(min(max(inside / between, 1.0), 1e6)) if between > 0 else 1e6


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def quality_scores(docs: DataFrame, model: Classifier, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, doc_score, host_rate, path_rate, score, keep, text_sha256), one row per input row.

    Null text counts as empty and has the classifier's odds of one; null hosts and paths are sites of their own. Rates leave the row itself out. Rows that
    repeat are scored each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    raw = text_features(docs, text_col, {"id": docs[id_col], "host": host.cast("string"), "path": path.cast("string"), "text_sha256": F.sha2(text_of(docs, text_col), 256)})
    kind = dict(raw.dtypes)["id"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["features"].flatten().to_numpy().reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["path"], batch["text_sha256"], pa.array(np.clip(shared.value.log_odds(x), -30, 30))], names=["id", "host", "path", "text_sha256", "odds"])
    key = lambda *cs: F.sha2(F.concat_ws(",", *[F.coalesce(F.hex(c), F.lit("-")) for c in cs]), 256)
    scored = raw.mapInArrow(score, f"id {kind}, host string, path string, text_sha256 string, odds double")
    scored, _ = store(scored.withColumns({"p": 1 / (1 + F.exp(-F.col("odds"))), "host_key": key("host"), "path_key": key("host", "path")}), "quality-odds")
    sums = [F.count("*").alias("n"), F.sum("p").alias("s1"), F.sum(F.col("p") * F.col("p")).alias("s2")]
    paths, _ = store(scored.groupBy("host_key", "path_key").agg(*sums), "quality-paths")
    hosts, _ = store(paths.groupBy("host_key").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")]), "quality-hosts")
    whole = hosts.agg(F.sum("n"), F.sum("s1")).first()
    rate = whole[1] / whole[0] if whole[0] else 0.5
    k_host = _strength(hosts, F.lit(rate))
    up = hosts.select("host_key", F.col("n").alias("hn"), F.col("s1").alias("hs"))
    k_path = _strength(paths.join(up, "host_key"), F.col("hs") / F.col("hn"))
    sites, _ = store(paths.join(up, "host_key").select("path_key", "n", "s1", "hn", "hs"), "quality-sites")
    # both sides are plain exchanges: AQE splits the partition of a path that very many rows share
    host_rate = (F.col("hs") - F.col("p") + k_host * rate) / (F.col("hn") - 1 + k_host)
    out = scored.join(sites, "path_key").withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", (F.col("s1") - F.col("p") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path))
    odds = F.col("odds") + _odds(F.col("path_rate")) - _odds(F.lit(rate))
    score_col = 1 / (1 + F.exp(-odds))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("p").alias("doc_score"), "host_rate", "path_rate", score_col.alias("score"), (score_col >= threshold).alias("keep"), "text_sha256")
