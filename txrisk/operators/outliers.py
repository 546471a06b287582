"""Unsupervised outlier scores; higher is more anomalous. Labels are never used."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.functions.scale import attach, hash_u32, keep, num_partitions, top_share_cut
from txrisk.operators.aggregates import equal_width_bin
from txrisk.operators.neighbors import attach_vectors, knn_join, vector
from txrisk.schema import DEFAULT, Columns

# From so many columns on, covariances are matrix products: hundreds of aggregates in one make code that Java does not compile.
WIDE = 8


# ------------------------------------------------------------------ isolation forest

def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list) -> int:
    """Append the subtree of ``x`` to ``out`` as (feature, split, left, right, path) rows; returns its index."""
    node = len(out)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else np.array([], dtype=int)
    if depth >= limit or len(spread) == 0:
        out.append((-1, 0.0, -1, -1, depth + _c(len(x))))
        return node
    f = int(rng.choice(spread))
    split = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    out.append(None)
    left = _grow(x[x[:, f] < split], rng, depth + 1, limit, out)
    right = _grow(x[x[:, f] >= split], rng, depth + 1, limit, out)
    out[node] = (f, split, left, right, 0.0)
    return node


@dataclass
class IsolationForest:
    trees: list[np.ndarray]
    sample_size: int
    features: list[str]
    id: str

    def transform(self, df: DataFrame, name: str = "iforest") -> DataFrame:
        trees, norm = self.trees, _c(self.sample_size) or 1.0
        shared = df.sparkSession.sparkContext.broadcast(trees)   # trees x at most 511 nodes

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            x = np.stack([np.asarray(a, dtype=float) for a in v]) if len(v) else np.zeros((0, 1))
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = t[at, 0].astype(int)
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(f, 0)] < t[at, 1]
                    nxt = np.where(go_left, t[at, 2], t[at, 3]).astype(int)
                    at = np.where(inner, nxt, at)
                total += t[at, 4]
            return pd.Series(2.0 ** (-(total / len(shared.value)) / norm))

        return df.withColumn(name, score(vector(self.features)))


def isolation_forest(df: DataFrame, features: list[str], n_trees: int = 100, sample_size: int = 256, seed: int = 0,
                     cols: Columns = DEFAULT) -> IsolationForest:
    """Trees are grown in parallel, one task group per tree, on hash samples of ``sample_size`` rows each."""
    n = df.count()
    size = min(sample_size, n)
    # each tree draws every row with the same chance, about twice the rows it keeps; only the hits of a row are generated
    drawn = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(cols.id), t, F.lit(seed)), F.lit(max(1, n // (2 * size)))) == 0)
    rows = df.withColumn("tree", F.explode(drawn))
    rows = rows.select("tree", hash_u32(F.concat_ws("#", F.col(cols.id).cast("string"), F.col("tree").cast("string")), "order").alias("h"),
                       vector(features).alias("vec"))
    limit = max(1, math.ceil(math.log2(max(2, size))))

    def grow(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = np.stack([np.asarray(v, dtype=float) for v in pdf.sort_values("h")["vec"].iloc[:size]])
        out: list = []
        _grow(x, np.random.default_rng(seed * 100_003 + tree), 0, limit, out)
        flat = np.array(out, dtype=float).ravel().tolist()
        return pd.DataFrame({"tree": [tree], "nodes": [flat]})

    rows = rows.repartition(min(n_trees, num_partitions(df.sparkSession)), "tree")   # not merged into few tasks
    grown = rows.groupBy("tree").applyInPandas(grow, "tree int, nodes array<double>").orderBy("tree").collect()
    trees = [np.array(r["nodes"], dtype=float).reshape(-1, 5) for r in grown]
    return IsolationForest(trees, size, features, cols.id)


# ------------------------------------------------------------------ histograms

@dataclass
class HistogramScore:
    """Densities of equal-width bins per feature."""

    features: list[str]
    limits: dict[str, tuple[float, float]]
    density: dict[str, list[float]]
    bins: int
    alpha: float
    tol: float

    def transform(self, df: DataFrame, name: str) -> DataFrame:
        terms = []
        for c in self.features:
            e = F.col(c).cast("double")
            lo, hi = self.limits[c]
            width = (hi - lo) / self.bins
            values = F.array(*[F.lit(-math.log2(d + self.alpha)) for d in self.density[c]])
            worst = F.lit(max(-math.log2(d + self.alpha) for d in self.density[c]))
            # values slightly outside the fitted range still belong to the outermost bins
            far = (e < lo - self.tol * width) | (e > hi + self.tol * width)
            inside = F.element_at(values, equal_width_bin(e, lo, hi, self.bins))
            terms.append(F.when(far, worst).otherwise(inside))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return df.withColumn(name, total)


def hbos(df: DataFrame, features: list[str], bins: int = 10, alpha: float = 0.1, tol: float = 0.5) -> HistogramScore:
    """Sum over features of ``-log2(density + alpha)`` on equal-width bins."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    r = x.agg(*[e for c in features for e in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))], F.count("*").alias("n")).first()
    limits = {c: (r[f"a_{c}"], r[f"b_{c}"]) for c in features}
    long = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), equal_width_bin(F.col(c), *limits[c], bins).alias("b"))
                                        for c in features])).alias("x")).select("x.*")
    counts = {(q["c"], q["b"]): q["count"] for q in long.groupBy("c", "b").count().collect()}   # features x bins
    density = {}
    for c, (lo, hi) in limits.items():
        width = (hi - lo) / bins or 1.0
        density[c] = [counts.get((c, b), 0) / (r["n"] * width) for b in range(1, bins + 1)]
    return HistogramScore(list(features), limits, density, bins, alpha, tol)


def loda_weights(p: int, n_projections: int = 100, seed: int = 0) -> np.ndarray:
    """Sparse random projections (one column each) with sqrt(p) standard normal weights."""
    rng = np.random.default_rng(seed)
    k = max(1, int(round(math.sqrt(p))))
    w = np.zeros((p, n_projections))
    for i in range(n_projections):
        w[rng.choice(p, k, replace=False), i] = rng.standard_normal(k)
    return w


@dataclass
class LodaModel:
    features: list[str]
    weights: np.ndarray
    low: np.ndarray
    width: np.ndarray
    score: np.ndarray      # projections x bins, minus log2 density

    def transform(self, df: DataFrame, name: str = "loda") -> DataFrame:
        weights, low, width, table = self.weights, self.low, self.width, self.score
        n = len(low)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            b = _bin_index(np.stack([np.asarray(a, dtype=float) for a in v]) @ weights, low, width, table.shape[1])
            return pd.Series(table[np.arange(n)[None, :], b].mean(axis=1))

        return df.withColumn(name, score(vector(self.features)))


def _bin_index(z: np.ndarray, low: np.ndarray, width: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(np.floor((z - low) / width).astype(int), 0, bins - 1)


def loda(df: DataFrame, features: list[str], bins: int = 10, n_projections: int = 100, seed: int = 0,
         alpha: float = 1e-12) -> LodaModel:
    """Mean negative log density over one-dimensional histograms of random projections.

    Tasks reduce their rows to limits and bin counts; only projections x bins numbers are merged.
    """
    weights = loda_weights(len(features), n_projections, seed)
    x = df.select(vector(features).alias("v"))

    def projected(b: pa.RecordBatch) -> np.ndarray:
        return b["v"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(features)) @ weights

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = projected(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(z.shape[1], dtype=np.int32)), pa.array(z.min(axis=0)), pa.array(z.max(axis=0)),
                                                  pa.array(np.full(z.shape[1], len(z)))], names=["i", "a", "b", "n"])

    r = x.mapInArrow(limits, "i int, a double, b double, n long").groupBy("i").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).orderBy("i").collect()
    low = np.array([q["a"] for q in r])
    width = np.array([(q["b"] - q["a"]) / bins or 1.0 for q in r])
    n = r[0]["n"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = projected(b)
                k = _bin_index(z, low, width, bins) + bins * np.arange(z.shape[1])[None, :]
                c = np.bincount(k.ravel(), minlength=bins * z.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c)], names=["k", "c"])

    c = np.zeros(bins * n_projections)
    for q in x.mapInArrow(counts, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).collect():
        c[q["k"]] = q["c"]
    density = c.reshape(n_projections, bins) / (n * width[:, None])
    return LodaModel(features, weights, low, width, -np.log2(density + alpha))


# ------------------------------------------------------------------ neighbours

def knn_distance(df: DataFrame, features: list[str], k: int = 5, method: str = "largest", refs: DataFrame | None = None,
                 cols: Columns = DEFAULT, **search) -> DataFrame:
    """(id, knn): distance to the k-th nearest row, or the mean or median over the k nearest."""
    pts = df.select(F.col(cols.id).alias("id"), vector(features).alias("vec"))
    if refs is not None:
        fn = {"largest": F.max("distance"), "mean": F.avg("distance"), "median": F.median("distance")}[method]
        nn = knn_join(pts, refs.select(F.col(cols.id).alias("id"), vector(features).alias("vec")), k, "id", "id", exclude_self=True, **search)
        return nn.groupBy(F.col("qid").alias(cols.id)).agg(fn.alias("knn"))
    found = knn_join(_first_rows(pts), pts, k, "id", "id", exclude_self=True, lists=True, **search)
    score = found.select("vec", _list_score(k, method).alias("knn")).where("knn IS NOT NULL")
    return attach_vectors(pts, score, "vec", "inner").select(F.col("id").alias(cols.id), "knn")


def _list_score(k: int, method: str) -> Column:
    """Largest, mean or median of the k smallest distances of a list of neighbours; null for an empty list."""
    d = F.transform(F.slice("near", 1, k), lambda x: x["distance"])
    n = F.size(d)
    score = {"largest": F.get(d, n - 1), "mean": F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n,
             "median": (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2}[method]
    return F.when(n > 0, score)


def _first_rows(pts: DataFrame) -> DataFrame:
    """One row per vector. In a search of a table in itself it scores for all its copies: each of them leaves out one row at
    distance 0 (itself, or one more copy), so the distances and vectors of its neighbours are the same."""
    return keep(pts.groupBy("vec").agg(F.min("id").alias("id")))


def abod(df: DataFrame, features: list[str], k: int = 10, cols: Columns = DEFAULT, refs: DataFrame | None = None) -> DataFrame:
    """(id, abod): minus the variance of the distance-weighted angles between pairs of the k nearest other rows (of ``refs``)."""
    pts = df.select(F.col(cols.id).alias("id"), vector(features).alias("vec"))
    ref = pts if refs is None else refs.select(F.col(cols.id).alias("id"), vector(features).alias("vec"))
    asked = _first_rows(pts) if refs is None else pts
    scored = _angle_scores(knn_join(asked, ref, k, "id", "id", exclude_self=True, lists=True), ref, k)
    if refs is None:
        scored = attach_vectors(pts, scored.drop("id"), "vec")
    return scored.select(F.col("id").alias(cols.id), "abod")


def _angle_scores(found: DataFrame, ref: DataFrame, k: int) -> DataFrame:
    """(id, vec, abod) of rows with the list of their neighbours in ``ref``."""
    nn = found.select("id", F.explode(F.slice("near", 1, k)).alias("x")).select("id", F.col("x.rid").alias("neighbour"))
    vecs = nn.join(ref.select(F.col("id").alias("neighbour"), F.col("vec").alias("nv")), "neighbour")
    near = vecs.groupBy("id").agg(F.collect_list("nv").alias("ns"))   # k vectors

    @F.pandas_udf("double")
    def angle_variance(v: pd.Series, ns: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=v.index)
        for n, own in v.groupby(ns.str.len()):     # one block of arrays per number of neighbours
            if n < 2:
                continue
            near = np.stack([np.stack(a) for a in ns[own.index]]).astype(float)
            d = near - np.stack(own.to_numpy()).astype(float)[:, None, :]
            sq = (d * d).sum(axis=2)
            i, j = np.triu_indices(int(n), 1)
            w = (sq[:, i] > 0) & (sq[:, j] > 0)    # copies of the row itself have no angle
            angle = (d[:, i] * d[:, j]).sum(axis=2) / np.where(w, sq[:, i] * sq[:, j], 1.0)
            pairs = np.maximum(w.sum(axis=1), 1)
            mean = np.where(w, angle, 0.0).sum(axis=1) / pairs
            out[own.index] = -np.where(w, (angle - mean[:, None]) ** 2, 0.0).sum(axis=1) / pairs
        return out

    return attach(found.select("id", "vec"), near, "id").select("id", "vec", angle_variance("vec", "ns").alias("abod"))


# ------------------------------------------------------------------ clusters and covariance

def sq_distance(vec: Column, centre: list[float]) -> Column:
    return F.aggregate(F.zip_with(vec, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b)),
                       F.lit(0.0), lambda s, v: s + v)


def cblof(df: DataFrame, features: list[str], n_clusters: int = 8, alpha: float = 0.9, beta: float = 5.0,
          use_weights: bool = False, seed: int = 0) -> "CblofModel":
    """K-means clusters, split into large and small ones by size share ``alpha`` or size jump ``beta``."""
    x = df.select(array_to_vector(vector(features)).alias("features"))
    model = KMeans(k=n_clusters, seed=seed, featuresCol="features", predictionCol="c").fit(x)
    sizes = {r["c"]: r["count"] for r in model.transform(x).groupBy("c").count().collect()}   # one row per cluster
    order = sorted(sizes, key=lambda c: (-sizes[c], c))
    n = sum(sizes.values())
    by_alpha, by_beta, total = None, None, 0
    for i, c in enumerate(order[:-1]):
        total += sizes[c]
        if by_alpha is None and total >= alpha * n:
            by_alpha = i + 1
        if by_beta is None and sizes[c] / sizes[order[i + 1]] >= beta:
            by_beta = i + 1
        if total >= alpha * n and sizes[c] / sizes[order[i + 1]] >= beta:
            by_alpha = by_beta = i + 1
            break
    cut = by_alpha or by_beta or len(order)
    return CblofModel(features, [c.tolist() for c in model.clusterCenters()], set(order[:cut]), sizes, use_weights)


@dataclass
class CblofModel:
    features: list[str]
    centres: list[list[float]]
    large: set[int]
    sizes: dict[int, int]
    use_weights: bool

    def transform(self, df: DataFrame, name: str = "cblof") -> DataFrame:
        d = F.array(*[F.sqrt(sq_distance(F.col("__v"), c)) for c in self.centres])
        out = df.withColumn("__v", vector(self.features)).withColumn("__d", d)
        own = F.array_position("__d", F.array_min("__d")).cast("int")
        to_large = F.least(*[F.col("__d")[c] for c in self.large]) if len(self.large) > 1 else F.col("__d")[next(iter(self.large))]
        in_large = F.array_contains(F.array(*[F.lit(c + 1) for c in self.large]), own)
        score = F.when(in_large, F.array_min("__d")).otherwise(to_large)
        if self.use_weights:
            score = score * F.element_at(F.array(*[F.lit(float(self.sizes.get(i, 0))) for i in range(len(self.centres))]), own)
        return out.withColumn(name, score).drop("__v", "__d")


@dataclass
class McdModel:
    features: list[str]
    mean: np.ndarray
    precision: np.ndarray

    def transform(self, df: DataFrame, name: str = "mcd") -> DataFrame:
        return df.withColumn(name, mahalanobis(self.features, self.mean, self.precision))


def mahalanobis(features: list[str], mean: np.ndarray, precision: np.ndarray) -> Column:
    d = [F.col(c).cast("double") - float(m) for c, m in zip(features, mean)]
    total = F.lit(0.0)
    for i in range(len(features)):
        for j in range(i, len(features)):
            total = total + float(precision[i, j] * (1 if i == j else 2)) * d[i] * d[j]
    return total


def moments(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, population covariance, rows): p x p numbers from one aggregate, or from two when they are many."""
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    c = [F.col(f).cast("double") for f in features]
    wide = p >= WIDE
    r = df.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)],
               *[F.covar_pop(c[i], c[j]).alias(f"v{i}_{j}") for i, j in ([] if wide else pairs)]).first()
    cov = np.zeros((p, p))
    for i, j in [] if wide else pairs:
        cov[i, j] = cov[j, i] = r[f"v{i}_{j}"] or 0.0
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(p)])
    return mean, _covariance(df, c, np.where(np.isfinite(mean), mean, 0.0)) if wide else cov, r["n"]


def _covariance(df: DataFrame, values: list[Column], centre: np.ndarray) -> np.ndarray:
    """Population covariances of rows where both values are there, around ``centre``; one matrix product a batch. NaN and infinity spoil their pairs."""
    p = len(values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten()
                there = ~x.is_null().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
                x = x.to_numpy(zero_copy_only=False).reshape(b.num_rows, p) - centre
                odd = there & ~np.isfinite(x)
                x, m, q = np.where(there & ~odd, x, 0.0), there.astype(float), odd.astype(float)
                total += np.stack([m.T @ m, x.T @ m, x.T @ x, q.T @ m + m.T @ q])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["j", "v"])

    total = np.zeros(4 * p * p)
    for r in df.select(F.array(*values).alias("x")).mapInArrow(products, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
        total[r["j"]] = r["v"]
    n, s, xy, odd = total.reshape(4, p, p)
    some = np.maximum(n, 1.0)
    return np.where(odd > 0, np.nan, xy / some - (s / some) * (s / some).T)


def mcd(df: DataFrame, features: list[str], support: float | None = None, max_steps: int = 10) -> McdModel:
    """Robust mean and covariance by concentration steps: moments of the share of rows closest to the last ones."""
    x = keep(df.select(*features))
    mean, cov, n = moments(x, features)
    p = len(features)
    h = support or (n + p + 1) / (2 * n)
    last = None
    for _ in range(max_steps):
        scored = x.withColumn("__d", mahalanobis(features, mean, np.linalg.pinv(cov)))
        cut = scored.approxQuantile("__d", [h], 0.001)[0]
        mean, cov, _ = moments(scored.where(F.col("__d") <= cut), features)
        det = float(np.linalg.det(cov))
        if last is not None and abs(last - det) <= 1e-9 * max(1.0, abs(last)):
            break
        last = det
    # scale so that the median distance equals its value under normality
    d = mahalanobis(features, mean, np.linalg.pinv(cov))
    med = x.select(d.alias("d")).approxQuantile("d", [0.5], 0.001)[0]
    expected = p * (1 - 2 / (9 * p)) ** 3   # Wilson-Hilferty median of chi-square
    if med > 0:
        cov = cov * (med / expected)
    x.unpersist()
    return McdModel(features, mean, np.linalg.pinv(cov))


# ------------------------------------------------------------------ union of scores

DETECTORS = ("iforest", "hbos", "loda", "cblof", "mcd", "knn", "abod")


@dataclass
class NeighbourScores:
    """k-nearest distance or angle score against the fitted rows; rows that were fitted are compared with the others."""

    refs: DataFrame
    features: list[str]
    kind: str
    params: dict[str, Any]
    cols: Columns

    def transform(self, df: DataFrame, name: str | None = None) -> DataFrame:
        score = knn_distance if self.kind == "knn" else abod
        table = score(df, self.features, refs=self.refs, cols=self.cols, **self.params)
        return attach(df, table.withColumnRenamed(self.kind, name or self.kind), self.cols.id)


def fit_detector(df: DataFrame, features: list[str], name: str, cols: Columns = DEFAULT, **params):
    """A fitted detector that scores any table."""
    if name == "iforest":
        return isolation_forest(df, features, cols=cols, **params)
    if name in ("knn", "abod"):
        return NeighbourScores(df, features, name, params, cols)
    return {"hbos": hbos, "loda": loda, "cblof": cblof, "mcd": mcd}[name](df, features, **params)


def add_scores(df: DataFrame, features: list[str], detectors: list[str], params: dict[str, dict] | None = None,
               fit_on: DataFrame | None = None, cols: Columns = DEFAULT) -> DataFrame:
    """Append one score column per detector, learnt on ``fit_on`` (default: the table itself)."""
    params = params or {}
    if unknown := [n for n in detectors if n not in DETECTORS]:
        raise ValueError(f"unknown detector {unknown[0]}; known are {DETECTORS}")
    if fit_on is None and {"knn", "abod"} & set(detectors):
        return _own_scores(df, features, detectors, params, cols)
    fit = df if fit_on is None else fit_on
    out = df
    for name in detectors:
        out = fit_detector(fit, features, name, cols, **params.get(name, {})).transform(out, name)
    return out


def _own_scores(df: DataFrame, features: list[str], detectors: list[str], params: dict[str, dict], cols: Columns) -> DataFrame:
    """Scores of a table learnt on itself. They depend on the vector alone, so every distinct vector is scored once, with one
    neighbour search for all scores that ask for one, and one join brings all scores to the rows."""
    rows = keep(df.select(F.col(cols.id), *features))
    pts = rows.select(F.col(cols.id).alias("id"), vector(features).alias("vec"))
    search = {n: {"k": k, **params.get(n, {})} for n, k in (("knn", 5), ("abod", 10)) if n in detectors}
    route = {n: v for p in search.values() for n, v in p.items() if n not in ("k", "method")}
    found = keep(knn_join(_first_rows(pts), pts, max(p["k"] for p in search.values()), "id", "id", exclude_self=True, lists=True, **route))
    scores = found.select("id", "vec", *[_list_score(p["k"], p.get("method", "largest")).alias("knn") for n, p in search.items() if n == "knn"])
    if "abod" in search:
        scores = attach(scores, _angle_scores(found, pts, search["abod"]["k"]).drop("vec"), "id")
    scores = scores.select("*", *[F.col("vec")[i].alias(f) for i, f in enumerate(features)])
    for name in detectors:
        if name not in search:
            scores = fit_detector(rows, features, name, cols, **params.get(name, {})).transform(scores, name)
    return attach_vectors(df.withColumn("vec", vector(features)), scores.select("vec", *detectors), "vec").drop("vec").select(*df.columns, *detectors)


_STATES = {c.__name__: c for c in (IsolationForest, HistogramScore, LodaModel, CblofModel, McdModel)}


def detector_state(model) -> dict:
    """Plain JSON values of a fitted detector."""
    if isinstance(model, NeighbourScores):
        raise ValueError("neighbour detectors hold their reference rows; fit them again instead of saving them")
    def plain(v):
        if isinstance(v, np.ndarray):
            return {"array": v.tolist()}
        if isinstance(v, set):
            return {"set": sorted(v)}
        if isinstance(v, dict):
            return {"items": [[k, plain(x)] for k, x in v.items()]}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v
    return {"kind": type(model).__name__, **{k: plain(v) for k, v in vars(model).items()}}


def detector_from_state(state: dict):
    def back(v):
        if isinstance(v, dict):
            if "array" in v:
                return np.array(v["array"], dtype=float)
            if "set" in v:
                return set(v["set"])
            return {k: back(x) for k, x in v["items"]}
        return [back(x) for x in v] if isinstance(v, list) else v
    return _STATES[state["kind"]](**{k: back(v) for k, v in state.items() if k != "kind"})


def contamination_flag(df: DataFrame, score: str, contamination: float = 0.1, name: str | None = None) -> DataFrame:
    """1 for rows whose score exceeds the exact ``1 - contamination`` quantile."""
    cut = top_share_cut(df, score, contamination)
    return df.withColumn(name or f"{score}_outlier", (F.col(score) > cut).cast("int"))
