"""Clusters by mergeable clustering features.

A clustering feature is (rows, mean, sum of squared distances from the mean); two of them add up to the feature of the joined rows. Every task folds its rows into a bounded list of leaves whose
radius (root mean square distance from the mean) stays within a threshold, lists are merged eight at a time until one is left, and a Ward pass over its leaves gives the clusters. A list that outgrows its
bound is rebuilt with a larger threshold, so neither a task nor the driver ever holds more than ``max_leaves`` times a constant. As the leaves are bounded, one matrix product finds the nearest leaf of a
whole batch exactly, where a tree descent would find a near one row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from txrisk.functions.scale import num_partitions

# Lists merged by one task, and rows compared with the leaves at once.
FAN_IN = 8
BLOCK = 4096
LEAF = "part long, n long, mean array<double>, spread double, threshold double"


class Leaves:
    """A bounded list of clustering features."""

    def __init__(self, threshold: float, max_leaves: int):
        self.t2, self.limit = threshold * threshold, max_leaves
        self.n = self.mean = self.spread = None

    def add(self, n: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> None:
        """Fold features (rows are features of one row and no spread) into the leaves."""
        for lo in range(0, len(n), BLOCK):
            self._block(n[lo:lo + BLOCK], mean[lo:lo + BLOCK], spread[lo:lo + BLOCK])

    def _block(self, n, mean, spread) -> None:
        if self.n is None:
            self.n, self.mean, self.spread = n[:1].copy(), mean[:1].copy(), spread[:1].copy()
            n, mean, spread = n[1:], mean[1:], spread[1:]
        while len(n):
            left = self._absorb(n, mean, spread)
            n, mean, spread = n[left], mean[left], spread[left]
            if len(self.n) > self.limit:
                self._rebuild()

    def _absorb(self, n, mean, spread) -> np.ndarray:
        """Add to every leaf the nearest of its features that keep its radius, make the farthest of those that do not fit a leaf of its own; returns the rest."""
        near, d2 = nearest(mean, self.mean)
        order = np.lexsort((d2, near))
        leaf, w = near[order], n[order].astype(float)
        start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(leaf)]))
        away = mean[order] - self.mean[leaf]

        def running(v):
            total = np.cumsum(v, axis=0)
            return total - np.concatenate([np.zeros_like(total[:1]), total])[start][group]

        rows = running(w) + self.n[leaf]
        shift = running(away * w[:, None]) / rows[:, None]
        inside = running(spread[order] + w * (away * away).sum(1)) + self.spread[leaf]
        r2 = inside / rows - (shift * shift).sum(1)
        # features of one place differ by rounding only
        slack = 1e-28 * (1.0 + (self.mean[leaf] ** 2).sum(1))
        fits = np.cumsum(r2 > self.t2 + slack)
        fits = fits - np.r_[0, fits][start][group] == 0
        taken = np.bincount(group, fits, len(start)).astype(int)
        last = start + taken - 1
        some = taken > 0
        at, last = leaf[start[some]], last[some]
        self.n[at] = rows[last].astype(np.int64)
        self.mean[at] += shift[last]
        self.spread[at] = np.maximum(rows[last] * r2[last], 0.0)
        # the last of a group is its farthest
        ends = np.r_[start[1:], len(leaf)] - 1
        new = order[ends[~fits[ends]]]
        self.n, self.mean = np.concatenate([self.n, n[new]]), np.concatenate([self.mean, mean[new]])
        self.spread = np.concatenate([self.spread, spread[new]])
        rest = np.zeros(len(n), bool)
        rest[order[~fits]] = True
        rest[new] = False
        return rest

    def _rebuild(self) -> None:
        """Widen the threshold to the radius at which about half of the leaves join their neighbour, until at most half of the bound is left."""
        while len(self.n) > max(1, self.limit // 2):
            n, mean, spread = self.n, self.mean, self.spread
            gap = np.full(len(n), np.inf)
            for lo in range(0, len(n), BLOCK):
                d2 = distances(mean[lo:lo + BLOCK], mean)
                d2[np.arange(len(d2)), np.arange(lo, lo + len(d2))] = np.inf
                j = d2.argmin(1)
                a, b = n[lo:lo + BLOCK], n[j]
                gap[lo:lo + BLOCK] = (spread[lo:lo + BLOCK] + spread[j] + a * b / (a + b) * d2.min(1)) / (a + b)
            self.t2 = max(2 * self.t2, float(np.median(gap)))
            big = np.argsort(-n, kind="stable")
            again = Leaves(0.0, len(n) + 1)
            again.t2 = self.t2
            again.add(n[big], mean[big], spread[big])
            self.n, self.mean, self.spread = again.n, again.mean, again.spread

    def table(self, part: int) -> pa.RecordBatch:
        k = 0 if self.n is None else len(self.n)
        return pa.RecordBatch.from_arrays([
            pa.array([part] * k, pa.int64()), pa.array(self.n if k else [], pa.int64()), pa.array(list(self.mean) if k else [], pa.list_(pa.float64())),
            pa.array(self.spread if k else [], pa.float64()), pa.array([float(np.sqrt(self.t2))] * k, pa.float64())], ["part", "n", "mean", "spread", "threshold"])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, about the mean of ``y`` so that far-off data keep their digits."""
    c = y.mean(0)
    x, y = x - c, y - c
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0.0)


def nearest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest ``y`` of every ``x``; the first of equal ones."""
    j = distances(x, y).argmin(1)
    return j, ((x - y[j]) ** 2).sum(1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, width)


def usable(v: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def leaf_table(df: DataFrame, vectors: Column, threshold: float = 0.5, max_leaves: int = 1000) -> DataFrame:
    """Leaves of all usable vectors: (part, n, mean, spread, threshold), at most ``max_leaves`` rows.

    Equal vectors are counted first (combined map-side), so a vector that a third of all rows hold is one row, and what a task reads is sorted: a rerun gives the same leaves. ``threshold`` is the radius
    that was reached; it is the given one unless the bound forced a larger one.
    """
    counted = (df.select(vectors.alias("v")).where(usable(F.col("v"))).select(F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
               .groupBy("v").agg(F.count("*").alias("n")).sortWithinPartitions("v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = Leaves(threshold, max_leaves)
        for b in batches:
            if b.num_rows:
                n = np.asarray(b.column("n"), dtype=np.int64)
                leaves.add(n, _matrix(b.column("v"), len(b.column("v")[0])), np.zeros(len(n)))
        yield leaves.table(TaskContext.get().partitionId())

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaves = Leaves(max(t.column("threshold").to_pylist()), max_leaves)
        n, spread = np.asarray(t.column("n"), dtype=np.int64), np.asarray(t.column("spread"), dtype=float)
        mean = np.asarray(t.column("mean").combine_chunks().flatten(), dtype=float).reshape(len(n), -1)
        order = np.lexsort((*mean.T[::-1], -n))
        leaves.add(n[order], mean[order], spread[order])
        return pa.Table.from_batches([leaves.table(t.column("part")[0].as_py() // FAN_IN)])

    out, parts = counted.mapInArrow(build, LEAF), num_partitions(df.sparkSession)
    while parts > 1:
        out = out.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, LEAF)
        parts = -(-parts // FAN_IN)
    return out


def ward(mean: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Labels of at most ``k`` clusters: the pair whose joining adds the least squared distance is joined, until ``k`` are left."""
    mean, weight = mean.astype(float).copy(), weight.astype(float).copy()
    m = len(weight)
    owner, alive = np.arange(m), np.ones(m, bool)
    cost = distances(mean, mean) * (weight[:, None] * weight / (weight[:, None] + weight))
    np.fill_diagonal(cost, np.inf)
    for _ in range(m - max(1, k)):
        low = cost.min(1)
        i = int(low.argmin())
        j = int(cost[i].argmin())
        mean[i] = (weight[i] * mean[i] + weight[j] * mean[j]) / (weight[i] + weight[j])
        weight[i] += weight[j]
        owner[owner == j] = i
        alive[j] = False
        cost[j, :] = cost[:, j] = np.inf
        row = ((mean - mean[i]) ** 2).sum(1) * (weight * weight[i] / (weight + weight[i]))
        row[~alive] = np.inf
        row[i] = np.inf
        cost[i, :] = cost[:, i] = row
    return owner


class FeatureTreeModel(Model):
    """Cluster of the nearest leaf; rows without a usable vector have none (null). Clusters are numbered by falling rows."""

    def __init__(self, leaves: np.ndarray, labels: np.ndarray, sizes: np.ndarray, threshold: float, featuresCol: str, predictionCol: str):
        super().__init__()
        self.leaves, self.labels, self.sizes, self.threshold = leaves, labels, sizes, threshold
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def _transform(self, df: DataFrame) -> DataFrame:
        leaves, labels = self.leaves, self.labels
        if not len(leaves):
            return df.withColumn(self.predictionCol, F.lit(None).cast("int"))

        @F.pandas_udf("int")
        def cluster(v: pd.Series) -> pd.Series:
            out = [labels[nearest(np.stack(v.iloc[lo:lo + BLOCK].to_list()), leaves)[0]] for lo in range(0, len(v), BLOCK)]
            return pd.Series(np.concatenate(out) if out else [], dtype="int32")

        # an unusable vector is replaced before it reaches the task and has no cluster after it
        v = vector_to_array(self.featuresCol)
        some = F.lit([0.0] * leaves.shape[1])
        return df.withColumn(self.predictionCol, F.when(usable(v), cluster(F.when(usable(v), v).otherwise(some))))


class FeatureTree(Estimator):
    """``k`` clusters over leaves of at most ``threshold`` radius; the leaves (at most ``max_leaves``) reach the driver. With ``weighted`` a leaf weighs as many as its rows in the last pass, else 1."""

    def __init__(self, k: int = 3, threshold: float = 0.5, max_leaves: int = 1000, weighted: bool = False, featuresCol: str = "features", predictionCol: str = "cluster"):
        super().__init__()
        self.k, self.threshold, self.max_leaves, self.weighted = k, threshold, max_leaves, weighted
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def _fit(self, df: DataFrame) -> FeatureTreeModel:
        rows = leaf_table(df, vector_to_array(self.featuresCol), self.threshold, self.max_leaves).collect()
        if not rows:
            return FeatureTreeModel(np.zeros((0, 0)), np.zeros(0, int), np.zeros(0, int), self.threshold, self.featuresCol, self.predictionCol)
        rows.sort(key=lambda r: (-r["n"], r["mean"]))
        n, mean = np.array([r["n"] for r in rows]), np.array([r["mean"] for r in rows])
        owner = ward(mean, n if self.weighted else np.ones(len(n)), self.k)
        size = {o: int(n[owner == o].sum()) for o in np.unique(owner)}
        rank = {o: i for i, o in enumerate(sorted(size, key=lambda o: (-size[o], o)))}
        labels = np.array([rank[o] for o in owner])
        return FeatureTreeModel(mean, labels, np.array(sorted(size.values(), reverse=True)), max(r["threshold"] for r in rows), self.featuresCol, self.predictionCol)
