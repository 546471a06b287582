"""Linear classifier by hinge loss under L1, L2 or elastic-net penalty.

Each round is one aggregate of p + 2 sums (loss, gradient) over all rows, after one of the p * p moments; the driver holds the coefficients and takes an accelerated proximal step, which sets
coefficients to exactly zero under L1. The hinge's corner is rounded over a width that shrinks in stages, each starting where the one before ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from txrisk.functions.scale import keep
from txrisk.schema import DEFAULT, Columns

# Widths of the rounded corner; the loss is off by at most half the last one.
WIDTHS = (0.5, 0.07, 0.01)
BLOCK_ROWS = 4096


class HingeModel(Model):
    """Margin of ``features``; ``objective`` lists the penalised loss of every round."""

    def __init__(self, coefficients: np.ndarray, intercept: float, objective: list[float]):
        super().__init__()
        self.coefficients, self.intercept, self.objective = coefficients, intercept, objective

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        margin = F.lit(float(self.intercept))
        for j in np.flatnonzero(self.coefficients):
            margin = margin + x[int(j)] * float(self.coefficients[j])
        out = df.withColumn("__m", margin)
        return out.withColumns({"rawPrediction": array_to_vector(F.array(-F.col("__m"), F.col("__m"))), "prediction": (F.col("__m") > 0).cast("double")}).drop("__m")


class ProximalHinge(Estimator):
    """sum(w * max(0, 1 - y f(x))) / sum(w) + alpha * (l1_ratio * |b|_1 + (1 - l1_ratio) / 2 * |b|_2^2), b being the coefficients of standardised features.

    Rows without a ``weight`` column weigh 1. Constant features get 0. A table without rows or without weight gives the zero model.
    """

    def __init__(self, l1_ratio: float = 1.0, alpha: float = 1e-4, max_iter: int = 150, tol: float = 1e-5, cols: Columns = DEFAULT, weight: str = "weight"):
        super().__init__()
        self.l1_ratio, self.alpha, self.max_iter, self.tol, self.cols, self.weight = l1_ratio, alpha, max_iter, tol, cols, weight

    def _fit(self, df: DataFrame) -> HingeModel:
        w = F.col(self.weight).cast("double") if self.weight in df.columns else F.lit(1.0)
        rows = df.select(F.when(F.col(self.cols.label) == 1, 1.0).otherwise(-1.0).alias("y"), w.alias("w"), vector_to_array("features").alias("x"))
        blocks = keep(_blocks(rows))
        try:
            return self._solve(blocks)
        finally:
            blocks.unpersist()

    def _solve(self, rows: DataFrame) -> HingeModel:
        first = rows.select("p").first()
        if first is None:
            return HingeModel(np.zeros(0), 0.0, [])
        p = first.p
        s = _sums(rows, lambda y, w, x: np.concatenate([[w.sum()], w @ x]), p + 1)
        total = s[0]
        if not total > 0:
            return HingeModel(np.zeros(p), 0.0, [])
        mean = s[1:p + 1] / total
        # a second pass around the mean: large values lose nothing
        moments = _sums(rows, lambda y, w, x: ((x - mean).T @ ((x - mean) * w[:, None])).ravel(), p * p).reshape(p, p) / total
        spread = np.sqrt(np.diag(moments))
        scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean)), spread, np.inf)
        # the largest eigenvalue of the standardised moments bounds the curvature; the intercept, apart from centred features, has 1
        curve = max(1.0, float(np.linalg.eigvalsh(moments / np.outer(scale, scale)).max()) * (1 + 1e-6))
        b, objective = np.zeros(p + 1), []
        for i, width in enumerate(WIDTHS):
            step = 1.0 / (curve / width + self.alpha * (1 - self.l1_ratio))
            at, t = b, 1.0
            # rounds that a stage leaves over go to the later ones
            for _ in range(max(1, (self.max_iter - len(objective)) // (len(WIDTHS) - i))):
                def part(y, w, x, at=at, width=width):
                    z = (x - mean) / scale
                    gap = 1 - y * (z @ at[:p] + at[p])
                    pull = -w * y * np.clip(gap / width, 0, 1)
                    return np.concatenate([pull @ z, [pull.sum(), w @ np.maximum(gap, 0)]])
                g = _sums(rows, part, p + 2) / total
                objective.append(float(g[p + 1] + self._penalty(at[:p])))
                move = at - step * g[:p + 1]
                move[:p] -= step * self.alpha * (1 - self.l1_ratio) * at[:p]
                move[:p] = np.sign(move[:p]) * np.maximum(np.abs(move[:p]) - step * self.alpha * self.l1_ratio, 0)
                turn = (at - move) @ (move - b) > 0     # the momentum points uphill: start it anew
                t_next = 1.0 if turn else (1 + np.sqrt(1 + 4 * t * t)) / 2
                at = move if turn else move + (t - 1) / t_next * (move - b)
                change, b, t = np.abs(move - b).max(), move, t_next
                if change < self.tol * max(1.0, np.abs(b).max()):
                    break
        coefficients = b[:p] / scale
        return HingeModel(coefficients, float(b[p] - coefficients @ mean), objective)

    def _penalty(self, b: np.ndarray) -> float:
        return self.alpha * (self.l1_ratio * np.abs(b).sum() + (1 - self.l1_ratio) / 2 * (b @ b))


def _blocks(rows: DataFrame) -> DataFrame:
    """(p, block): at most ``BLOCK_ROWS`` rows of label, weight and p features as one run of bytes, so that a round reads numbers and converts no rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                whole = np.column_stack([b["y"].to_numpy(zero_copy_only=False), b["w"].to_numpy(zero_copy_only=False), x])
                for a in range(0, len(whole), BLOCK_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([whole[a:a + BLOCK_ROWS].tobytes()], pa.binary())], names=["p", "block"])
    return rows.mapInArrow(pack, "p int, block binary")


def _sums(blocks: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part`` (labels, weights, features) over all rows: every task sends one number per place, summed by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for p, block in zip(b["p"].to_pylist(), b["block"]):
                m = np.frombuffer(block.as_buffer(), dtype=float).reshape(-1, p + 2)
                total += part(m[:, 0], m[:, 1], m[:, 2:])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["j", "v"])
    out = np.zeros(size)
    for r in blocks.mapInArrow(run, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect():
        out[r["j"]] = r["v"]
    return out
