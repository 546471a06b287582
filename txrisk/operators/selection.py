"""Dimension reduction and feature selection.

Data is reduced by Spark to p x p or (feature, bin, label) aggregates; the driver only ranks features.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from txrisk.functions.scale import attach, cpu_threads, exact_quantile_row, hash_u32, keep
from txrisk.operators.encoders import standard_scaler
from txrisk.operators.neighbor_information import neighbor_information
from txrisk.operators.neighbors import vector
from txrisk.operators.outliers import moments
from txrisk.schema import DEFAULT, Columns


# ------------------------------------------------------------------ projections

@dataclass
class PcaModel:
    scaler: object
    model: object
    features: list[str]
    k: int

    @property
    def explained(self) -> list[float]:
        return [float(v) for v in self.model.explainedVariance]

    def transform(self, df: DataFrame, prefix: str = "pca") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        x = self.scaler.transform(df.select("*", *[F.col(c).alias(f"__{c}") for c in self.features]))
        x = VectorAssembler(inputCols=self.features, outputCol="__in").transform(x)
        x = self.model.transform(x).withColumn("__arr", vector_to_array("__out"))
        rest = [c for c in df.columns if c not in self.features]
        return x.select(*rest, *[F.col(f"__{c}").alias(c) for c in self.features],
                        *[F.col("__arr")[i].alias(f"{prefix}_{i}") for i in range(self.k)])


def pca(df: DataFrame, features: list[str], n: int) -> PcaModel:
    """Standardise, then project; the number of components is clipped to the number of columns."""
    k = min(n, len(features))
    scaler = standard_scaler(df, features)
    x = VectorAssembler(inputCols=features, outputCol="__in").transform(scaler.transform(df.select(*features)))
    return PcaModel(scaler, PCA(k=k, inputCol="__in", outputCol="__out").fit(x), features, k)


@dataclass
class NystroemMap:
    landmarks: np.ndarray
    basis: np.ndarray
    features: list[str]
    gamma: float
    degree: int

    def transform(self, df: DataFrame, prefix: str = "nystroem") -> DataFrame:
        z, basis, gamma, degree = self.landmarks, self.basis, self.gamma, self.degree

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack([np.asarray(a, dtype=float) for a in v])
            return pd.Series(list(((gamma * (x @ z.T) + 1.0) ** degree) @ basis))

        out = df.withColumn("__p", project(vector(self.features)))
        return out.select(*df.columns, *[F.col("__p")[i].alias(f"{prefix}_{i}") for i in range(len(z))])


def nystroem(df: DataFrame, features: list[str], m: int = 50, degree: int = 2, seed: int = 0, cols: Columns = DEFAULT) -> NystroemMap:
    """Polynomial kernel against ``m`` landmark rows, whitened by the landmark kernel."""
    rows = df.select(hash_u32(cols.id, seed).alias("h"), vector(features).alias("v")).orderBy("h").limit(m).collect()
    z = np.array([r["v"] for r in rows], dtype=float)
    gamma = 1.0 / len(features)
    kernel = (gamma * (z @ z.T) + 1.0) ** degree
    u, s, vt = np.linalg.svd(kernel)
    basis = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt
    return NystroemMap(z, basis.T, features, gamma, degree)


# ------------------------------------------------------------------ univariate scores

def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10,
                       discrete: list[str] = ()) -> DataFrame:
    """(feature, mi): mutual information with the label; continuous features in exact quantile bins."""
    cont = [c for c in features if c not in discrete]
    edges = exact_quantile_row(df, cont, [i / bins for i in range(1, bins)]) if cont else {}

    def bin_of(c: str):
        if c in discrete:
            return F.col(c).cast("string")
        cuts = sorted(set(edges[c]))
        below = [(F.col(c) > e).cast("int") for e in cuts]
        total = below[0]
        for b in below[1:]:
            total = total + b
        return total.cast("string")

    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), bin_of(c).alias("b")) for c in features])).alias("x")).select("y", "x.*")
    return information(long)


def information(long: DataFrame) -> DataFrame:
    """Mutual information of ``b`` and ``y`` per ``feature`` from one contingency aggregate."""
    cells = long.groupBy("feature", "b", "y").agg(F.count("*").cast("double").alias("o"))
    rows = cells.groupBy("feature", "b").agg(F.sum("o").alias("r"))
    columns = cells.groupBy("feature", "y").agg(F.sum("o").alias("c"))
    total = cells.groupBy("feature").agg(F.sum("o").alias("n"))
    full = attach(attach(attach(cells, rows, ["feature", "b"]), columns, ["feature", "y"]), total, "feature")
    o, r, c, n = (F.col(x) for x in ("o", "r", "c", "n"))
    return full.groupBy("feature").agg(F.sum(o / n * F.log(o * n / (r * c))).alias("mi"))


def anova_f(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, f): one-way ANOVA F statistic between the label's classes."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("x")).select("y", "x.*")
    per = long.groupBy("feature", "y").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    grand = per.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"), F.sum("n").alias("t"),
                                       F.count("*").alias("k"))
    j = attach(per, grand, "feature")
    between = F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g")))
    within = F.sum(F.col("n") * F.col("s"))
    k, t = F.max("k"), F.max("t")
    return j.groupBy("feature").agg(F.try_divide(between / (k - 1), within / (t - k)).alias("f"))


def label_correlation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, corr): absolute Pearson correlation with the label."""
    row = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in features])).alias("x")
                      ).select("x.*")


def select_k_best(df: DataFrame, features: list[str], label: str, k: int, score: str = "mi", **params) -> list[str]:
    """Names of the k best features (ties by name); k is clipped to the number of columns."""
    table = {"mi": mutual_information, "f": anova_f, "corr": label_correlation, "neighbors": neighbor_information}[score](df, features, label, **params)
    value = table.columns[1]
    rows = table.orderBy(F.col(value).desc_nulls_last(), "feature").limit(min(k, len(features))).collect()
    return [r["feature"] for r in rows]


# ------------------------------------------------------------------ correlation and lasso

def _absolute_correlation(df: DataFrame, features: list[str], method: str) -> np.ndarray:
    """p x p; a pair without a correlation has 0."""
    if method == "pearson":
        _, cov, _ = moments(df, features)
        sd = np.sqrt(np.diag(cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(np.abs(cov / np.outer(sd, sd)))
    from txrisk.operators.aggregates import correlation_matrix
    at, corr = {c: i for i, c in enumerate(features)}, np.eye(len(features))
    for r in correlation_matrix(df, features, method).collect() if len(features) > 1 else ():
        corr[at[r["x"]], at[r["y"]]] = corr[at[r["y"]], at[r["x"]]] = abs(r["corr"])
    return np.nan_to_num(corr)


def correlated_groups(df: DataFrame, features: list[str], threshold: float = 0.8, method: str = "pearson") -> list[list[str]]:
    """Greedy groups: a feature collects the later, still free ones it correlates with by value (pearson) or by rank (spearman)."""
    corr = _absolute_correlation(df, features, method)
    free, groups = list(range(len(features))), []
    while free:
        i = free.pop(0)
        mates = [j for j in free if corr[i, j] > threshold]
        free = [j for j in free if j not in mates]
        groups.append([features[i], *[features[j] for j in mates]])
    return groups


def smart_correlated_selection(df: DataFrame, features: list[str], threshold: float = 0.8, method: str = "pearson") -> list[str]:
    """Of every correlated group the feature with the highest variance, in input order."""
    _, cov, _ = moments(df, features)
    var = dict(zip(features, np.diag(cov)))
    chosen = {max(g, key=lambda c: (var[c], -features.index(c))) for g in correlated_groups(df, features, threshold, method)}
    return [c for c in features if c in chosen]


def group_lasso_selection(df: DataFrame, numeric: list[str], categorical: list[str], label: str, strength: float = 0.01,
                          n_hash: int = 8, cut: float = 1e-3, max_iter: int = 500) -> list[str]:
    """Features kept by a group lasso: the hash slots of one category form a group, numerics are unpenalised.

    One distributed aggregate gives the Gram matrix; proximal gradient steps run on p x p numbers.
    """
    from txrisk.operators.encoders import md5_mod
    scaled = standard_scaler(df, numeric).transform(df.select(label, *numeric, *categorical)) if numeric else df
    slots = {c: [f"{c}__{j}" for j in range(n_hash)] for c in categorical}
    x = scaled.withColumns({f"__slot_{c}": md5_mod(F.coalesce(F.col(c).cast("string"), F.lit("nan")), n_hash) for c in categorical})
    x = x.withColumns({s: (F.col(f"__slot_{c}") == j).cast("double") for c in categorical for j, s in enumerate(slots[c])})
    names = [*numeric, *[s for c in categorical for s in slots[c]]]
    _, cov, _ = moments(x.withColumn("__y", F.col(label).cast("double")), [*names, "__y"])
    gram, target = cov[:-1, :-1], cov[:-1, -1]
    groups = [list(range(len(numeric) + i * n_hash, len(numeric) + (i + 1) * n_hash)) for i in range(len(categorical))]
    step = 1.0 / max(1e-12, np.linalg.eigvalsh(gram)[-1])
    beta = np.zeros(len(names))
    for _ in range(max_iter):
        new = beta - step * (gram @ beta - target)
        for g in groups:
            norm = np.linalg.norm(new[g])
            new[g] *= max(0.0, 1 - step * strength * np.sqrt(len(g)) / norm) if norm > 0 else 0.0
        done = np.abs(new - beta).max() < 1e-10
        beta = new
        if done:
            break
    kept = [c for i, c in enumerate(numeric) if abs(beta[i]) > cut]
    return kept + [c for c, g in zip(categorical, groups) if np.abs(beta[g]).max() > cut]


# ------------------------------------------------------------------ wrapper selection

def cv_score(df: DataFrame, features: list[str], label: str, learner, evaluate: Callable[[DataFrame], float], fold: str = "fold") -> float:
    """Mean score over folds given by a fold column; every fold trains on the other folds."""
    x = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    scores = []
    for f in folds:
        model = learner.fit(x.where(F.col(fold) != f))
        scores.append(evaluate(model.transform(x.where(F.col(fold) == f))))
    return float(np.mean(scores))


def importances(df: DataFrame, features: list[str], learner) -> dict[str, float]:
    """Tree importances or absolute coefficients of one fit."""
    model = learner.fit(VectorAssembler(inputCols=features, outputCol="features").transform(df))
    values = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return dict(zip(features, np.abs(values.toArray()).tolist()))


def recursive_elimination_cv(df: DataFrame, features: list[str], label: str, learner, evaluate, step: int = 1,
                             min_features: int = 1) -> list[str]:
    """Drop the ``step`` least important features per round; keep the round with the best fold score."""
    data = keep(df)
    current, best, best_score = list(features), list(features), -np.inf
    while True:
        score = cv_score(data, current, label, learner, evaluate)
        if score >= best_score:
            best, best_score = list(current), score
        if len(current) <= min_features:
            break
        imp = importances(data, current, learner)
        worst = sorted(current, key=lambda c: (imp[c], c))[:min(step, len(current) - min_features)]
        current = [c for c in current if c not in worst]
    data.unpersist()
    return best


def sequential_selection(df: DataFrame, features: list[str], label: str, learner, evaluate, k: int, tol: float = 1e-4) -> list[str]:
    """Add the feature that helps most until ``k`` are chosen or the gain falls below ``tol``."""
    data = keep(df)
    chosen, score = [], -np.inf
    with ThreadPoolExecutor(cpu_threads()) as pool:
        while len(chosen) < min(k, len(features)):
            rest = [c for c in features if c not in chosen]
            got = list(pool.map(lambda c: cv_score(data, [*chosen, c], label, learner, evaluate), rest))
            i = max(range(len(rest)), key=lambda j: (got[j], -j))
            if chosen and got[i] - score < tol:
                break
            chosen.append(rest[i])
            score = got[i]
    data.unpersist()
    return chosen


def recursive_addition(df: DataFrame, features: list[str], label: str, learner, evaluate, threshold: float = 0.05) -> list[str]:
    """Offer features in order of importance; keep those that raise the fold score by more than ``threshold``."""
    data = keep(df)
    imp = importances(data, features, learner)
    ranked = sorted(features, key=lambda c: (-imp[c], c))
    chosen = [ranked[0]]
    score = cv_score(data, chosen, label, learner, evaluate)
    for c in ranked[1:]:
        new = cv_score(data, [*chosen, c], label, learner, evaluate)
        if new - score > threshold:
            chosen.append(c)
            score = new
    data.unpersist()
    return chosen


def pca_then_select(df: DataFrame, features: list[str], label: str, n: int, k: int, score: str = "f") -> tuple[PcaModel, list[str]]:
    """PCA followed by the k best components."""
    model = pca(df, features, n)
    out = model.transform(df)
    return model, select_k_best(out, [f"pca_{i}" for i in range(model.k)], label, k, score)
