"""Classifiers, ensembles and their fitting helpers on top of ``pyspark.ml``.

Estimators are plain ``pyspark.ml`` learners with class weights; ensembles are Estimator/Model pairs whose
transform only adds columns, so they chain with the rest of a pipeline.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from txrisk.functions.scale import checkpoint, cpu_threads, hash_unit, keep
from txrisk.operators.encoders import count_encoder, standard_scaler
from txrisk.operators.feature_tree import FeatureTree
from txrisk.operators.linear import ProximalHinge
from txrisk.operators.metrics import best_f1_threshold
from txrisk.operators.splits import class_sizes, random_undersample
from txrisk.schema import DEFAULT, Columns

WEIGHT = "weight"
POSITIVE_WEIGHT = 1000.0   # constant positive weight of the boosters


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error").transform(df)


def class_weights(df: DataFrame, mode: str | float = "balanced", cols: Columns = DEFAULT, name: str = WEIGHT) -> DataFrame:
    """Row weights: balanced is n / (2 * class size), a number is the weight of positives."""
    y = F.col(cols.label) == 1
    if mode == "balanced":
        pos, neg = class_sizes(df, cols)
        n = pos + neg
        return df.withColumn(name, F.when(y, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(neg, 1))))
    return df.withColumn(name, F.when(y, float(mode)).otherwise(1.0))


# ------------------------------------------------------------------ learners

def _std(cols: Columns, weighted: bool = True) -> dict:
    return {"featuresCol": "features", "labelCol": cols.label, **({"weightCol": WEIGHT} if weighted else {})}


def logistic(cols: Columns = DEFAULT, c: float = 1.0, **p) -> LogisticRegression:
    return LogisticRegression(**_std(cols), **{"regParam": 0.01 / c, "elasticNetParam": 0.0, "maxIter": 100, **p})


def linear_svm(cols: Columns = DEFAULT, **p) -> LinearSVC:
    return LinearSVC(**_std(cols), **{"regParam": 0.01, "maxIter": 100, **p})


def sgd_linear(cols: Columns = DEFAULT, loss: str = "log_loss", penalty: str = "l2", alpha: float = 1e-4, l1_ratio: float = 0.15, **p):
    """Linear model by hinge or log loss with L1, L2 or elastic-net penalty."""
    mix = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
    if loss == "hinge":
        return linear_svm(cols, regParam=alpha, **p) if penalty == "l2" else ProximalHinge(mix, alpha, cols=cols, weight=WEIGHT, **p)
    return LogisticRegression(**_std(cols), **{"regParam": alpha, "elasticNetParam": mix, "maxIter": 100, **p})


def perceptron(n_features: int, hidden: tuple[int, ...] = (64,), cols: Columns = DEFAULT, **p) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(**_std(cols, False), layers=[n_features, *hidden, 2], **{"maxIter": 100, "seed": 0, **p})


def decision_tree(cols: Columns = DEFAULT, **p) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(**_std(cols), **{"maxDepth": 7, "impurity": "gini", "seed": 0, **p})


def random_forest(cols: Columns = DEFAULT, **p) -> RandomForestClassifier:
    return RandomForestClassifier(**_std(cols), **{"maxDepth": 3, "numTrees": 50, "featureSubsetStrategy": "sqrt", "seed": 0, **p})


def gradient_boosting(cols: Columns = DEFAULT, **p) -> GBTClassifier:
    """Boosted shallow trees: the plain, histogram and vendor booster family."""
    return GBTClassifier(**_std(cols), **{"maxDepth": 3, "maxIter": 30, "stepSize": 0.1, "subsamplingRate": 0.8,
                                          "featureSubsetStrategy": "0.8", "seed": 0, **p})


LEARNERS: dict[str, Callable] = {
    "logistic": logistic, "linear_svm": linear_svm, "sgd": sgd_linear, "tree": decision_tree,
    "forest": random_forest, "gbt": gradient_boosting,
}


def fraud_probability(scored: DataFrame, name: str = "predictions") -> DataFrame:
    """Probability of class 1; margin models use the logistic of their margin."""
    if "probability" in scored.columns:
        return scored.withColumn(name, vector_to_array("probability")[1])
    return scored.withColumn(name, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def score_table(model, df: DataFrame, threshold: float = 0.5, name: str = "predictions") -> DataFrame:
    """Rows with fraud probability and predicted class; works on unlabelled rows."""
    out = fraud_probability(model.transform(df), name)
    return out.withColumn("predicted", (F.col(name) >= threshold).cast("int"))


def positive_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("predicted").alias("n_positive"), F.avg(F.col("predicted").cast("double")).alias("positive_rate"))


def fit_and_predict(learner, train: DataFrame, test: DataFrame, features: list[str], scale: bool = False,
                    cols: Columns = DEFAULT) -> dict:
    """Fit, score both sets, and measure the seconds of both steps."""
    if scale:
        scaler = standard_scaler(train, features)
        train, test = scaler.transform(train), scaler.transform(test)
    train, test = keep(assemble(class_weights(train, cols=cols), features)), assemble(test, features)
    t0 = time.time()
    model = learner.fit(train)
    t1 = time.time()
    scored_train, scored_test = fraud_probability(model.transform(train)), fraud_probability(model.transform(test))
    scored_test.agg(F.sum("predictions")).collect()
    t2 = time.time()
    return {"model": model, "train": scored_train, "test": scored_test, "training_time": t1 - t0, "prediction_time": t2 - t1}


# ------------------------------------------------------------------ client clusters

def _clusters(method: str, k: int, seed: int, name: str) -> Estimator:
    if method == "tree":
        return FeatureTree(k, predictionCol=name)
    return {"bisecting": BisectingKMeans, "kmeans": KMeans}[method](k=k, seed=seed, featuresCol="features", predictionCol=name)


def client_clusters(profiles: DataFrame, key: str, numeric: list[str], categorical: list[str] = (), k: int = 5,
                    method: str = "bisecting", seed: int = 0) -> DataFrame:
    """(key, CustomerCluster): cluster of each client profile; categoricals are count-encoded.

    ``method`` is bisecting (k-means), kmeans or tree (merged clustering features, then Ward).
    """
    x = profiles
    names = list(numeric)
    if categorical:
        x = count_encoder(profiles, list(categorical)).transform(profiles)
        names += [f"{c}_count" for c in categorical]
    x = x.na.fill(0.0, names)
    x = standard_scaler(x, names).transform(x)
    v = keep(assemble(x.select(key, *names), names))
    learner = _clusters(method, k, seed, "CustomerCluster")
    return learner.fit(v).transform(v).select(key, "CustomerCluster")


# ------------------------------------------------------------------ ensembles

class ScoreAverage(Model):
    """Mean (optionally weighted) of member scores; members are fitted models with optional vector slices."""

    def __init__(self, members: list, weights: list[float] | None = None, slices: list[list[int] | None] | None = None):
        super().__init__()
        self.members = members
        self.weights = weights or [1.0] * len(members)
        self.slices = slices or [None] * len(members)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (m, s) in enumerate(zip(self.members, self.slices)):
            out = fraud_probability(_apply(m, out, s), f"__s{i}").drop("rawPrediction", "probability", "prediction", "__slice")
        total = sum(self.weights)
        mean = reduce(lambda a, b: a + b, [F.col(f"__s{i}") * w for i, w in enumerate(self.weights)]) / total
        out = out.withColumn("__p", mean).drop(*[f"__s{i}" for i in range(len(self.members))])
        return out.withColumns({"probability": array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))),
                                "prediction": (F.col("__p") >= 0.5).cast("double")}).drop("__p")


def _apply(model, df: DataFrame, indices: list[int] | None) -> DataFrame:
    if indices is None:
        return model.transform(df)
    return model.transform(VectorSlicer(inputCol="features", outputCol="__slice", indices=indices).transform(df))


class SoftVoting(Estimator):
    """Mean probability of several learners."""

    def __init__(self, learners: list, weights: list[float] | None = None):
        super().__init__()
        self.learners, self.weights = learners, weights

    def _fit(self, df: DataFrame) -> ScoreAverage:
        with ThreadPoolExecutor(cpu_threads()) as pool:
            return ScoreAverage(list(pool.map(lambda l: l.fit(df), self.learners)), self.weights)


class UndersampledBags(Estimator):
    """Each bag keeps all positives and its own hash sample of negatives; probabilities are averaged."""

    def __init__(self, learner, n_bags: int = 10, ratio: float = 1.0, seed: int = 0, cols: Columns = DEFAULT):
        super().__init__()
        self.learner, self.n_bags, self.ratio, self.seed, self.cols = learner, n_bags, ratio, seed, cols

    def _fit(self, df: DataFrame) -> ScoreAverage:
        def one(i: int):
            bag = random_undersample(df, self.ratio, f"{self.seed}b{i}", self.cols)
            return self.learner.fit(class_weights(bag, "balanced", self.cols))
        with ThreadPoolExecutor(cpu_threads()) as pool:
            return ScoreAverage(list(pool.map(one, range(self.n_bags))))


class Bagging(Estimator):
    """Members see a hash share of rows and a random subset of vector positions."""

    def __init__(self, learner, n_features: int, n_bags: int = 10, row_share: float = 0.8, feature_share: float = 0.8,
                 seed: int = 0, cols: Columns = DEFAULT):
        super().__init__()
        self.learner, self.n_features, self.n_bags = learner, n_features, n_bags
        self.row_share, self.feature_share, self.seed, self.cols = row_share, feature_share, seed, cols

    def _fit(self, df: DataFrame) -> ScoreAverage:
        import random
        k = max(1, int(round(self.n_features * self.feature_share)))
        slices = [sorted(random.Random(f"{self.seed}-{i}").sample(range(self.n_features), k)) for i in range(self.n_bags)]

        def one(i: int):
            rows = df.where(hash_unit(self.cols.id, f"{self.seed}bag{i}") < self.row_share)
            sliced = VectorSlicer(inputCol="features", outputCol="__slice", indices=slices[i]).transform(rows)
            return self.learner.copy({self.learner.featuresCol: "__slice"}).fit(sliced)
        with ThreadPoolExecutor(cpu_threads()) as pool:
            return ScoreAverage(list(pool.map(one, range(self.n_bags))), None, slices)


class BoostedRounds(Estimator):
    """Adaptive boosting with a weight column; ``ratio`` adds random undersampling of each round.

    Weights are carried as a column; every few rounds the table is checkpointed so the plan stays short.
    """

    def __init__(self, learner, n_rounds: int = 10, learning_rate: float = 1.0, ratio: float | None = None, seed: int = 0,
                 every: int = 4, cols: Columns = DEFAULT):
        super().__init__()
        self.learner, self.n_rounds, self.rate, self.ratio = learner, n_rounds, learning_rate, ratio
        self.seed, self.every, self.cols = seed, every, cols

    def _fit(self, df: DataFrame) -> "BoostedModel":
        y = F.col(self.cols.label)
        state = df.withColumn("__w", F.lit(1.0))
        learner = self.learner.copy({self.learner.weightCol: "__w"})
        members, alphas = [], []
        for r in range(self.n_rounds):
            train = state if self.ratio is None else random_undersample(state, self.ratio, f"{self.seed}r{r}", self.cols)
            model = learner.fit(train)
            pred = model.transform(state)
            wrong = (F.col("prediction") != y.cast("double"))
            row = pred.agg(F.sum("__w"), F.sum(F.when(wrong, F.col("__w")).otherwise(0.0))).first()
            err = row[1] / row[0]
            if err >= 0.5 and members:
                break
            err = min(max(err, 1e-10), 1 - 1e-10)
            alpha = self.rate * math.log((1 - err) / err)
            members.append(model)
            alphas.append(alpha)
            if err <= 1e-10:
                break
            # keep the total weight constant so that long runs stay in range
            grown = row[0] + row[1] * (math.exp(alpha) - 1)
            state = pred.withColumn("__w", F.when(wrong, F.col("__w") * math.exp(alpha)).otherwise(F.col("__w")) * (row[0] / grown))
            state = state.select(*df.columns, "__w")
            if (r + 1) % self.every == 0:
                state = checkpoint(state)
        return BoostedModel(members, alphas)


class BoostedModel(Model):
    def __init__(self, members: list, alphas: list[float]):
        super().__init__()
        self.members, self.alphas = members, alphas

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("__m", F.lit(0.0))
        for m, a in zip(self.members, self.alphas):
            out = m.transform(out).withColumn("__m", F.col("__m") + a * (2 * F.col("prediction") - 1))
            out = out.drop("rawPrediction", "probability", "prediction")
        total = sum(abs(a) for a in self.alphas) or 1.0
        p = 1 / (1 + F.exp(-2 * F.col("__m") / total))
        return out.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p >= 0.5).cast("double")}).drop("__m")


class Stacking(Estimator):
    """Probabilities of fitted base models as the features of a final logistic regression."""

    def __init__(self, fitted: list, final=None, cols: Columns = DEFAULT):
        super().__init__()
        self.fitted, self.cols = fitted, cols
        self.final = final or LogisticRegression(featuresCol="__stack", labelCol=cols.label, weightCol=WEIGHT, regParam=0.01)

    def _fit(self, df: DataFrame) -> "StackingModel":
        x = stacked(self.fitted, df)
        x = x if WEIGHT in x.columns else class_weights(x, "balanced", self.cols)
        return StackingModel(self.fitted, self.final.fit(x))


class StackingModel(Model):
    def __init__(self, fitted: list, final):
        super().__init__()
        self.fitted, self.final = fitted, final

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.final.transform(stacked(self.fitted, df)).drop("__stack")


def stacked(fitted: list, df: DataFrame) -> DataFrame:
    out = df
    for i, m in enumerate(fitted):
        out = fraud_probability(m.transform(out), f"__b{i}").drop("rawPrediction", "probability", "prediction", "features_scaled")
    names = [f"__b{i}" for i in range(len(fitted))]
    return assemble(out, names, "__stack").drop(*names)


class ClusterwiseClassifier(Estimator):
    """K-means or a feature tree (``method``); per cluster the features kept by an elastic net feed a tree; rows are routed at scoring."""

    def __init__(self, n_clusters: int = 3, reg: float = 0.01, mix: float = 0.5, tree: dict | None = None, seed: int = 0,
                 cols: Columns = DEFAULT, method: str = "kmeans"):
        super().__init__()
        self.n_clusters, self.reg, self.mix, self.tree, self.seed, self.cols = n_clusters, reg, mix, tree or {}, seed, cols
        self.method = method

    def _fit(self, df: DataFrame) -> "ClusterwiseModel":
        km = _clusters(self.method, self.n_clusters, self.seed, "__cluster").fit(df)
        x = keep(km.transform(df))
        rate = x.groupBy("__cluster").agg(F.avg(F.col(self.cols.label).cast("double")).alias("r")).collect()   # one row per cluster
        members = {}
        for r in rate:
            c, share = r["__cluster"], r["r"]
            part = x.where(F.col("__cluster") == c)
            if share in (0.0, 1.0):
                members[c] = (None, share)
                continue
            net = LinearRegression(featuresCol="features", labelCol=self.cols.label, regParam=self.reg, elasticNetParam=self.mix).fit(part)
            idx = [i for i, b in enumerate(net.coefficients.toArray()) if abs(b) > 1e-6]
            idx = idx or list(range(len(net.coefficients)))
            sliced = VectorSlicer(inputCol="features", outputCol="__slice", indices=idx).transform(class_weights(part, "balanced", self.cols))
            tree = decision_tree(self.cols, **self.tree)
            members[c] = (tree.copy({tree.featuresCol: "__slice"}).fit(sliced), idx)
        x.unpersist()
        overall = df.agg(F.avg(F.col(self.cols.label).cast("double"))).first()[0]
        return ClusterwiseModel(km, members, overall or 0.0)


class ClusterwiseModel(Model):
    def __init__(self, clusters, members: dict, overall: float = 0.0):
        super().__init__()
        self.clusters, self.members, self.overall = clusters, members, overall

    def _transform(self, df: DataFrame) -> DataFrame:
        x = self.clusters.transform(df)
        parts = []
        # rows of a cluster that had no training rows get the overall rate
        known = sorted(self.members.items())
        for c, (model, info) in [*known, (None, (None, self.overall))]:
            rows = x.where(~F.coalesce(F.col("__cluster").isin([k for k, _ in known]), F.lit(False)) if c is None else F.col("__cluster") == c)
            if model is None:
                p = F.lit(float(info))
                parts.append(rows.withColumns({"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p >= 0.5).cast("double")}))
            else:
                parts.append(_apply(model, rows, info).drop("rawPrediction", "__slice"))
        names = [*df.columns, "probability", "prediction"]
        return reduce(DataFrame.unionByName, [p.select(*names) for p in parts])


# ------------------------------------------------------------------ calibration and thresholds

def calibrate(scored: DataFrame, score: str = "predictions", cols: Columns = DEFAULT):
    """Sigmoid calibration: a logistic fit of the label on held-out scores; returns ``f(df) -> df``."""
    x = assemble(scored.select(score, cols.label), [score], "__cal")
    m = LogisticRegression(featuresCol="__cal", labelCol=cols.label, regParam=0.0).fit(x)
    a, b = float(m.coefficients[0]), float(m.intercept)
    return lambda df, name="calibrated": df.withColumn(name, 1 / (1 + F.exp(-(F.col(score) * a + b))))


def tune_threshold(scored: DataFrame, grid: int = 100, score: str = "predictions", cols: Columns = DEFAULT) -> float:
    """Threshold of a uniform grid with the highest F1 on held-out scores."""
    return best_f1_threshold(scored, [i / grid for i in range(1, grid)], score, cols.label).first()["Threshold"]


def best_boosting_stage(model, validation: DataFrame, threshold: float = 0.5, cols: Columns = DEFAULT) -> DataFrame:
    """(stage, f1) for every prefix of a boosted ensemble, in one pass over the validation rows."""
    trees, weights = model.trees, list(model.treeWeights)
    out = validation
    for i, t in enumerate(trees):
        t = t.copy()
        out = t.setPredictionCol(f"__t{i}").setFeaturesCol("features").transform(out)
    margin, parts = F.lit(0.0), []
    for i, w in enumerate(weights):
        margin = margin + F.col(f"__t{i}") * float(w)
        parts.append(F.struct(F.lit(i + 1).alias("stage"), (1 / (1 + F.exp(-2 * margin))).alias("p")))
    long = out.select(cols.label, F.explode(F.array(*parts)).alias("x")).select(cols.label, "x.*")
    y, hit = F.col(cols.label) == 1, F.col("p") >= threshold
    counts = long.groupBy("stage").agg(F.count(F.when(hit & y, 1)).alias("tp"), F.count(F.when(hit & ~y, 1)).alias("fp"),
                                       F.count(F.when(~hit & y, 1)).alias("fn"))
    return counts.select("stage", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def soft_vote(df: DataFrame, scores: list[str], name: str = "predictions", weights: list[float] | None = None) -> DataFrame:
    """Mean of score columns."""
    w = weights or [1.0] * len(scores)
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) * x for c, x in zip(scores, w)]) / float(sum(w)))
