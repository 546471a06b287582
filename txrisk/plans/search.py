"""Time-aware model selection: folds come from the split operators, fits run in a bounded thread pool."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F

from txrisk.functions.scale import cpu_threads, keep
from txrisk.operators import models as M
from txrisk.operators.metrics import SCORE, card_precision, ranking_scores, score_report
from txrisk.operators.splits import prequential_split, stratified_kfold, time_series_split
from txrisk.plans.workflow import Workflow, WorkflowOptions
from txrisk.schema import DEFAULT, Columns
from txrisk.sources.io import BestRun


def grid_of(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, v)) for v in product(*space.values())]


def sample_of(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """``n`` distinct random parameter sets, or the whole grid when it is smaller."""
    grid = grid_of(space)
    return grid if len(grid) <= n else random.Random(seed).sample(grid, n)


def evaluate(scored: DataFrame, k: int | None = None, threshold: float = 0.5, cols: Columns = DEFAULT) -> dict[str, float]:
    r = ranking_scores(scored, SCORE, cols.label).first()
    f = score_report(scored, threshold, SCORE, cols.label).first()
    out = {"AUC ROC": r["auc_roc"] or 0.0, "Average precision": r["average_precision"] or 0.0, "F1": f["f1"],
           "Precision": f["precision"], "Recall": f["recall"]}
    if k:
        out[f"Card Precision@{k}"] = card_precision(scored, k, cols=cols)
    return {m: float(v) for m, v in out.items()}


def run_folds(folds: DataFrame, features: list[str], learner_of: Callable[[dict], Estimator], grid: list[dict],
              test_split: str = "test", k: int | None = None, weight: str | float = "balanced",
              cols: Columns = DEFAULT) -> DataFrame:
    """(params, fold, metric, value): every parameter set on every fold of a (fold, split) table."""
    x = keep(M.assemble(folds, features))
    ids = sorted(r[0] for r in x.select("fold").distinct().collect())

    def one(job: tuple[dict, int]) -> list[tuple]:
        params, fold = job
        part = x.where(F.col("fold") == fold)
        train = M.class_weights(part.where("split = 'train'"), weight, cols)
        test = part.where(F.col("split") == test_split)
        t0 = time.time()
        model = learner_of(params).fit(train)
        t1 = time.time()
        scores = evaluate(M.fraud_probability(model.transform(test)), k, cols=cols)
        scores |= {"Fit time": t1 - t0, "Score time": time.time() - t1}
        return [(str(params), fold, m, v) for m, v in scores.items()]

    with ThreadPoolExecutor(cpu_threads()) as pool:
        rows = [r for got in pool.map(one, [(p, f) for p in grid for f in ids]) for r in got]
    x.unpersist()
    return folds.sparkSession.createDataFrame(rows, "params string, fold int, metric string, value double")


def summarise(trials: DataFrame) -> DataFrame:
    """(params, metric, mean, std) over folds."""
    return trials.groupBy("params", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def performance_table(validation: DataFrame, test: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide table with ``<metric> Validation``, ``... Std``, ``<metric> Test``, ``... Std`` per parameter set."""
    def wide(t: DataFrame, name: str) -> DataFrame:
        return summarise(t).groupBy("params").agg(*[e for m in metrics for e in (
            F.max(F.when(F.col("metric") == m, F.col("mean"))).alias(f"{m} {name}"),
            F.max(F.when(F.col("metric") == m, F.col("std"))).alias(f"{m} {name} Std"))])
    return wide(validation, "Validation").join(wide(test, "Test"), "params").withColumnRenamed("params", "Parameters summary")


def prequential_grid_search(df: DataFrame, features: list[str], learner_of, grid: list[dict], n_folds: int = 3, start=None,
                            train: int = 14, delay: int = 3, test: int = 7, k: int | None = None,
                            cols: Columns = DEFAULT) -> DataFrame:
    folds = prequential_split(df, n_folds, start, train, delay, test, cols=cols)
    return run_folds(folds, features, learner_of, grid, k=k, cols=cols)


def model_selection(df: DataFrame, features: list[str], learner_of, grid: list[dict], validation_start, test_start,
                    metrics: list[str] = ("AUC ROC", "Average precision"), cols: Columns = DEFAULT, **split) -> DataFrame:
    """Validation and test results of the same grid, side by side."""
    val = prequential_grid_search(df, features, learner_of, grid, start=validation_start, cols=cols, **split)
    tst = prequential_grid_search(df, features, learner_of, grid, start=test_start, cols=cols, **split)
    return performance_table(val, tst, list(metrics))


class TimeSeriesCrossValidator(Estimator):
    """Grid or random search with expanding-window folds; refits the best parameters on all rows."""

    def __init__(self, features: list[str], learner_of: Callable[[dict], Estimator], space: dict[str, list], n_trials: int | None = None,
                 n_splits: int = 2, gap: int = 0, metric: str = "F1", seed: int = 0, cols: Columns = DEFAULT):
        super().__init__()
        self.features, self.learner_of, self.space, self.n_trials = features, learner_of, space, n_trials
        self.n_splits, self.gap, self.metric, self.seed, self.cols = n_splits, gap, metric, seed, cols
        self.trials: DataFrame | None = None
        self.best_params: dict | None = None

    def _fit(self, df: DataFrame):
        grid = grid_of(self.space) if self.n_trials is None else sample_of(self.space, self.n_trials, self.seed)
        folds = time_series_split(df, self.n_splits, self.gap, self.cols)
        self.trials = run_folds(folds, self.features, self.learner_of, grid, cols=self.cols)
        best = summarise(self.trials).where(F.col("metric") == self.metric).orderBy(F.desc("mean"), "params").first()
        self.best_params = next(p for p in grid if str(p) == best["params"])
        return self.learner_of(self.best_params).fit(M.class_weights(M.assemble(df, self.features), cols=self.cols))


def stratified_report(df: DataFrame, features: list[str], learner, n: int = 5, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """(metric, mean, std): AUC, average precision, balanced accuracy and times over stratified folds."""
    x = keep(M.assemble(M.class_weights(stratified_kfold(df, n, seed, cols), cols=cols), features))
    rows = []
    for f in range(n):
        t0 = time.time()
        model = learner.fit(x.where(F.col("fold") != f))
        t1 = time.time()
        scored = M.fraud_probability(model.transform(x.where(F.col("fold") == f)))
        r = ranking_scores(scored, SCORE, cols.label).first()
        y, hit = F.col(cols.label) == 1, F.col(SCORE) >= 0.5
        b = scored.agg((F.avg(F.when(y, hit.cast("double"))) + F.avg(F.when(~y, (~hit).cast("double")))) / 2).first()[0]
        rows += [(f, "AUC ROC", r["auc_roc"]), (f, "Average precision", r["average_precision"]), (f, "Balanced accuracy", b),
                 (f, "Fit time", t1 - t0), (f, "Score time", time.time() - t1)]
    x.unpersist()
    t = df.sparkSession.createDataFrame(rows, "fold int, metric string, value double")
    return t.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


class WorkflowSearch:
    """Random search over whole workflows; keeps the best fitted one in a ``BestRun`` folder."""

    def __init__(self, spark: SparkSession, path: str, space: dict[str, list], metric: str = "F1", seed: int = 0,
                 cols: Columns = DEFAULT):
        self.spark, self.run, self.space = spark, BestRun(spark, path), space
        self.metric, self.seed, self.cols = metric, seed, cols

    def objective(self, options: WorkflowOptions, pairs: list[tuple[DataFrame, DataFrame]]) -> tuple[float, object]:
        """Mean score over (train, validation) pairs: one pair is a hold-out, several are folds."""
        scores, fitted = [], None
        for train, val in pairs:
            fitted = Workflow(options, self.cols).fit(train)
            scores.append(evaluate(fitted.transform(val), threshold=options.threshold, cols=self.cols)[self.metric])
        return sum(scores) / len(scores), fitted

    def optimise(self, pairs: list[tuple[DataFrame, DataFrame]], n_trials: int = 10, base: WorkflowOptions | None = None,
                 max_seconds: float | None = None) -> DataFrame:
        rows, t0 = [], time.time()
        for i, params in enumerate(sample_of(self.space, n_trials, self.seed)):
            if max_seconds is not None and rows and time.time() - t0 > max_seconds:
                break
            options = WorkflowOptions(**{**vars(base or WorkflowOptions()), **params})
            s = time.time()
            score, fitted = self.objective(options, pairs)
            best = self.run.offer(fitted, score, params)
            rows.append((i, str(params), float(score), time.time() - s, best))
        trials = self.spark.createDataFrame(rows, "trial int, params string, score double, seconds double, improved boolean")
        self.run.save_trials(trials)
        return trials
