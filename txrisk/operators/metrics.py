"""Fraud metrics from scored tables and summaries of model comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, keep, prefix_sums
from txrisk.schema import DEFAULT, Columns

SCORE = "predictions"


# ------------------------------------------------------------------ ranking quality

def _curve(df: DataFrame, score: str, label: str, groups: list[str]) -> DataFrame:
    """One row per distinct score with cumulative positives and negatives in descending score order."""
    by_score = df.groupBy(*groups, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("q"))
    return prefix_sums(by_score, score, ["p", "q"], descending=True, groups=groups)


def ranking_scores(df: DataFrame, score: str = SCORE, label: str = DEFAULT.label, groups: list[str] | None = None) -> DataFrame:
    """``auc_roc`` and ``average_precision`` (tied scores count once), overall or per group.

    Rows are reduced to distinct scores, then prefix-summed in score buckets, so no task orders the table.
    """
    groups = groups or []
    c = _curve(df, score, label, groups)
    sizes = c.groupBy(*groups).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    c = attach(c, sizes, groups) if groups else c.crossJoin(F.broadcast(sizes))   # one row
    tp, fp, p, q = F.col("cum_p"), F.col("cum_q"), F.col("p"), F.col("q")
    n_pos, n_neg = F.max("n_pos"), F.max("n_neg")
    area = F.sum(q * (2 * tp - p) / 2.0) / (n_pos * n_neg)
    ap = F.sum(p * tp / (tp + fp)) / n_pos
    return c.where("p + q > 0").groupBy(*groups).agg(
        F.when((n_pos > 0) & (n_neg > 0), area).alias("auc_roc"), F.when(n_pos > 0, ap).alias("average_precision"))


def confusion(df: DataFrame, thresholds: list[float], score: str = SCORE, label: str = DEFAULT.label,
              groups: list[str] | None = None) -> DataFrame:
    """(groups.., Threshold, TN, FP, FN, TP) for every threshold in one pass: predicted 1 when score >= threshold."""
    groups = groups or []
    y, s = F.col(label) == 1, F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        hit = s >= t
        for name, cond in {"TN": ~hit & ~y, "FP": hit & ~y, "FN": ~hit & y, "TP": hit & y}.items():
            aggs.append(F.count(F.when(cond, 1)).alias(f"{name}_{i}"))
    row = df.groupBy(*groups).agg(*aggs)
    return row.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(float(t)).alias("Threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("TN", "FP", "FN", "TP")])
        for i, t in enumerate(thresholds)])).alias("x")).select(*groups, "x.*")


def _or(c: Column, default: float) -> Column:
    return F.coalesce(c, F.lit(default))


def rate_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    d = F.try_divide
    tpr, fpr, precision = d(tp, tp + fn), d(fp, tn + fp), _or(d(tp, tp + fp), 1.0)
    return {
        "MME": d(fp + fn, tn + fp + fn + tp), "TPR": tpr, "TNR": d(tn, tn + fp), "FPR": fpr, "FNR": d(fn, tp + fn),
        "BER": (fpr + d(fn, tp + fn)) / 2, "G-mean": F.sqrt(tpr * d(tn, tn + fp)), "Precision": precision,
        "NPV": _or(d(tn, tn + fn), 1.0), "FDR": _or(d(fp, tp + fp), 1.0), "FOR": _or(d(fn, tn + fn), 1.0),
        "F1 Score": _or(d(2 * precision * tpr, precision + tpr), 0.0),
    }


def threshold_metrics(df: DataFrame, thresholds: list[float], score: str = SCORE, label: str = DEFAULT.label,
                      groups: list[str] | None = None) -> DataFrame:
    """The threshold metric table."""
    c = confusion(df, thresholds, score, label, groups)
    return c.select(*(groups or []), "Threshold", *[e.alias(n) for n, e in rate_columns().items()])


def best_f1_threshold(df: DataFrame, thresholds: list[float], score: str = SCORE, label: str = DEFAULT.label) -> DataFrame:
    """One row: the smallest threshold with the highest F1, and that F1."""
    t = threshold_metrics(df, thresholds, score, label)
    return t.agg(F.max_by("Threshold", F.struct("F1 Score", -F.col("Threshold"))).alias("Threshold"),
                 F.max("F1 Score").alias("F1"))


def score_report(df: DataFrame, threshold: float = 0.5, score: str = SCORE, label: str = DEFAULT.label) -> DataFrame:
    """One row: f1, average_precision, precision, recall."""
    row = confusion(df, [threshold], score, label)
    d = F.try_divide
    tp, fp, fn = F.col("TP"), F.col("FP"), F.col("FN")
    flat = row.select(_or(d(2 * tp, 2 * tp + fp + fn), 0.0).alias("f1"), _or(d(tp, tp + fp), 0.0).alias("precision"),
                      _or(d(tp, tp + fn), 0.0).alias("recall"))
    return flat.crossJoin(ranking_scores(df, score, label).select("average_precision"))   # one row each


# ------------------------------------------------------------------ card precision

def customer_days(df: DataFrame, score: str = SCORE, cols: Columns = DEFAULT) -> DataFrame:
    """(day, customer): highest score and label of the customer on the day."""
    return df.groupBy(cols.day, cols.customer).agg(F.max(score).alias(score), F.max(cols.label).alias(cols.label))


def card_topk_day(df: DataFrame, k: int, score: str = SCORE, cols: Columns = DEFAULT) -> DataFrame:
    """(day, precision): share of defrauded customers among the k highest scores of each day."""
    d = customer_days(df, score, cols)
    w = W.partitionBy(cols.day).orderBy(F.col(score).desc(), cols.customer)
    top = d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)   # limited per task before the shuffle
    return top.groupBy(cols.day).agg((F.sum(cols.label) / F.lit(float(k))).alias("card_precision"))


def card_topk(df: DataFrame, k: int, remove_detected: bool = True, score: str = SCORE, cols: Columns = DEFAULT) -> DataFrame:
    """(day, nb_compromised, card_precision). With ``remove_detected`` a customer found on one day leaves later days.

    The days depend on each other. One job brings the 2k best candidates of each day to the driver (a few
    hundred rows per day); a day that loses so many found customers that fewer than k candidates remain is
    read again without them. At most k customers per day are remembered.
    """
    spark = df.sparkSession
    fraud_days = lambda d: d.where(F.col(cols.label) == 1).groupBy(cols.day).agg(F.count("*").alias("nb_compromised"))
    daily = customer_days(df, score, cols)
    if not remove_detected:
        out = attach(card_topk_day(df, k, score, cols), fraud_days(daily), cols.day)
        return out.select(cols.day, F.coalesce("nb_compromised", F.lit(0)).alias("nb_compromised"), "card_precision")
    daily = keep(daily)
    order = [F.col(score).desc(), F.col(cols.customer)]
    w = W.partitionBy(cols.day).orderBy(*order)
    top = daily.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 2 * k)
    by_day: dict[int, list] = {}
    for r in top.orderBy(cols.day, "__r").collect():
        by_day.setdefault(r[cols.day], []).append((r[cols.customer], r[cols.label]))
    schema = f"__c {daily.schema[cols.customer].dataType.simpleString()}, __found int"
    found: dict = {}
    rows = []
    for day in sorted(by_day):
        left = [(c, y) for c, y in by_day[day] if c not in found]
        if len(left) < k and len(by_day[day]) == 2 * k:
            seen = F.broadcast(spark.createDataFrame(list(found.items()), schema))
            d = daily.where(F.col(cols.day) == day)
            d = d.join(seen, d[cols.customer] == seen["__c"], "left_anti")
            left = [(r[cols.customer], r[cols.label]) for r in d.orderBy(*order).limit(k).collect()]
        hits = [c for c, y in left[:k] if y == 1]
        found |= {c: int(day) for c in hits}
        rows.append((int(day), len(hits) / k))
    seen = F.broadcast(spark.createDataFrame(list(found.items()), schema))
    open_days = daily.join(seen, (daily[cols.customer] == seen["__c"]) & (daily[cols.day] > seen["__found"]), "left_anti")
    left_per_day = {r[0]: r[1] for r in fraud_days(open_days).collect()}   # one number per day
    daily.unpersist()
    return spark.createDataFrame([(d, left_per_day.get(d, 0), p) for d, p in rows],
                                 f"{cols.day} int, nb_compromised long, card_precision double")


def card_precision(df: DataFrame, k: int, remove_detected: bool = True, score: str = SCORE, cols: Columns = DEFAULT) -> float:
    """Mean over days of card precision at k."""
    return card_topk(df, k, remove_detected, score, cols).agg(F.avg("card_precision")).first()[0]


class FraudEvaluator(Evaluator):
    """One of auc_roc, average_precision, f1, precision, recall, card_precision as an ML evaluator."""

    def __init__(self, metric: str = "f1", probability: str = "probability", label: str = DEFAULT.label,
                 threshold: float = 0.5, k: int = 100, cols: Columns = DEFAULT):
        super().__init__()
        self.metric, self.probability, self.label = metric, probability, label
        self.threshold, self.k, self.cols = threshold, k, cols

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset if self.probability not in dataset.columns or SCORE in dataset.columns else dataset.withColumn(
            SCORE, vector_to_array(self.probability)[1])
        if self.metric == "card_precision":
            return card_precision(scored, self.k, cols=self.cols)
        if self.metric in ("auc_roc", "average_precision"):
            return float(ranking_scores(scored, SCORE, self.label).first()[self.metric] or 0.0)
        return float(score_report(scored, self.threshold, SCORE, self.label).first()[self.metric])

    def isLargerBetter(self) -> bool:
        return True


# ------------------------------------------------------------------ comparison tables

def performance_assessment(df: DataFrame, ks: list[int] = (100,), score: str = SCORE, cols: Columns = DEFAULT,
                           rounded: int | None = 3) -> DataFrame:
    """One row: AUC ROC, Average precision and Card Precision@k."""
    row = ranking_scores(df, score, cols.label).first()
    values = {"AUC ROC": row["auc_roc"], "Average precision": row["average_precision"]}
    values |= {f"Card Precision@{k}": card_precision(df, k, score=score, cols=cols) for k in ks}
    values = {m: None if v is None else float(round(v, rounded) if rounded is not None else v) for m, v in values.items()}
    return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"`{m}` double" for m in values))


def model_comparison(scored: DataFrame, model_col: str, score: str = SCORE, label: str = DEFAULT.label) -> DataFrame:
    """Long table (model, metric, value) for a table that holds the scores of several models."""
    r = ranking_scores(scored, score, label, [model_col])
    return r.select(F.col(model_col).alias("model"), F.explode(F.create_map(
        F.lit("AUC ROC"), F.col("auc_roc"), F.lit("Average precision"), F.col("average_precision"))).alias("metric", "value"))


def execution_times(times: dict[str, tuple[float, float]], spark) -> DataFrame:
    """(model, training_time, prediction_time)."""
    return spark.createDataFrame([(m, float(a), float(b)) for m, (a, b) in times.items()],
                                 "model string, training_time double, prediction_time double")


def parameter_summary(perf: DataFrame, metrics: list[str], params: str = "Parameters summary",
                      groups: list[str] | None = None) -> DataFrame:
    """Per metric: parameters with the best validation score, scores there, and the optimum on test.

    ``perf`` has ``<metric> Validation``, ``<metric> Validation Std``, ``<metric> Test``, ``<metric> Test Std``.
    """
    groups = groups or []
    text = lambda mean, std: F.format_string("%.3f+/-%.2f", mean, std)
    parts = []
    for m in metrics:
        v, vs, t, ts = (F.col(f"`{m} {s}`") for s in ("Validation", "Validation Std", "Test", "Test Std"))
        row = F.struct(F.col(f"`{params}`").alias("p"), v.alias("v"), vs.alias("vs"), t.alias("t"), ts.alias("ts"))
        # equal scores resolve to the smallest parameter text
        parts.append(perf.groupBy(*groups).agg(
            F.min_by(row, F.struct(-v, F.col(f"`{params}`"))).alias("b"),
            F.min_by(row, F.struct(-t, F.col(f"`{params}`"))).alias("o")).select(
            *groups, F.lit(m).alias("metric"), F.col("b.p").alias("best_parameters"),
            text(F.col("b.v"), F.col("b.vs")).alias("validation_performance"),
            text(F.col("b.t"), F.col("b.ts")).alias("test_performance"),
            F.col("o.p").alias("optimal_parameters"),
            text(F.col("o.t"), F.col("o.ts")).alias("optimal_test_performance")))
    return reduce(DataFrame.unionByName, parts)


def model_selection_summary(perf: DataFrame, metrics: list[str], model_col: str, default_params: dict[str, str],
                            params: str = "Parameters summary") -> DataFrame:
    """(model, metric, kind, mean, std) on test: default, best-by-validation and optimal parameters."""
    p = F.col(f"`{params}`")
    parts = []
    for m in metrics:
        v, t, ts = (F.col(f"`{m} {s}`") for s in ("Validation", "Test", "Test Std"))
        row = F.struct(t.alias("mean"), ts.alias("std"))
        default = F.create_map(*[F.lit(x) for kv in default_params.items() for x in kv])[F.col(model_col)]
        agg = perf.groupBy(model_col).agg(
            F.max(F.when(p == default, row)).alias("default"),
            F.min_by(row, F.struct(-v, p)).alias("best"), F.min_by(row, F.struct(-t, p)).alias("optimal"))
        parts.append(agg.select(F.col(model_col).alias("model"), F.lit(m).alias("metric"), F.explode(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.col(f"{k}.mean").alias("mean"), F.col(f"{k}.std").alias("std"))
            for k in ("default", "best", "optimal")])).alias("x")).select("model", "metric", "x.*"))
    return reduce(DataFrame.unionByName, parts)
