"""Reading transactions, writing predictions, saving pipelines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from txrisk.functions.rows import day_offset
from txrisk.schema import DEFAULT, RENAMES, Columns, raw_schema, use_utc

# Day-first date text first, then the ISO form with a zone suffix.
TIME_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy",
                "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss")


def load_transactions(spark: SparkSession, path: str, fmt: str = "csv", labelled: bool = True,
                      cols: Columns = DEFAULT) -> DataFrame:
    """Read raw transactions with a fixed schema, rename, parse times and add the day offset."""
    use_utc(spark)
    reader = spark.read.schema(raw_schema(labelled))
    raw = reader.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)
    return normalise(raw, cols)


def normalise(raw: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    df = raw.withColumnsRenamed(RENAMES)
    if dict(df.dtypes)[cols.ts] == "string":
        df = df.withColumn(cols.ts, F.coalesce(*[F.try_to_timestamp(F.col(cols.ts), F.lit(f)) for f in TIME_FORMATS]))
    codes = [c for c in ("CountryCode", cols.pricing) if c in df.columns]
    df = df.withColumns({**{c: F.col(c).cast("string") for c in codes},
                         cols.ts: F.col(cols.ts).cast("timestamp"),
                         cols.amount: F.col(cols.amount).cast("double"),
                         cols.value: F.col(cols.value).cast("double")})
    if cols.label in df.columns:
        df = df.withColumn(cols.label, F.col(cols.label).cast("int"))
    return day_offset(df, cols)


def write_daily(df: DataFrame, path: str, cols: Columns = DEFAULT) -> None:
    """One folder per calendar day, so that date ranges prune files."""
    df.withColumn("tx_date", F.to_date(cols.ts)).write.mode("overwrite").partitionBy("tx_date").parquet(path)


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> None:
    """Files in global order of ``keys``: ranges are dealt to tasks and sorted there, nothing passes one task."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """An ordered table with the 0-based position of every row, from file names and row numbers inside files."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = df.groupBy("__file").agg(F.count("*").alias("__n"))
    before = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)   # one row per file
    files = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return df.join(F.broadcast(files), "__file").withColumn(name, F.col("__off") + F.col("__row")).drop("__file", "__row", "__off")


def read_date_range(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Days ``begin <= day <= end`` of a daily table; the missing marker -1 becomes 0."""
    df = spark.read.parquet(path)
    return date_range(df, "tx_date", begin, end)


def date_range(df: DataFrame, date_col: str, begin: str, end: str) -> DataFrame:
    picked = df.where(F.col(date_col).between(F.lit(begin).cast("date"), F.lit(end).cast("date")))
    return picked.na.replace(-1, 0)


def clean(df: DataFrame, drop_all_na: bool = False) -> DataFrame:
    """Drop exact duplicate rows, optionally rows with any null."""
    out = df.dropDuplicates()
    return out.na.drop("any") if drop_all_na else out


def align_predictions(template: DataFrame, predictions: DataFrame, id_col: str, label: str) -> DataFrame:
    """Predictions in the order of the submission ids, as integers; unmatched ids stay null."""
    pred = predictions.select(id_col, F.col(label).cast("int").alias(label))
    return template.select(id_col).join(pred, id_col, "left")


def write_predictions(template: DataFrame, predictions: DataFrame, path: str, id_col: str = "TransactionId",
                      label: str = "FraudResult", fmt: str = "csv") -> DataFrame:
    out = align_predictions(template, predictions, id_col, label)
    missing = out.where(F.col(label).isNull()).count()
    if missing:
        raise ValueError(f"{missing} submission ids have no prediction")
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.format(fmt).save(path)
    return out


class BestRun:
    """Keeps the best fitted pipeline of a search and the table of its trials under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _score_path(self) -> str:
        return f"{self.path}/best_score"

    def best_score(self) -> float | None:
        try:
            return json.loads(self.spark.read.text(self._score_path()).first()[0])["score"]
        except Exception as e:   # nothing saved yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def offer(self, model, score: float, params: dict | None = None) -> bool:
        """Save ``model`` only when ``score`` beats the stored one."""
        best = self.best_score()
        if best is not None and score <= best:
            return False
        model.write().overwrite().save(f"{self.path}/model")
        record = json.dumps({"score": score, "params": params or {}}, default=str)
        self.spark.createDataFrame([(record,)], "value string").coalesce(1).write.mode("overwrite").text(self._score_path())
        return True

    def load(self, loader=None):
        """The stored model; ``loader(path)`` reads it, by default as a ``PipelineModel``."""
        from pyspark.ml import PipelineModel
        return (loader or PipelineModel.load)(f"{self.path}/model")

    def save_trials(self, trials: DataFrame) -> None:
        trials.write.mode("overwrite").json(f"{self.path}/trials")


def explore(df: DataFrame, columns: list[str], id_col: str, fraction: float, seed: int = 0) -> DataFrame:
    """Column selection and a reproducible random sample for the visual workflow."""
    from txrisk.functions.scale import hash_unit
    return df.where(hash_unit(id_col, seed) < fraction).select(*columns)
