"""Training-corpus pipeline: each stage reads what the one before wrote as Parquet.

Quality (rejected documents go), exact duplicates (the largest id stays), SimHash near-duplicates (the smallest id of a group stays), mixing (documents without a share
go, repeated ones are repeated), tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txrisk.llm.common import store
from txrisk.llm.exact_dedup import exact_dedup
from txrisk.llm.mixing import mix
from txrisk.llm.queries import scored_documents, token_digests
from txrisk.llm.simhash import simhash_groups


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the names by which decisions find them: id (null has one too) and text digest."""
    return docs.withColumns({"__id": _name(F.col("doc_id")), "__sha": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})


def _name(i: Column) -> Column:
    return F.coalesce(i.cast("string"), F.lit("-"))


def _decided(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows whose id and text are ("left_semi") or are not ("left_anti") in ``rows``."""
    return _keyed(docs).join(rows.select(_name(F.col("doc_id")).alias("__id"), F.col("text_sha256").alias("__sha")).distinct(), ["__id", "__sha"], how)


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return _columns(_decided(docs, scored_documents(docs, spark, sf_dir).where(~F.col("keep")), "left_anti"), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every text; rows that repeat id and text are met at the same place and dropped there."""
    return _columns(_decided(docs, exact_dedup(docs, keep="largest").where("kept"), "left_semi").dropDuplicates(["__id", "__sha"]), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that names its near-duplicate group."""
    groups = simhash_groups(docs, radius=4, with_digest=True)
    return _columns(_decided(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_anti"), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed, _ = mix(docs, F.array("source"))
    copies = mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return _columns(copies, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers still hold what earlier stages needed
    return token_digests(docs, chunk_bytes=2 << 20)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixture), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
