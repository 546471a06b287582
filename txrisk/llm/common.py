"""Helpers of the corpus operators: shared scratch tables, size probes and connected components."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txrisk.functions.scale import shared_folder

SPACE = r"\x20\x09-\x0D"

_written: list[tuple[SparkSession, str]] = []


def text_of(df: DataFrame, text_col: str) -> Column:
    """The text with null counted as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the cluster's shared folder; return the table read back and its path.

    This cuts lineage and survives lost executors. ``discard`` removes it; what a returned frame still reads is removed at exit.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [w for w in _written if w[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        if spark.sparkContext._jsc is not None:
            try:
                discard(spark, path)
            except Exception:  # the JVM may be gone
                return


def total_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts, the size from which chunk and bucket counts follow."""
    return df.agg(F.sum(F.octet_length(df[text_col].cast("string")).cast("long"))).first()[0] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest node reachable.

    Contraction: every node hooks to its smallest neighbour, the hooking forest is flattened by pointer jumping, edges are rewritten to
    the roots and the survivors go on. Each round at least halves the nodes left. Tables stay in Spark; only row counts reach the driver.
    Nodes appear if an edge names them; loops and nulls are ignored.
    """
    spark = edges.sparkSession
    left, old = store(_undirected(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "cc-edges")
    whole, kept = None, None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots, path = _flatten(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                               .select("node", F.least("node", "low").alias("root")))
        to_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest, new = store(_undirected(left.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "cc-edges")
        discard(spark, old)
        left, old = rest, new
        if whole is None:
            whole, kept = roots, path
            continue
        step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        merged, path2 = store(whole.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "cc-map")
        discard(spark, kept)
        discard(spark, path)
        whole, kept = merged, path2
    discard(spark, old)
    if whole is None:
        kind = dict(edges.dtypes)[a]
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return whole.select("node", F.col("root").alias("component"))


def _undirected(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _flatten(parents: DataFrame) -> tuple[DataFrame, str]:
    """Pointer jumping until every node points at a root."""
    table, path = store(parents, "cc-hook")
    while True:
        up = table.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped, new = store(table.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"),
                                                                 (F.col("top") < F.col("root")).alias("moved")), "cc-hook")
        discard(table.sparkSession, path)
        table, path = jumped.select("node", "root"), new
        if jumped.where("moved").isEmpty():
            return table, path
