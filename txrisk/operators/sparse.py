"""Category flags, counts and similarities as sparse vectors: one schema whatever the number of values.

A stored dictionary numbers the values of every column; every statistic is one ``pyspark.ml`` sparse vector per row over those numbers. A table that gains
a value gets longer vectors, not more columns. Nulls have no number; values that the dictionary does not know leave no entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from txrisk.functions.scale import attach, checkpoint
from txrisk.operators.aggregates import unpivot_counts
from txrisk.operators.encoders import similarity_table
from txrisk.operators.windows import counts_in_frames, label_us
from txrisk.schema import DAY_US, DEFAULT, HOUR_US, Columns

# Hex digits of the digest by which values are dealt before they are numbered: at most 4,096 counts per column are summed up.
BUCKET_DIGITS = 3
_BOXED = T.StructType([T.StructField("v", VectorUDT())])


@dataclass
class CategoryDictionary:
    """(column, category, number) with gapless numbers per column, and how many each column has."""

    table: DataFrame
    sizes: dict[str, int]

    def of(self, column: str, name: str) -> DataFrame:
        """(name, __number) of one column."""
        return self.table.where(F.col("column") == column).select(F.col("category").alias(name), F.col("number").alias("__number"))


def category_dictionary(df: DataFrame, names: list[str], path: str | None = None) -> CategoryDictionary:
    """Number the distinct values of ``names`` by (digest prefix, value), so that numbers do not depend on partitions and no task sorts all values.

    The table is written to ``path``, or checkpointed in the shared folder. Values count as strings.
    """
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in names]))
    values = df.select(items.alias("x")).select("x.*").where("category IS NOT NULL").distinct()
    values = values.withColumn("__b", F.substring(F.md5("category"), 1, BUCKET_DIGITS))
    before = W.partitionBy("column").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = values.groupBy("column", "__b").agg(F.count("*").alias("__n")).select("column", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = W.partitionBy("column", "__b").orderBy("category")
    table = attach(values.withColumn("__i", F.row_number().over(inside) - 1), offsets, ["column", "__b"])
    table = table.select("column", "category", (F.col("__off") + F.col("__i")).alias("number"))
    if path is None:
        return _counted(checkpoint(table), names)
    table.write.mode("overwrite").parquet(path)
    return load_dictionary(df.sparkSession, path, names)


def load_dictionary(spark: SparkSession, path: str, names: list[str]) -> CategoryDictionary:
    return _counted(spark.read.parquet(path), names)


def _counted(table: DataFrame, names: list[str]) -> CategoryDictionary:
    found = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}
    return CategoryDictionary(table, {c: found.get(c, 0) for c in names})


def sparse(size: int, items: Column) -> Column:
    """Sparse vector of (number, value) items in the order of their numbers; null gives no entries.

    Spark has no expression from columns to sparse vectors other than a Python UDF; the JSON reader knows the type and stays in the JVM.
    """
    kind = "array<struct<number:int,value:double>>"
    got = F.sort_array(F.coalesce(items.cast(kind), F.array().cast(kind)))
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), got["number"].alias("indices"), got["value"].alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _BOXED)["v"]


def entries(vector: str | Column) -> Column:
    """Array of (number, value) of a sparse vector: the way back to rows and SQL."""
    v = F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)
    return F.arrays_zip(v["indices"].alias("number"), v["values"].alias("value"))


def _item(value: Column) -> Column:
    return F.when(F.col("__number").isNotNull(), F.struct(F.col("__number").alias("number"), value.alias("value")))


def one_hot_vectors(df: DataFrame, names: list[str], dictionary: CategoryDictionary) -> DataFrame:
    """``<column>_OneHot``: a vector with one 1, or none where the value is null or unknown."""
    for c in names:
        coded = attach(df.withColumn("__cat", F.col(c).cast("string")), dictionary.of(c, "__cat"), "__cat")
        flag = sparse(dictionary.sizes[c], F.array_compact(F.array(_item(F.lit(1.0)))))
        df = coded.withColumn(f"{c}_OneHot", flag).drop("__cat", "__number")
    return df


def client_count_vectors(df: DataFrame, key: str, names: list[str], dictionary: CategoryDictionary) -> DataFrame:
    """(key, ``<column>_perClient`` ...): counts of every value a client has; counted before the one shuffle by client."""
    table = dictionary.table.select("column", F.col("category").alias("value"), F.col("number").alias("__number"))
    coded = attach(unpivot_counts(df, key, names), table, ["column", "value"])
    found = coded.groupBy(key).agg(*[F.collect_list(F.when(F.col("column") == c, _item(F.col("counts")))).alias(f"__{i}") for i, c in enumerate(names)])
    return found.select(key, *[sparse(dictionary.sizes[c], F.col(f"__{i}")).alias(f"{c}_perClient") for i, c in enumerate(names)])


def rolling_category_vectors(df: DataFrame, key: str, category: str, dictionary: CategoryDictionary,
                             widths_us: tuple[int, ...] = (HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US), cols: Columns = DEFAULT, hot_rows: int | None = None) -> DataFrame:
    """``<category>_Counts_<window>``: how often each value stands in the key's (t - w, t], own row included."""
    # values become numbers once a row, before the windows
    coded = attach(df.withColumn("__cat", F.col(category).cast("string")), dictionary.of(category, "__cat"), "__cat").drop("__cat")
    out = counts_in_frames(coded, key, "__number", widths_us, cols, hot_rows)
    item = lambda x: F.struct(x["value"].alias("number"), x["count"].alias("value"))
    return out.select(*df.columns, *[sparse(dictionary.sizes[category], F.transform(f"__counts_{n}", item)).alias(f"{category}_Counts_{n}") for n in map(label_us, widths_us)])


def similarity_vectors(df: DataFrame, name: str, dictionary: CategoryDictionary, vectors: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``<name>_Similarity``: similarities above ``least`` of the row's value to the known ones; by cosine of ``vectors``, else by string ratio.

    Of several vectors of a value the highest similarity counts. Pairs whose lengths alone keep the string ratio at or below ``least`` are never compared.
    """
    pairs = similarity_table(df, name, vectors, least).where(F.col("v") > least).groupBy("category", "other").agg(F.max("v").alias("v"))
    coded = attach(pairs, dictionary.of(name, "other"), "other")
    found = coded.groupBy(F.col("category").alias("__cat")).agg(F.collect_list(_item(F.col("v"))).alias("__items"))
    out = attach(df.withColumn("__cat", F.col(name).cast("string")), found, "__cat")
    return out.withColumn(f"{name}_Similarity", sparse(dictionary.sizes[name], F.col("__items"))).drop("__cat", "__items")
