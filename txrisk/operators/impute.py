"""Nearest-neighbour imputation of numeric nulls."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, checkpoint
from txrisk.operators.neighbors import knn_join
from txrisk.schema import DEFAULT, Columns

# Searches per written intermediate table: keeps the plan small whatever the number of mask combinations.
STEP = 12


def knn_impute(df: DataFrame, names: list[str], k: int = 5, weights: str = "distance", fit_on: DataFrame | None = None,
               cols: Columns = DEFAULT) -> DataFrame:
    """Fill nulls with the (distance-weighted) mean of the k nearest donors that have the value.

    The distance uses the coordinates both rows have, scaled up to the full number. Rows sharing the same set
    of missing columns are searched together, against donors grouped the same way, and the candidates of all
    donor groups are merged; every set is searched. A column without usable donors gets its mean.
    """
    donors = df if fit_on is None else fit_on
    p = len(names)
    mask = F.concat(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), "0").otherwise("1") for c in names])
    q, d = df.withColumn("__m", mask), donors.withColumn("__m", mask)
    # one short string per set of missing columns: a matter of the schema, not of the rows
    q_masks = sorted(r[0] for r in q.select("__m").distinct().collect() if "0" in r[0])
    d_masks = sorted(r[0] for r in d.select("__m").distinct().collect())
    means = donors.agg(*[F.avg(c).alias(c) for c in names]).first()
    found, parts = [], []
    for qm in q_masks:
        missing = [c for c, b in zip(names, qm) if b == "0"]
        for dm in d_masks:
            common = [c for c, a, b in zip(names, qm, dm) if a == "1" and b == "1"]
            filled = [c for c in missing if dm[names.index(c)] == "1"]
            if not common or not filled:
                continue
            scale = math.sqrt(p / len(common))
            vec = F.array(*[F.col(c).cast("double") for c in common]).alias("vec")
            rows = q.where(F.col("__m") == qm).select(cols.id, vec)
            refs = d.where(F.col("__m") == dm)
            nn = knn_join(rows, refs.select(cols.id, vec), k, cols.id, cols.id)
            values = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in filled]))
            donor = refs.select(F.col(cols.id).alias("neighbour"), values.alias("x")).select("neighbour", "x.*")
            # rounded, so that equal distances tie and the id decides
            part = nn.select("qid", "neighbour", F.round(F.col("distance") * scale, 9).alias("distance")).join(donor, "neighbour")
            parts.append(part)
            if len(parts) == STEP:
                found.append(checkpoint(reduce(DataFrame.unionByName, parts)))
                parts = []
    if not found and not parts:
        return df.na.fill({c: means[c] for c in names if means[c] is not None})
    w = W.partitionBy("qid", "c").orderBy("distance", "neighbour")   # at most k per donor group
    best = reduce(DataFrame.unionByName, [*found, *parts]).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    if weights == "distance":
        exact = F.max(F.when(F.col("distance") == 0, 1).otherwise(0))
        weighted = F.sum(F.when(F.col("distance") > 0, F.col("v") / F.col("distance"))) / F.sum(
            F.when(F.col("distance") > 0, 1 / F.col("distance")))
        value = F.when(exact == 1, F.avg(F.when(F.col("distance") == 0, F.col("v")))).otherwise(weighted)
    else:
        value = F.avg("v")
    filled = best.groupBy("qid", "c").agg(value.alias("v"))
    wide = filled.groupBy(F.col("qid").alias(cols.id)).agg(
        *[F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"__f_{c}") for c in names])
    out = attach(df, wide, cols.id)
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return out.withColumns({c: F.coalesce(clean(c), F.col(f"__f_{c}"), F.lit(means[c])) for c in names}).select(*df.columns)
