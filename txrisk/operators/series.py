"""Daily series per key and their seasonal and spectral summaries.

A daily series has one row per day, so the windows of this module are bounded by the number of days;
the transactions themselves only enter map-side combined sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach
from txrisk.schema import DEFAULT, HOUR_US, Columns, micros


def resample_daily(df: DataFrame, key: str, values: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """(key, day, i, n, sums): every day from the key's first to its last one; empty days are 0."""
    sums = df.groupBy(key, F.to_date(cols.ts).alias("__day")).agg(*[F.sum(v).alias(v) for v in values]).where("__day IS NOT NULL")
    whole = W.partitionBy(key)
    # a day with rows brings the empty days up to the next one along, so that the series of a key stays where its days are
    spans = sums.select("*", F.lead("__day").over(whole.orderBy("__day")).alias("__next"), F.min("__day").over(whole).alias("__a"), F.max("__day").over(whole).alias("__b"))
    out = spans.select("*", F.explode(F.sequence("__day", F.coalesce(F.date_sub("__next", 1), "__day"))).alias("day"))
    return out.select(key, "day", F.datediff("day", "__a").alias("i"), (F.datediff("__b", "__a") + 1).alias("n"),
                      *[F.when(F.col("day") == F.col("__day"), F.coalesce(F.col(v), F.lit(0.0))).otherwise(0.0).alias(v) for v in values])


def seasonal_table(df: DataFrame, key: str, value: str | None = None, period: int = 7, cols: Columns = DEFAULT) -> DataFrame:
    """(key, trend_slope, seasonal_amplitude, residual_variance) of keys with at least two periods of days."""
    value = value or cols.amount
    if period % 2 == 0:
        raise ValueError("the centred moving average needs an odd period")
    half = period // 2
    d = resample_daily(df, key, [value], cols).where(F.col("n") >= 2 * period).withColumnRenamed(value, "y")
    near = W.partitionBy(key).orderBy("i").rowsBetween(-half, half)
    full = (F.col("i") >= half) & (F.col("i") < F.col("n") - half)
    d = d.withColumn("trend", F.when(full, F.avg("y").over(near))).withColumn("phase", F.pmod("i", F.lit(period)))
    d = d.withColumn("p", F.avg(F.col("y") - F.col("trend")).over(W.partitionBy(key, "phase")))
    # every phase weighs the same in the centring mean; the first days of a series hold each phase once
    whole = W.partitionBy(key)
    d = d.withColumns({"centre": F.avg(F.when(F.col("i") < period, F.col("p"))).over(whole),
                       "seasonal_amplitude": F.max("p").over(whole) - F.min("p").over(whole)})
    resid = F.col("y") - F.col("trend") - (F.col("p") - F.col("centre"))
    return d.groupBy(key).agg(F.regr_slope("trend", "i").alias("trend_slope"),
                              F.first("seasonal_amplitude").alias("seasonal_amplitude"),
                              F.var_pop(resid).alias("residual_variance"))


def seasonal_features(df: DataFrame, key: str, value: str | None = None, period: int = 7, cols: Columns = DEFAULT,
                      source: DataFrame | None = None) -> DataFrame:
    """Seasonal summaries on every row, 0 for keys with short series."""
    t = seasonal_table(df if source is None else source, key, value, period, cols)
    return attach(df, t, key).na.fill(0.0, [c for c in t.columns if c != key])


def fft_table(df: DataFrame, key: str, values: list[str] | None = None, top_n: int = 5, cols: Columns = DEFAULT) -> DataFrame:
    """(key, {value}_fft_freq_k): magnitude of the k-th Fourier coefficient of the daily series."""
    values = values or [cols.amount, cols.value]
    d = resample_daily(df, key, values, cols).where(F.col("n") >= 2 * top_n)
    aggs = []
    for v in values:
        for k in range(1, top_n + 1):
            angle = F.col("i") * (2 * math.pi * k) / F.col("n")
            re, im = F.sum(F.col(v) * F.cos(angle)), F.sum(F.col(v) * F.sin(angle))
            # series of exactly 2*top_n days still hold coefficient top_n
            aggs.append(F.sqrt(re * re + im * im).alias(f"{v}_fft_freq_{k}"))
    return d.groupBy(key).agg(*aggs)


def fft_features(df: DataFrame, key: str, values: list[str] | None = None, top_n: int = 5, cols: Columns = DEFAULT,
                 source: DataFrame | None = None) -> DataFrame:
    t = fft_table(df if source is None else source, key, values, top_n, cols)
    return attach(df, t, key).na.fill(0.0, [c for c in t.columns if c != key])


def lomb_scargle_frequencies(min_period: float, max_period: float, n_freqs: int) -> list[float]:
    lo, hi = 1 / max_period, 1 / min_period
    step = (hi - lo) / (n_freqs - 1) if n_freqs > 1 else 0.0
    return [lo + i * step for i in range(n_freqs)]


def lomb_scargle(df: DataFrame, key: str, value: str | None = None, min_period: float = 24.0, max_period: float = 168.0,
                 n_freqs: int = 10, cols: Columns = DEFAULT) -> DataFrame:
    """(key, {value}_LombScargle_i): floating-mean periodogram power against time in hours.

    The power does not depend on the time origin, so absolute hours serve. Each (key, frequency) needs
    a handful of sums, all combined map-side.
    """
    value = value or cols.amount
    freqs = lomb_scargle_frequencies(min_period, max_period, n_freqs)
    rows = df.select(key, (micros(cols.ts) / HOUR_US).alias("t"), F.col(value).cast("double").alias("y"),
                     F.posexplode(F.array(*[F.lit(f) for f in freqs])).alias("i", "f"))
    angle = F.col("t") * F.col("f") * (2 * math.pi)
    rows = rows.select(key, "i", "y", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    y, c, s = F.col("y"), F.col("c"), F.col("s")
    m = rows.groupBy(key, "i").agg(F.count("*").alias("n"), *[F.avg(e).alias(a) for a, e in {
        "Y": y, "C": c, "S": s, "y2": y * y, "yc": y * c, "ys": y * s, "cc": c * c, "ss": s * s, "cs": c * s}.items()])
    v = F.col
    YY, YC, YS = v("y2") - v("Y") * v("Y"), v("yc") - v("Y") * v("C"), v("ys") - v("Y") * v("S")
    CC, SS, CS = v("cc") - v("C") * v("C"), v("ss") - v("S") * v("S"), v("cs") - v("C") * v("S")
    det = CC * SS - CS * CS
    power = (SS * YC * YC + CC * YS * YS - 2 * CS * YC * YS) / (YY * det)
    usable = (v("n") >= 3) & (YY > 1e-12) & (det > 1e-12)
    scored = m.select(key, "i", F.when(usable, power).otherwise(0.0).alias("p"))
    return scored.groupBy(key).agg(*[
        F.max(F.when(F.col("i") == i, F.col("p"))).alias(f"{value}_LombScargle_{i}") for i in range(n_freqs)])


def lomb_scargle_features(df: DataFrame, key: str, value: str | None = None, cols: Columns = DEFAULT,
                          source: DataFrame | None = None, **params) -> DataFrame:
    return attach(df, lomb_scargle(df if source is None else source, key, value, cols=cols, **params), key)
