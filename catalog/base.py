"""Registration helpers and the SQL text shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from txrisk.functions.rows import add_client_key, calendar_features, day_offset
from txrisk.schema import transaction_view, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A shift far below the last kept digit: averages of 2^n cents end exactly on a rounding boundary.
SHIFT = 1.3e-8


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def r6(c: Column) -> Column:
    return F.round(c + SHIFT, 6)


def s6(expr: str) -> str:
    return f"round(({expr}) + {SHIFT}, 6)"


def rounded(df: DataFrame) -> DataFrame:
    """All floating columns at six decimals."""
    return df.select(*[r6(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else F.col(f"`{f.name}`") for f in df.schema])


def tx(spark: SparkSession, d: str) -> DataFrame:
    return add_client_key(transaction_view(spark, d))


def txd(spark: SparkSession, d: str) -> DataFrame:
    return day_offset(tx(spark, d))


def cal(spark: SparkSession, d: str) -> DataFrame:
    return calendar_features(tx(spark, d))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


K = "CAST(json_extract_string(props,'$.k') AS INT)"
TX = f"""
base AS (
  SELECT event_id AS TRANSACTION_ID, ts AS TX_DATETIME, epoch_us(ts) AS us,
    'A'||user_id AS AccountId, 'C'||(user_id*2 + {K}%3) AS CUSTOMER_ID, 'S'||(user_id%97) AS SubscriptionId,
    'B'||CAST(floor(event_id/3) AS BIGINT) AS BatchId,
    'P'||({K}%6) AS ProviderId, 'PR'||({K}%23) AS ProductId, event_type AS ProductCategory,
    'CH'||({K}%4) AS ChannelId, CAST({K}%5 AS VARCHAR) AS PricingStrategy,
    'UGX' AS CurrencyCode, '256' AS CountryCode,
    CASE WHEN event_type IN ('error','signup') THEN -value ELSE value END AS TX_AMOUNT, value AS Value,
    CASE WHEN (event_type='purchase' AND {K}<3) OR (event_type='error' AND {K}=7 AND value>20) THEN 1 ELSE 0 END AS TX_FRAUD
  FROM events),
tx AS (SELECT *, AccountId||'+'||CUSTOMER_ID AS CustomerUID,
    CAST((us - min(us) OVER ()) // 86400000000 AS INTEGER) AS TX_TIME_DAYS FROM base)
"""
CAL = TX + """,
cal AS (SELECT *, CAST(hour(TX_DATETIME) AS INT) AS Hour, CAST(isodow(TX_DATETIME)-1 AS INT) AS DayOfWeek,
    CAST(day(TX_DATETIME) AS INT) AS DayOfMonth,
    CAST(isodow(TX_DATETIME) >= 6 AS INT) AS IsWeekend, CAST(hour(TX_DATETIME) <= 6 AS INT) AS IsNight,
    CAST(CAST(TX_DATETIME AS DATE) = last_day(TX_DATETIME) AS INT) AS IsMonthEnd,
    CAST(day(TX_DATETIME) = 1 AS INT) AS IsMonthStart FROM tx)
"""


def unit(expr: str, seed) -> str:
    """Hash number in [0, 1), as ``hash_unit``."""
    return f"({u32(expr, seed)} / 4294967296.0)"


def u32(expr: str, seed) -> str:
    return f"CAST(('0x'||substr(md5(CAST({expr} AS VARCHAR)||'|{seed}'),1,8)) AS BIGINT)"


SCORED = TX + f", scored AS (SELECT *, round({unit('TRANSACTION_ID', 'score')}, 3) AS predictions FROM tx)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Transactions with a reproducible pseudo score that has ties."""
    from txrisk.functions.scale import hash_unit
    return txd(spark, d).withColumn("predictions", F.round(hash_unit("TRANSACTION_ID", "score"), 3))
