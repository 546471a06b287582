"""Logical column roles, the raw transaction schema and a transaction view over ``events``."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Columns:
    """Physical names of the roles every operator refers to."""

    id: str = "TRANSACTION_ID"
    ts: str = "TX_DATETIME"
    account: str = "AccountId"
    customer: str = "CUSTOMER_ID"
    client: str = "CustomerUID"
    batch: str = "BatchId"
    provider: str = "ProviderId"
    product: str = "ProductId"
    category: str = "ProductCategory"
    channel: str = "ChannelId"
    pricing: str = "PricingStrategy"
    amount: str = "TX_AMOUNT"
    value: str = "Value"
    label: str = "TX_FRAUD"
    day: str = "TX_TIME_DAYS"
    uid_parts: tuple[str, ...] = ("AccountId", "CUSTOMER_ID")

    @property
    def keys(self) -> tuple[str, str, str]:
        return (self.account, self.customer, self.client)

    @property
    def categoricals(self) -> tuple[str, ...]:
        return (self.channel, self.category, self.product, self.provider, self.pricing)

    def with_names(self, **names: str) -> "Columns":
        return replace(self, **names)


DEFAULT = Columns()

# Raw file layout: the label is absent from files to be scored.
RAW_FIELDS = [
    ("TransactionId", T.StringType()),
    ("BatchId", T.StringType()),
    ("AccountId", T.StringType()),
    ("SubscriptionId", T.StringType()),
    ("CustomerId", T.StringType()),
    ("CurrencyCode", T.StringType()),
    ("CountryCode", T.StringType()),
    ("ProviderId", T.StringType()),
    ("ProductId", T.StringType()),
    ("ProductCategory", T.StringType()),
    ("ChannelId", T.StringType()),
    ("Amount", T.DoubleType()),
    ("Value", T.DoubleType()),
    ("TransactionStartTime", T.StringType()),
    ("PricingStrategy", T.StringType()),
    ("FraudResult", T.IntegerType()),
]
RENAMES = {
    "TransactionStartTime": "TX_DATETIME",
    "Amount": "TX_AMOUNT",
    "CustomerId": "CUSTOMER_ID",
    "TransactionId": "TRANSACTION_ID",
    "FraudResult": "TX_FRAUD",
}


def raw_schema(labelled: bool = True) -> T.StructType:
    fields = RAW_FIELDS if labelled else RAW_FIELDS[:-1]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def micros(ts: str | Column) -> Column:
    """Event time as microseconds since the epoch (session time zone is UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def transaction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table seen as card transactions (see FIXTURES.md)."""
    use_utc(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        F.col("event_id").alias("TRANSACTION_ID"),
        F.col("ts").cast("timestamp").alias("TX_DATETIME"),
        text("A", user).alias("AccountId"),
        text("C", user * 2 + k % 3).alias("CUSTOMER_ID"),
        text("S", user % 97).alias("SubscriptionId"),
        text("B", F.floor(F.col("event_id") / 3)).alias("BatchId"),
        text("P", k % 6).alias("ProviderId"),
        text("PR", k % 23).alias("ProductId"),
        F.col("event_type").alias("ProductCategory"),
        text("CH", k % 4).alias("ChannelId"),
        (k % 5).cast("string").alias("PricingStrategy"),
        F.lit("UGX").alias("CurrencyCode"),
        F.lit("256").alias("CountryCode"),
        F.when(F.col("event_type").isin("error", "signup"), -F.col("value"))
        .otherwise(F.col("value")).alias("TX_AMOUNT"),
        F.col("value").alias("Value"),
        F.when(((F.col("event_type") == "purchase") & (k < 3))
               | ((F.col("event_type") == "error") & (k == 7) & (F.col("value") > 20)), 1)
        .otherwise(0).alias("TX_FRAUD"),
    )
