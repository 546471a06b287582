import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tx(spark):
    from txrisk.functions.rows import add_client_key, day_offset
    from txrisk.schema import transaction_view
    return day_offset(add_client_key(transaction_view(spark, SF))).cache()


@pytest.fixture(scope="session")
def micro(spark):
    from pyspark.sql import functions as F
    rows = [(1, "A", "2024-01-01 00:00:00", 10.0, 0), (2, "A", "2024-01-02 00:00:00", 30.0, 1), (3, "A", "2024-01-08 00:00:00", 20.0, 0),
            (4, "A", "2024-01-09 00:00:01", 0.0, 0), (5, "B", "2024-01-03 12:00:00", 5.0, 0)]
    df = spark.createDataFrame(rows, "TRANSACTION_ID int, AccountId string, t string, TX_AMOUNT double, TX_FRAUD int")
    return df.withColumn("TX_DATETIME", F.to_timestamp("t")).withColumn("Value", F.col("TX_AMOUNT")).drop("t").cache()
