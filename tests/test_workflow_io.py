import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.functions import rows as R
from txrisk.plans.features import FeatureOptions, build_features, fit_features
from txrisk.plans.workflow import FittedWorkflow, Workflow, WorkflowOptions
from txrisk.sources import io

LIGHT = FeatureOptions(use_client=False, seasonal=False, fft=False, crosses=False, splines=False, cycles=False, rate_columns=("ProductCategory",))


def test_csv_round_trip(spark, tx, tmp_path):
    raw = tx.select(F.col("TRANSACTION_ID").alias("TransactionId"), "BatchId", "AccountId", "SubscriptionId", F.col("CUSTOMER_ID").alias("CustomerId"),
                    "CurrencyCode", "CountryCode", "ProviderId", "ProductId", "ProductCategory", "ChannelId", F.col("TX_AMOUNT").alias("Amount"), "Value",
                    F.date_format("TX_DATETIME", "dd/MM/yyyy HH:mm:ss").alias("TransactionStartTime"), "PricingStrategy", F.col("TX_FRAUD").alias("FraudResult"))
    raw.write.csv(str(tmp_path / "t"), header=True)
    got = io.load_transactions(spark, str(tmp_path / "t"))
    assert got.count() == tx.count() and got.where("TX_DATETIME IS NULL").count() == 0
    assert got.agg(F.sum("TX_FRAUD")).first()[0] == tx.agg(F.sum("TX_FRAUD")).first()[0]
    assert got.agg(F.max("TX_TIME_DAYS")).first()[0] == 29


def test_predictions_need_every_id(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("b",)], "TransactionId string")
    good = spark.createDataFrame([("b", 1.0), ("a", 0.0)], "TransactionId string, FraudResult double")
    io.write_predictions(ids, good, str(tmp_path / "p"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "p"), header=True).collect())) == [("a", "0"), ("b", "1")]
    with pytest.raises(ValueError):
        io.write_predictions(ids, good.where("TransactionId = 'a'"), str(tmp_path / "q"))


def test_daily_files_prune(spark, tx, tmp_path):
    io.write_daily(tx.select("TRANSACTION_ID", "TX_DATETIME"), str(tmp_path / "d"))
    got = io.read_date_range(spark, str(tmp_path / "d"), "2024-01-03", "2024-01-05")
    assert "PartitionFilters: [isnotnull(tx_date" in got._jdf.queryExecution().executedPlan().toString()
    assert got.select("tx_date").distinct().count() == 3


def test_validate_lists_bad_columns(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x")], "a double, b string")
    with pytest.raises(ValueError, match="a.*b"):
        R.validate(df)
    with pytest.raises(ValueError, match="label"):
        R.validate(spark.createDataFrame([(1,)], "TX_FRAUD int"))


def test_feature_table_keeps_rows_and_has_no_gaps(tx):
    df = tx.drop("CustomerUID")
    out = build_features(df, fit_features(df), FeatureOptions(cumulative=True, session_gap_minutes=720.0, lomb_scargle=True, n_clusters=3))
    assert out.count() == df.count()
    p = out.drop("SessionAmtStd", "SessionValueStd").toPandas()
    assert p.isna().sum().sum() == 0 and "CustomerCluster" in p


def test_fraud_rates_stay_in_a_table(tx):
    state = fit_features(tx, LIGHT)
    want = {r[0]: r[1] for r in tx.groupBy("ProductCategory").agg(F.avg("TX_FRAUD")).collect()}
    got = {r["category"]: r["rate"] for r in state.rates.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    out = build_features(tx, state, LIGHT).select("TRANSACTION_ID", "ProductCategory_FraudRate").collect()
    assert len(out) == tx.count() and {round(r[1], 9) for r in out} == {round(v, 9) for v in want.values()}


def test_workflow_save_and_load_give_the_same_scores(spark, tx, tmp_path):
    o = WorkflowOptions(features=LIGHT, classifier="tree", encoder="ordered", detectors=("hbos",), select_k=8, scaler="standard", sampler="undersample",
                        sampler_params={"ratio": 0.2}, classifier_params={"maxDepth": 3})
    train, test = tx.where("TX_TIME_DAYS < 20"), tx.where("TX_TIME_DAYS >= 20")
    w = Workflow(o).fit(train)
    a = w.transform(test).orderBy("TRANSACTION_ID").toPandas()
    w.save(str(tmp_path / "w"))
    b = FittedWorkflow.load(spark, str(tmp_path / "w")).transform(test).orderBy("TRANSACTION_ID").toPandas()
    assert len(a) == test.count() and np.allclose(a.predictions, b.predictions)
    run = io.BestRun(spark, str(tmp_path / "best"))
    assert run.offer(w, 0.4) and not run.offer(w, 0.3) and run.best_score() == 0.4


def test_search_keeps_the_best_workflow(spark, tx, tmp_path):
    from txrisk.plans.search import WorkflowSearch
    x = R.calendar_features(tx).select("TRANSACTION_ID", "TX_DATETIME", "TX_TIME_DAYS", "TX_AMOUNT", "Value", "Hour", "ProductCategory",
                                       ((F.col("Value") > 60) & (F.col("ProductCategory") == "view")).cast("int").alias("TX_FRAUD"))
    train, val = x.where("TX_TIME_DAYS < 20"), x.where("TX_TIME_DAYS >= 20")
    base = WorkflowOptions(engineer=False, classifier="tree", scaler="standard")
    search = WorkflowSearch(spark, str(tmp_path / "s"), {"encoder": ["onehot", "hashing"]})
    trials = search.optimise([(train, val)], 2, base).collect()
    assert len(trials) == 2 and search.run.best_score() == max(r["score"] for r in trials)
    best = search.run.load(lambda p: FittedWorkflow.load(spark, p))
    assert best.transform(val).count() == val.count()
