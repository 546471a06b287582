import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.functions.rows import calendar_features
from txrisk.operators import impute as I, models as M, neighbors as N, outliers as O, resample as X
from txrisk.operators.metrics import ranking_scores
from txrisk.schema import DEFAULT


def brute(ids, m, k):
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((m - m[i]) ** 2).sum(1))
        out[ids[i]] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


@pytest.mark.parametrize("max_broadcast", [10 ** 6, 10])
def test_knn_join_is_exact_even_with_copies(spark, monkeypatch, max_broadcast):
    monkeypatch.setattr(N, "RING_ROWS", 60)
    monkeypatch.setattr(N, "QUERY_ROWS", 60)
    a = spark.range(300).select(F.col("id"), F.array((F.col("id") * 37 % 101).cast("double"), (F.col("id") * 11 % 53).cast("double")).alias("vec"))
    copies = spark.range(1000, 1200).select("id", F.array(F.lit(5.0), F.lit(6.0)).alias("vec"))
    df = a.unionByName(copies)
    p = df.toPandas()
    want = brute(p.id.values, np.stack(p.vec), 4)
    got = {q: list(zip(g.sort_values("rank").neighbour, g.sort_values("rank").distance)) for q, g in
           N.knn_join(df, df, 4, "id", "id", exclude_self=True, max_broadcast=max_broadcast).toPandas().groupby("qid")}
    assert {q: [x[0] for x in v] for q, v in got.items()} == {q: [x[0] for x in v] for q, v in want.items()}
    assert all(np.allclose([x[1] for x in got[q]], [x[1] for x in want[q]]) for q in want)


def test_smote_points_lie_on_neighbour_segments(tx):
    f = ["TX_AMOUNT", "Value"]
    s = X.smote_rows(tx, f, 0.05, 3).toPandas()
    pos = tx.where("TX_FRAUD = 1").toPandas().set_index("TRANSACTION_ID")
    assert len(s) == round(0.05 * tx.where("TX_FRAUD = 0").count()) - len(pos)
    for r in s.itertuples():
        a, b = pos.loc[r.base_id, f].astype(float), pos.loc[r.neighbour_id, f].astype(float)
        assert np.allclose([r.TX_AMOUNT, r.Value], a + r.lam * (b - a)) and 0 <= r.lam < 1


def test_imputer_by_brute_force(spark):
    rows = [(i, float(i * 7 % 13) if i % 4 else None, float(i * 5 % 11) if i % 6 else None, float(i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = I.knn_impute(df, ["a", "b", "c"], 3, cols=DEFAULT.with_names(id="id")).toPandas().sort_values("id").set_index("id")
    m = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    for i, r in enumerate(m):
        for c in np.flatnonzero(np.isnan(r)):
            cand = []
            for j, s in enumerate(m):
                both = ~np.isnan(r) & ~np.isnan(s)
                if not np.isnan(s[c]) and both.any():
                    cand.append((round(np.sqrt(((r - s)[both] ** 2).sum()) * np.sqrt(3 / both.sum()), 9), j))
            best = sorted(cand)[:3]
            zero = [m[j][c] for d, j in best if d == 0]
            want = np.mean(zero) if zero else sum(m[j][c] / d for d, j in best) / sum(1 / d for d, _ in best)
            assert abs(got.loc[i].iloc[c] - want) < 1e-6


def test_detectors_rank_a_planted_outlier_first_and_survive_a_round_trip(spark):
    df = spark.range(500).select(F.col("id").alias("TRANSACTION_ID"), F.when(F.col("id") == 77, 900.0).otherwise((F.col("id") * 37 % 101) / 10.0).alias("x"),
                                 F.when(F.col("id") == 77, -500.0).otherwise((F.col("id") * 53 % 89) / 10.0).alias("y"))
    for name in ("iforest", "hbos", "loda", "cblof", "mcd"):
        model = O.fit_detector(df, ["x", "y"], name, **({"n_trees": 20} if name == "iforest" else {}))
        out = model.transform(df, "s")
        top = out.orderBy(F.desc("s")).limit(20).collect()
        assert any(r["TRANSACTION_ID"] == 77 for r in top), name
        again = O.detector_from_state(__import__("json").loads(__import__("json").dumps(O.detector_state(model)))).transform(df, "s")
        assert np.allclose(out.orderBy("TRANSACTION_ID").toPandas().s, again.orderBy("TRANSACTION_ID").toPandas().s)


@pytest.fixture(scope="module")
def planted(tx):
    x = calendar_features(tx).withColumn("k", (F.col("TRANSACTION_ID") % 7).cast("double"))
    x = x.withColumn("TX_FRAUD", ((F.col("Value") > 60) & (F.col("k") < 3)).cast("int"))
    return M.assemble(M.class_weights(x), ["TX_AMOUNT", "Value", "k"]).cache()


@pytest.mark.parametrize("make", [
    M.logistic, M.decision_tree, lambda: M.gradient_boosting(maxIter=3), lambda: M.UndersampledBags(M.decision_tree(maxDepth=4), 2),
    lambda: M.BoostedRounds(M.decision_tree(maxDepth=2), 3, every=2), lambda: M.Bagging(M.decision_tree(maxDepth=5), 3, 2),
    lambda: M.ClusterwiseClassifier(2), lambda: M.SoftVoting([M.logistic(), M.decision_tree()])])
def test_learners_find_a_planted_signal(planted, make):
    train, test = planted.where("TRANSACTION_ID % 3 > 0"), planted.where("TRANSACTION_ID % 3 = 0")
    auc = ranking_scores(M.fraud_probability(make().fit(train).transform(test))).first()["auc_roc"]
    assert auc > 0.8


def test_calibration_is_monotone(planted):
    s = M.fraud_probability(M.logistic().fit(planted).transform(planted)).select("TX_FRAUD", "predictions")
    p = M.calibrate(s)(s).toPandas().sort_values("predictions")
    assert (np.diff(p.calibrated) >= -1e-12).all()


def test_string_ratios_are_computed_in_tasks(tx):
    from difflib import SequenceMatcher
    from txrisk.operators import encoders as E
    table = E.similarity_encoder(tx, "ProductCategory").table
    assert "EvalPython" in table._jdf.queryExecution().executedPlan().toString()
    rows = table.collect()
    names = [r["category"] for r in rows]
    assert len(names) > 1 and all(r[o] == SequenceMatcher(None, r["category"], o).ratio() for r in rows for o in names)


@pytest.mark.parametrize("with_vectors", [False, True])
def test_many_similarity_categories_equal_the_columns(spark, tx, monkeypatch, with_vectors):
    from txrisk.operators import encoders as E
    vectors = spark.createDataFrame([(f"PR{i}", [float(i), 1.0, 2.0]) for i in range(1, 30)], "category string, vector array<double>") if with_vectors else None
    values = sorted(r[0] for r in tx.select("ProductId").distinct().collect())
    wide = E.similarity_encoder(tx, "ProductId", vectors).transform(tx)
    want = {r.TRANSACTION_ID: [r[f"ProductId_{v}"] for v in values] for r in wide.collect()}
    monkeypatch.setattr(E, "MAX_SIMILARITY_CATEGORIES", 3)
    got = E.similarity_encoder(tx, "ProductId", vectors).transform(tx).select("TRANSACTION_ID", "ProductId_similarity").collect()
    assert len(values) > 3 and {r[0]: r[1] for r in got} == want
    assert all(None not in v for v in want.values())
