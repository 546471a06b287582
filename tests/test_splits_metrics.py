import numpy as np
from pyspark.sql import functions as F

from txrisk.functions.scale import hash_unit, prefix_sums, exact_quantile_row, row_positions
from txrisk.operators import encoders as E, metrics as V, splits as X
from txrisk.schema import micros


def scored(tx):
    return tx.withColumn("predictions", F.round(hash_unit("TRANSACTION_ID", 1), 2))


def test_holdout_known_customers_are_removed(tx):
    p = X.holdout_split(tx, train=14, delay=3, test=7).toPandas()
    train, test = p[p.split == "train"], p[p.split == "test"]
    s0 = train.TX_TIME_DAYS.min()
    bad = set(train[train.TX_FRAUD == 1].CUSTOMER_ID)
    assert not bad & set(test.CUSTOMER_ID)
    assert test.TX_TIME_DAYS.between(s0 + 17, s0 + 23).all()
    full = tx.toPandas()
    for i in range(7):
        day = full[full.TX_TIME_DAYS == s0 + 14 + i - 1]
        bad |= set(day[day.TX_FRAUD == 1].CUSTOMER_ID)
        expect = full[(full.TX_TIME_DAYS == s0 + 17 + i) & ~full.CUSTOMER_ID.isin(bad)]
        assert set(expect.TRANSACTION_ID) == set(test[test.TX_TIME_DAYS == s0 + 17 + i].TRANSACTION_ID)


def test_time_series_folds_are_ordered_with_gap(tx):
    p = X.time_series_split(tx.withColumn("us", micros("TX_DATETIME")), 3, 20).toPandas()
    for f, g in p.groupby("fold"):
        tr, te = g[g.split == "train"], g[g.split == "test"]
        assert tr.us.max() < te.us.min()
        assert len(te) == 250 and not set(tr.TRANSACTION_ID) & set(te.TRANSACTION_ID)


def test_group_splits_share_no_group(tx):
    p = X.rolling_group_splits(tx, "CustomerUID", 7).toPandas()
    for _, g in p.groupby("fold"):
        assert not set(g[g.split == "train"].CustomerUID) & set(g[g.split == "val"].CustomerUID)


def test_ranking_scores_by_brute_force(tx):
    p = scored(tx).toPandas()
    pos, neg = p[p.TX_FRAUD == 1].predictions.values, p[p.TX_FRAUD == 0].predictions.values
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert abs(V.ranking_scores(scored(tx)).first()["auc_roc"] - auc) < 1e-12


def test_card_topk_removes_detected_customers(tx):
    k = 2
    x = scored(tx).withColumn("TX_FRAUD", ((F.col("TRANSACTION_ID") % 5) == 0).cast("int"))
    got = {r["TX_TIME_DAYS"]: (r["nb_compromised"], r["card_precision"]) for r in V.card_topk(x, k).collect()}
    p = x.toPandas()
    found = set()
    for day, g in sorted(p.groupby("TX_TIME_DAYS"), key=lambda t: t[0]):
        g = g[~g.CUSTOMER_ID.isin(found)].groupby("CUSTOMER_ID").agg(s=("predictions", "max"), f=("TX_FRAUD", "max")).reset_index()
        top = g.sort_values(["s", "CUSTOMER_ID"], ascending=[False, True]).head(k)
        assert got[day] == (int(g.f.sum()), top.f.sum() / k), day
        found |= set(top[top.f == 1].CUSTOMER_ID)


def test_quantiles_positions_and_prefixes(tx):
    p = tx.toPandas()
    q = exact_quantile_row(tx, ["TX_AMOUNT", "Value"], [0.0, 0.1, 0.5, 0.77, 1.0])
    for c in q:
        assert np.allclose(q[c], p[c].quantile([0.0, 0.1, 0.5, 0.77, 1.0]))
    pos = row_positions(tx.withColumn("us", micros("TX_DATETIME")), "us", "TRANSACTION_ID").select("TRANSACTION_ID", "pos").toPandas()
    assert (pos.sort_values("TRANSACTION_ID").pos.values == np.arange(len(p))).all()
    runs = prefix_sums(tx.groupBy("Value").agg(F.count("*").alias("n")), "Value", ["n"], descending=True).toPandas().sort_values("Value", ascending=False)
    assert (runs.cum_n.values == runs.n.cumsum().values).all()


def test_ordered_encoding_never_sees_later_labels(tx):
    enc = E.OrderedTargetEncoder(None, ["ProductCategory"], 0.01, __import__("txrisk.schema", fromlist=["DEFAULT"]).DEFAULT)
    a = enc.transform_train(tx).where("TX_TIME_DAYS < 10").select("TRANSACTION_ID", "ProductCategory_ordered").toPandas()
    flipped = tx.withColumn("TX_FRAUD", F.when(F.col("TX_TIME_DAYS") >= 10, 1 - F.col("TX_FRAUD")).otherwise(F.col("TX_FRAUD")))
    b = enc.transform_train(flipped).where("TX_TIME_DAYS < 10").select("TRANSACTION_ID", "ProductCategory_ordered").toPandas()
    key = "TRANSACTION_ID"
    assert np.allclose(a.sort_values(key).ProductCategory_ordered, b.sort_values(key).ProductCategory_ordered)


def test_spline_is_a_partition_of_unity(spark):
    from txrisk.functions.rows import periodic_spline
    df = spark.range(0, 24).select(F.col("id").alias("h"))
    p = periodic_spline(df, ["h"]).toPandas()
    cols = [c for c in p if c.startswith("h_spline")]
    assert len(cols) == 5 and np.allclose(p[cols].sum(axis=1), 1)
    assert np.allclose(p.sort_values("h")[cols].iloc[0], p.sort_values("h")[cols].iloc[-1])


def test_md5_modulo_equals_big_integers(spark):
    import hashlib
    df = spark.createDataFrame([(c,) for c in ("a", "xyz", "", "PR22")], "v string")
    for r in df.select("v", E.md5_mod(F.col("v"), 7).alias("m")).collect():
        assert r["m"] == int(hashlib.md5(r["v"].encode()).hexdigest(), 16) % 7
