"""Queries on sources, splits, set operations, samples, joins and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import SCORED, TX, query, rounded, s6, scored, table, tx, txd, u32, unit
from txrisk.operators import aggregates as A, metrics as V, splits as X
from txrisk.functions.scale import shared_folder
from txrisk.sources import io
from txrisk.schema import DAY_US

ID = "TRANSACTION_ID"


# ------------------------------------------------------------------ sources

RAW = {"TRANSACTION_ID": "TransactionId", "CUSTOMER_ID": "CustomerId", "TX_AMOUNT": "Amount", "TX_FRAUD": "FraudResult"}


@query("normalise_transactions", f"""WITH {TX} SELECT CAST(TRANSACTION_ID AS VARCHAR) AS TRANSACTION_ID, us AS TX_US, CountryCode, PricingStrategy,
 {s6('TX_AMOUNT')} AS TX_AMOUNT, {s6('Value')} AS Value, TX_FRAUD, CAST((us - min(us) OVER ()) // 86400000000 AS INT) AS TX_TIME_DAYS
 FROM (SELECT * REPLACE (us - us % 1000000 AS us) FROM tx)""")
def _(spark, d):
    """The raw file form (day-first text times, integer codes) of the transactions, loaded."""
    x = tx(spark, d)
    raw = x.select(F.col(ID).cast("string").alias("TransactionId"), "BatchId", "AccountId", "SubscriptionId",
                   F.col("CUSTOMER_ID").alias("CustomerId"), "CurrencyCode", F.col("CountryCode").cast("int").alias("CountryCode"),
                   "ProviderId", "ProductId", "ProductCategory", "ChannelId", F.col("TX_AMOUNT").alias("Amount"), "Value",
                   F.date_format("TX_DATETIME", "dd/MM/yyyy HH:mm:ss").alias("TransactionStartTime"),
                   F.col("PricingStrategy").cast("int").alias("PricingStrategy"), F.col("TX_FRAUD").alias("FraudResult"))
    out = io.normalise(raw)
    return rounded(out.select(ID, F.unix_micros("TX_DATETIME").alias("TX_US"), "CountryCode", "PricingStrategy", "TX_AMOUNT", "Value",
                              "TX_FRAUD", "TX_TIME_DAYS"))


@query("ordered_output", f"WITH {TX} SELECT TRANSACTION_ID, row_number() OVER (ORDER BY us, TRANSACTION_ID) - 1 AS pos FROM tx")
def _(spark, d):
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    io.write_ordered(tx(spark, d).select(ID, "TX_DATETIME"), path, ["TX_DATETIME", ID])
    return io.read_ordered(spark, path).select(ID, "pos")


@query("read_daily_folders", f"""WITH {TX} SELECT TRANSACTION_ID, CAST(CAST(TX_DATETIME AS DATE) AS VARCHAR) AS day FROM tx
 WHERE CAST(TX_DATETIME AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'""")
def _(spark, d):
    path = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    io.write_daily(tx(spark, d).select(ID, "TX_DATETIME"), path)
    return io.read_date_range(spark, path, "2024-01-05", "2024-01-11").select(ID, F.col("tx_date").cast("string").alias("day"))


@query("read_date_range", f"""WITH {TX} SELECT TRANSACTION_ID, CASE WHEN TX_FRAUD = 0 THEN 0 ELSE 1 END AS flag FROM tx
 WHERE CAST(TX_DATETIME AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def _(spark, d):
    x = tx(spark, d).select(ID, F.to_date("TX_DATETIME").alias("tx_date"), F.when(F.col("TX_FRAUD") == 0, -1).otherwise(1).alias("flag"))
    return io.date_range(x, "tx_date", "2024-01-05", "2024-01-12").select(ID, "flag")


@query("clean", "SELECT DISTINCT d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id "
                "WHERE d.lang IS NOT NULL AND d.source IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def _(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("lang", "source", "quality", "toxic")
    return io.clean(x, drop_all_na=True)


@query("align_predictions", f"""WITH {TX} SELECT t.TRANSACTION_ID, coalesce(p.TX_FRAUD, -1) AS TX_FRAUD FROM tx t LEFT JOIN
 (SELECT TRANSACTION_ID, TX_FRAUD FROM tx WHERE TX_TIME_DAYS < 20) p USING (TRANSACTION_ID)""")
def _(spark, d):
    x = txd(spark, d)
    return io.align_predictions(x.select(ID), x.where("TX_TIME_DAYS < 20"), ID, "TX_FRAUD").na.fill(-1)


@query("explore_sample", f"WITH {TX} SELECT AccountId, ProductCategory, {s6('Value')} AS Value FROM tx WHERE {unit('TRANSACTION_ID', 3)} < 0.25")
def _(spark, d):
    return rounded(io.explore(tx(spark, d), ["AccountId", "ProductCategory", "Value"], ID, 0.25, 3))


# ------------------------------------------------------------------ splits

def _holdout(key: str, delay_block: bool, fold: int = 0) -> str:
    """Train, delay-aware test and optionally the delay block of one fold, day by day."""
    tr, de, te = 14, 3, 7
    s = f"(SELECT max(us) - {(tr + de + te) * DAY_US} - {fold * te * DAY_US} FROM tx)"
    p = f"p{fold}{key[0]}"
    days = " UNION ALL ".join(
        f"SELECT * FROM tx WHERE TX_TIME_DAYS = (SELECT s0 FROM {p}s) + {tr + de + i} AND {key} NOT IN (SELECT {key} FROM {p}tr WHERE TX_FRAUD = 1) "
        f"AND {key} NOT IN (SELECT {key} FROM tx, {p}s WHERE TX_FRAUD = 1 AND TX_TIME_DAYS BETWEEN s0 + {tr - 1} AND s0 + {tr + i - 1})"
        for i in range(te))
    out = f"""{p}tr AS (SELECT * FROM tx WHERE us >= {s} AND us < {s} + {tr * DAY_US}), {p}s AS (SELECT min(TX_TIME_DAYS) AS s0 FROM {p}tr),
 {p} AS (SELECT {fold} AS fold, 'train' AS split, TRANSACTION_ID FROM {p}tr UNION ALL SELECT {fold}, 'test', TRANSACTION_ID FROM ({days})"""
    if delay_block:
        out += f" UNION ALL SELECT {fold}, 'delay', TRANSACTION_ID FROM tx WHERE us >= {s} + {tr * DAY_US} AND us < {s} + {(tr + de) * DAY_US}"
    return out + ")"


query("holdout_split", f"WITH {TX}, {_holdout('CUSTOMER_ID', False)} SELECT TRANSACTION_ID, split FROM p0C")(
    lambda spark, d: X.holdout_split(txd(spark, d)).select(ID, "split"))
query("train_delay_test_split", f"WITH {TX}, {_holdout('AccountId', True)} SELECT TRANSACTION_ID, split FROM p0A")(
    lambda spark, d: X.train_delay_test_split(txd(spark, d)).select(ID, "split"))
query("prequential_split", f"WITH {TX}, " + ", ".join(_holdout("CUSTOMER_ID", False, f) for f in range(2))
      + " SELECT * FROM p0C UNION ALL SELECT * FROM p1C")(
    lambda spark, d: X.prequential_split(txd(spark, d), 2).select("fold", "split", ID))

query("remove_known_bad", f"""WITH {TX} SELECT TRANSACTION_ID FROM tx t WHERE NOT EXISTS (SELECT 1 FROM tx b WHERE b.TX_FRAUD = 1
 AND b.CUSTOMER_ID = t.CUSTOMER_ID AND b.TX_TIME_DAYS <= t.TX_TIME_DAYS - 5)""")(
    lambda spark, d: X.remove_known_bad(txd(spark, d), txd(spark, d), "CUSTOMER_ID", 5).select(ID))
query("remove_group_overlap", f"""WITH {TX} SELECT TRANSACTION_ID FROM tx WHERE TX_TIME_DAYS >= 20 AND CustomerUID NOT IN
 (SELECT CustomerUID FROM tx WHERE TX_TIME_DAYS < 4)""")(
    lambda spark, d: X.remove_group_overlap(txd(spark, d).where("TX_TIME_DAYS >= 20"), txd(spark, d).where("TX_TIME_DAYS < 4"), "CustomerUID").select(ID))
query("known_defrauded", f"WITH {TX} SELECT CUSTOMER_ID, min(TX_TIME_DAYS) AS first_day FROM tx WHERE TX_FRAUD = 1 GROUP BY 1")(
    lambda spark, d: X.known_defrauded(txd(spark, d), "CUSTOMER_ID"))

query("time_series_split", f"""WITH {TX}, p AS (SELECT TRANSACTION_ID, row_number() OVER (ORDER BY us, TRANSACTION_ID) - 1 AS pos, count(*) OVER () AS n FROM tx),
 f AS (SELECT unnest([0, 1, 2]) AS fold), q AS (SELECT *, n - (3 - fold) * (n // 4) AS a FROM p, f)
 SELECT TRANSACTION_ID, CAST(fold AS INT) AS fold, CASE WHEN pos < a - 100 THEN 'train' ELSE 'test' END AS split FROM q
 WHERE pos < a - 100 OR (pos >= a AND pos < a + n // 4)""")(
    lambda spark, d: X.time_series_split(tx(spark, d), 3, 100).select(ID, "fold", "split"))

_G = f"""lim AS (SELECT min(us) AS lo, (max(us) - min(us)) // {DAY_US} - 7 AS sh FROM tx), f AS (SELECT unnest([0, 1, 2]) AS fold),
 w AS (SELECT fold, lo + CAST(trunc(sh * fold / 2) AS BIGINT) * {DAY_US} AS a FROM lim, f),
 tr AS (SELECT fold, tx.* FROM tx, w WHERE us < a),
 va AS (SELECT fold, tx.* FROM tx, w WHERE us >= a AND us < a + 7 * {DAY_US} AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.fold = w.fold AND tr.CustomerUID = tx.CustomerUID)),
 g AS (SELECT TRANSACTION_ID, CAST(fold AS INT) AS fold, 'train' AS split FROM tr UNION ALL SELECT TRANSACTION_ID, CAST(fold AS INT), 'val' FROM va)"""
query("rolling_group_splits", f"WITH {TX}, {_G} SELECT * FROM g")(
    lambda spark, d: X.rolling_group_splits(tx(spark, d), "CustomerUID", 7, 3).select(ID, "fold", "split"))
query("train_val_split", f"WITH {TX}, {_G} SELECT TRANSACTION_ID, split FROM g WHERE (fold = 1 AND split = 'train') OR (fold = 2 AND split = 'val')")(
    lambda spark, d: X.train_val_split(tx(spark, d), "CustomerUID", 7).select(ID, "split"))

query("stratified_sample", f"""WITH {TX}, r AS (SELECT TRANSACTION_ID, TX_FRAUD, row_number() OVER (PARTITION BY TX_FRAUD ORDER BY {u32('TRANSACTION_ID', 5)}, TRANSACTION_ID) AS rn,
 count(*) OVER (PARTITION BY TX_FRAUD) AS n FROM tx) SELECT TRANSACTION_ID, TX_FRAUD FROM r WHERE rn <= round(n * 0.2)""")(
    lambda spark, d: X.stratified_sample(tx(spark, d), 0.2, 5).select(ID, "TX_FRAUD"))
query("stratified_kfold", f"""WITH {TX} SELECT TRANSACTION_ID, CAST((row_number() OVER (PARTITION BY TX_FRAUD ORDER BY {u32('TRANSACTION_ID', 5)}, TRANSACTION_ID) - 1) % 5 AS INT)
 AS fold FROM tx""")(lambda spark, d: X.stratified_kfold(tx(spark, d), 5, 5).select(ID, "fold"))
query("random_undersample", f"""WITH {TX}, n AS (SELECT CAST(sum(TX_FRAUD) AS DOUBLE) AS p, CAST(sum(1 - TX_FRAUD) AS DOUBLE) AS q FROM tx)
 SELECT TRANSACTION_ID, TX_FRAUD FROM tx, n WHERE TX_FRAUD = 1 OR {unit('TRANSACTION_ID', 5)} < p / 0.1 / q""")(
    lambda spark, d: X.random_undersample(tx(spark, d), 0.1, 5).select(ID, "TX_FRAUD"))


# ------------------------------------------------------------------ joins and sets on the other tables

@query("attach_group_statistics", f"""WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1)
 SELECT c_custkey, {s6('m')} AS nation_mean, {s6('s')} AS nation_std FROM customer LEFT JOIN s USING (c_nationkey)""")
def _(spark, d):
    from txrisk.functions.scale import attach
    c = table(spark, d, "customer")
    s = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("nation_mean"), F.stddev_samp("c_acctbal").alias("nation_std"))
    return rounded(attach(c, s, "c_nationkey").select("c_custkey", "nation_mean", "nation_std"))


query("union_slices", f"WITH {TX} SELECT TRANSACTION_ID FROM tx WHERE TX_TIME_DAYS = 3 UNION ALL SELECT TRANSACTION_ID FROM tx WHERE TX_TIME_DAYS = 9")(
    lambda spark, d: (lambda x: X.union_slices(x.where("TX_TIME_DAYS = 3"), x.where("TX_TIME_DAYS = 9")))(txd(spark, d).select(ID, "TX_TIME_DAYS")).select(ID))
query("common_keys", f"WITH {TX} SELECT CustomerUID FROM tx WHERE TX_FRAUD = 1 INTERSECT SELECT CustomerUID FROM tx WHERE TX_FRAUD = 0")(
    lambda spark, d: (lambda x: X.common_keys(x.where("TX_FRAUD = 1"), x.where("TX_FRAUD = 0"), "CustomerUID"))(tx(spark, d)))
query("unique_keys", f"WITH {TX} SELECT CustomerUID FROM tx EXCEPT SELECT CustomerUID FROM tx WHERE TX_TIME_DAYS < 3")(
    lambda spark, d: (lambda x: X.unique_keys(x, x.where("TX_TIME_DAYS < 3"), "CustomerUID"))(txd(spark, d)))
query("unique_ratio", f"""WITH {TX}, k AS (SELECT DISTINCT CustomerUID FROM tx), s AS (SELECT DISTINCT CustomerUID AS u FROM tx WHERE TX_TIME_DAYS < 3)
 SELECT count(*) AS n_keys, count(*) FILTER (u IS NULL) AS n_unique, {s6('count(*) FILTER (u IS NULL) / count(*)')} AS ratio FROM k LEFT JOIN s ON u = CustomerUID""")(
    lambda spark, d: rounded((lambda x: X.unique_ratio(x, x.where("TX_TIME_DAYS < 3"), "CustomerUID"))(txd(spark, d))))
query("unseen_categories", f"""WITH {TX}, o AS (SELECT 'ProductId' AS "column", ProductId AS value FROM tx UNION SELECT 'CUSTOMER_ID', CUSTOMER_ID FROM tx),
 t AS (SELECT 'ProductId' AS "column", ProductId AS value FROM tx WHERE TX_FRAUD = 1 UNION SELECT 'CUSTOMER_ID', CUSTOMER_ID FROM tx WHERE TX_FRAUD = 1)
 SELECT * FROM o EXCEPT SELECT * FROM t""")(
    lambda spark, d: X.unseen_categories(tx(spark, d).where("TX_FRAUD = 1"), tx(spark, d), ["ProductId", "CUSTOMER_ID"]))


# ------------------------------------------------------------------ metrics

CURVE = """c AS (SELECT predictions AS s, sum(TX_FRAUD) AS p, sum(1 - TX_FRAUD) AS q FROM scored GROUP BY 1),
 k AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c),
 rs AS (SELECT sum(q * (2*tp - p) / 2.0) / (any_value(np) * any_value(nq)) AS auc, sum(p * tp / (tp + fp)) / any_value(np) AS ap FROM k)"""
query("ranking_scores", f"WITH {SCORED}, {CURVE} SELECT {s6('auc')} AS auc_roc, {s6('ap')} AS average_precision FROM rs")(
    lambda spark, d: rounded(V.ranking_scores(scored(spark, d))))

THRESHOLDS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.5]


def _threshold_sql(ts) -> str:
    rows = " UNION ALL ".join(f"""SELECT CAST({t} AS DOUBLE) AS t, count(*) FILTER (predictions < {t} AND TX_FRAUD = 0)::DOUBLE AS tn,
 count(*) FILTER (predictions >= {t} AND TX_FRAUD = 0)::DOUBLE AS fp, count(*) FILTER (predictions < {t} AND TX_FRAUD = 1)::DOUBLE AS fn,
 count(*) FILTER (predictions >= {t} AND TX_FRAUD = 1)::DOUBLE AS tp FROM scored""" for t in ts)
    return f"""cm AS ({rows}), tm AS (SELECT t AS Threshold, (fp+fn)/(tn+fp+fn+tp) AS MME, tp/(tp+fn) AS TPR, tn/(tn+fp) AS TNR, fp/(tn+fp) AS FPR, fn/(tp+fn) AS FNR,
 (fp/(tn+fp) + fn/(tp+fn))/2 AS BER, sqrt(tp/(tp+fn)*tn/(tn+fp)) AS "G-mean", CASE WHEN tp+fp > 0 THEN tp/(tp+fp) ELSE 1 END AS "Precision",
 CASE WHEN tn+fn > 0 THEN tn/(tn+fn) ELSE 1 END AS NPV, CASE WHEN tp+fp > 0 THEN fp/(tp+fp) ELSE 1 END AS FDR,
 CASE WHEN tn+fn > 0 THEN fn/(tn+fn) ELSE 1 END AS "FOR", CASE WHEN tp = 0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END AS "F1 Score" FROM cm)"""


_names = ["Threshold", "MME", "TPR", "TNR", "FPR", "FNR", "BER", "G-mean", "Precision", "NPV", "FDR", "FOR", "F1 Score"]
query("threshold_metrics", f"WITH {SCORED}, {_threshold_sql(THRESHOLDS)} SELECT " + ", ".join(
    f"round(\"{n}\" + 1.3e-8, 6) AS \"{n}\"" for n in _names) + " FROM tm")(
    lambda spark, d: rounded(V.threshold_metrics(scored(spark, d), THRESHOLDS)))
query("best_f1_threshold", f"WITH {SCORED}, {_threshold_sql([i / 20 for i in range(1, 20)])} SELECT {s6('Threshold')} AS Threshold, round(\"F1 Score\" + 1.3e-8, 6) AS F1 "
      "FROM tm ORDER BY \"F1 Score\" DESC, Threshold LIMIT 1")(
    lambda spark, d: rounded(V.best_f1_threshold(scored(spark, d), [i / 20 for i in range(1, 20)])))
query("score_report", f"WITH {SCORED}, {CURVE}, {_threshold_sql([0.5])} SELECT round(\"F1 Score\" + 1.3e-8, 6) AS f1, round(\"Precision\" + 1.3e-8, 6) AS \"precision\", "
      f"{s6('TPR')} AS recall, {s6('ap')} AS average_precision FROM tm, rs")(lambda spark, d: rounded(V.score_report(scored(spark, d))))
query("classify", f"WITH {SCORED} SELECT TRANSACTION_ID, CASE WHEN predictions < 0.7 THEN 0 ELSE 1 END AS predicted FROM scored")(
    lambda spark, d: __import__("txrisk.functions.rows", fromlist=["classify"]).classify(scored(spark, d), 0.7).select(ID, "predicted"))

TOPK = """cd AS (SELECT TX_TIME_DAYS, CUSTOMER_ID, max(predictions) AS s, max(TX_FRAUD) AS f FROM scored GROUP BY 1, 2),
 top AS (SELECT *, row_number() OVER (PARTITION BY TX_TIME_DAYS ORDER BY s DESC, CUSTOMER_ID) AS r FROM cd)"""
query("card_topk_day", f"WITH {SCORED}, {TOPK} SELECT TX_TIME_DAYS, {s6('sum(f) / 20.0')} AS card_precision FROM top WHERE r <= 20 GROUP BY 1")(
    lambda spark, d: rounded(V.card_topk_day(scored(spark, d), 20)))
query("card_topk_keep_detected", f"""WITH {SCORED}, {TOPK} SELECT TX_TIME_DAYS, CAST(sum(f) AS BIGINT) AS nb_compromised,
 {s6('CAST(sum(f) FILTER (r <= 20) AS DOUBLE) / 20.0')} AS card_precision FROM top GROUP BY 1""")(
    lambda spark, d: rounded(V.card_topk(scored(spark, d), 20, False)))
query("card_topk_remove_detected")(lambda spark, d: rounded(V.card_topk(scored(spark, d), 20, True)))
query("performance_assessment")(lambda spark, d: rounded(V.performance_assessment(scored(spark, d), [20])))

query("model_comparison", f"""WITH {SCORED}, c AS (SELECT ChannelId, predictions AS s, sum(TX_FRAUD) AS p, sum(1 - TX_FRAUD) AS q FROM scored GROUP BY 1, 2),
 k AS (SELECT *, sum(p) OVER (PARTITION BY ChannelId ORDER BY s DESC) AS tp, sum(q) OVER (PARTITION BY ChannelId ORDER BY s DESC) AS fp,
  sum(p) OVER (PARTITION BY ChannelId) AS np, sum(q) OVER (PARTITION BY ChannelId) AS nq FROM c),
 r AS (SELECT ChannelId, sum(q * (2*tp - p) / 2.0) / (any_value(np) * any_value(nq)) AS auc, sum(p * tp / (tp + fp)) / any_value(np) AS ap FROM k GROUP BY 1)
 SELECT ChannelId AS model, 'AUC ROC' AS metric, {s6('auc')} AS value FROM r UNION ALL SELECT ChannelId, 'Average precision', {s6('ap')} FROM r""")(
    lambda spark, d: rounded(V.model_comparison(scored(spark, d), "ChannelId")))


def _performance(spark, d):
    """A performance table (one row per channel and pricing strategy) measured on the transactions."""
    x = scored(spark, d)
    return x.groupBy(F.col("ChannelId").alias("model"), F.col("PricingStrategy").alias("Parameters summary")).agg(
        F.avg("predictions").alias("AP Validation"), F.stddev_samp("predictions").alias("AP Validation Std"),
        F.avg(F.col("Value") / 100).alias("AP Test"), F.stddev_samp(F.col("Value") / 100).alias("AP Test Std"))


PERF = """pf AS (SELECT ChannelId AS model, PricingStrategy AS p, avg(predictions) AS v, stddev_samp(predictions) AS vs, avg(Value/100) AS t,
 stddev_samp(Value/100) AS ts FROM scored GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v DESC, p) AS rv, row_number() OVER (PARTITION BY model ORDER BY t DESC, p) AS rt FROM pf)"""
query("parameter_summary", f"""WITH {SCORED}, {PERF} SELECT x.model, 'AP' AS metric, x.p AS best_parameters, printf('%.3f+/-%.2f', x.v, x.vs) AS validation_performance,
 printf('%.3f+/-%.2f', x.t, x.ts) AS test_performance, o.p AS optimal_parameters, printf('%.3f+/-%.2f', o.t, o.ts) AS optimal_test_performance
 FROM b x JOIN b o ON x.model = o.model AND x.rv = 1 AND o.rt = 1""")(
    lambda spark, d: V.parameter_summary(_performance(spark, d), ["AP"], groups=["model"]))
query("model_selection_summary", f"""WITH {SCORED}, {PERF} SELECT model, 'AP' AS metric, 'best' AS kind, {s6('t')} AS mean, {s6('ts')} AS std FROM b WHERE rv = 1
 UNION ALL SELECT model, 'AP', 'optimal', {s6('t')}, {s6('ts')} FROM b WHERE rt = 1
 UNION ALL SELECT model, 'AP', 'default', {s6('t')}, {s6('ts')} FROM b WHERE p = '0'""")(
    lambda spark, d: rounded(V.model_selection_summary(_performance(spark, d), ["AP"], "model", {f"CH{i}": "0" for i in range(4)})))
