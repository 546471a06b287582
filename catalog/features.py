"""Row, window, aggregate and series queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import CAL, TX, cal, query, rounded, s6, table, tx, txd
from txrisk.functions import rows as R
from txrisk.functions.scale import exact_quantiles
from txrisk.operators import aggregates as A, series as S, windows as W
from txrisk.schema import DAY_US, DEFAULT, HOUR_US

ID = "TRANSACTION_ID"
ACC = "AccountId"


def plus(before, after):
    """Id and the columns an operator added."""
    return rounded(after.select(ID, *[c for c in after.columns if c not in before.columns]))


# ------------------------------------------------------------------ rows

@query("composite_key", f"WITH {TX} SELECT TRANSACTION_ID, CustomerUID FROM tx")
def _(spark, d):
    return tx(spark, d).select(ID, "CustomerUID")


@query("calendar_features", f"""WITH {CAL} SELECT TRANSACTION_ID, Hour, DayOfWeek, DayOfMonth, IsWeekend, IsNight,
 IsMonthEnd, IsMonthStart FROM cal""")
def _(spark, d):
    return plus(tx(spark, d), cal(spark, d))


@query("legacy_calendar_flags", f"""WITH {TX} SELECT TRANSACTION_ID, CAST(isodow(TX_DATETIME) > 5 AS INT) AS TX_DURING_WEEKEND,
 CAST(hour(TX_DATETIME) < 6 OR hour(TX_DATETIME) > 18 AS INT) AS TX_DURING_NIGHT, CAST(hour(TX_DATETIME) AS INT) AS TX_HOUR,
 TX_TIME_DAYS FROM tx""")
def _(spark, d):
    x = tx(spark, d)
    return plus(x, R.legacy_calendar_flags(x))


def _cross_sql(groups):
    return ", ".join(f"concat_ws('_', {', '.join(g)}) AS \"{'_'.join(g)}\"" for g in dict.fromkeys(groups))


CROSS = [g for n in (2, 3) for g in combinations(["ProductCategory", "PricingStrategy", "ProviderId", "ChannelId"], n)]


@query("cross_features", f"WITH {TX} SELECT TRANSACTION_ID, {_cross_sql(CROSS)} FROM tx")
def _(spark, d):
    x = tx(spark, d)
    return plus(x, R.cross_features(x))


_flags = ["IsNight", "IsWeekend", "ProviderId", "ProductCategory", "IsMonthEnd", "IsMonthStart"]
_clock = ["DayOfWeek", "ProviderId", "ProductCategory", "Hour"]
TEMPORAL = [("DayOfWeek", "Hour"), *combinations(_flags, 3), *combinations(_clock, 3),
            *[g for n in (_flags, [*_clock, "IsMonthEnd"]) for g in combinations(n, 2)
              if g != ("ProviderId", "ProductCategory")]]


@query("temporal_identity_crosses", f"WITH {CAL} SELECT TRANSACTION_ID, {_cross_sql(TEMPORAL)} FROM cal")
def _(spark, d):
    x = cal(spark, d)
    return plus(x, R.temporal_identity_crosses(x))


NIGHT = [(f, c) for f in ("IsNight", "IsWeekend") for c in DEFAULT.categoricals]


@query("night_weekend_crosses", f"WITH {CAL} SELECT TRANSACTION_ID, {_cross_sql(NIGHT)} FROM cal")
def _(spark, d):
    x = cal(spark, d)
    return plus(x, R.night_weekend_crosses(x))


@query("cyclical_sincos", f"WITH {CAL} SELECT TRANSACTION_ID, " + ", ".join(
    f"{s6(f'{fn}({c} * (2*pi()/{m}))')} AS {c}_{fn}" for c, m in R.CYCLES.items() for fn in ("sin", "cos")) + " FROM cal")
def _(spark, d):
    x = cal(spark, d)
    return plus(x, R.cyclical_sincos(x))


def _spline_sql(c: str) -> str:
    out = []
    for j in range(5):
        u = f"(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 5.0))"
        v = f"((({u} - {j}) % 5.0 + 5.0) % 5.0)"
        a = f"abs({v} - 2)"
        out.append(s6(f"CASE WHEN {a} < 1 THEN (4 - 6*{a}*{a} + 3*{a}*{a}*{a})/6 WHEN {a} < 2 THEN (2-{a})*(2-{a})*(2-{a})/6 "
                      "ELSE 0.0 END") + f" AS {c}_spline_{j}")
    return ", ".join(out)


@query("periodic_spline", f"""WITH {CAL}, lim AS (SELECT min(Hour) AS lo_Hour, max(Hour) AS hi_Hour, min(DayOfMonth) AS lo_DayOfMonth,
 max(DayOfMonth) AS hi_DayOfMonth FROM cal) SELECT TRANSACTION_ID, {_spline_sql('Hour')}, {_spline_sql('DayOfMonth')} FROM cal, lim""")
def _(spark, d):
    x = cal(spark, d)
    return plus(x, R.periodic_spline(x, ["Hour", "DayOfMonth"]))


@query("debit_and_ratio", f"""WITH {TX} SELECT TRANSACTION_ID, CAST(TX_AMOUNT < 0 AS INT) AS IsDebit,
 {s6("CASE WHEN Value = 0 THEN 0 ELSE TX_AMOUNT / Value END")} AS AmountValueRatio FROM tx""")
def _(spark, d):
    x = tx(spark, d)
    return plus(x, R.debit_and_ratio(x))


@query("finalise_features", f"""WITH {TX}, r AS (SELECT TRANSACTION_ID, CASE WHEN Value = 0 THEN NULL ELSE TX_FRAUD / Value END AS q FROM tx)
 SELECT TRANSACTION_ID, {s6("coalesce(q, 0)")} AS rate FROM r""")
def _(spark, d):
    inf = F.lit(float("inf"))
    x = tx(spark, d).select(ID, F.coalesce(F.try_divide(F.col("TX_FRAUD").cast("double"), "Value"), inf).alias("rate"), F.lit(1).alias("helper"))
    return rounded(R.finalise_features(x, ["helper"]))


@query("missing_counts", "SELECT 'doc_id' AS \"column\", count(*) - count(doc_id) AS missing FROM d0 UNION ALL SELECT 'quality', "
       "count(*) - count(quality) FROM d0 UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM d0 UNION ALL SELECT 'lang', "
       "count(*) - count(lang) FROM d0".replace("d0", "(SELECT d.doc_id, quality, toxic, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"))
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return R.missing_counts(x)


@query("drop_columns", f"WITH {TX} SELECT TRANSACTION_ID, TX_AMOUNT, Value FROM tx")
def _(spark, d):
    x = tx(spark, d).select(ID, "TX_AMOUNT", "Value", "CurrencyCode", "CountryCode")
    return R.drop_columns(x, ["CurrencyCode", "CountryCode"])


@query("drop_constant", f"WITH {TX} SELECT TRANSACTION_ID, AccountId, ProductCategory, ChannelId FROM tx")
def _(spark, d):
    return R.drop_constant(tx(spark, d).select(ID, ACC, "ProductCategory", "ChannelId", "CurrencyCode", "CountryCode"))


@query("drop_duplicate_columns", f"WITH {TX} SELECT TRANSACTION_ID, TX_AMOUNT, Value FROM tx")
def _(spark, d):
    return R.drop_duplicate_columns(tx(spark, d).select(ID, "TX_AMOUNT", "Value", F.col("Value").alias("Value2"), F.col(ID).alias("Id2")))


@query("vector_to_columns", "SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE) + 1.3e-8, 6) AS to_df_{i}" for i in range(64)) + " FROM embeddings")
def _(spark, d):
    return rounded(R.to_frame(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 64))


@query("feature_union", f"""WITH {CAL} SELECT TRANSACTION_ID, Hour, DayOfWeek, DayOfMonth, IsWeekend, IsNight, IsMonthEnd, IsMonthStart,
 CAST(TX_AMOUNT < 0 AS INT) AS IsDebit, {s6("CASE WHEN Value = 0 THEN 0 ELSE TX_AMOUNT / Value END")} AS AmountValueRatio FROM cal""")
def _(spark, d):
    x = tx(spark, d)
    return plus(x, R.feature_union(x, R.calendar_features, R.debit_and_ratio))


@query("transform_hooks", f"WITH {TX} SELECT TRANSACTION_ID, {s6('abs(TX_AMOUNT)')} AS magnitude FROM tx WHERE Value > 10")
def _(spark, d):
    return rounded(R.apply_hooks(tx(spark, d), lambda x: x.where("Value > 10"), None,
                                 lambda x: x.select(ID, F.abs("TX_AMOUNT").alias("magnitude"))))


@query("route_columns")
def _(spark, d):
    x = tx(spark, d)
    routes = R.route_columns(x, [ACC, "CUSTOMER_ID"], [ID], onehot_threshold=10)
    return spark.createDataFrame([(k, c) for k, v in routes.items() for c in v], "route string, column string")


# ------------------------------------------------------------------ windows

KEYS = (ACC, "CUSTOMER_ID", "CustomerUID")


def over(key: str, frame: str = "") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY us, TRANSACTION_ID {frame})"


def rng(key: str, width: int, lag: int = 0) -> str:
    end = f"{lag} PRECEDING" if lag else "CURRENT ROW"
    return f"OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {width + lag - 1} PRECEDING AND {end})"


def both(name: str, sql: str, fn):
    """The query on native frames, and with keys above 60 rows forced through the sliced route."""
    query(name, sql)(lambda spark, d: fn(spark, d, None))
    query(f"{name}_hot_keys", sql)(lambda spark, d: fn(spark, d, 60))


def since(key: str) -> str:
    return f"coalesce((us - lag(us) {over(key)}) / 60000000.0, 0)"


query("time_since_last", f"WITH {TX} SELECT TRANSACTION_ID, " + ", ".join(
    f"{s6(since(k))} AS {k}_TimeSinceLast" for k in KEYS) + " FROM tx")(
    lambda spark, d: plus(tx(spark, d), W.time_since_last(W.time_since_last(W.time_since_last(tx(spark, d), KEYS[0]), KEYS[1]), KEYS[2])))
both("time_since_last_account", f"WITH {TX} SELECT TRANSACTION_ID, {s6(since(ACC))} AS AccountId_TimeSinceLast FROM tx",
     lambda spark, d, h: plus(tx(spark, d), W.time_since_last(tx(spark, d), ACC, hot_rows=h)))

COUNTS = (6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US)
both("rolling_count", f"WITH {TX} SELECT TRANSACTION_ID, " + ", ".join(
    f"count(*) {rng(ACC, w)} AS {ACC}_Count_{W.label_us(w)}" for w in COUNTS) + " FROM tx",
    lambda spark, d, h: plus(tx(spark, d), W.rolling_count(tx(spark, d), ACC, COUNTS, hot_rows=h)))
both("rolling_mean", f"WITH {TX} SELECT TRANSACTION_ID, " + ", ".join(
    f"{s6(f'avg(TX_AMOUNT) {rng(ACC, n * DAY_US)}')} AS {ACC}_Mean_{n}d" for n in (1, 7, 30)) + " FROM tx",
    lambda spark, d, h: plus(tx(spark, d), W.rolling_mean(tx(spark, d), ACC, hot_rows=h)))


def _drift(v: str, n: int) -> str:
    o = rng(ACC, n * DAY_US)
    m, s = f"avg({v}) {o}", f"coalesce(nullif(stddev_samp({v}) {o}, 0), 1)"
    return (f"{s6(f'CASE WHEN {m} = 0 THEN 0 ELSE {v} / ({m}) END')} AS {ACC}_{v}_RatioToMean_{n}d, "
            f"{s6(f'({v} - {m}) / {s}')} AS {ACC}_{v}_Z_{n}d")


for _v in ("Value", "TX_AMOUNT"):
    both(f"behavioral_drift_{_v.lower()}", f"WITH {TX} SELECT TRANSACTION_ID, {_drift(_v, 7)}, {_drift(_v, 30)} FROM tx",
         lambda spark, d, h, v=_v: plus(tx(spark, d), W.behavioral_drift(tx(spark, d), ACC, v, hot_rows=h)))

_mov = f"avg(TX_AMOUNT) {over(ACC, 'ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')}"
_all = f"avg(TX_AMOUNT) OVER (PARTITION BY {ACC})"
both("moving_average", f"""WITH {TX} SELECT TRANSACTION_ID, {s6(_mov)} AS {ACC}_MovingAvg_5, {s6(_all)} AS {ACC}_LongTermAvg,
 {s6(f'({_mov} - {_all}) / ({_all})')} AS {ACC}_PctChangeFromAvg FROM tx""",
     lambda spark, d, h: plus(tx(spark, d), W.moving_average(tx(spark, d), ACC, hot_rows=h)))

both("cumulative", f"""WITH {TX}, g AS (SELECT *, coalesce(us - lag(us) {over(ACC)}, 0) AS gap FROM tx)
 SELECT TRANSACTION_ID, {s6(f"sum(TX_AMOUNT) {over(ACC, 'ROWS UNBOUNDED PRECEDING')}")} AS {ACC}_CumAmount,
 {s6(f"sum(Value) {over(ACC, 'ROWS UNBOUNDED PRECEDING')}")} AS {ACC}_CumValue,
 {s6(f"CAST(sum(gap) {over(ACC, 'ROWS UNBOUNDED PRECEDING')} AS DOUBLE) / 3600000000.0")} AS {ACC}_CumHours FROM g""",
     lambda spark, d, h: plus(tx(spark, d), W.cumulative(tx(spark, d), ACC, hot_rows=h)))

both("delta_to_last", f"""WITH {TX} SELECT TRANSACTION_ID, {s6(f'coalesce(TX_AMOUNT - lag(TX_AMOUNT) {over(ACC)}, 0)')} AS {ACC}_AmountDelta,
 {s6(f'coalesce(Value - lag(Value) {over(ACC)}, 0)')} AS {ACC}_ValueDelta FROM tx""",
     lambda spark, d, h: plus(tx(spark, d), W.delta_to_last(tx(spark, d), ACC, hot_rows=h)))

SESS = TX + f""", gaps AS (SELECT *, coalesce(us - lag(us) {over(ACC)}, 0) > 43200000000 AS st FROM tx),
sess AS (SELECT *, CAST(sum(CAST(st AS INT)) {over(ACC, 'ROWS UNBOUNDED PRECEDING')} AS BIGINT) AS SessionId FROM gaps)"""
both("sessionize", f"WITH {SESS} SELECT TRANSACTION_ID, SessionId FROM sess",
     lambda spark, d, h: plus(tx(spark, d), W.sessionize(tx(spark, d), ACC, 720, hot_rows=h)))

both("spending_behaviour", f"WITH {TX} SELECT TRANSACTION_ID, " + ", ".join(
    f"count(*) {rng('CUSTOMER_ID', n * DAY_US)} AS CUSTOMER_ID_NB_TX_{n}d, "
    f"{s6(f'sum(TX_AMOUNT) {rng('CUSTOMER_ID', n * DAY_US)} / (count(*) {rng('CUSTOMER_ID', n * DAY_US)} + 1e-8)')} AS CUSTOMER_ID_AVG_AMOUNT_{n}d"
    for n in (1, 7, 30)) + " FROM tx",
    lambda spark, d, h: plus(tx(spark, d), W.spending_behaviour(tx(spark, d), "CUSTOMER_ID", hot_rows=h and 30)))


def _risk(n: int) -> str:
    o = rng(ACC, n * DAY_US, 3 * DAY_US)
    f, c = f"coalesce(sum(TX_FRAUD) {o}, 0)", f"count(*) {o}"
    return (f"{c} AS {ACC}_NB_TX_{n}d, CAST({f} AS BIGINT) AS {ACC}_NB_FRAUD_{n}d, "
            f"{s6(f'CASE WHEN {c} = 0 THEN 0 ELSE CAST({f} AS DOUBLE) / ({c}) END')} AS {ACC}_RISK_{n}d")


both("delayed_risk", f"WITH {TX} SELECT TRANSACTION_ID, {_risk(1)}, {_risk(7)}, {_risk(14)} FROM tx",
     lambda spark, d, h: plus(tx(spark, d), W.delayed_risk(tx(spark, d), ACC, 3, (1, 7, 14), hot_rows=h)))

CATS = ["click", "error", "purchase", "signup", "view"]


def _catstats(n: int) -> str:
    o = rng(ACC, n * DAY_US)
    c = {v: f"count(*) FILTER (ProductCategory = '{v}') {o}" for v in CATS}
    best = f"greatest({', '.join(c.values())})"
    mode = "CASE " + " ".join(f"WHEN {c[v]} = {best} THEN '{v}'" for v in CATS) + " END"
    return (f"count(*) {o} AS ProductCategory_Count_{n}d, CAST({' + '.join(f'CAST({c[v]} > 0 AS INT)' for v in CATS)} AS INT) AS ProductCategory_Distinct_{n}d, "
            f"{mode} AS ProductCategory_Mode_{n}d, " + ", ".join(f"{c[v]} AS ProductCategory_{v}_Count_{n}d" for v in CATS))


both("rolling_category_stats", f"WITH {TX} SELECT TRANSACTION_ID, {_catstats(1)}, {_catstats(7)} FROM tx",
     lambda spark, d, h: plus(tx(spark, d), W.rolling_category_stats(tx(spark, d), ACC, "ProductCategory", (DAY_US, 7 * DAY_US), hot_rows=h)))

query("fraud_cumsum", f"""WITH {TX} SELECT TRANSACTION_ID, CAST(sum(TX_FRAUD) OVER (ORDER BY us, TRANSACTION_ID ROWS UNBOUNDED PRECEDING) AS BIGINT)
 AS CumFrauds FROM tx""")(lambda spark, d: plus(tx(spark, d), W.fraud_cumsum(tx(spark, d))))

both("sequence_windows", f"""WITH {TX}, n AS (SELECT *, row_number() {over(ACC)} - 1 AS rn,
  list(TX_AMOUNT) {over(ACC, 'ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING')} AS l FROM tx)
 SELECT AccountId, rn // 5 AS SequenceId, rn AS StartRow, array_to_string(list_transform(l, lambda x: CAST(CAST(round(x*100) AS BIGINT) AS VARCHAR)), ',') AS cents
 FROM n WHERE rn % 5 = 0 AND len(l) = 10""",
     lambda spark, d, h: W.sequence_windows(tx(spark, d), ACC, ["TX_AMOUNT"], 10, 0.5, hot_rows=h).select(
         ACC, "SequenceId", "StartRow",
         F.array_join(F.transform("TX_AMOUNT", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("cents")))

both("padded_history", f"""WITH {TX}, n AS (SELECT *, list(Value) {over(ACC, 'ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS l FROM tx)
 SELECT TRANSACTION_ID, repeat('-100,', 5 - len(l)) || array_to_string(list_transform(l, lambda x: CAST(CAST(round(x*100) AS BIGINT) AS VARCHAR)), ',') AS cents FROM n""",
     lambda spark, d, h: W.padded_history(tx(spark, d), ACC, "Value", 5, hot_rows=h).select(
         ID, F.array_join(F.transform("History", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("cents")))

# customers with several orders at the same time: ties share a rolling value, the order id breaks the others
ORD = DEFAULT.with_names(id="o_orderkey", ts="o_orderdate", amount="o_totalprice", value="o_totalprice")
_o = "OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN {} PRECEDING AND CURRENT ROW)"
both("rolling_orders", f"""SELECT o_orderkey, count(*) {_o.format(90 * DAY_US - 1)} AS n90, {s6(f'avg(o_totalprice) {_o.format(365 * DAY_US - 1)}')} AS m365,
 {s6(f'coalesce(stddev_samp(o_totalprice) {_o.format(365 * DAY_US - 1)}, -1)')} AS s365,
 {s6('coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate), o_orderkey), 0)')} AS delta FROM orders""",
     lambda spark, d, h: rounded(W.over_key(table(spark, d, "orders"), "o_custkey", [
         W.Rolling("n90", "count", 90 * DAY_US), W.Rolling("m365", "avg", 365 * DAY_US, "o_totalprice"),
         W.Rolling("s", "std", 365 * DAY_US, "o_totalprice"), W.Prev("p", "o_totalprice")], ORD, hot_rows=h and 11).select(
         "o_orderkey", "n90", "m365", F.coalesce("s", F.lit(-1.0)).alias("s365"),
         F.coalesce(F.col("o_totalprice") - F.col("p"), F.lit(0.0)).alias("delta"))))


# ------------------------------------------------------------------ group statistics

def _stats(k: str, v: str) -> str:
    m, s = f"avg({v}) OVER (PARTITION BY {k})", f"coalesce(nullif(stddev_samp({v}) OVER (PARTITION BY {k}), 0), 1)"
    return (f"{s6(m)} AS {k}_{v}_Mean, {s6(s)} AS {k}_{v}_Std, {s6(f'({v} - {m}) / {s}')} AS {k}_{v}_Z, "
            f"{s6(f'CASE WHEN {m} = 0 THEN 0 ELSE {v} / ({m}) END')} AS {k}_{v}_Ratio")


for _k in KEYS:
    query(f"entity_amount_stats_{_k.lower()}", f"WITH {TX} SELECT TRANSACTION_ID, {_stats(_k, 'TX_AMOUNT')}, {_stats(_k, 'Value')} FROM tx")(
        lambda spark, d, k=_k: plus(tx(spark, d), A.entity_amount_stats(tx(spark, d), k)))

for _c in ("ProductCategory", "ProductId", "ProviderId", "ChannelId"):
    query(f"target_rate_{_c.lower()}", f"WITH {TX} SELECT {_c}, {s6('avg(TX_FRAUD)')} AS {_c}_FraudRate FROM tx GROUP BY 1")(
        lambda spark, d, c=_c: rounded(A.target_rate(tx(spark, d), c)))

query("lookup_with_fallback", f"""WITH {TX}, r AS (SELECT ProductId, avg(TX_FRAUD) AS rate FROM tx WHERE ProductId <> 'PR3' AND ProductId <> 'PR7' GROUP BY 1)
 SELECT TRANSACTION_ID, {s6('coalesce(rate, avg(rate) OVER ())')} AS ProductId_FraudRate FROM tx LEFT JOIN r USING (ProductId)""")(
    lambda spark, d: plus(tx(spark, d), A.lookup_with_fallback(
        tx(spark, d), A.target_rate(tx(spark, d).where("ProductId NOT IN ('PR3', 'PR7')"), "ProductId"), "ProductId")))

for _k in (ACC, "CustomerUID"):
    query(f"daily_count_{_k.lower()}", f"""WITH {TX} SELECT TRANSACTION_ID, count(*) OVER (PARTITION BY {_k}, CAST(TX_DATETIME AS DATE))
 AS Daily_{_k}_TxnCount FROM tx""")(lambda spark, d, k=_k: plus(tx(spark, d), A.daily_count(tx(spark, d), k)))

BATCH = f"""b AS (SELECT BatchId, count(*) AS n, min(us) AS st FROM tx GROUP BY 1),
 g AS (SELECT BatchId, n AS TxnPerBatch, {s6('coalesce((st - lag(st) OVER (ORDER BY st, BatchId)) / 60000000.0, 0)')} AS TimeBetweenBatches FROM b)"""
query("batch_gap", f"WITH {TX}, {BATCH} SELECT * FROM g")(lambda spark, d: rounded(A.batch_table(tx(spark, d))))
query("batch_features", f"WITH {TX}, {BATCH} SELECT TRANSACTION_ID, TxnPerBatch, TimeBetweenBatches FROM tx LEFT JOIN g USING (BatchId)")(
    lambda spark, d: plus(tx(spark, d), A.batch_features(tx(spark, d))))


def _mode(c: str, keys: str) -> str:
    return f"(SELECT {keys}, {c} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {c}) AS r FROM sess GROUP BY {keys}, {c})"


@query("session_stats", f"""WITH {SESS}, s AS (SELECT AccountId, SessionId, count(*) AS SessionTxnCount, {s6('sum(TX_AMOUNT)')} AS SessionAmt,
 {s6('avg(TX_AMOUNT)')} AS SessionAmtMean, {s6('stddev_samp(TX_AMOUNT)')} AS SessionAmtStd, {s6('sum(Value)')} AS SessionValue,
 {s6('avg(Value)')} AS SessionValueMean, {s6('stddev_samp(Value)')} AS SessionValueStd,
 {s6('(max(us) - min(us)) / 60000000.0')} AS SessionDuration FROM sess GROUP BY 1, 2)
 SELECT s.*, """ + ", ".join(f"m{i}.v AS {n}" for i, n in enumerate(A.SESSION_MODES)) + " FROM s " + " ".join(
    f"JOIN {_mode(getattr(DEFAULT, role), 'AccountId, SessionId')} m{i} ON m{i}.AccountId = s.AccountId AND m{i}.SessionId = s.SessionId AND m{i}.r = 1"
    for i, role in enumerate(A.SESSION_MODES.values())))
def _(spark, d):
    return rounded(A.session_stats(W.sessionize(tx(spark, d), ACC, 720), ACC))


PROFILE_MODES = ("Hour", "DayOfWeek", "DayOfMonth")


@query("client_profile", f"""WITH {CAL}, p AS (SELECT CustomerUID, {s6('avg(TX_AMOUNT)')} AS cluster_TX_AMOUNT, {s6('avg(Value)')} AS cluster_Value,
 {s6('avg(IsNight)')} AS "cluster_IsNight" FROM cal GROUP BY 1)
 SELECT p.*, """ + ", ".join(f"t{i}.v AS cluster_{c}" for i, c in enumerate(PROFILE_MODES)) + ", " + ", ".join(
    f"m{i}.v AS cluster_{c}" for i, c in enumerate(DEFAULT.categoricals)) + " FROM p " + " ".join(
    f"JOIN (SELECT CustomerUID, {s6('avg(v)')} AS v FROM (SELECT CustomerUID, {c} AS v, rank() OVER (PARTITION BY CustomerUID ORDER BY count(*) DESC) AS r "
    f"FROM cal GROUP BY 1, 2) WHERE r = 1 GROUP BY 1) t{i} ON t{i}.CustomerUID = p.CustomerUID" for i, c in enumerate(PROFILE_MODES)) + " " + " ".join(
    f"JOIN {_mode(c, 'CustomerUID').replace('sess', 'cal')} m{i} ON m{i}.CustomerUID = p.CustomerUID AND m{i}.r = 1" for i, c in enumerate(DEFAULT.categoricals)))
def _(spark, d):
    return rounded(A.client_profile(cal(spark, d), "CustomerUID", ["TX_AMOUNT", "Value", "IsNight"]))


query("client_value_counts", f"WITH {TX} SELECT CustomerUID, " + ", ".join(
    f"count(*) FILTER ({c} = '{v}') AS {c}_perClient_{v}" for c, vs in (("ProductCategory", CATS), ("ChannelId", ["CH0", "CH1", "CH2", "CH3"])) for v in vs)
      + " FROM tx GROUP BY 1")(lambda spark, d: A.client_value_counts(tx(spark, d), "CustomerUID", ["ProductCategory", "ChannelId"]))
query("unpivot_counts", f"""WITH {TX} SELECT CustomerUID, 'ChannelId' AS "column", ChannelId AS value, count(*) AS counts FROM tx GROUP BY 1, 3
 UNION ALL SELECT CustomerUID, 'ProviderId', ProviderId, count(*) FROM tx GROUP BY 1, 3""")(
    lambda spark, d: A.unpivot_counts(tx(spark, d), "CustomerUID", ["ChannelId", "ProviderId"]))


# ------------------------------------------------------------------ series

DAILY = TX + """, ds AS (SELECT AccountId, CAST(TX_DATETIME AS DATE) AS day, sum(TX_AMOUNT) AS y FROM tx GROUP BY 1, 2),
 sp AS (SELECT AccountId, min(day) AS a, max(day) AS b FROM ds GROUP BY 1),
 grid AS (SELECT AccountId, a, b, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM sp),
 daily AS (SELECT g.AccountId, g.day, CAST(g.day - g.a AS INT) AS i, CAST(g.b - g.a + 1 AS INT) AS n, coalesce(ds.y, 0) AS y
  FROM grid g LEFT JOIN ds ON ds.AccountId = g.AccountId AND ds.day = g.day)"""
query("resample_daily", f"WITH {DAILY} SELECT AccountId, strftime(day, '%Y-%m-%d') AS day, i, n, {s6('y')} AS TX_AMOUNT FROM daily")(
    lambda spark, d: rounded(S.resample_daily(tx(spark, d), ACC, ["TX_AMOUNT"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))))
query("seasonal_features", f"""WITH {DAILY}, t AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN avg(y) OVER (PARTITION BY AccountId ORDER BY i
  ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend FROM daily WHERE n >= 14),
 p AS (SELECT AccountId, i % 7 AS ph, avg(y - trend) AS p FROM t GROUP BY 1, 2),
 c AS (SELECT AccountId, avg(p) AS centre, max(p) - min(p) AS amp FROM p GROUP BY 1)
 SELECT t.AccountId, {s6('regr_slope(trend, i)')} AS trend_slope, {s6('any_value(amp)')} AS seasonal_amplitude,
 {s6('var_pop(y - trend - (p.p - centre))')} AS residual_variance FROM t JOIN p ON p.AccountId = t.AccountId AND p.ph = t.i % 7
 JOIN c ON c.AccountId = t.AccountId GROUP BY 1""")(lambda spark, d: rounded(S.seasonal_table(tx(spark, d), ACC)))
query("fft_features", f"WITH {DAILY} SELECT AccountId, " + ", ".join(
    s6(f"sqrt(sum(y*cos(2*pi()*{k}*i/n))*sum(y*cos(2*pi()*{k}*i/n)) + sum(y*sin(2*pi()*{k}*i/n))*sum(y*sin(2*pi()*{k}*i/n)))") + f" AS TX_AMOUNT_fft_freq_{k}"
    for k in range(1, 6)) + " FROM daily WHERE n >= 10 GROUP BY 1")(
    lambda spark, d: rounded(S.fft_table(tx(spark, d), ACC, ["TX_AMOUNT"])))


def _ls(i: int, f: float) -> str:
    return f"""SELECT AccountId, {i} AS i, count(*) AS n, avg(y) AS Y_, avg(c) AS C_, avg(s) AS S_, avg(y*y) AS y2, avg(y*c) AS yc, avg(y*s) AS ys,
 avg(c*c) AS cc, avg(s*s) AS ss, avg(c*s) AS cs FROM (SELECT AccountId, TX_AMOUNT AS y, cos((us/3600000000.0)*{f!r}*(2*pi())) AS c,
 sin((us/3600000000.0)*{f!r}*(2*pi())) AS s FROM tx) GROUP BY 1"""


query("lomb_scargle", f"WITH {TX}, m AS (" + " UNION ALL ".join(
    _ls(i, f) for i, f in enumerate(S.lomb_scargle_frequencies(24.0, 168.0, 4))) + """),
 q AS (SELECT AccountId, i, n, y2-Y_*Y_ AS YY, yc-Y_*C_ AS YC_, ys-Y_*S_ AS YS_, cc-C_*C_ AS CC_, ss-S_*S_ AS SS_, cs-C_*S_ AS CS_ FROM m),
 p AS (SELECT AccountId, i, CASE WHEN n >= 3 AND YY > 1e-12 AND CC_*SS_-CS_*CS_ > 1e-12 THEN
  (SS_*YC_*YC_ + CC_*YS_*YS_ - 2*CS_*YC_*YS_)/(YY*(CC_*SS_-CS_*CS_)) ELSE 0.0 END AS p FROM q)
 SELECT AccountId, """ + ", ".join(f"round(max(p) FILTER (i = {i}) + 1.3e-8, 4) AS TX_AMOUNT_LombScargle_{i}" for i in range(4)) + " FROM p GROUP BY 1")(
    lambda spark, d: (lambda t: t.select(ACC, *[F.round(F.col(c) + 1.3e-8, 4).alias(c) for c in t.columns[1:]]))(
        S.lomb_scargle(tx(spark, d), ACC, n_freqs=4)))


# ------------------------------------------------------------------ table reports

@query("daily_fraud_stats", f"""WITH {TX} SELECT TX_TIME_DAYS, count(*) AS nb_tx_per_day, CAST(sum(TX_FRAUD) AS BIGINT) AS nb_fraudulent_transactions_per_day,
 count(DISTINCT CASE WHEN TX_FRAUD = 1 THEN CUSTOMER_ID END) AS nb_compromised_cards_per_day,
 strftime(DATE '2024-01-01' + TX_TIME_DAYS, '%Y-%m-%d') AS tx_date FROM tx GROUP BY TX_TIME_DAYS""")
def _(spark, d):
    return A.daily_fraud_stats(txd(spark, d), "2024-01-01").withColumn("tx_date", F.date_format("tx_date", "yyyy-MM-dd"))


def _q(c: str, y: int, stat: str) -> str:
    f = {"count": "CAST(count(*) AS DOUBLE)", "mean": f"avg({c})", "std": f"stddev_samp({c})", "min": f"min({c})", "max": f"max({c})",
         "25%": f"quantile_cont({c}, 0.25)", "50%": f"quantile_cont({c}, 0.5)", "75%": f"quantile_cont({c}, 0.75)"}[stat]
    return f"(SELECT {f} FROM tx WHERE TX_FRAUD = {y})"


query("describe_by_class", f"WITH {TX}, q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{s}' AS stat, {_q(c, 1, s)} AS fraud, {_q(c, 0, s)} AS genuine" for c in ("TX_AMOUNT", "Value") for s in A.STATS)
      + f") SELECT \"column\", stat, {s6('fraud')} AS fraud, {s6('genuine')} AS genuine, {s6('CASE WHEN genuine = 0 THEN NULL ELSE fraud / genuine END')} AS ratio FROM q")(
    lambda spark, d: rounded(A.describe_by_class(tx(spark, d), ["TX_AMOUNT", "Value"])))

query("exact_quantiles", "WITH q AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p} AS q, quantile_cont({c}, {p}) AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")
    for p in (0.01, 0.25, 0.5, 0.9, 0.999)) + f") SELECT \"column\", CAST(q AS DOUBLE) AS q, {s6('v')} AS value FROM q")(
    lambda spark, d: exact_quantiles(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], [0.01, 0.25, 0.5, 0.9, 0.999])
    .withColumn("value", F.round(F.col("value") + 1.3e-8, 6)))

query("cardinality_report", f"WITH {TX} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, {s6(f'count(DISTINCT {c}) / count(*)')} AS unique_ratio FROM tx"
    for c in (ACC, "BatchId", "ProductId", "CurrencyCode")))(
    lambda spark, d: rounded(A.cardinality_report(tx(spark, d), [ACC, "BatchId", "ProductId", "CurrencyCode"])))
query("functional_dependency", "SELECT count(*) AS groups, count(*) FILTER (n > 1) AS violations FROM "
      "(SELECT n_regionkey, count(DISTINCT n_name) AS n FROM nation GROUP BY 1)")(
    lambda spark, d: A.functional_dependency(table(spark, d, "nation"), ["n_regionkey"], "n_name"))


def _cramers(a: str, b: str, yates: bool) -> str:
    chi = ("sum((abs(coalesce(o,0) - r*c/n) - least(0.5, abs(coalesce(o,0) - r*c/n))) ** 2 / (r*c/n))" if yates
           else "sum((coalesce(o,0) - r*c/n) ** 2 / (r*c/n))")
    return f"""SELECT '{a}' AS x, '{b}' AS y, {chi} AS chi2, any_value(n) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k
 FROM (SELECT {a} AS a, count(*) AS r FROM tx GROUP BY 1) ra, (SELECT {b} AS b, count(*) AS c FROM tx GROUP BY 1) rb, (SELECT count(*)::DOUBLE AS n FROM tx) nn
 LEFT JOIN (SELECT {a} AS a2, {b} AS b2, count(*) AS o FROM tx GROUP BY 1, 2) oo ON a2 = a AND b2 = b"""


_pairs = [("ProductCategory", "ChannelId", False), ("ProductCategory", "TX_FRAUD", False), ("ChannelId", "TX_FRAUD", False)]
query("cramers_matrix", f"WITH {TX}, s AS (" + " UNION ALL ".join(_cramers(*p) for p in _pairs) + f"""),
 v AS (SELECT x, y, chi2, greatest(0, chi2/n - (k-1)*(r-1)/(n-1)) AS phi, r - (r-1)*(r-1)/(n-1) AS rc, k - (k-1)*(k-1)/(n-1) AS kc FROM s)
 SELECT x, y, {s6('chi2')} AS chi2, {s6('sqrt(phi / least(kc-1, rc-1))')} AS cramers_v FROM v""")(
    lambda spark, d: rounded(A.cramers_matrix(tx(spark, d), ["ProductCategory", "ChannelId", "TX_FRAUD"])))
query("cramers_two_by_two", f"WITH {CAL.replace('tx AS', 'tx0 AS').replace('FROM tx)', 'FROM tx0)')}, tx AS (SELECT * FROM cal), s AS ("
      + _cramers("IsNight", "TX_FRAUD", True) + f"""), v AS (SELECT x, y, chi2, greatest(0, chi2/n - (k-1)*(r-1)/(n-1)) AS phi,
 r - (r-1)*(r-1)/(n-1) AS rc, k - (k-1)*(k-1)/(n-1) AS kc FROM s) SELECT x, y, {s6('chi2')} AS chi2, {s6('sqrt(phi / least(kc-1, rc-1))')} AS cramers_v FROM v""")(
    lambda spark, d: rounded(A.cramers_v(cal(spark, d), [("IsNight", "TX_FRAUD")])))

query("class_balance", f"""WITH {TX}, c AS (SELECT CUSTOMER_ID, max(TX_FRAUD) AS f, max(1 - TX_FRAUD) AS g, count(*) AS n, sum(TX_FRAUD) AS p FROM tx GROUP BY 1)
 SELECT CAST(sum(n) AS BIGINT) AS n_tx, CAST(sum(p) AS BIGINT) AS n_fraud, {s6('sum(p) / sum(n)')} AS fraud_ratio, CAST(sum(f) AS BIGINT) AS fraud_customers,
 CAST(sum(g) AS BIGINT) AS genuine_customers, CAST(sum(f*g) AS BIGINT) AS common_customers FROM c""")(lambda spark, d: rounded(A.class_balance(tx(spark, d))))
query("time_coverage", f"WITH {TX} SELECT min(us) AS first_us, max(us) AS last_us, {s6('(max(us) - min(us)) / 86400000000.0')} AS days FROM tx")(
    lambda spark, d: rounded(A.time_coverage(tx(spark, d))))
query("mean_tx_per_day", f"WITH {TX} SELECT {s6('avg(n)')} AS mean_tx_per_day FROM (SELECT CAST(TX_DATETIME AS DATE) AS d, count(*) AS n FROM tx GROUP BY 1)")(
    lambda spark, d: rounded(A.mean_tx_per_day(tx(spark, d))))

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {s6(f'corr({a}, {b})')} AS corr FROM lineitem" for a, b in combinations(NUM, 2)))(
    lambda spark, d: rounded(A.correlation_matrix(table(spark, d, "lineitem"), NUM)))
_rank = "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in NUM[:3]) + " FROM lineitem)"
query("correlation_spearman", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {s6(f'corr({a}, {b})')} AS corr FROM {_rank}" for a, b in combinations(NUM[:3], 2)))(
    lambda spark, d: rounded(A.correlation_matrix(table(spark, d, "lineitem"), NUM[:3], "spearman")))

query("histogram", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(least(greatest(floor(({c} - lo) * 20 / (hi - lo)) + 1, 1), 20) AS INT) AS bin,
 {s6('any_value(lo) + (bin - 1) * ((any_value(hi) - any_value(lo)) / 20)')} AS low, {s6('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 20)')} AS high, count(*) AS n
 FROM orders, (SELECT min({c}) AS lo, max({c}) AS hi FROM orders) GROUP BY bin""" for c in ("o_totalprice",)))(
    lambda spark, d: rounded(A.histogram(table(spark, d, "orders"), ["o_totalprice"])))
query("column_statistics", "WITH q AS (" + " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS \"column\", '{s}' AS stat, {e} AS v FROM orders" for s, e in {
        "count": "CAST(count(*) AS DOUBLE)", "mean": "avg(o_totalprice)", "std": "stddev_samp(o_totalprice)", "min": "min(o_totalprice)",
        "25%": "quantile_cont(o_totalprice, 0.25)", "50%": "quantile_cont(o_totalprice, 0.5)", "75%": "quantile_cont(o_totalprice, 0.75)",
        "max": "max(o_totalprice)"}.items()) + f") SELECT \"column\", stat, {s6('v')} AS value FROM q")(
    lambda spark, d: rounded(A.describe(table(spark, d, "orders"), ["o_totalprice"])))
query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_unique FROM customer"
    for c, t in (("c_custkey", "bigint"), ("c_nationkey", "int"), ("c_mktsegment", "string"), ("c_acctbal", "double"))))(
    lambda spark, d: A.column_profile(table(spark, d, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"]))
