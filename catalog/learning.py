"""Queries on encoders, scalers, selection, outlier scores, resampling, models, search and streaming."""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import CAL, SCORED, TX, cal, query, r6, rounded, s6, scored, table, tx, txd, u32, unit
from txrisk.functions.scale import attach, hash_unit, keep, shared_folder
from txrisk.operators import encoders as E, impute as I, metrics as V, models as M, outliers as O, resample as X, selection as S, sparse as Z
from txrisk.functions.rows import calendar_features
from txrisk.operators.aggregates import client_profile
from txrisk.operators.neighbor_information import neighbor_information
from txrisk.schema import DAY_US, DEFAULT

ID = "TRANSACTION_ID"
CATS = ["ProductCategory", "ProductId", "BatchId"]
TRAIN = TX + ", tr AS (SELECT * FROM tx WHERE TX_TIME_DAYS < 20)"


def split(spark, d):
    x = txd(spark, d)
    return x.where("TX_TIME_DAYS < 20"), x


def encoded(df, names):
    return rounded(df.select(ID, *names))


# ------------------------------------------------------------------ encoders

def _lookup_sql(value: str, suffix: str, unseen: str, extra: str = "") -> str:
    joins = " ".join(f"LEFT JOIN (SELECT {c} AS k{i}, {value} AS v{i} FROM tr{', pr' if extra else ''} GROUP BY {c}) t{i} ON k{i} = {c}" for i, c in enumerate(CATS))
    return (f"WITH {TRAIN}{extra} SELECT TRANSACTION_ID, " + ", ".join(f"{s6(f'coalesce(v{i}, {unseen})') if suffix != '_count' else f'coalesce(v{i}, {unseen})'} AS {c}{suffix}"
            for i, c in enumerate(CATS)) + f" FROM tx {joins}")


PRIOR = ", pr AS (SELECT avg(TX_FRAUD) AS pm, CAST(sum(TX_FRAUD) AS DOUBLE) AS P, CAST(count(*) AS DOUBLE) AS N FROM tr)"
_pm = "(SELECT pm FROM pr)"

query("count_encoder", _lookup_sql("count(*)", "_count", "0"))(
    lambda spark, d: (lambda tr, x: encoded(E.count_encoder(tr, CATS).transform(x), [f"{c}_count" for c in CATS]))(*split(spark, d)))
query("target_encoder", _lookup_sql(
    "CASE WHEN count(*) = 1 THEN any_value(pm) ELSE any_value(pm) * (1 - 1/(1+exp(-(count(*)-20)/10.0))) + avg(TX_FRAUD) * (1/(1+exp(-(count(*)-20)/10.0))) END",
    "_target", _pm, PRIOR))(
    lambda spark, d: (lambda tr, x: encoded(E.target_encoder(tr, CATS).transform(x), [f"{c}_target" for c in CATS]))(*split(spark, d)))
query("woe_encoder", _lookup_sql(
    "ln(((sum(TX_FRAUD)+1)/(any_value(P)+2)) / ((sum(1-TX_FRAUD)+1)/(any_value(N)-any_value(P)+2)))", "_woe", "0", PRIOR))(
    lambda spark, d: (lambda tr, x: encoded(E.woe_encoder(tr, CATS).transform(x), [f"{c}_woe" for c in CATS]))(*split(spark, d)))
_noise = f"sqrt(-2 * ln(greatest({unit('TRANSACTION_ID', '0ProductId_woea')}, 1e-12))) * cos({unit('TRANSACTION_ID', '0ProductId_woeb')} * 6.283185307179586)"
query("woe_encoder_noise", f"""WITH {TRAIN}{PRIOR}, t AS (SELECT ProductId AS k, ln(((sum(TX_FRAUD)+1)/(any_value(P)+2)) / ((sum(1-TX_FRAUD)+1)/(any_value(N)-any_value(P)+2))) AS v FROM tr, pr GROUP BY 1)
 SELECT TRANSACTION_ID, {s6(f'v * (1 + 0.05 * {_noise})')} AS ProductId_woe FROM tr JOIN t ON k = ProductId""")(lambda spark, d: (lambda tr, x: encoded(E.add_train_noise(
    E.woe_encoder(tr, ["ProductId"]).transform(tr), ["ProductId_woe"]), ["ProductId_woe"]))(*split(spark, d)))
query("ordered_encoder_scoring", _lookup_sql("(sum(TX_FRAUD) + any_value(pm)) / (count(*) + 1)", "_ordered", _pm, PRIOR))(
    lambda spark, d: (lambda tr, x: encoded(E.ordered_target_encoder(tr, CATS).transform(x), [f"{c}_ordered" for c in CATS]))(*split(spark, d)))
_ord = lambda c: (f"(coalesce(sum(TX_FRAUD) OVER (PARTITION BY {c} ORDER BY us, TRANSACTION_ID ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pm) / "
                  f"(row_number() OVER (PARTITION BY {c} ORDER BY us, TRANSACTION_ID))")
for _hot in (None, 500):
    query("ordered_encoder_training" + ("_hot_keys" if _hot else ""), f"WITH {TRAIN}{PRIOR} SELECT TRANSACTION_ID, " + ", ".join(
        f"{s6(_ord(c))} AS {c}_ordered" for c in CATS) + " FROM tr, pr")(
        lambda spark, d, h=_hot: (lambda tr, x: encoded(E.ordered_target_encoder(tr, CATS).transform_train(tr, h), [f"{c}_ordered" for c in CATS]))(*split(spark, d)))


def _base_sql(base: int, digits: dict[str, int]) -> str:
    joins = " ".join(f"LEFT JOIN (SELECT {c} AS k{i}, row_number() OVER (ORDER BY min(us)) AS o{i} FROM tr GROUP BY {c}) t{i} ON k{i} = {c}" for i, c in enumerate(digits))
    cols = ", ".join(f"CAST((coalesce(o{i}, 0) // {base ** (n - 1 - j)}) % {base} AS INT) AS {c}_{j}" for i, (c, n) in enumerate(digits.items()) for j in range(n))
    return f"WITH {TRAIN} SELECT TRANSACTION_ID, {cols} FROM tx {joins}"


def _digits(enc, x):
    out = E.apply_encoders(x, enc)
    return out.select(ID, *[c for c in out.columns if c not in x.columns])


query("binary_encoder", _base_sql(2, {"ProductCategory": 3, "ProductId": 5}))(
    lambda spark, d: (lambda tr, x: _digits(E.binary_encoder(tr, ["ProductCategory", "ProductId"]), x))(*split(spark, d)))
query("base_n_encoder", _base_sql(4, {"ProductCategory": 2, "ProductId": 3}))(
    lambda spark, d: (lambda tr, x: _digits(E.base_n_encoder(tr, ["ProductCategory", "ProductId"], 4), x))(*split(spark, d)))


def _md5_mod_sql(c: str, n: int) -> str:
    r = "0"
    for i in range(4):
        r = f"(({r}) * {2 ** 32 % n} + CAST(('0x'||substr(md5({c}),{1 + 8 * i},8)) AS BIGINT)) % {n}"
    return r


query("hashing_encoder", f"WITH {TX} SELECT TRANSACTION_ID, " + ", ".join(
    "(" + " + ".join(f"CAST({_md5_mod_sql(c, 6)} = {j} AS INT)" for c in CATS) + f") AS hash_{j}" for j in range(6)) + " FROM tx")(
    lambda spark, d: encoded(E.hashing_encoder(tx(spark, d), CATS, 6), [f"hash_{j}" for j in range(6)]))

VALUES = ["click", "error", "purchase", "signup", "view"]
PRODUCTS = [f"PR{i}" for i in range(23)]
query("similarity_encoder_vectors", f"""WITH {TX}, v AS (SELECT 'PR' || (vec_id - 2) AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
 SELECT TRANSACTION_ID, """ + ", ".join(f"{s6(f'coalesce(list_cosine_similarity(a.e, b{i}.e), 0)')} AS ProductId_{v}" for i, v in enumerate(PRODUCTS))
      + " FROM tx LEFT JOIN v a ON a.c = ProductId " + " ".join(f"LEFT JOIN v b{i} ON b{i}.c = '{v}'" for i, v in enumerate(PRODUCTS)))(
    lambda spark, d: (lambda x, v: encoded(E.similarity_encoder(x, "ProductId", v).transform(x), [f"ProductId_{c}" for c in PRODUCTS]))(
        tx(spark, d), table(spark, d, "embeddings").select(F.concat(F.lit("PR"), (F.col("vec_id") - 2).cast("string")).alias("category"), F.col("embedding").alias("vector"))))
query("similarity_encoder_strings")(lambda spark, d: (lambda x: encoded(
    E.similarity_encoder(x, "ProductCategory").transform(x), [f"ProductCategory_{c}" for c in VALUES]))(tx(spark, d)))
query("one_hot", f"""WITH {TX} SELECT TRANSACTION_ID, """ + ", ".join(f"CAST(ProductCategory = '{v}' AS INT) AS ProductCategory_{v}" for v in VALUES)
      + " FROM tx")(lambda spark, d: (lambda x: encoded(E.one_hot(x, ["ProductCategory"]), [f"ProductCategory_{v}" for v in VALUES]))(tx(spark, d)))

# ------------------------------------------------------------------ sparse vectors over a dictionary of values

DICT = TX + """, dict AS (SELECT c AS "column", v AS category, row_number() OVER (PARTITION BY c ORDER BY substr(md5(v), 1, 3), v) - 1 AS number
 FROM (SELECT DISTINCT c, v FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM tx" for c in CATS) + ") WHERE v IS NOT NULL))"


def _spread(df, keys, vector, **more):
    """Entries of a vector column as rows."""
    return df.select(*keys, *[F.lit(v).alias(k) for k, v in more.items()], F.explode(Z.entries(vector)).alias("x")).select(*keys, *more, F.col("x.number").cast("long").alias("number"), F.col("x.value").alias("value"))


query("category_dictionary", f"WITH {DICT} SELECT * FROM dict")(lambda spark, d: Z.category_dictionary(tx(spark, d), CATS).table)


@query("one_hot_vectors", f"WITH {DICT} " + " UNION ALL ".join(
    f"SELECT TRANSACTION_ID, '{c}' AS name, number, 1.0::DOUBLE AS value FROM tx JOIN dict ON \"column\" = '{c}' AND category = {c}" for c in CATS))
def _(spark, d):
    x = tx(spark, d)
    out = Z.one_hot_vectors(x, CATS, Z.category_dictionary(x, CATS))
    return reduce(lambda a, b: a.unionByName(b), [_spread(out, [ID], f"{c}_OneHot", name=c) for c in CATS])


@query("client_count_vectors", f"WITH {DICT} " + " UNION ALL ".join(
    f"SELECT CustomerUID, '{c}' AS name, number, count(*)::DOUBLE AS value FROM tx JOIN dict ON \"column\" = '{c}' AND category = {c} GROUP BY ALL" for c in CATS))
def _(spark, d):
    x = tx(spark, d)
    out = Z.client_count_vectors(x, "CustomerUID", CATS, Z.category_dictionary(x, CATS))
    return reduce(lambda a, b: a.unionByName(b), [_spread(out, ["CustomerUID"], f"{c}_perClient", name=c) for c in CATS])


@query("rolling_category_vectors", f"WITH {DICT} " + " UNION ALL ".join(
    f"""SELECT a.TRANSACTION_ID, '{n}d' AS name, number, count(*)::DOUBLE AS value FROM tx a JOIN tx b ON a.AccountId = b.AccountId AND b.us > a.us - {n * DAY_US} AND b.us <= a.us
 JOIN dict ON "column" = 'BatchId' AND category = b.BatchId GROUP BY ALL""" for n in (1, 7)))
def _(spark, d):
    x = tx(spark, d)
    out = Z.rolling_category_vectors(x, "AccountId", "BatchId", Z.category_dictionary(x, ["BatchId"]), (DAY_US, 7 * DAY_US))
    return reduce(lambda a, b: a.unionByName(b), [_spread(out, [ID], f"BatchId_Counts_{n}d", name=f"{n}d") for n in (1, 7)])


@query("similarity_vectors", f"""WITH {DICT}, v AS (SELECT 'PR' || (vec_id - 2) AS c, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 pairs AS (SELECT a.c AS category, b.c AS other, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE b.c IN (SELECT ProductId FROM tx) AND a.c IN (SELECT ProductId FROM tx))
 SELECT TRANSACTION_ID, number, {s6('s')} AS value FROM tx JOIN pairs ON category = ProductId JOIN dict ON "column" = 'ProductId' AND dict.category = other WHERE s > 0.1""")
def _(spark, d):
    x = tx(spark, d)
    v = table(spark, d, "embeddings").select(F.concat(F.lit("PR"), (F.col("vec_id") - 2).cast("string")).alias("category"), F.col("embedding").alias("vector"))
    return rounded(_spread(Z.similarity_vectors(x, "ProductId", Z.category_dictionary(x, CATS), v, 0.1), [ID], "ProductId_Similarity"))

# ------------------------------------------------------------------ scalers and interactions

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LID = "l_orderkey"
_scale = lambda a, b: "SELECT l_orderkey, l_partkey, " + ", ".join(
    f"{s6(f'({c} - (SELECT {a.format(c)} FROM lineitem)) / (SELECT {b.format(c)} FROM lineitem)')} AS {c}" for c in LINE) + " FROM lineitem"


def _scaled(fn):
    return lambda spark, d: (lambda x: rounded(fn(x, LINE).transform(x).select("l_orderkey", "l_partkey", *LINE)))(table(spark, d, "lineitem"))


query("standard_scaler", _scale("avg({})", "stddev_pop({0})"))(_scaled(E.standard_scaler))
query("minmax_scaler", _scale("min({})", "max({0}) - min({0})"))(_scaled(E.minmax_scaler))
query("robust_scaler", _scale("median({})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"))(_scaled(E.robust_scaler))
query("interactions", "SELECT l_orderkey, l_partkey, " + ", ".join(
    f"{s6('*'.join(g))} AS \"{'*'.join(g)}\"" for n in (2, 3) for g in combinations(LINE[:3], n)) + " FROM lineitem")(
    lambda spark, d: (lambda x: rounded(E.interactions(x, LINE[:3], 3).select("l_orderkey", "l_partkey", *[
        F.col(f"`{'*'.join(g)}`") for n in (2, 3) for g in combinations(LINE[:3], n)])))(table(spark, d, "lineitem")))
query("encoded_interactions", f"WITH {TRAIN}{PRIOR} SELECT TRANSACTION_ID, {s6('Value * ' + _ord('ProductId'))} AS \"Value*ProductId_ordered\" FROM tr, pr")(
    lambda spark, d: (lambda tr, x: rounded(E.encoded_interactions(tr, ["Value"], E.ordered_target_encoder(tr, ["ProductId"])).select(
        ID, F.col("`Value*ProductId_ordered`"))))(*split(spark, d)))


@query("knn_impute", f"""WITH p AS (SELECT c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS n, length(c_mktsegment) * 10.0 AS s, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS a FROM customer),
 g AS (SELECT q.id, d.id AS did, d.a, round(sqrt(1.5) * sqrt((q.n - d.n) * (q.n - d.n) + CAST((q.s - d.s) * (q.s - d.s) AS DOUBLE)), 9) AS dist FROM p q JOIN p d ON q.a IS NULL AND d.a IS NOT NULL),
 nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, did) AS r FROM g),
 f AS (SELECT id, CASE WHEN min(dist) = 0 THEN avg(a) FILTER (dist = 0) ELSE sum(a / nullif(dist, 0)) / sum(1 / nullif(dist, 0)) END AS v FROM nn WHERE r <= 5 GROUP BY 1)
 SELECT p.id AS c_custkey, {s6('n')} AS c_nationkey, {s6('coalesce(a, v)')} AS c_acctbal, {s6('CAST(s AS DOUBLE)')} AS seg FROM p LEFT JOIN f USING (id)""")
def _(spark, d):
    x = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("c_acctbal"),
                                           (F.length("c_mktsegment") * 10.0).alias("seg"))
    return rounded(I.knn_impute(x, ["c_acctbal", "c_nationkey", "seg"], 5, cols=DEFAULT.with_names(id="c_custkey")))


# ------------------------------------------------------------------ selection

# The power sums of the explained shares fix the shares; in SQL they are traces of powers of the correlation matrix.
query("pca_explained", "WITH c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, corr({a}, {b}) / {len(LINE)} AS v FROM lineitem" for i, a in enumerate(LINE) for j, b in enumerate(LINE))
      + f"""), s AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
 SELECT 1 AS power, {s6('sum(v)')} AS total FROM c WHERE i = j UNION ALL SELECT 2, {s6('sum(v)')} FROM s WHERE i = j
 UNION ALL SELECT 3, {s6('sum(s.v * c.v)')} FROM s JOIN c ON s.j = c.i AND s.i = c.j UNION ALL SELECT 4, {s6('sum(v * v)')} FROM s""")(
    lambda spark, d: (lambda e: rounded(spark.createDataFrame([(k, float(sum(x ** k for x in e))) for k in (1, 2, 3, 4)], "power int, total double")))(
        S.pca(table(spark, d, "lineitem"), LINE, 4).explained))
query("pca_scores")(lambda spark, d: (lambda x: rounded(S.pca(x, LINE, 2).transform(x).select("l_orderkey", "l_partkey", "pca_0", "pca_1")))(table(spark, d, "lineitem")))
query("nystroem")(lambda spark, d: (lambda x: rounded(S.nystroem(x, ["TX_AMOUNT", "Value", "Hour"], 8).transform(x).select(
    ID, *[f"nystroem_{i}" for i in range(8)])))(cal(spark, d)))

_cuts = lambda c: [f"(SELECT quantile_cont({c}, {p}) FROM cal)" for p in (0.25, 0.5, 0.75)]


def _mi(c: str, b: str) -> str:
    return (f"SELECT '{c}' AS feature, sum(o / n * ln(o * n / (r * k))) AS mi FROM (SELECT *, sum(o) OVER (PARTITION BY b) AS r, sum(o) OVER (PARTITION BY y) AS k, "
            f"sum(o) OVER () AS n FROM (SELECT {b} AS b, TX_FRAUD AS y, count(*)::DOUBLE AS o FROM cal GROUP BY 1, 2))")


query("mutual_information", f"WITH {CAL}, m AS (" + " UNION ALL ".join(
    [_mi(c, " + ".join(f"CAST({c} > {q} AS INT)" for q in _cuts(c))) for c in ("TX_AMOUNT", "Value")] + [_mi("ProductCategory", "ProductCategory")])
      + f") SELECT feature, {s6('mi')} AS mi FROM m")(
    lambda spark, d: rounded(S.mutual_information(cal(spark, d), ["TX_AMOUNT", "Value", "ProductCategory"], "TX_FRAUD", 4, ["ProductCategory"])))


def _psi(x: str) -> str:
    """Digamma of a whole number: ten steps of the recurrence, then the series."""
    y = f"(({x}) + 10.0)"
    return (f"(ln({y}) - 0.5/{y} - 1/(12*{y}*{y}) + 1/(120*pow({y}, 4)) - 1/(252*pow({y}, 6)) + 1/(240*pow({y}, 8)) - "
            + " - ".join(f"1/(({x}) + {i}.0)" for i in range(10)) + ")")


# Rows side by side: distance to the third neighbour of the class, then the rows of both classes within it.
query("neighbor_information", f"""WITH {CAL}, p AS (SELECT 'TX_AMOUNT' AS f, TX_AMOUNT AS v, TX_FRAUD AS y FROM cal UNION ALL SELECT 'Value', Value, TX_FRAUD FROM cal),
 d AS (SELECT f, v, y, list_sort(list_filter([{", ".join(f"v - lag(v, {i}) OVER w, lead(v, {i}) OVER w - v" for i in (1, 2, 3))}], lambda x: x IS NOT NULL))[3] AS r,
  count(*) OVER (PARTITION BY f, y) AS size, count(*) OVER (PARTITION BY f) AS total FROM p WINDOW w AS (PARTITION BY f, y ORDER BY v)),
 q AS (SELECT f, v, y, any_value(r) AS r, any_value(size) AS size, any_value(total) AS total, count(*) AS c FROM d GROUP BY f, v, y),
 u AS (SELECT f, v, count(*) AS c FROM p GROUP BY f, v),
 m AS (SELECT q.f, q.v, q.y, any_value(q.size) AS size, any_value(q.total) AS total, any_value(q.c) AS c, sum(u.c) AS m FROM q JOIN u ON u.f = q.f
  AND u.v >= q.v - q.r AND u.v <= q.v + q.r AND (q.r = 0 OR u.v > q.v - q.r AND u.v < q.v + q.r) GROUP BY q.f, q.v, q.y)
 SELECT f AS feature, round(greatest(0, {_psi("any_value(total)")} + {_psi("3")} - sum(c * ({_psi("size")} + {_psi("m")})) / any_value(total)), 6) AS mi FROM m GROUP BY f""")(
    lambda spark, d: neighbor_information(cal(spark, d), ["TX_AMOUNT", "Value"], "TX_FRAUD").select("feature", F.round("mi", 6).alias("mi")))


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS feature, (sum(n*(m-g)*(m-g)) / (count(*)-1)) / (sum(n*s) / (sum(n)-count(*))) AS f FROM (SELECT TX_FRAUD, count(*) AS n, avg({c}) AS m, var_pop({c}) AS s,
 (SELECT avg({c}) FROM cal) AS g FROM cal GROUP BY 1)"""


query("anova_f", f"WITH {CAL}, m AS (" + " UNION ALL ".join(_anova(c) for c in ("TX_AMOUNT", "Value", "Hour")) + f") SELECT feature, {s6('f')} AS f FROM m")(
    lambda spark, d: rounded(S.anova_f(cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], "TX_FRAUD")))
query("label_correlation", f"WITH {CAL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {s6(f'abs(corr({c}, TX_FRAUD))')} AS corr FROM cal" for c in ("TX_AMOUNT", "Value", "Hour")))(
    lambda spark, d: rounded(S.label_correlation(cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], "TX_FRAUD")))
query("select_k_best", f"WITH {CAL}, m AS (" + " UNION ALL ".join(_anova(c) for c in ("TX_AMOUNT", "Value", "Hour")) + ") SELECT feature FROM m ORDER BY f DESC LIMIT 2")(
    lambda spark, d: spark.createDataFrame([(c,) for c in S.select_k_best(cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], "TX_FRAUD", 2, "f")], "feature string"))


def _names(spark, names):
    return spark.createDataFrame([(c,) for c in names], "feature string")


query("correlated_selection", """WITH p AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r, var_pop(l_quantity) AS vq, var_pop(l_extendedprice) AS ve FROM lineitem)
 SELECT unnest(CASE WHEN r > 0.8 THEN [CASE WHEN ve > vq THEN 'l_extendedprice' ELSE 'l_quantity' END, 'l_discount', 'l_tax']
 ELSE ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'] END) AS feature FROM p""")(
    lambda spark, d: _names(spark, S.smart_correlated_selection(table(spark, d, "lineitem"), LINE)))
# Amount and its ninth power rank alike, though their correlation by value is low: by rank they are one group, of which the power varies more.
_powers = [("TX_AMOUNT", "TX_AMOUNT"), ("Power", "pow(TX_AMOUNT, 9)"), ("Hour", "CAST(hour(TX_DATETIME) AS DOUBLE)")]
query("correlated_selection_spearman", f"""WITH {TX}, c AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _powers)} FROM tx),
 k AS (SELECT {", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS {n}" for n, _ in _powers)} FROM c),
 r AS (SELECT abs(corr(TX_AMOUNT, Power)) AS tc, abs(corr(TX_AMOUNT, Hour)) AS th, abs(corr(Power, Hour)) AS ch FROM k)
 SELECT unnest(CASE WHEN th > 0.8 OR ch > 0.8 THEN NULL WHEN tc > 0.8 THEN ['Power', 'Hour'] ELSE ['TX_AMOUNT', 'Power', 'Hour'] END) AS feature FROM r""")(
    lambda spark, d: _names(spark, S.smart_correlated_selection(cal(spark, d).withColumn("Power", F.pow("TX_AMOUNT", F.lit(9))), [n for n, _ in _powers], method="spearman")))
query("group_lasso_selection")(lambda spark, d: _names(spark, S.group_lasso_selection(
    cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], ["ProductCategory", "ChannelId"], "TX_FRAUD", 1e-4)))


def _auc(x):
    return V.ranking_scores(M.fraud_probability(x)).first()["auc_roc"] or 0.0


def _folded(spark, d):
    from txrisk.operators.splits import stratified_kfold
    x = cal(spark, d).withColumn("Category", F.when(F.col("ProductCategory") == "purchase", 2.0).when(F.col("ProductCategory") == "error", 1.0).otherwise(0.0))
    return keep(stratified_kfold(M.class_weights(x), 2).select("fold", "TX_FRAUD", "weight", "TX_AMOUNT", "Value", "Category"))


SMALL = ["TX_AMOUNT", "Value", "Category"]
query("recursive_elimination")(lambda spark, d: _names(spark, S.recursive_elimination_cv(_folded(spark, d), SMALL, "TX_FRAUD", M.decision_tree(maxDepth=3), _auc)))
query("sequential_selection")(lambda spark, d: _names(spark, S.sequential_selection(_folded(spark, d), SMALL, "TX_FRAUD", M.decision_tree(maxDepth=3), _auc, 2)))
query("recursive_addition")(lambda spark, d: _names(spark, S.recursive_addition(_folded(spark, d), SMALL, "TX_FRAUD", M.decision_tree(maxDepth=3), _auc)))
query("pca_then_select")(lambda spark, d: _names(spark, S.pca_then_select(cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], "TX_FRAUD", 3, 2)[1]))

# ------------------------------------------------------------------ outlier scores

OUT = ["TX_AMOUNT", "Value", "Hour"]
LINE_COLS = DEFAULT.with_names(id="l_orderkey")


def _hist_sql(exprs: dict[str, str], src: str, bins: int, alpha: str, mean: bool, ids: str, name: str) -> str:
    ctes, terms = [], []
    for i, (c, e) in enumerate(exprs.items()):
        b = f"CAST(least(greatest(floor((({e}) - lo{i}) / ((hi{i} - lo{i}) / {bins})) , 0), {bins - 1}) AS INT)" if mean else \
            f"CAST(least(greatest(floor((({e}) - lo{i}) * {bins} / (hi{i} - lo{i})), 0), {bins - 1}) AS INT)"
        ctes.append(f"l{i} AS (SELECT min({e}) AS lo{i}, max({e}) AS hi{i}, count(*) AS n{i} FROM {src})")
        ctes.append(f"h{i} AS (SELECT {b} AS b{i}, -log2(count(*) / (any_value(n{i}) * ((any_value(hi{i}) - any_value(lo{i})) / {bins})) + {alpha}) AS v{i} FROM {src}, l{i} GROUP BY 1)")
        terms.append((b, i))
    joins = " ".join(f"CROSS JOIN l{i} LEFT JOIN h{i} ON b{i} = {b}" for b, i in terms)
    total = " + ".join(f"v{i}" for _, i in terms)
    return ", ".join(ctes) + f" SELECT {ids}, {s6(f'({total})' + (f' / {len(terms)}' if mean else ''))} AS {name} FROM {src} {joins}"


query("hbos", f"WITH {_hist_sql({c: c for c in LINE}, 'lineitem', 10, '0.1', False, 'l_orderkey, l_partkey', 'hbos')}")(
    lambda spark, d: (lambda x: rounded(O.hbos(x, LINE).transform(x, "hbos").select("l_orderkey", "l_partkey", "hbos")))(table(spark, d, "lineitem")))
_w = O.loda_weights(4, 5, 0)
query("loda", "WITH " + _hist_sql({f"p{i}": " + ".join(f"{c} * ({w!r})" for c, w in zip(LINE, map(float, _w[:, i]))) for i in range(5)},
                                  "lineitem", 10, "1e-12", True, "l_orderkey, l_partkey", "loda"))(
    lambda spark, d: (lambda x: rounded(O.loda(x, LINE, 10, 5, 0).transform(x).select("l_orderkey", "l_partkey", "loda")))(table(spark, d, "lineitem")))
query("isolation_forest")(lambda spark, d: (lambda x: rounded(O.isolation_forest(x, OUT, 50).transform(x).select(ID, "iforest")))(cal(spark, d)))
query("cblof")(lambda spark, d: (lambda x: rounded(O.cblof(x, OUT, 5).transform(x).select(ID, "cblof")))(cal(spark, d)))
query("mcd")(lambda spark, d: (lambda x: rounded(O.mcd(x, LINE).transform(x).select("l_orderkey", "l_partkey", "mcd")))(table(spark, d, "lineitem")))
CUST = DEFAULT.with_names(id="c_custkey")
KNN = """p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) * 100 AS y FROM customer),
 nn AS (SELECT a.id, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), b.id) AS r
 FROM p a JOIN p b ON a.id <> b.id)"""


def _cust(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey").cast("double") * 100).alias("nation"))


query("knn_distance", f"WITH {KNN} SELECT id AS c_custkey, {s6('max(dist)')} AS knn FROM nn WHERE r <= 5 GROUP BY 1")(
    lambda spark, d: rounded(O.knn_distance(_cust(spark, d), ["c_acctbal", "nation"], 5, cols=CUST)))
query("knn_distance_partitioned", f"WITH {KNN} SELECT id AS c_custkey, {s6('avg(dist)')} AS knn FROM nn WHERE r <= 5 GROUP BY 1")(
    lambda spark, d: rounded(O.knn_distance(_cust(spark, d), ["c_acctbal", "nation"], 5, "mean", cols=CUST, max_broadcast=100)))
query("abod", f"""WITH {KNN.replace('b.id) AS r', 'b.id) AS r, b.x - a.x AS dx, b.y - a.y AS dy')}, k AS (SELECT *, dx * dx + dy * dy AS sq FROM nn WHERE r <= 6),
 v AS (SELECT a.id, var_pop((a.dx * b.dx + a.dy * b.dy) / (a.sq * b.sq)) AS v FROM k a JOIN k b ON a.id = b.id AND a.r < b.r AND a.sq > 0 AND b.sq > 0 GROUP BY 1)
 SELECT c_custkey, {s6('ln(1e-30 + coalesce(v, 0))')} AS log_abod FROM customer LEFT JOIN v ON id = c_custkey""")(
    lambda spark, d: rounded(O.abod(_cust(spark, d), ["c_acctbal", "nation"], 6, CUST).select("c_custkey", F.log(1e-30 - F.col("abod")).alias("log_abod"))))
query("contamination_flag", f"WITH {TX} SELECT TRANSACTION_ID, CAST(Value > (SELECT quantile_cont(Value, 0.95) FROM tx) AS INT) AS Value_outlier FROM tx")(
    lambda spark, d: O.contamination_flag(tx(spark, d), "Value", 0.05).select(ID, "Value_outlier"))
query("score_union")(lambda spark, d: rounded(O.add_scores(cal(spark, d), OUT, list(O.DETECTORS), {"loda": {"n_projections": 10}, "iforest": {"n_trees": 20}}).select(ID, *O.DETECTORS)))

# ------------------------------------------------------------------ resampling

XF = ["TX_AMOUNT", "Value"]
DIST = "sqrt((a.TX_AMOUNT-b.TX_AMOUNT)*(a.TX_AMOUNT-b.TX_AMOUNT) + (a.Value-b.Value)*(a.Value-b.Value))"
query("near_miss", f"""WITH {TX}, nn AS (SELECT a.TRANSACTION_ID AS id, {DIST} AS dist, row_number() OVER (PARTITION BY a.TRANSACTION_ID ORDER BY {DIST}, b.TRANSACTION_ID) AS r
 FROM tx a JOIN tx b ON a.TX_FRAUD = 0 AND b.TX_FRAUD = 1),
 md AS (SELECT id, avg(dist) AS m FROM nn WHERE r <= 3 GROUP BY 1), k AS (SELECT id, row_number() OVER (ORDER BY round(m, 9), id) AS r FROM md)
 SELECT TRANSACTION_ID, TX_FRAUD FROM tx WHERE TX_FRAUD = 1 UNION ALL SELECT id, 0 FROM k WHERE r <= (SELECT CAST(sum(TX_FRAUD) / 0.1 AS INT) FROM tx)""")(
    lambda spark, d: X.near_miss(tx(spark, d), XF, 0.1, 3).select(ID, "TX_FRAUD"))
_tag = "concat(CAST(id AS VARCHAR), '#', CAST(j AS VARCHAR))"
query("smote", f"""WITH {TX}, pos AS (SELECT TRANSACTION_ID AS id, TX_AMOUNT, Value FROM tx WHERE TX_FRAUD = 1),
 sz AS (SELECT CAST(round(0.0161 * (SELECT count(*) FROM tx WHERE TX_FRAUD = 0)) AS BIGINT) - count(*) AS nn, count(*) AS np FROM pos),
 rk AS (SELECT *, row_number() OVER (ORDER BY {u32('id', 'base')}, id) - 1 AS p FROM pos),
 cp AS (SELECT *, greatest(nn, 0) // np + CAST(p < greatest(nn, 0) % np AS INT) AS c FROM rk, sz),
 e AS (SELECT id, TX_AMOUNT, Value, CAST(unnest(generate_series(1, c)) AS INT) AS j FROM cp WHERE c > 0),
 nb AS (SELECT a.id, b.id AS nid, b.TX_AMOUNT AS na, b.Value AS nv, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS r FROM pos a JOIN pos b ON a.id <> b.id),
 q AS (SELECT *, {u32(_tag, '0n')} % 3 + 1 AS pick, {unit(_tag, '0l')} AS lam FROM e)
 SELECT q.id AS base_id, nid AS neighbour_id, j, {s6('lam')} AS lam, {s6('TX_AMOUNT + lam * (na - TX_AMOUNT)')} AS TX_AMOUNT,
 {s6('Value + lam * (nv - Value)')} AS Value, 1 AS TX_FRAUD FROM q JOIN nb ON nb.id = q.id AND r = pick""")(
    lambda spark, d: rounded(X.smote_rows(tx(spark, d), XF, 0.0161, 3, 0)))


def _more(spark, d):
    """Transactions with all small purchases as positives, so that every sampler has neighbours to work with."""
    return keep(tx(spark, d).withColumn("TX_FRAUD", ((F.col("ProductCategory") == "purchase") & (F.col("Value") < 40)).cast("int")))


for _n, _p in {"adasyn": {"k": 5}, "borderline": {"k": 5, "m": 10}, "kmeans": {"k": 3, "n_clusters": 4}, "svm": {"k": 5, "m": 10}}.items():
    query(f"{_n}_oversampling")(lambda spark, d, n=_n, p=_p: rounded(X.SAMPLERS[n](_more(spark, d), XF, ratio=0.2, **p)))
query("borderline_oversampling_kind_2")(lambda spark, d: rounded(X.borderline_smote_rows(_more(spark, d), XF, 0.2, 5, 10, 2)))
query("smote_enn")(lambda spark, d: rounded(X.smote_enn(tx(spark, d), XF, 0.0161, 3)))
query("smote_tomek")(lambda spark, d: rounded(X.smote_tomek(tx(spark, d), XF, 0.0161, 3)))
NN1 = """p AS (SELECT c_custkey AS id, c_acctbal AS x, CAST(c_mktsegment = 'BUILDING' AS INT) AS f FROM customer),
 n1 AS (SELECT a.id, arg_min(b.id, (abs(a.x-b.x), b.id)) AS nid FROM p a JOIN p b ON a.id <> b.id GROUP BY 1)"""


def _building(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("f"))


query("tomek_links", f"WITH {NN1} SELECT a.id AS negative, a.nid AS positive FROM n1 a JOIN n1 b ON a.nid = b.id AND b.nid = a.id JOIN p pa ON pa.id = a.id "
      "JOIN p pb ON pb.id = b.id WHERE pa.f = 0 AND pb.f = 1")(
    lambda spark, d: X.tomek_links(_building(spark, d), ["c_acctbal"], DEFAULT.with_names(id="c_custkey", label="f")))
query("edited_nearest_neighbours", f"""WITH {NN1}, nk AS (SELECT a.id, a.f, b.f AS bf, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.x-b.x), b.id) AS r FROM p a JOIN p b ON a.id <> b.id)
 SELECT id AS c_custkey, any_value(f) AS f FROM nk WHERE r <= 3 GROUP BY id HAVING any_value(f) = 1 OR sum(bf) = 0""")(
    lambda spark, d: X.edited_nearest_neighbours(_building(spark, d), ["c_acctbal"], 3, DEFAULT.with_names(id="c_custkey", label="f")).select("c_custkey", "f"))
query("sampler_chain")(lambda spark, d: rounded(X.sampler_chain(tx(spark, d), XF, [("smote", {"ratio": 0.0161, "k": 3}), ("undersample", {"ratio": 0.1})])))

# ------------------------------------------------------------------ models

MF = ["TX_AMOUNT", "Value", "Hour", "DayOfWeek", "Category"]


def _model_table(spark, d):
    x = cal(spark, d).withColumn("Category", F.when(F.col("ProductCategory") == "purchase", 2.0).when(F.col("ProductCategory") == "error", 1.0).otherwise(0.0))
    return keep(M.assemble(M.class_weights(x), MF).select(ID, "TX_FRAUD", "weight", "features", *MF))


def _score(learner):
    def run(spark, d):
        x = _model_table(spark, d)
        return rounded(M.fraud_probability(learner.fit(x).transform(x)).select(ID, "predictions"))
    return run


def _late(make):
    return lambda spark, d: _score(make())(spark, d)


for _n, _make in {
    "logistic": lambda: M.logistic(maxIter=30), "linear_svm": lambda: M.linear_svm(maxIter=20),
    "sgd_elasticnet": lambda: M.sgd_linear(penalty="elasticnet", maxIter=30), "perceptron": lambda: M.perceptron(5, (8,), maxIter=30),
    "sgd_hinge_l1": lambda: M.sgd_linear(loss="hinge", penalty="l1", alpha=0.01, max_iter=60),
    "sgd_hinge_elasticnet": lambda: M.sgd_linear(loss="hinge", penalty="elasticnet", alpha=0.01, max_iter=60),
    "decision_tree": lambda: M.decision_tree(), "random_forest": lambda: M.random_forest(numTrees=20), "gradient_boosting": lambda: M.gradient_boosting(maxIter=10),
    "undersampled_bags": lambda: M.UndersampledBags(M.decision_tree(maxDepth=4), 4), "boosted_rounds": lambda: M.BoostedRounds(M.decision_tree(maxDepth=2), 4),
    "boosted_undersampled_rounds": lambda: M.BoostedRounds(M.decision_tree(maxDepth=2), 4, ratio=0.5),
    "bagging": lambda: M.Bagging(M.decision_tree(maxDepth=4), 5, 4), "soft_voting_models": lambda: M.SoftVoting([M.logistic(maxIter=20), M.decision_tree()]),
    "clusterwise": lambda: M.ClusterwiseClassifier(3),
    "clusterwise_tree": lambda: M.ClusterwiseClassifier(3, method="tree"),
}.items():
    query(f"classifier_{_n}")(_late(_make))


@query("classifier_stacking")
def _(spark, d):
    x = _model_table(spark, d)
    base = [M.logistic(maxIter=20).fit(x), M.decision_tree().fit(x)]
    return rounded(M.fraud_probability(M.Stacking(base).fit(x).transform(x)).select(ID, "predictions"))


query("soft_vote", f"WITH {SCORED} SELECT TRANSACTION_ID, {s6('(predictions + 2 * Value / 1000) / 3')} AS vote FROM scored")(
    lambda spark, d: rounded(M.soft_vote(scored(spark, d).withColumn("v", F.col("Value") / 1000), ["predictions", "v"], "vote", [1, 2]).select(ID, "vote")))
query("class_weights", f"WITH {TX}, n AS (SELECT count(*)::DOUBLE AS n, sum(TX_FRAUD)::DOUBLE AS p FROM tx) SELECT TRANSACTION_ID, "
      f"{s6('CASE WHEN TX_FRAUD = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END')} AS weight FROM tx, n")(
    lambda spark, d: rounded(M.class_weights(tx(spark, d)).select(ID, "weight")))


@query("calibration")
def _(spark, d):
    x = _model_table(spark, d)
    s = M.fraud_probability(M.decision_tree().fit(x).transform(x)).select(ID, "TX_FRAUD", "predictions")
    return rounded(M.calibrate(s)(s).select(ID, "calibrated"))


_BOOST = dict(bins=8, l1=0.5, l2=2.0, min_child=0.5, positive_weight=10.0)


# Gains of all splits of the first node: quantile bins, gradient and hessian sums, running sums over the bins.
@query("booster_root_gains", f"""WITH {TX}, v AS (SELECT TX_FRAUD AS y, unnest(['Hour', 'TX_AMOUNT', 'Value']) AS feature, unnest([CAST(hour(TX_DATETIME) AS DOUBLE), TX_AMOUNT, Value]) AS v FROM tx),
 e AS (SELECT feature, unnest(list_distinct(quantile_cont(v, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]))) AS edge FROM v GROUP BY 1),
 q AS (SELECT 1 / (1 + exp(-ln(10.0 * sum(TX_FRAUD) / sum(1 - TX_FRAUD)))) AS q FROM tx),
 b AS (SELECT feature, y, (SELECT count(*) FROM e WHERE e.feature = v.feature AND edge < v.v) AS bin FROM v),
 c AS (SELECT feature, bin, count(*) AS n, sum((CASE WHEN y = 1 THEN 10.0 ELSE 1.0 END) * (q - y)) AS g, sum((CASE WHEN y = 1 THEN 10.0 ELSE 1.0 END) * q * (1 - q)) AS h FROM b, q GROUP BY 1, 2),
 s AS (SELECT feature, bin, sum(n) OVER u AS nl, sum(g) OVER u AS gl, sum(h) OVER u AS hl, sum(n) OVER p AS n, sum(g) OVER p AS g, sum(h) OVER p AS h FROM c
       WINDOW p AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 t AS (SELECT feature, bin, h, hl, nl, n, pow(greatest(abs(gl) - 0.5, 0), 2) / (hl + 2) + pow(greatest(abs(g - gl) - 0.5, 0), 2) / (h - hl + 2) - pow(greatest(abs(g) - 0.5, 0), 2) / (h + 2) AS d FROM s)
 SELECT feature, CAST(bin AS INT) AS bin, {s6('d / 2')} AS gain FROM t WHERE nl < n AND hl >= 0.5 AND h - hl >= 0.5""")
def _(spark, d):
    from txrisk.operators.boosting import Boosting, root_gains
    return rounded(root_gains(cal(spark, d), ["Hour", "TX_AMOUNT", "Value"], Boosting(**_BOOST)))


@query("classifier_histogram_boosting")
def _(spark, d):
    from txrisk.operators.boosting import Boosting, fit_booster
    x = cal(spark, d)
    model = fit_booster(x, ["Hour", "DayOfWeek", "TX_AMOUNT", "Value"], Boosting(n_trees=6, rows=0.8, columns=0.75, **_BOOST))
    return rounded(model.best_stage(x).transform(x).select(ID, "predictions"))


@query("best_boosting_stage")
def _(spark, d):
    x = _model_table(spark, d)
    return rounded(M.best_boosting_stage(M.gradient_boosting(maxIter=8).fit(x), x))


@query("score_table")
def _(spark, d):
    x = _model_table(spark, d)
    return M.positive_rate(M.score_table(M.decision_tree().fit(x), x.drop("TX_FRAUD"), 0.8))


@query("fit_and_predict")
def _(spark, d):
    x = _model_table(spark, d).drop("features", "weight")
    got = M.fit_and_predict(M.logistic(maxIter=20), x.where(f"{ID} % 4 > 0"), x.where(f"{ID} % 4 = 0"), MF, scale=True)
    return rounded(got["test"].select(ID, "predictions"))


@query("client_clusters")
def _(spark, d):
    p = client_profile(cal(spark, d), "CustomerUID", ["TX_AMOUNT", "Value", "IsNight"])
    return M.client_clusters(p, "CustomerUID", ["cluster_TX_AMOUNT", "cluster_Value", "cluster_Hour"], ["cluster_ProductCategory"], 4)


# Leaves of the feature tree hold all rows, sums and squares of the table, none of them wider than its threshold.
_TREE = ["TX_AMOUNT", "Value", "Hour"]


@query("feature_tree_leaves", f"""WITH {CAL} SELECT count(*)::BIGINT AS n, {", ".join(f"{s6(f'avg({c})')} AS mean_{c}" for c in _TREE)},
 round({" + ".join(f"var_pop({c})" for c in _TREE)}, 4) AS variance, true AS within, true AS bounded FROM cal""")
def _(spark, d):
    from txrisk.operators.feature_tree import leaf_table
    x = cal(spark, d)
    leaves = leaf_table(x, F.array(*[F.col(c).cast("double") for c in _TREE]), 2.0, 200)
    mean = [F.sum(F.col("n") * F.col("mean")[j]) / F.sum("n") for j in range(3)]
    square = [F.sum(F.col("n") * F.col("mean")[j] * F.col("mean")[j]) / F.sum("n") for j in range(3)]
    spread = sum(((q - m * m) for q, m in zip(square, mean)), F.sum("spread") / F.sum("n"))
    return leaves.agg(F.sum("n").alias("n"), *[r6(m).alias(f"mean_{c}") for m, c in zip(mean, _TREE)], F.round(spread, 4).alias("variance"),
                      (F.max(F.sqrt(F.col("spread") / F.col("n")) - F.col("threshold")) <= 1e-9).alias("within"), (F.count("*") <= 200).alias("bounded"))


@query("client_clusters_tree")
def _(spark, d):
    p = client_profile(cal(spark, d), "CustomerUID", ["TX_AMOUNT", "Value", "IsNight"])
    return M.client_clusters(p, "CustomerUID", ["cluster_TX_AMOUNT", "cluster_Value", "cluster_Hour"], ["cluster_ProductCategory"], 4, "tree")


# ------------------------------------------------------------------ plans, search

@query("feature_table")
def _(spark, d):
    from txrisk.plans.features import build_features, fit_features
    x = tx(spark, d).drop("CustomerUID")
    return rounded(build_features(x, fit_features(x)))


@query("prequential_grid_search")
def _(spark, d):
    from txrisk.plans.search import prequential_grid_search, summarise
    from txrisk.functions.rows import day_offset
    x = day_offset(cal(spark, d))
    got = prequential_grid_search(x, ["TX_AMOUNT", "Value", "Hour"], lambda p: M.decision_tree(**p), [{"maxDepth": 3}, {"maxDepth": 5}], 2, k=20)
    return summarise(got).where("metric NOT LIKE '% time'")


@query("time_series_cross_validation")
def _(spark, d):
    from txrisk.plans.search import TimeSeriesCrossValidator
    cv = TimeSeriesCrossValidator(["TX_AMOUNT", "Value", "Hour"], lambda p: M.decision_tree(**p), {"maxDepth": [3, 5]}, 2, 2, 200, "Average precision")
    cv.fit(cal(spark, d))
    return cv.trials.where("metric NOT LIKE '% time'")


@query("stratified_kfold_report")
def _(spark, d):
    from txrisk.plans.search import stratified_report
    return stratified_report(cal(spark, d), ["TX_AMOUNT", "Value", "Hour"], M.decision_tree(maxDepth=4), 3).where("metric NOT LIKE '% time'")


# ------------------------------------------------------------------ whole workflows

def _workflow_rows(spark, d):
    x = calendar_features(txd(spark, d)).select(ID, "TX_DATETIME", "TX_TIME_DAYS", "TX_AMOUNT", "Value", "Hour", "ProductCategory", "ProductId", "TX_FRAUD")
    return x.where("TX_TIME_DAYS < 20"), x.where("TX_TIME_DAYS >= 20")


def _workflow():
    from txrisk.plans.workflow import Workflow, WorkflowOptions
    return Workflow(WorkflowOptions(engineer=False, classifier="tree", encoder="ordered", detectors=("hbos",), scaler="standard", classifier_params={"maxDepth": 3}))


@query("workflow_fit_score")
def _(spark, d):
    train, test = _workflow_rows(spark, d)
    return rounded(_workflow().fit(train).transform(test).select(ID, "predictions"))


# A stored workflow scores every row as the fitted one did.
@query("workflow_save_load", f"WITH {TX} SELECT TRANSACTION_ID, true AS same FROM tx WHERE TX_TIME_DAYS >= 20")
def _(spark, d):
    from txrisk.plans.workflow import FittedWorkflow
    train, test = _workflow_rows(spark, d)
    w = _workflow().fit(train)
    path = f"{shared_folder(spark)}/workflow-{uuid.uuid4().hex}"
    w.save(path)
    again = FittedWorkflow.load(spark, path).transform(test).select(ID, F.col("predictions").alias("loaded"))
    return w.transform(test).select(ID, "predictions").join(again, ID).select(ID, (F.abs(F.col("predictions") - F.col("loaded")) < 1e-9).alias("same"))


# Rows carry the cluster of their client: one cluster per client, none missing.
@query("cluster_labels_on_rows", f"""WITH {TX} SELECT CustomerUID, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_clusters FROM tx GROUP BY 1""")
def _(spark, d):
    p = client_profile(cal(spark, d), "CustomerUID", ["TX_AMOUNT", "Value", "IsNight"])
    c = M.client_clusters(p, "CustomerUID", ["cluster_TX_AMOUNT", "cluster_Value"], (), 4)
    rows = attach(tx(spark, d), c, "CustomerUID")
    return rows.groupBy("CustomerUID").agg(F.count("*").alias("n_rows"), F.countDistinct("CustomerCluster").alias("n_clusters"))


# ------------------------------------------------------------------ streaming

def _stream(spark, d):
    """The events table as a file stream with the columns the live features need."""
    e = spark.read.parquet(f"{d}/events.parquet")
    s = spark.readStream.schema(e.schema).parquet(f"{d}/event[s].parquet")
    return s.select(F.col("event_id").alias("TRANSACTION_ID"), F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("AccountId"), F.col("ts").cast("timestamp").alias("TX_DATETIME"),
                    F.when(F.col("event_type").isin("error", "signup"), -F.col("value")).otherwise(F.col("value")).alias("TX_AMOUNT"), F.col("value").alias("Value"))


def _drain(spark, result, closed_only=False):
    from txrisk.streaming.velocity import run_available
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run_available(result, f"{root}/out", f"{root}/state", closed_only)
    return spark.read.schema(result.schema).parquet(f"{root}/out")


@query("streaming_velocity", f"""WITH {TX}, w AS (SELECT AccountId, TX_AMOUNT, us // {DAY_US} - unnest([0, 1, 2, 3, 4, 5, 6]) AS d FROM tx)
 SELECT AccountId, d * {DAY_US} AS start_us, (d + 7) * {DAY_US} AS end_us, count(*) AS n_tx, {s6('sum(TX_AMOUNT)')} AS amount, {s6('avg(TX_AMOUNT)')} AS mean_amount
 FROM w GROUP BY 1, 2, 3""")
def _(spark, d):
    from txrisk.streaming.velocity import streaming_velocity
    tx(spark, d)
    return rounded(_drain(spark, streaming_velocity(_stream(spark, d), "AccountId")))


_LIVE = [(f"AccountId_Count_{n}", "count(*)", f"INTERVAL {w}") for n, w in (("6h", "6 HOURS"), ("1d", "1 DAY"), ("3d", "3 DAYS"), ("7d", "7 DAYS"))]
_LIVE += [(f"AccountId_Mean_{n}d", "avg(TX_AMOUNT)", f"INTERVAL {n} DAYS") for n in (1, 7, 30)]
_LIVE_SQL = ", ".join(f"""{s6(f"{fn} OVER (PARTITION BY AccountId ORDER BY TX_DATETIME RANGE BETWEEN {w} - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)") if fn != "count(*)"
    else f"{fn} OVER (PARTITION BY AccountId ORDER BY TX_DATETIME RANGE BETWEEN {w} - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)"} AS {name}""" for name, fn, w in _LIVE)


# Rows after the last watermark, an hour before the latest row, are not closed yet.
@query("streaming_exact_velocity", f"""WITH {TX}, r AS (SELECT AccountId, CAST(TRANSACTION_ID AS VARCHAR) AS TRANSACTION_ID, us, {_LIVE_SQL} FROM tx)
 SELECT * FROM r WHERE us // 1000 <= (SELECT max(us) // 1000 - 3600000 FROM tx)""")
def _(spark, d):
    from txrisk.streaming.velocity import streaming_exact_velocity
    tx(spark, d)
    return rounded(_drain(spark, streaming_exact_velocity(_stream(spark, d), "AccountId"), closed_only=True))


@query("streaming_sessions", f"""WITH {TX}, g AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY AccountId ORDER BY us), 99999999999999) > 43200000000 AS st FROM tx),
 s AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY AccountId ORDER BY us ROWS UNBOUNDED PRECEDING) AS sid FROM g)
 SELECT AccountId, min(us) AS start_us, count(*) AS n_tx, {s6('sum(TX_AMOUNT)')} AS amount, {s6('sum(Value)')} AS value, {s6('(max(us) - min(us)) / 60000000.0')} AS minutes
 FROM s GROUP BY AccountId, sid""")
def _(spark, d):
    from txrisk.streaming.velocity import streaming_sessions
    tx(spark, d)
    return rounded(_drain(spark, streaming_sessions(_stream(spark, d), "AccountId", "12 hours")))
