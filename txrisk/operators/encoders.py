"""Category encoders, scalers, imputation and interactions.

Category encoders learn one long table (column, category, ...) with a single aggregate over all columns.
Applying one joins the learnt table per column; Spark broadcasts it when it is small.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import attach, exact_quantile_row, hash_unit, time_offsets
from txrisk.operators.windows import Running, category_values, over_key
from txrisk.schema import DEFAULT, MINUTE_US, Columns, micros


def category_table(df: DataFrame, names: list[str], label: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """(column, category, n [, pos] [, first]): counts, label sums and first appearance per category."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in names]))
    keep = [F.col(label).cast("double").alias("__y")] if label else []
    first = [F.struct(*order).alias("__o")] if order else []
    long = df.select(items.alias("x"), *keep, *first).select("x.*", *(["__y"] if label else []), *(["__o"] if order else []))
    aggs = [F.count("*").alias("n")]
    if label:
        aggs.append(F.sum("__y").alias("pos"))
    if order:
        aggs.append(F.min("__o").alias("first"))
    return long.groupBy("column", "category").agg(*aggs)


@dataclass
class TableEncoder:
    """A learnt (column, category) -> values table plus the values of unseen categories."""

    table: DataFrame
    names: list[str]
    outputs: list[str]                       # value columns of the table
    unseen: dict[str, float | None] = field(default_factory=dict)
    replace: bool = True                     # drop the encoded column
    suffix: str = ""

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.names:
            t = self.table.where(F.col("column") == c).select(
                F.col("category").alias("__cat"), *[F.col(o).alias(f"__o_{o}") for o in self.outputs])
            out = attach(out.withColumn("__cat", F.col(c).cast("string")), t, "__cat")
            values = {self._name(c, o): F.coalesce(F.col(f"__o_{o}"), F.lit(self.unseen.get(o)))
                      if self.unseen.get(o) is not None else F.col(f"__o_{o}") for o in self.outputs}
            out = out.withColumns(values).drop("__cat", *[f"__o_{o}" for o in self.outputs])
        return out

    def _name(self, c: str, o: str) -> str:
        single = len(self.outputs) == 1
        if single:
            return c if self.replace and not self.suffix else f"{c}{self.suffix}"
        return f"{c}_{o}"

    def drop_inputs(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.names) if len(self.outputs) > 1 or self.suffix else df


def count_encoder(df: DataFrame, names: list[str], suffix: str = "_count") -> TableEncoder:
    """Fit-data frequency; unseen categories become 0."""
    t = category_table(df, names).select("column", "category", "n")
    return TableEncoder(t, names, ["n"], {"n": 0}, suffix=suffix)


def ordinal_table(df: DataFrame, names: list[str], cols: Columns = DEFAULT) -> DataFrame:
    """(column, category, ordinal): 1-based rank of first appearance in (time, id) order.

    A column may have very many categories, so they are ranked minute by minute of their first appearance.
    """
    t = category_table(df, names, order=[micros(cols.ts).alias("us"), F.col(cols.id).alias("id")])
    t = t.withColumns({"__us": F.col("first.us"), "__one": F.lit(1).cast("long"), "__minute": F.floor(F.col("first.us") / MINUTE_US)})
    inside = W.partitionBy("column", "__minute").orderBy("first")
    return attach(t, time_offsets(t, "__us", "__one", ["column"]), ["column", "__minute"]).select(
        "column", "category", (F.col("__off") + F.row_number().over(inside)).cast("int").alias("ordinal"))


def digits_needed(n: int, base: int) -> int:
    d = 1
    while base ** d <= n:
        d += 1
    return d


def base_n_encoder(df: DataFrame, names: list[str], base: int = 4, cols: Columns = DEFAULT) -> dict[str, TableEncoder]:
    """Ordinal written in base-``base`` digits, most significant first; unseen categories are all zeros."""
    ords = ordinal_table(df, names, cols)
    sizes = {r["column"]: r["m"] for r in ords.groupBy("column").agg(F.max("ordinal").alias("m")).collect()}
    out = {}
    for c in names:
        d = digits_needed(sizes.get(c, 0), base)
        digit = lambda i: (F.floor(F.col("ordinal") / base ** (d - 1 - i)) % base).cast("int")
        t = ords.where(F.col("column") == c).select("column", "category", *[digit(i).alias(str(i)) for i in range(d)])
        outs = [str(i) for i in range(d)]
        out[c] = TableEncoder(t, [c], outs, {o: 0 for o in outs})
    return out


def binary_encoder(df: DataFrame, names: list[str], cols: Columns = DEFAULT) -> dict[str, TableEncoder]:
    return base_n_encoder(df, names, 2, cols)


def apply_encoders(df: DataFrame, encoders: dict[str, TableEncoder]) -> DataFrame:
    for e in encoders.values():
        df = e.transform(df)
        if len(e.outputs) == 1:
            df = df.withColumnRenamed(e._name(e.names[0], e.outputs[0]), f"{e.names[0]}_{e.outputs[0]}")
    return df


def md5_mod(text: Column, n: int) -> Column:
    """The 128-bit md5 number modulo ``n``, folded over four 32-bit chunks."""
    digest = F.md5(text)
    r = F.lit(0).cast("long")
    for i in range(4):
        chunk = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        r = (r * (2 ** 32 % n) + chunk) % n
    return r


def hashing_encoder(df: DataFrame, names: list[str], n: int = 8, prefix: str = "hash") -> DataFrame:
    """Column j counts the row's values whose md5 falls on j; nothing is fitted."""
    slots = [md5_mod(F.coalesce(F.col(c).cast("string"), F.lit("nan")), n) for c in names]
    counts = {f"{prefix}_{j}": sum(((s == j).cast("int") for s in slots[1:]), (slots[0] == j).cast("int")) for j in range(n)}
    return df.withColumns(counts)


@dataclass
class OrderedTargetEncoder:
    """Ordered target statistics: training rows only see earlier labels of their category."""

    table: DataFrame
    names: list[str]
    prior: float
    cols: Columns
    suffix: str = "_ordered"

    def transform_train(self, df: DataFrame, hot_rows: int | None = None) -> DataFrame:
        out = df.withColumn("__one", F.lit(1).cast("long")).withColumn("__y", F.col(self.cols.label).cast("double"))
        for c in self.names:
            got = over_key(out, c, [Running("__n", "__one"), Running("__s", "__y")], self.cols, hot_rows=hot_rows,
                           source=df)
            value = (F.col("__s") - F.col("__y") + self.prior) / F.col("__n")
            out = got.withColumn(f"{c}{self.suffix}", value).drop("__n", "__s")
        return out.drop("__one", "__y")

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.table.withColumn("v", (F.col("pos") + self.prior) / (F.col("n") + 1))
        return TableEncoder(t, self.names, ["v"], {"v": self.prior}, suffix=self.suffix).transform(df)


def overall_rate(df: DataFrame, cols: Columns = DEFAULT) -> float:
    return df.agg(F.avg(F.col(cols.label).cast("double"))).first()[0]


def ordered_target_encoder(df: DataFrame, names: list[str], cols: Columns = DEFAULT) -> OrderedTargetEncoder:
    return OrderedTargetEncoder(category_table(df, names, cols.label), names, overall_rate(df, cols), cols)


def target_encoder(df: DataFrame, names: list[str], smoothing: float = 10.0, min_leaf: float = 20.0,
                   cols: Columns = DEFAULT) -> TableEncoder:
    """Category mean shrunk to the prior by a logistic weight of the category size; single rows get the prior."""
    prior = overall_rate(df, cols)
    n = F.col("n")
    s = 1 / (1 + F.exp(-(n - min_leaf) / smoothing))
    v = F.when(n == 1, F.lit(prior)).otherwise(prior * (1 - s) + F.col("pos") / n * s)
    t = category_table(df, names, cols.label).select("column", "category", v.alias("v"))
    return TableEncoder(t, names, ["v"], {"v": prior}, suffix="_target")


def woe_encoder(df: DataFrame, names: list[str], regularization: float = 1.0, cols: Columns = DEFAULT) -> TableEncoder:
    """Weight of evidence with additive regularisation; unseen categories get 0."""
    total = df.agg(F.count("*").alias("n"), F.sum(F.col(cols.label).cast("double")).alias("p")).first()
    pos, neg, r = F.col("pos"), F.col("n") - F.col("pos"), regularization
    v = F.log(((pos + r) / (total["p"] + 2 * r)) / ((neg + r) / (total["n"] - total["p"] + 2 * r)))
    t = category_table(df, names, cols.label).select("column", "category", v.alias("v"))
    return TableEncoder(t, names, ["v"], {"v": 0.0}, suffix="_woe")


def gaussian_noise(id_col: str, seed: int | str) -> Column:
    """Standard normal noise from the row id (Box-Muller on two hashes)."""
    u = F.greatest(hash_unit(id_col, f"{seed}a"), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(hash_unit(id_col, f"{seed}b") * 6.283185307179586)


def add_train_noise(df: DataFrame, names: list[str], sigma: float = 0.05, seed: int = 0, cols: Columns = DEFAULT) -> DataFrame:
    """Multiply encoded training columns by ``1 + sigma * noise``."""
    return df.withColumns({c: F.col(c) * (1 + sigma * gaussian_noise(cols.id, f"{seed}{c}")) for c in names})


MAX_SIMILARITY_CATEGORIES = 1000


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


# Both sides of the pairs are dealt in so many blocks; a block meets every other block in a group of its own.
PAIR_BLOCKS = 16


def string_ratio(a: Column, b: Column) -> Column:
    """2*M/T ratio of two names, computed in the tasks."""
    def ratio(x, y):
        from difflib import SequenceMatcher
        return SequenceMatcher(None, x, y).ratio()
    return F.udf(ratio, "double")(a, b)


def similarity_table(df: DataFrame, name: str, vectors: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(category, other, v): similarity of every known category to every fitted one, joined block by block.

    With ``least`` string pairs whose lengths bound the ratio by it are left out before they are compared.
    """
    cats = df.select(F.col(name).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    if vectors is None:
        known = fitted = cats.withColumn("vector", F.lit(None).cast("array<double>"))
    else:
        v = vectors.select(F.col("category").cast("string").alias("category"), "vector")
        fitted = attach(cats, v, "category")
        known = v.unionByName(fitted.where("vector IS NULL"))
    block, every = F.pmod(F.xxhash64("category"), F.lit(PAIR_BLOCKS)), F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1)).cast("array<long>"))
    left = known.select("category", "vector", block.alias("i"), every.alias("j"))
    right = fitted.select(F.col("category").alias("other"), F.col("vector").alias("w"), every.alias("i"), block.alias("j"))
    value = string_ratio(F.col("category"), F.col("other")) if vectors is None else F.coalesce(cosine(F.col("vector"), F.col("w")), F.lit(0.0))
    pairs = left.join(right, ["i", "j"])
    if vectors is None and least is not None:
        a, b = F.length("category"), F.length("other")
        pairs = pairs.where((a + b == 0) | (2.0 * F.least(a, b) > least * (a + b)))
    return pairs.select("category", "other", value.alias("v"))


def similarity_encoder(df: DataFrame, name: str, vectors: DataFrame | None = None) -> TableEncoder:
    """One column per fitted category: similarity of the row's category to it.

    ``vectors`` is a (category, vector) table compared by cosine, 0 for a missing vector; without it the string ratio is used. More categories than
    ``MAX_SIMILARITY_CATEGORIES`` give one array column ``<name>_similarity`` instead, in the order of the sorted fitted categories.
    """
    cats = df.select(F.col(name).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    values = sorted(r[0] for r in cats.limit(MAX_SIMILARITY_CATEGORIES + 1).collect())
    pairs = similarity_table(df, name, vectors)
    if len(values) > MAX_SIMILARITY_CATEGORIES:
        # a category may have several vectors, as in the columns the highest similarity counts
        one = pairs.groupBy("category", "other").agg(F.max("v").alias("v"))
        rows = one.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("other", "v"))).getField("v").alias("similarity"))
        return TableEncoder(rows.withColumn("column", F.lit(name)), [name], ["similarity"], suffix="_similarity")
    wide = pairs.groupBy("category").agg(*[F.max(F.when(F.col("other") == x, F.col("v"))).alias(x) for x in values])
    return TableEncoder(wide.withColumn("column", F.lit(name)), [name], values)


def one_hot(df: DataFrame, names: list[str], values: dict[str, list[str]] | None = None) -> DataFrame:
    """One 0/1 column per fitted category; unseen categories are all zeros."""
    values = values or {c: category_values(df, c) for c in names}
    return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c in names for v in values[c]})


# ------------------------------------------------------------------ scalers

@dataclass
class LinearScaler:
    """``(x - shift) / scale`` per column."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(float(a))) / F.lit(float(b)) for c, (a, b) in self.params.items()})


def _non_zero(x: float | None) -> float:
    return float(x) if x else 1.0


def standard_scaler(df: DataFrame, names: list[str]) -> LinearScaler:
    """Mean and population standard deviation (0 becomes 1)."""
    r = df.agg(*[e for c in names for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return LinearScaler({c: (r[f"m_{c}"], _non_zero(r[f"s_{c}"])) for c in names})


def robust_scaler(df: DataFrame, names: list[str]) -> LinearScaler:
    """Exact median and interquartile range (0 becomes 1)."""
    q = exact_quantile_row(df, names, [0.25, 0.5, 0.75])
    return LinearScaler({c: (q[c][1], _non_zero(q[c][2] - q[c][0])) for c in names})


def minmax_scaler(df: DataFrame, names: list[str]) -> LinearScaler:
    r = df.agg(*[e for c in names for e in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"))]).first()
    return LinearScaler({c: (r[f"a_{c}"], _non_zero(r[f"b_{c}"] - r[f"a_{c}"])) for c in names})


# ------------------------------------------------------------------ interactions

def interactions(df: DataFrame, names: list[str], degree: int = 2) -> DataFrame:
    """Products of distinct numeric columns for every size from 2 to ``degree``."""
    out = {}
    for n in range(2, degree + 1):
        for g in combinations(names, n):
            product = F.col(g[0]).cast("double")
            for c in g[1:]:
                product = product * F.col(c)
            out["*".join(g)] = product
    return df.withColumns(out)


def encoded_interactions(df: DataFrame, numeric: list[str], encoder: TableEncoder | OrderedTargetEncoder | None,
                         degree: int = 2, train: bool = True) -> DataFrame:
    """Encode the categorical inputs, then multiply; the ordered encoder uses earlier labels on training rows."""
    if encoder is None:
        return interactions(df, numeric, degree)
    if isinstance(encoder, OrderedTargetEncoder) and train:
        out = encoder.transform_train(df)
    else:
        out = encoder.transform(df)
    coded = [f"{c}{encoder.suffix}" for c in encoder.names]
    return interactions(out, [*numeric, *coded], degree)
