"""Boosted trees on histograms of first and second derivatives.

Features become bins of their exact quantiles once. Every level of a tree is one aggregate of gradient and hessian sums by (node, feature, bin), combined map-side, so a
shuffle carries nodes x features x bins rows whatever the table; running sums over the bins give the gain of every split in Spark, and one row per node, the
best split, reaches the driver. Penalties, child weight, samples of rows and columns, class weight and random thresholds are those of the booster family.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log
from zlib import crc32

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.functions.scale import checkpoint, exact_quantile_row, hash_unit
from txrisk.schema import DEFAULT, Columns

# Margins are written and lineage is cut after so many trees.
CUT_EVERY = 5
SUMS = ("n", "g", "h")


@dataclass(frozen=True)
class Boosting:
    """``rows`` and ``columns`` are shares drawn per tree by seeded hash; ``random_splits`` tries one hashed threshold per node and feature."""

    n_trees: int = 30
    depth: int = 3
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    bins: int = 32
    rows: float = 1.0
    columns: float = 1.0
    positive_weight: float = 1.0
    random_splits: bool = False
    seed: int = 0


@dataclass
class Tree:
    """Splits (feature, bin) and leaf values by node; the children of node n are 2n, which has bins up to the split's, and 2n + 1, which has the others and missing values."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, goes_left, leaf, node: int = 1) -> Column:
        if node not in self.splits:
            return leaf(node)
        return F.when(goes_left(*self.splits[node]), self.walk(goes_left, leaf, 2 * node)).otherwise(self.walk(goes_left, leaf, 2 * node + 1))


def quantile_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Ascending distinct cuts of every feature: its quantiles at i / bins; a feature without values has none."""
    values = [F.col(f"`{f}`").cast("double") for f in features]
    some = df.agg(*[F.count(F.when(~F.isnan(v), 1)) for v in values]).first()
    found = exact_quantile_row(df, known, [i / bins for i in range(1, bins)]) if (known := [f for f, n in zip(features, some) if n]) else {}
    return [sorted({v for v in found.get(f, ()) if v is not None}) for f in features]


def _binned(df: DataFrame, features: list[str], edges: list[list[float]]) -> Column:
    """Bins of a row: how many cuts lie below the value; a missing value has the bin after the last."""
    def one(name: str, cuts: list[float]) -> Column:
        v = df[name].cast("double")
        below = sum(((v > F.lit(e)).cast("int") for e in cuts), F.lit(0))
        return F.when(v.isNull() | F.isnan(v), len(cuts) + 1).otherwise(below)
    return F.array(*[one(f, e) for f, e in zip(features, edges)])


def _prepared(df: DataFrame, features: list[str], edges: list[list[float]], p: Boosting, label: str, id_col: str) -> tuple[DataFrame, float]:
    """(id, y, w, bins) of rows with a label, and the margin to start from."""
    y = df[label].cast("double")
    rows = df.select(df[id_col].cast("string").alias("id"), y.alias("y"), F.when(y > 0, F.lit(float(p.positive_weight))).otherwise(1.0).alias("w"),
                     _binned(df, features, edges).alias("bins")).where("y IS NOT NULL")
    pos, every = rows.agg(F.sum(F.col("w") * F.col("y")), F.sum("w")).first()
    return rows, log(pos / (every - pos)) if pos and every > pos else 0.0


def _with_derivatives(rows: DataFrame, margin: Column) -> DataFrame:
    q = 1 / (1 + F.exp(-margin))
    return rows.withColumn("__q", q).withColumns({"g": F.col("w") * (F.col("__q") - F.col("y")), "h": F.col("w") * F.col("__q") * (1 - F.col("__q"))}).drop("__q")


def histogram(rows: DataFrame, node: Column, features: list[int]) -> DataFrame:
    """(node, feature, bin, n, g, h) of rows with bins and derivatives; rows whose node is null are left out."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col("bins")[f].alias("bin")) for f in features])
    long = rows.withColumn("node", node).where("node IS NOT NULL").select("node", "g", "h", F.explode(cells).alias("c"))
    return long.groupBy("node", F.col("c.feature").alias("feature"), F.col("c.bin").alias("bin")).agg(
        F.count("*").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def split_gains(cells: DataFrame, p: Boosting) -> DataFrame:
    """(node, feature, bin, gain, left and whole sums) of every split that leaves both children enough weight."""
    group = W.partitionBy("node", "feature")   # at most one row per bin
    upto = group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    s = cells.select("node", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}_left") for c in SUMS], *[F.sum(c).over(group).alias(f"{c}_all") for c in SUMS])

    def score(g: Column, h: Column) -> Column:
        shrunk = F.greatest(F.abs(g) - p.l1, F.lit(0.0))
        return shrunk * shrunk / (h + p.l2)
    right_g, right_h = F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left")
    gain = 0.5 * (score(F.col("g_left"), F.col("h_left")) + score(right_g, right_h) - score(F.col("g_all"), F.col("h_all"))) - p.gamma
    return s.where((F.col("n_left") < F.col("n_all")) & (F.col("h_left") >= p.min_child) & (right_h >= p.min_child)).withColumn("gain", gain)


def _best(cells: DataFrame, p: Boosting, tree: int) -> list:
    """One row per node: the split of the highest gain; of equal ones the first feature and bin."""
    gains = split_gains(cells, p)
    if p.random_splits:
        seen = W.partitionBy("node", "feature")
        u = hash_unit(F.concat_ws("|", "node", "feature"), f"{p.seed}|{tree}|cut")
        low, high = F.min("bin").over(seen), F.max("bin").over(seen)
        gains = gains.withColumn("__cut", low + F.floor(u * (high - low + 1))).where(F.col("bin") == F.col("__cut"))
    best = F.max_by(F.struct("feature", "bin", "g_left", "h_left", "g_all", "h_all"), F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin")))
    return gains.where(F.round("gain", 9) > 0).groupBy("node").agg(best.alias("s")).select("node", "s.*").collect()


class HistogramBooster:
    """A fitted booster: cuts and trees."""

    def __init__(self, features: list[str], edges: list[list[float]], base: float, trees: list[Tree], rate: float):
        self.features, self.edges, self.base, self.trees, self.rate = features, edges, base, trees, rate

    def values(self, df: DataFrame) -> Column:
        """What each tree adds to the margin of a row, as one list."""
        def goes_left(f: int, b: int) -> Column:
            v, cuts = df[self.features[f]].cast("double"), self.edges[f]
            known = v.isNotNull() & ~F.isnan(v)
            return known & (v <= F.lit(cuts[b])) if b < len(cuts) else known
        return F.array(*[t.walk(goes_left, lambda n, t=t: F.lit(t.leaves[n])) for t in self.trees]).cast("array<double>")

    def transform(self, df: DataFrame, name: str = "predictions") -> DataFrame:
        """Adds the fraud probability."""
        margin = F.aggregate(self.values(df), F.lit(float(self.base)), lambda a, x: a + x)
        return df.withColumn(name, 1 / (1 + F.exp(-margin)))

    def stages(self, df: DataFrame, threshold: float = 0.5, cols: Columns = DEFAULT) -> DataFrame:
        """(n_trees, f1) of every number of first trees, from one aggregate."""
        margins = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(self.trees)))), lambda k: F.aggregate(F.slice("__v", 1, k), F.lit(float(self.base)), lambda a, x: a + x))
        rows = df.select(df[cols.label].alias("y"), self.values(df).alias("__v")).select("y", F.posexplode(margins).alias("k", "m"))
        hit, true = 1 / (1 + F.exp(-F.col("m"))) >= threshold, F.col("y") == 1
        count = lambda c: F.sum(c.cast("long"))
        f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
        return rows.groupBy((F.col("k") + 1).alias("n_trees")).agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn")).select("n_trees", f1.alias("f1"))

    def best_stage(self, validation: DataFrame, threshold: float = 0.5, cols: Columns = DEFAULT) -> HistogramBooster:
        """The booster cut after the number of trees with the highest F1; of equal ones the smallest."""
        best = self.stages(validation, threshold, cols).orderBy(F.desc("f1"), "n_trees").first()
        return HistogramBooster(self.features, self.edges, self.base, self.trees[:best["n_trees"]] if best else self.trees, self.rate)


def root_gains(df: DataFrame, features: list[str], p: Boosting = Boosting(), cols: Columns = DEFAULT) -> DataFrame:
    """(feature, bin, gain) of every split of the first node of the first tree."""
    edges = quantile_edges(df, features, p.bins)
    rows, base = _prepared(df, features, edges, p, cols.label, cols.id)
    cells = histogram(_with_derivatives(rows, F.lit(base)), F.lit(1), list(range(len(features))))
    names = F.array(*[F.lit(f) for f in features])
    return split_gains(cells, p).select(names[F.col("feature")].alias("feature"), "bin", "gain")


def fit_booster(df: DataFrame, features: list[str], p: Boosting = Boosting(), cols: Columns = DEFAULT) -> HistogramBooster:
    """Boost by log loss. Rows without a label are left out; missing values go right; a table with one class gives trees that add nothing."""
    edges = quantile_edges(df, features, p.bins)
    rows, base = _prepared(df, features, edges, p, cols.label, cols.id)
    table, since, trees = checkpoint(rows.withColumn("margin", F.lit(float(base)))), F.col("margin"), []
    for t in range(p.n_trees):
        order = sorted(range(len(features)), key=lambda f: crc32(f"{p.seed}|{t}|{f}".encode()))
        own = sorted(order[:max(1, round(p.columns * len(features)))])
        drawn = table if p.rows >= 1 else table.where(hash_unit("id", f"{p.seed}|{t}") < p.rows)
        drawn = _with_derivatives(drawn, since)
        tree, sums = Tree(), {}
        left = lambda f, b: F.col("bins")[f] <= b
        for level in range(p.depth):
            at = tree.walk(left, lambda n, level=level: F.lit(n if n.bit_length() == level + 1 else None).cast("int"))
            found = _best(histogram(drawn, at, own), p, t)
            for r in found:
                n = r["node"]
                tree.splits[n] = (r["feature"], r["bin"])
                sums.pop(n, None)
                sums[2 * n], sums[2 * n + 1] = (r["g_left"], r["h_left"]), (r["g_all"] - r["g_left"], r["h_all"] - r["h_left"])
            if not found:
                break
        if not tree.splits:
            break
        tree.leaves = {n: -p.rate * max(abs(g) - p.l1, 0.0) * (1 if g > 0 else -1) / (h + p.l2) for n, (g, h) in sums.items()}
        trees.append(tree)
        since = since + tree.walk(left, lambda n, tree=tree: F.lit(tree.leaves[n]))
        if (t + 1) % CUT_EVERY == 0 and t + 1 < p.n_trees:
            table, since = checkpoint(table.withColumn("margin", since)), F.col("margin")
    return HistogramBooster(features, edges, base, trees, p.rate)
