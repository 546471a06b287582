"""The histogram booster against a plain build with numpy."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators.boosting import Boosting, fit_booster, quantile_edges
from txrisk.schema import Columns

COLS = Columns(id="i", label="y")
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(600):
        a, b = rng.gauss(0, 1), float(rng.randrange(5))
        c = rng.choice([None, math.nan, 1.0, 2.0])
        y = int(a + 0.4 * b + (1.5 if c == 2.0 else 0) + rng.gauss(0, 0.5) > 2)
        out.append((i, a, b, c, y if i % 50 else None))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "i long, a double, b double, c double, y int").repartition(6)


def plain(rows, edges, p):
    """Trees as dictionaries, one node after the other."""
    rows = [r for r in rows if r[4] is not None]
    missing = lambda v: v is None or math.isnan(v)
    bins = np.array([[len(e) + 1 if missing(v) else sum(v > x for x in e) for v, e in zip(r[1:4], edges)] for r in rows])
    y = np.array([r[4] for r in rows], float)
    w = np.where(y > 0, p.positive_weight, 1.0)
    margin = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum()))
    score = lambda g, h: max(abs(g) - p.l1, 0) ** 2 / (h + p.l2)
    trees = []
    for _ in range(p.n_trees):
        q = 1 / (1 + np.exp(-margin))
        g, h, splits, leaves = w * (q - y), w * q * (1 - q), {}, {}

        def grow(node, own, depth, g=g, h=h, splits=splits, leaves=leaves):
            best = None
            if depth < p.depth:
                for f in range(3):
                    for b in range(int(bins[own, f].min()) if own.any() else 0, int(bins[own, f].max()) if own.any() else 0):
                        left = own & (bins[:, f] <= b)
                        if not (own & (bins[:, f] == b)).any() or h[left].sum() < p.min_child or h[own].sum() - h[left].sum() < p.min_child:
                            continue
                        gain = 0.5 * (score(g[left].sum(), h[left].sum()) + score(g[own].sum() - g[left].sum(), h[own].sum() - h[left].sum()) - score(g[own].sum(), h[own].sum())) - p.gamma
                        if round(gain, 9) > 0 and (best is None or round(gain, 9) > best[0]):
                            best = (round(gain, 9), f, b, left)
            if best is None:
                s = g[own].sum()
                leaves[node] = -p.rate * max(abs(s) - p.l1, 0) * np.sign(s) / (h[own].sum() + p.l2)
                margin[own] += leaves[node]
                return
            splits[node] = best[1:3]
            grow(2 * node, best[3], depth + 1)
            grow(2 * node + 1, own & ~best[3], depth + 1)
        grow(1, np.ones(len(y), bool), 0)
        trees.append((splits, leaves))
    return trees, margin


@pytest.mark.parametrize("p", [Boosting(n_trees=7, bins=8), Boosting(n_trees=3, depth=4, l1=1.5, l2=0.5, gamma=0.05, min_child=4.0, positive_weight=20.0, bins=16)])
def test_trees_equal_a_plain_build(table, rows, p):
    model = fit_booster(table, FEATURES, p, COLS)
    trees, margin = plain(rows, model.edges, p)
    assert [t.splits for t in model.trees] == [s for s, _ in trees]
    for t, (_, leaves) in zip(model.trees, trees):
        assert t.leaves.keys() == leaves.keys() and all(abs(t.leaves[n] - leaves[n]) < 1e-9 for n in leaves)
    got = {r.i: r.predictions for r in model.transform(table).collect()}
    want = dict(zip([r[0] for r in rows if r[4] is not None], 1 / (1 + np.exp(-margin))))
    assert len(got) == len(rows) and all(abs(got[i] - v) < 1e-9 for i, v in want.items())


def test_samples_and_random_splits_do_not_depend_on_partitions(table):
    for p in (Boosting(n_trees=3, rows=0.6, columns=0.5, bins=8), Boosting(n_trees=3, random_splits=True, bins=8)):
        one, two = (fit_booster(t, FEATURES, p, COLS) for t in (table, table.orderBy(F.desc("a")).coalesce(1)))
        assert [t.splits for t in one.trees] == [t.splits for t in two.trees] and one.trees
        if p.columns < 1:
            assert all(len({f for f, _ in t.splits.values()}) <= 2 for t in one.trees)


def test_stages_and_edges(spark, table):
    model = fit_booster(table, FEATURES, Boosting(n_trees=5, bins=8), COLS)
    known = table.where("y IS NOT NULL")
    stages = {r.n_trees: r.f1 for r in model.stages(known, cols=COLS).collect()}
    best = model.best_stage(known, cols=COLS)
    assert set(stages) == {1, 2, 3, 4, 5} and stages[len(best.trees)] == max(stages.values())
    s = best.transform(known).agg(*[F.sum(F.expr(e).cast("int")).alias(n) for n, e in (("tp", "predictions >= 0.5 AND y = 1"), ("fp", "predictions >= 0.5 AND y = 0"), ("fn", "predictions < 0.5 AND y = 1"))]).first()
    assert abs(stages[len(best.trees)] - 2 * s.tp / (2 * s.tp + s.fp + s.fn)) < 1e-12
    for odd in (table.where("false"), table.where("y = 1"), table.withColumns({c: F.lit(None).cast("double") for c in FEATURES})):
        model = fit_booster(odd, FEATURES, Boosting(n_trees=2), COLS)
        assert model.transform(table).where("predictions IS NULL").isEmpty()
    assert quantile_edges(table.where("false"), FEATURES, 4) == [[], [], []]


def test_one_shuffle_per_level(table):
    from txrisk.operators import boosting as B
    edges = quantile_edges(table, FEATURES, 8)
    rows, base = B._prepared(table, FEATURES, edges, Boosting(), "y", "i")
    cells = B.histogram(B._with_derivatives(rows, F.lit(base)), F.lit(1), [0, 1, 2])
    plan = B.split_gains(cells, Boosting())._jdf.queryExecution().executedPlan().toString()
    # rows meet only in the aggregate; what follows moves one row per node, feature and bin
    assert plan.count("partial_sum") >= 1 and plan.split("partial_sum")[-1].count("Exchange") <= 1
