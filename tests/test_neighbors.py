"""The neighbour search: rings that no query visits, and tables of copies."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import neighbors as N


def _plain(points, queries, k):
    out = []
    for i in queries:
        near = sorted((float(np.linalg.norm(np.subtract(points[i], p))), j) for j, p in points.items() if j != i)
        out += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(near[:k])]
    return out


def _found(nn):
    return sorted((r["qid"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in nn.collect())


@pytest.mark.parametrize("max_broadcast", [10, 20_000])
@pytest.mark.parametrize("values", [1000, 40, 2])
def test_few_queries_and_copies(spark, monkeypatch, max_broadcast, values):
    monkeypatch.setattr(N, "RING_ROWS", 20)
    rng = np.random.default_rng(values)
    different = rng.integers(0, 30, (values, 2)).astype(float).tolist()
    points = {i: different[i % values] for i in range(600)}
    refs = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    queries = [3, 300, 301]
    got = N.knn_join(refs.where(F.col("id").isin(queries)), refs, 7, "id", "id", exclude_self=True, max_broadcast=max_broadcast)
    assert _found(got) == _plain(points, queries, 7)


def test_text_ids(spark, monkeypatch):
    monkeypatch.setattr(N, "RING_ROWS", 20)
    points = {f"r{i:03d}": [float(i % 50), float(i % 3)] for i in range(400)}
    refs = spark.createDataFrame(list(points.items()), "id string, vec array<double>")
    got = N.knn_join(refs.where("id < 'r005'"), refs, 4, "id", "id", exclude_self=True, max_broadcast=10)
    assert _found(got) == _plain(points, sorted(points)[:5], 4)


def test_copies_are_scored_once(spark, monkeypatch):
    """Scores of a table in itself: every copy as a search of all rows finds it, from one query a vector."""
    from txrisk.operators import outliers as O
    rng = np.random.default_rng(1)
    different = rng.integers(0, 9, (60, 2)).astype(float).tolist()
    rows = [(i, *different[i % 60]) for i in range(150)] + [(i, 1.0, 1.0) for i in range(150, 170)]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, a double, b double")
    asked, plain = [], N.knn_join
    monkeypatch.setattr(O, "knn_join", lambda q, *args, **more: asked.append(q.count()) or plain(q, *args, **more))
    for score, name in ((O.knn_distance, "knn"), (O.abod, "abod")):
        got, want = ({r["TRANSACTION_ID"]: r[name] for r in score(df, ["a", "b"], 5, refs=refs).collect()} for refs in (None, df))
        assert len(want) == 170 and got == {i: pytest.approx(x, abs=1e-12) for i, x in want.items()}
    few = len({r[1:] for r in rows})
    assert asked == [few, 170, few, 170]


def test_few_rings_are_visited(spark, monkeypatch):
    """The k-th distance in the nearest ring leaves few other rings to a query."""
    monkeypatch.setattr(N, "RING_ROWS", 50)
    rng = np.random.default_rng(3)
    points = {i: v for i, v in enumerate(rng.random((4000, 2)).tolist())}
    refs = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    visits, plain = [], N._search_rings
    monkeypatch.setattr(N, "_search_rings", lambda seen, *more: visits.append(seen.count()) or plain(seen, *more))
    got = N.knn_join(refs, refs, 5, "id", "id", exclude_self=True, max_broadcast=10)
    assert sorted(x for x in _found(got) if x[0] < 50) == _plain(points, range(50), 5)
    assert visits[0] == 4000 and visits[1] < 3 * 4000   # of 80 rings a query


def test_neighbour_scores_share_one_search(spark, monkeypatch):
    from txrisk.operators import outliers as O
    rng = np.random.default_rng(2)
    rows = [(i, *v) for i, v in enumerate(rng.integers(0, 12, (300, 2)).astype(float).tolist())]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, a double, b double")
    scores = lambda d, name: {r["TRANSACTION_ID"]: r[name] for r in d.collect()}
    want = {"knn": scores(O.knn_distance(df, ["a", "b"], 5), "knn"), "abod": scores(O.abod(df, ["a", "b"], 10), "abod")}
    searches, plain = [], O.knn_join
    monkeypatch.setattr(O, "knn_join", lambda *args, **more: searches.append(1) or plain(*args, **more))
    both = O.add_scores(df, ["a", "b"], ["knn", "abod"])
    assert len(searches) == 1
    for name in want:
        assert scores(both, name) == {i: pytest.approx(x, abs=1e-12) for i, x in want[name].items()}


@pytest.mark.parametrize("step", [1.0, 0.01])
def test_numbers_are_searched_in_order(spark, monkeypatch, step):
    """One number a vector: buckets of the order, no rings; the values of a bucket need not be many, queries may lie outside."""
    monkeypatch.setattr(N, "BUCKET_VALUES", 20)
    monkeypatch.setattr(N, "_ring_search", lambda *a: pytest.fail("searched rings"))
    rng = np.random.default_rng(5)
    points = {i: [float(round(v / step) * step)] for i, v in enumerate(rng.normal(0, 20, 500) ** 2)}
    points |= {500: [-1e6], 501: [-0.0], 502: [0.0], 503: [1e6]}
    refs = spark.createDataFrame(list(points.items()), "id long, vec array<double>")
    got = N.knn_join(refs, refs, 4, "id", "id", exclude_self=True, max_broadcast=10)
    assert _found(got) == _plain(points, points, 4)
    far = spark.createDataFrame([(1, [5e6]), (2, [-5e6]), (3, [77.7])], "id long, vec array<double>")
    few = {i: p for i, p in points.items() if i % 20 == 0 or i > 499}
    got = N.knn_join(far, refs.where(F.col("id").isin(list(few))), 3, "id", "id", max_broadcast=10)
    want = [(q, r + 1, j, round(d, 9)) for q, x in ((1, 5e6), (2, -5e6), (3, 77.7)) for r, (d, j) in enumerate(sorted((abs(p[0] - x), i) for i, p in few.items())[:3])]
    assert _found(got) == want


def test_scores_of_distinct_vectors_reach_their_rows_by_one_join(spark):
    from txrisk.operators import outliers as O
    rows = [(i, float(i % 40), 0.0 if i % 2 else -0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "TRANSACTION_ID long, a double, b double")
    names = ["hbos", "loda", "knn", "abod"]
    got = O.add_scores(df, ["a", "b"], names)
    assert got.columns == [*df.columns, *names]
    scored = {r["TRANSACTION_ID"]: r for r in got.collect()}
    assert len(scored) == 400 and all(x[n] is not None for x in scored.values() for n in names)
    for n, fit in (("hbos", O.hbos), ("loda", O.loda)):
        want = {r["TRANSACTION_ID"]: r[n] for r in fit(df, ["a", "b"]).transform(df, n).collect()}
        assert {i: r[n] for i, r in scored.items()} == {i: pytest.approx(x, abs=1e-12) for i, x in want.items()}
    asked = got._jdf.queryExecution().executedPlan().toString()
    assert asked.count("PythonUDF") + asked.count("ArrowEvalPython") > 0 and "TRANSACTION_ID" in asked
    # the id of a row is no join key: scores come by the vector
    assert not [line for line in asked.splitlines() if "Join" in line and "TRANSACTION_ID" in line.split("Join", 1)[1].split("]")[0]]
