"""Exact k-nearest-neighbour join.

Neighbours are ordered by (distance, id). Three exact routes:

* few reference rows (their number is checked): the reference matrix is broadcast and every query batch is
  compared with it;
* one number a vector: value buckets borrow the k outermost values of the buckets beside them, so the k nearest values of a
  query lie in its bucket, around the query's place in the order, and the work grows with the values;
* otherwise reference rows are grouped around pivots and, inside a pivot's cell, into rings of similar
  distance to the pivot. A query searches the nearest ring of its own cell first. The k-th distance found there bounds
  its neighbours, the distances to the pivots bound every ring, so it only visits the other rings that can hold a neighbour (Lu et al., VLDB 2012;
  Jagadish et al., TODS 2005). Crowded rings and crowded query groups are split by hash.

Copies cannot pile up: distinct vectors are compared, a reference vector carries the smallest ids of its rows (no others
can be neighbours), and equal query vectors are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from txrisk.functions.scale import attach, hash_u32, keep, num_partitions

MAX_BROADCAST_REFS = 20_000
MAX_BROADCAST_CELLS = 4_000_000   # rows x dimensions of a broadcast matrix
RING_ROWS = 2_000                 # reference vectors per ring
QUERY_ROWS = 5_000                # queries per task group
BLOCK = 256                       # rows whose distances to all pivots or rings fit the processor's cache
MAX_PIVOTS = 1_024
BUCKET_VALUES = 20_000            # values of a bucket of the search among numbers


def vector(names: list[str]):
    return F.array(*[F.col(c).cast("double") for c in names])


def _whole(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A list column in one piece, of the type Spark expects back: elements that may be null."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.cast(pa.list_(col.type.value_type))


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel(), kind))


def _distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(r)))
    for j in range(r.shape[1]):
        d = q[:, j, None] - r[None, :, j]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def attach_vectors(df: DataFrame, stats: DataFrame, vec: str, how: str = "left") -> DataFrame:
    """``attach`` by a vector; a hash in front spares the sort from comparing arrays."""
    hashed = lambda x: x.withColumn("__h", F.xxhash64(_plain_zero(vec)))
    return attach(hashed(df), hashed(stats), ["__h", vec], how).drop("__h")


def _plain_zero(vec: str) -> Column:
    """Equal vectors with one hash: without the sign of zero."""
    return F.transform(vec, lambda x: x + F.lit(0.0))


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k smallest (distance, id) per row; columns must be in id order."""
    k = min(k, d.shape[1])
    if d.shape[1] <= 4 * k:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    picks = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(d, picks, axis=1)
    picks = np.take_along_axis(picks, np.argsort(near, axis=1, kind="stable"), axis=1)
    # ties across the cut are decided by id
    for i in np.flatnonzero((d <= near.max(axis=1)[:, None]).sum(axis=1) > k):
        c = np.flatnonzero(d[i] <= near[i].max())
        picks[i] = c[np.argsort(d[i][c], kind="stable")[:k]]
    return picks


def _numbered(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order, and the rows of every vector as numbers in that order: one line a vector, filled up with a number beyond all."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    number = np.empty(len(flat), dtype=np.int64)
    number[order] = np.arange(len(flat))
    widths = ids.value_lengths().to_numpy()
    rows = np.full((len(ids), widths.max()), len(flat))
    rows[np.arange(rows.shape[1]) < widths[:, None]] = number
    return flat[order], rows


def _nearest_rows(got: np.ndarray, dist: np.ndarray, n: int, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest of every line of numbered rows, by (distance, id)."""
    dist[got == beyond] = np.inf
    best = np.lexsort((got, dist), axis=-1)[:, :n]
    return np.take_along_axis(got, best, axis=1), np.take_along_axis(dist, best, axis=1)


def _answer(vectors: pa.Array, ids: pa.Array, near: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    return pa.table({"__v": vectors, "rid": _lists(np.concatenate([x[0] for x in near]), ids.type.value_type),
                     "distance": _lists(np.concatenate([x[1] for x in near]), pa.float64())})


def _pairs(vectors: pa.Array, r: np.ndarray, ids: pa.Array, k: int) -> pa.Table:
    """The k nearest rows of every query; ``ids`` are the rows of each reference vector in order."""
    q = _matrix(vectors)
    flat, rows = _numbered(ids)
    by_id = np.argsort(rows[:, 0])
    r, rows = r[by_id], rows[by_id]
    # k nearest vectors hold the k nearest rows, and fewer vectors than that are all of them
    n = min(k, len(flat))
    step = max(1, 2_000_000 // max(len(r), n * rows.shape[1]))
    near = []
    for a in range(0, len(q), step):
        d = _distances(q[a:a + step], r)
        p = _smallest(d, k)
        got, dist = rows[p].reshape(len(p), -1), np.repeat(np.take_along_axis(d, p, axis=1), rows.shape[1], axis=1)
        if rows.shape[1] > 1:
            got, dist = _nearest_rows(got, dist, n, len(flat))
        near.append((flat[got], dist))
    return _answer(vectors, ids, near)


def knn_join(queries: DataFrame, refs: DataFrame, k: int, qid: str, rid: str, vec: str = "vec",
             exclude_self: bool = False, max_broadcast: int = MAX_BROADCAST_REFS, lists: bool = False) -> DataFrame:
    """(qid, rank, neighbour, distance): the k nearest reference rows of every query row.

    ``vec`` is an array<double> column of both tables. ``exclude_self`` drops the reference row with the
    query's own id. With ``lists`` a query row is one row (id, vec, near), its neighbours a list of (distance, rid) in order.
    """
    need = k + 1 if exclude_self else k
    r = refs.select(F.col(rid).alias("rid"), F.col(vec).alias("__v")).withColumn("__h", F.xxhash64(_plain_zero("__v")))
    w = W.partitionBy("__h", "__v").orderBy("rid")   # sorting compares hashes, hardly ever arrays
    r = r.withColumn("__c", F.row_number().over(w)).where(F.col("__c") <= need)
    r = keep(r.groupBy("__h", "__v").agg(F.sort_array(F.collect_list("rid")).alias("ids")).drop("__h"))   # at most k + 1 ids
    # an explicit count keeps the compute-heavy search spread out even when the rows are small
    q = queries.select(F.col(vec).alias("__v")).repartition(num_partitions(queries.sparkSession), "__v").distinct()
    head = r.limit(max_broadcast + 1).select(F.size("__v").alias("d")).agg(F.count("*"), F.max("d")).first()
    n, dim = head[0], head[1] or 1
    if n == 0:
        raise ValueError("there are no reference rows")
    pairs = F.arrays_zip("distance", "rid")
    if n <= max_broadcast and n * dim <= MAX_BROADCAST_CELLS:
        merged = _broadcast_search(q, r, need).select("__v", pairs.alias("__l"))   # complete and in order
    else:
        line = _line_search(q, r, need) if dim == 1 else None
        if line is not None:
            merged = line.select("__v", pairs.alias("__l"))
        else:
            found = _ring_search(q, r, need).select(F.xxhash64("__v").alias("__h"), "__v", F.explode(pairs).alias("x")).select("__h", "__v", "x.*")
            best = W.partitionBy("__h", "__v").orderBy("distance", "rid")
            found = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= need)
            # at most k + 1 entries per distinct query vector
            merged = found.groupBy("__h", "__v").agg(F.sort_array(F.collect_list(F.struct("distance", "rid"))).alias("__l")).drop("__h")
    out = attach_vectors(queries.select(F.col(qid).alias("qid"), F.col(vec).alias("__v")), merged, "__v")
    if exclude_self:
        out = out.withColumn("__l", F.filter("__l", lambda x: x["rid"] != F.col("qid")))
    out = out.withColumn("__l", F.slice("__l", 1, k))
    if lists:
        return out.select(F.col("qid").alias(qid), F.col("__v").alias(vec), F.col("__l").alias("near"))
    return out.select("qid", F.posexplode("__l").alias("rank", "x")).select(
        "qid", (F.col("rank") + 1).alias("rank"), F.col("x.rid").alias("neighbour"), F.col("x.distance").alias("distance"))


def _schema(r: DataFrame) -> str:
    return f"__v array<double>, rid {r.schema['ids'].dataType.simpleString()}, distance array<double>"


def _broadcast_search(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    kind = r.schema["ids"].dataType.elementType
    rows = r.collect()   # number and size checked by the caller
    shared = q.sparkSession.sparkContext.broadcast(([x["ids"] for x in rows], np.array([x["__v"] for x in rows], dtype=float)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mat = shared.value
        ids = pa.array(ids, pa.list_(to_arrow_type(kind)))
        for b in batches:
            if b.num_rows:
                yield from _pairs(_whole(b["__v"]), mat, ids, k).to_batches()

    return q.mapInArrow(search, _schema(r))


def _line_search(q: DataFrame, r: DataFrame, k: int) -> DataFrame | None:
    """The k nearest rows of every query number; None where null, NaN or infinite numbers leave no order."""
    x = F.col("__v")[0]
    odd = F.sum((x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (F.size("__v") != 1)).cast("int"))
    if any(t.agg(odd).first()[0] for t in (q, r)):
        return None
    n = max(2, 4 * num_partitions(q.sparkSession), r.count() // BUCKET_VALUES)
    cuts = sorted(set(r.select(x.alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 1.0 / (4 * n))))
    place = F.pandas_udf(lambda v: pd.Series(np.searchsorted(cuts, v.to_numpy(dtype=float), side="left").astype("int32")), "int")
    refs = r.withColumn("x", x).withColumn("b", place("x"))
    sizes = {c["b"]: c["count"] for c in refs.groupBy("b").count().collect()}   # one row a bucket
    # neighbouring buckets are one until each has k values; what is left over joins the last
    merged, last, held = np.zeros(len(cuts) + 1, dtype=int), 0, 0
    for b in range(len(cuts) + 1):
        if held >= k:
            last, held = last + 1, 0
        merged[b], held = last, held + sizes.get(b, 0)
    if held < k and last:
        merged[merged == last] = last - 1
    group = F.element_at(F.lit(merged.tolist()), F.col("b") + 1)
    refs = keep(refs.withColumn("b", group))
    up, down = (W.partitionBy("b").orderBy(o) for o in (F.asc("x"), F.desc("x")))
    edges = [refs.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r").withColumn("b", F.col("b") + step) for w, step in ((up, -1), (down, 1))]
    near = refs.unionByName(edges[0]).unionByName(edges[1])
    asked = q.withColumn("x", x).withColumn("b", place("x")).withColumn("b", group)
    # crowded query groups are split
    load = {c["b"]: c["count"] for c in asked.groupBy("b").count().collect()}
    salts = F.element_at(F.lit([int(-(-load.get(b, 1) // BUCKET_VALUES)) for b in range(last + 1)]), F.col("b") + 1)
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("__v"), salts).cast("int"))
    near = near.where(F.col("b").between(0, last)).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _no_answer(a, b)
        b = b.sort_by("x")
        x, ids = b["x"].to_numpy(), _whole(b["ids"])
        flat, rows = _numbered(ids)
        rows = np.vstack([rows, np.full((1, rows.shape[1]), len(flat))])   # beyond both ends
        values, near = a["x"].to_numpy(), []
        step = max(1, 1_000_000 // (2 * k * rows.shape[1]))
        for lo in range(0, len(values), step):
            part = values[lo:lo + step]
            c = np.searchsorted(x, part)[:, None] + np.arange(-k, k)[None, :]
            c = np.where((c < 0) | (c >= len(x)), len(x), c)
            d = np.abs(np.append(x, np.inf)[c] - part[:, None])
            got, dist = _nearest_rows(rows[c].reshape(len(part), -1), np.repeat(d, rows.shape[1], axis=1), min(k, len(flat)), len(flat))
            near.append((flat[got], dist))
        return _answer(_whole(a["__v"]), ids, near)

    by = ["b", "salt"]
    parts = max(num_partitions(q.sparkSession), (last + 1) // 8)
    return asked.repartition(parts, *by).groupBy(*by).cogroup(near.repartition(parts, *by).groupBy(*by)).applyInArrow(search, _schema(r))


def _ring_search(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    spark = q.sparkSession
    n = r.count()
    n_pivots = int(min(MAX_PIVOTS, max(8, n // RING_ROWS)))
    picked = r.select("__v").orderBy(hash_u32(F.col("__v").cast("string"), 0)).limit(n_pivots).collect()
    pivots = np.array([x["__v"] for x in picked], dtype=float)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["__v"])
                cell, own = np.empty(len(x), dtype=np.int32), np.empty(len(x))
                for a in range(0, len(x), BLOCK):
                    d = _distances(x[a:a + BLOCK], pivots)
                    cell[a:a + BLOCK] = at = d.argmin(axis=1)
                    own[a:a + BLOCK] = d[np.arange(len(d)), at]
                yield pa.RecordBatch.from_arrays([_whole(b["__v"]), _whole(b["ids"]), pa.array(cell), pa.array(own)], names=["__v", "ids", "cell", "pd"])

    cells = keep(r.select("__v", "ids").mapInArrow(assign, f"__v array<double>, ids {r.schema['ids'].dataType.simpleString()}, cell int, pd double"))

    # ring limits per cell; the driver holds one number per RING_ROWS reference rows
    sizes = {x["cell"]: x["count"] for x in cells.groupBy("cell").count().collect()}
    rings = {c: int(-(-m // RING_ROWS)) for c, m in sizes.items()}
    limits: dict[int, list[float]] = {c: [] for c in sizes}
    for m in sorted(set(rings.values()) - {1}):
        many = [c for c in rings if rings[c] == m]
        probs = [i / m for i in range(1, m)]
        got = cells.where(F.col("cell").isin(many)).groupBy("cell").agg(
            F.percentile_approx("pd", F.array(*[F.lit(p) for p in probs]), max(1000, 4 * m)).alias("p")).collect()
        limits |= {x["cell"]: sorted(set(x["p"])) for x in got}
    longest = max(len(v) for v in limits.values())
    table = spark.createDataFrame([(c, v) for c, v in limits.items()], "cell int, lim array<double>")
    ringed = cells.join(F.broadcast(table), "cell") if longest else cells.withColumn("lim", F.array().cast("array<double>"))
    ringed = ringed.withColumn("ring", F.size(F.filter("lim", lambda x: x < F.col("pd")))).drop("lim")

    info = ringed.groupBy("cell", "ring").agg(F.min("pd").alias("a"), F.max("pd").alias("b"), F.count("*").alias("n")).collect()
    r_cell = np.array([x["cell"] for x in info])
    r_ring = np.array([x["ring"] for x in info])
    r_min, r_max = np.array([x["a"] for x in info]), np.array([x["b"] for x in info])
    parts_of = {(x["cell"], x["ring"]): int(-(-x["n"] // RING_ROWS)) for x in info}
    # the k smallest pivot distances of each cell bound the k-th neighbour distance of any query
    near_rows = cells.withColumn("__r", F.row_number().over(W.partitionBy("cell").orderBy("pd"))).where(F.col("__r") <= k)
    near_c, near_d = zip(*[(x["cell"], x["pd"]) for x in near_rows.select("cell", "pd").collect()])
    near_c, near_d = np.array(near_c), np.array(near_d)
    gaps = _distances(pivots, pivots)[:, r_cell]
    twice = np.where(gaps > 0, 2 * gaps, np.inf)
    order = np.argsort(r_cell, kind="stable")
    first, after = (np.searchsorted(r_cell[order], np.arange(n_pivots), side=s) for s in ("left", "right"))
    held = first < after

    def home_rings(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own cell by distances to the pivots, and the ring to begin with: the nearest of that cell."""
        own = d.argmin(axis=1)
        home = np.zeros(len(d), dtype=int)
        for c in np.unique(own[held[own]]):
            rows, rings = np.flatnonzero(own == c), order[first[c]:after[c]]
            to_pivot = d[rows, c][:, None]
            home[rows] = rings[np.maximum(to_pivot - r_max[rings], r_min[rings] - to_pivot).argmin(axis=1)]
        return own, home

    def lower_bounds(d: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What no row of a ring is nearer than."""
        to_pivot = d[:, r_cell]
        lower = np.maximum(to_pivot - r_max, r_min - to_pivot)
        # rows of another cell lie beyond the hyperplane between the two pivots
        to_pivot *= to_pivot
        to_pivot -= d[np.arange(len(d)), own][:, None] ** 2
        to_pivot /= twice[own]
        return np.maximum(np.maximum(lower, to_pivot, out=lower), 0.0, out=lower)

    def visit_rows(vectors: pa.Array, rows: np.ndarray, rings: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_whole(vectors.take(pa.array(rows))), pa.array(r_cell[rings].astype(np.int32)), pa.array(r_ring[rings].astype(np.int32))],
                                          names=["__v", "cell", "ring"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["__v"])
                home = np.concatenate([home_rings(_distances(x[a:a + BLOCK], pivots))[1] for a in range(0, len(x), BLOCK)])
                yield visit_rows(b["__v"], np.arange(len(x)), home)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, bounds, held_rows = _matrix(b["__v"]), b["bound"].to_numpy(zero_copy_only=False).astype(float), 0
            i, j = [], []
            for a in range(0, len(x), BLOCK):
                d, bound = _distances(x[a:a + BLOCK], pivots), bounds[a:a + BLOCK].copy()
                own, home = home_rings(d)
                lower = lower_bounds(d, own)
                open_ = np.flatnonzero(np.isnan(bound))   # fewer than k rows at home
                if len(open_):
                    upper = d[open_][:, near_c] + near_d[None, :]
                    kth = min(k, upper.shape[1]) - 1
                    bound[open_] = np.partition(upper, kth, axis=1)[:, kth]
                lower[np.arange(len(d)), home] = np.inf   # searched already
                slack = 1e-9 * (1.0 + np.abs(bound))
                rows, rings = np.nonzero(lower <= (bound + slack)[:, None])
                i.append(rows + a)
                j.append(rings)
                held_rows += len(rows)
                if held_rows > 100_000:
                    yield visit_rows(b["__v"], np.concatenate(i), np.concatenate(j))
                    i, j, held_rows = [], [], 0
            if held_rows:
                yield visit_rows(b["__v"], np.concatenate(i), np.concatenate(j))

    visit = "__v array<double>, cell int, ring int"
    at_home = keep(_search_rings(keep(q.mapInArrow(homes, visit)), ringed, parts_of, k, _schema(r)))
    # the k-th distance at home is far below what the pivots tell, so few other rings are left
    bounds = at_home.groupBy("__v").agg(F.min(F.when(F.size("distance") >= k, F.element_at("distance", k))).alias("bound"))
    return at_home.unionByName(_search_rings(keep(bounds.mapInArrow(visits, visit)), ringed, parts_of, k, _schema(r)))


def _search_rings(seen: DataFrame, ringed: DataFrame, parts_of: dict[tuple[int, int], int], k: int, schema: str) -> DataFrame:
    """The k nearest rows of every (query, ring) in ``seen``; crowded rings and query groups are split."""
    spark = seen.sparkSession
    load = {(x["cell"], x["ring"]): x["count"] for x in seen.groupBy("cell", "ring").count().collect()}
    # rings without queries stay where they are
    plan = spark.createDataFrame([(*ring, parts_of[ring], int(-(-n // QUERY_ROWS))) for ring, n in load.items()],
                                 "cell int, ring int, parts int, salts int")
    salt = F.pmod(F.xxhash64("__v"), F.col("salts")).cast("int")
    left = seen.join(F.broadcast(plan), ["cell", "ring"]).select(
        "__v", "cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt.alias("salt"))
    part = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("parts")).cast("int")
    right = ringed.join(F.broadcast(plan), ["cell", "ring"]).select(
        "ids", "__v", "cell", "ring", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    by = ["cell", "ring", "part", "salt"]

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _no_answer(a, b)
        return _pairs(_whole(a["__v"]), _matrix(b["__v"]), _whole(b["ids"]), k)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, schema)


def _no_answer(a: pa.Table, b: pa.Table) -> pa.Table:
    return pa.table({"__v": _whole(a["__v"])[:0], "rid": _whole(b["ids"])[:0], "distance": pa.array([], pa.list_(pa.float64()))})
