"""Embedding near-duplicates by dual traversal of cover trees.

Distinct vectors are dealt to cells around sampled pivots and to blocks of bounded size inside a cell; a task builds one cover tree per block: nested
levels of centres with halving radii, each node knowing its true covering radius. A task then walks two trees at once. A pair of nodes is dropped
when the centres are too far apart for any link, counted whole when all its members must link, and split otherwise, down to exact products.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txrisk.llm.common import components, store

# Vectors per tree on average; cells of more are split by hash.
BLOCK = 4096
# Bound on the pivots that the driver holds.
MAX_PIVOTS = 512
LEAF = 32
SLACK = 1e-9


def unit_rows(values) -> np.ndarray:
    """Rows scaled to length one in double precision; scaling by the largest component first keeps extreme values finite."""
    x = np.array(values, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class CoverTree:
    """Nodes as arrays: centre, radius, members [start, end) in ``order``, children [first, last).

    The root covers the sphere; of the halving radii below it those are left out at which no two nodes can be further apart than ``reach`` and both
    radii, since such a level drops nothing. Leaves are single vectors, or few within a quarter of ``reach``.
    """

    def __init__(self, units: np.ndarray, copies: np.ndarray, reach: float):
        top, tight = 1.0, reach / 4
        while reach + 2 * top >= 2 and top > 1e-3:
            top /= 2
        members, nodes, levels = np.arange(len(units)), [], [(np.arange(len(units)), 0, top)]
        nodes.append([0, 0.0, 0, len(units), 0, 0])
        order = members.copy()
        while levels:
            own, node, radius = levels.pop()
            centre = own[0]
            away = 2 - 2 * units[own] @ units[centre]
            nodes[node][0], nodes[node][1] = centre, float(np.sqrt(max(0.0, away.max()))) + SLACK if len(own) > 1 else 0.0
            if len(own) == 1 or radius < 1e-9 or len(own) <= LEAF and nodes[node][1] <= tight:
                continue
            parts = _cover(units, own, radius)
            at = nodes[node][2]
            nodes[node][4:] = [len(nodes), len(nodes) + len(parts)]
            for part in parts:
                order[at:at + len(part)] = part
                levels.append((part, len(nodes), radius / 2))
                nodes.append([part[0], 0.0, at, at + len(part), 0, 0])
                at += len(part)
        table = np.array(nodes, np.float64)
        self.centre, (self.start, self.end, self.first, self.last) = table[:, 0].astype(np.int64), table[:, 2:].astype(np.int64).T
        self.radius, self.order, self.units, self.copies = table[:, 1], order, units, copies
        sums = np.concatenate([[0], np.cumsum(copies[order])])
        self.weight = sums[self.end] - sums[self.start]

    def members(self, node: int) -> np.ndarray:
        return self.order[self.start[node]:self.end[node]]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """Children of all ``nodes``; a leaf stands for itself."""
        inner = nodes[self.last[nodes] > 0]
        counts = self.last[inner] - self.first[inner]
        ends = np.cumsum(counts)
        return np.concatenate([nodes[self.last[nodes] == 0], np.arange(counts.sum()) + np.repeat(self.first[inner] - ends + counts, counts)])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "units"}


def _cover(units: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
    """Greedy cover: the first member not covered yet becomes a centre and takes what lies within ``radius``; the first centre is the parent's."""
    rest, parts, least = own, [], 1 - radius * radius / 2
    part32 = units[own].astype(np.float32)
    while len(rest):
        near = part32 @ part32[0] >= least
        near[0] = True
        parts.append(rest[near])
        rest, part32 = rest[~near], part32[~near]
    return parts


def _grouped(by: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(by, kind="stable")
    names, starts = np.unique(by[order], return_index=True)
    return [(names[i:i + 1], part) for i, part in enumerate(np.split(other[order], starts[1:]))] if len(names) else []


class DualWalk:
    """Links between the members of two trees (or within one): weighted link counts of both sides and a spanning forest."""

    def __init__(self, a: CoverTree, b: CoverTree, threshold: float):
        self.a, self.b, self.same, self.threshold, self.reach = a, b, a is b, threshold, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.count = [np.zeros(len(a.order), np.int64), np.zeros(len(b.order), np.int64)]
        self.offset = 0 if self.same else len(a.order)
        self.i, self.j, self.held, self.starred = [], [], 0, set()
        self.single = (a.units.astype(np.float32), b.units.astype(np.float32))
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            stack += self._descend(*stack.pop())
        self._contract()

    def _descend(self, ps: np.ndarray, qs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Children of one node against those of all its partners; one of the two lists has a single node."""
        a, b, out = self.a, self.b, []
        own, against = a.children(ps), b.children(qs)
        jobs = [(own, against, False)]
        if self.same and len(ps) == 1 and ps[0] in qs:
            jobs = [(own, b.children(qs[qs != ps[0]]), False), (own, own, True)]
        for own, against, within in jobs:
            for at in range(0, len(own) if len(against) else 0, 512):
                ca, cb = self._near(own[at:at + 512], against)
                if within:
                    ca, cb = ca[ca <= cb], cb[ca <= cb]
                for s in range(0, len(ca), 1 << 16):
                    out += self._decide(ca[s:s + (1 << 16)], cb[s:s + (1 << 16)])
        return out

    def _near(self, own: np.ndarray, against: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that may hold a link. Single precision only drops what is too far by a margin."""
        a, b = self.a, self.b
        close = self.single[0][a.centre[own]] @ self.single[1][b.centre[against]].T
        # most nodes have radius 0: one bound for all their pairs; rows and columns of the others get their own
        near = close >= np.float32(self.threshold - 1e-5)
        wide, wide_b = np.flatnonzero(a.radius[own]), np.flatnonzero(b.radius[against])
        for rows, columns in ((wide, slice(None)), (slice(None), wide_b)):
            bound = np.minimum(self.reach + a.radius[own[rows]][:, None] + b.radius[against[columns]][None, :], 2.0)
            near[rows, columns] = close[rows, columns] >= 1 - bound * bound / 2 - 1e-5
        x, y = np.nonzero(near)
        return own[x], against[y]

    def _decide(self, na: np.ndarray, nb: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Count links of single vectors, whole nodes and leaves; what stays undecided, by the node that has children."""
        a, b = self.a, self.b
        product = np.einsum("ij,ij->i", a.units[a.centre[na]], b.units[b.centre[nb]])
        single = (a.end[na] - a.start[na] == 1) & (b.end[nb] - b.start[nb] == 1)
        hit = single & (product >= self.threshold)
        if self.same:
            hit &= na != nb
        i, j = a.centre[na[hit]], b.centre[nb[hit]]
        np.add.at(self.count[0], i, b.copies[j])
        np.add.at(self.count[0 if self.same else 1], j, a.copies[i])
        self._edges(i, j + self.offset)
        distance, spread = np.sqrt(np.maximum(0.0, 2 - 2 * product)), a.radius[na] + b.radius[nb]
        whole = ~single & (distance + spread < self.reach - 1e-7)
        for m, n in zip(na[whole].tolist(), nb[whole].tolist()):
            self._whole(m, n)
        open_ = ~single & ~whole & (distance <= self.reach + spread + 1e-7)
        leaves = open_ & (a.last[na] == 0) & (b.last[nb] == 0)
        for m, n in zip(na[leaves].tolist(), nb[leaves].tolist()):
            self._exact(m, n)
        na, nb = na[open_ & ~leaves], nb[open_ & ~leaves]
        inner = a.last[na] > 0
        return [*_grouped(na[inner], nb[inner]), *((p, q) for q, p in _grouped(nb[~inner], na[~inner]))]

    def _whole(self, p: int, q: int) -> None:
        """All members of both nodes link."""
        a, b = self.a, self.b
        left, right = a.members(p), b.members(q)
        if self.same and p == q:
            self.count[0][left] += a.weight[p] - a.copies[left]
        else:
            self.count[0][left] += b.weight[q]
            self.count[0 if self.same else 1][right] += a.weight[p]
        # all of one node link to the other's first member and so to each other; a node's star is written once
        for node, side, ids, add in ((p, 0, left, 0), (q, 1 - self.same, right, self.offset)):
            if (side, node) not in self.starred:
                self.starred.add((side, node))
                self._edges(np.full(len(ids), ids[0]) + add, ids + add)
        self._edges(left[:1], right[:1] + self.offset)

    def _exact(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        left, right = a.members(p), b.members(q)
        link = a.units[left] @ b.units[right].T >= self.threshold
        if self.same and p == q:
            np.fill_diagonal(link, False)
            self.count[0][left] += link @ a.copies[right]
        else:
            self.count[0][left] += link @ b.copies[right]
            self.count[0 if self.same else 1][right] += link.T @ a.copies[left]
        x, y = np.nonzero(link)
        self._edges(left[x], right[y] + self.offset)

    def _edges(self, i: np.ndarray, j: np.ndarray) -> None:
        self.i.append(i)
        self.j.append(j)
        self.held += len(i)
        if self.held > 2_000_000:
            self._contract()

    def _contract(self) -> None:
        """Replace the edges held by stars of their components."""
        n = self.offset + len(self.b.order)
        label = np.arange(n)
        i, j = np.concatenate(self.i or [label[:0]]), np.concatenate(self.j or [label[:0]])
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (before == label).all():
                break
        leaf = np.flatnonzero(label != np.arange(n))
        self.i, self.j, self.held = [label[leaf]], [leaf], len(leaf)


def clean_vectors(rows: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """(id, key, vec): key is a digest of the components, null where the vector can link with nothing."""
    number = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for v in batch["vec"].to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).hexdigest() if good else None)
                vecs.append(x.astype(number).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.string()), pa.array(vecs, pa.binary())], names=["id", "key", "vec"])
    picked = rows.select(rows[id_col].cast("long").alias("id"), rows[vec_col].cast(f"array<{kind}>").alias("vec"))
    return picked.mapInArrow(run, "id long, key string, vec binary")


def _stack(vecs, number) -> np.ndarray:
    return unit_rows(np.stack([np.frombuffer(v, number) for v in vecs]))


def near_vectors(rows: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): links at cosine >= ``threshold`` in double precision; exact, one row per input row.

    Equal vectors link like others and are compared once. Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths never link. Rows that repeat an id each count. An empty table gives no rows.
    """
    kind = "float" if "float" in dict(rows.dtypes)[vec_col] else "double"
    number = np.float32 if kind == "float" else np.float64
    clean, _ = store(clean_vectors(rows, id_col, vec_col, kind), "vectors")
    classes, _ = store(clean.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "vector-classes")
    found, _ = store(_links(classes, threshold, number, block), "vector-links")
    counts = found.where("n IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(found.where("n IS NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    named = classes.select("key", "low", "copies").join(counts, "key", "left").join(roots, "key", "left")
    named = named.select("key", "low", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "key").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    final, _ = store(named.join(lows, "root").select("key", "n_links", "component_id"), "vector-final")
    out = clean.select("id", "key").join(final, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, threshold: float, number, block: int) -> DataFrame:
    """(key, n, other): link counts (n set) and edges (n null) between classes."""
    size = np.dtype(number).itemsize
    classes = classes.withColumn("dim", F.octet_length("vec") / size)
    n = classes.count()
    pivots = [r.vec for r in classes.orderBy(F.xxhash64("key"), "key").limit(min(MAX_PIVOTS, -(-n // block))).select("vec").collect()]
    by_dim: dict[int, np.ndarray] = {d: _stack([p for p in pivots if len(p) == d], number) for d in {len(p) for p in pivots}}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            frame["cell"], frame["away"] = 0, 2.0
            for length, part in frame.groupby(frame.vec.str.len()):
                if length in by_dim:
                    close = _stack(part.vec, number) @ by_dim[length].T
                    frame.loc[part.index, "cell"] = close.argmax(axis=1)
                    frame.loc[part.index, "away"] = np.sqrt(np.maximum(0.0, 2 - 2 * close.max(axis=1)))
            yield pa.RecordBatch.from_pandas(frame[["key", "copies", "vec", "dim", "cell", "away"]], preserve_index=False)
    cells = classes.select("key", "copies", "vec", F.col("dim").cast("long").alias("dim")).mapInArrow(assign, "key string, copies long, vec binary, dim long, cell long, away double")
    cells, _ = store(cells, "vector-cells")
    stats = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()   # at most MAX_PIVOTS rows per vector length
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    partners = {}
    for s in stats:
        near = []
        for o in stats:
            if o.dim == s.dim:
                centres = by_dim.get(s.dim * size)
                gap = 0.0 if centres is None else float(np.linalg.norm(centres[s.cell] - centres[o.cell]))
                if gap <= reach + s.r + o.r + 1e-6:
                    near.append((o.cell, -(-o.n // block)))
        partners[s.dim, s.cell] = near
    spark = classes.sparkSession
    table = spark.createDataFrame([(d, c, -(-next(s.n for s in stats if (s.dim, s.cell) == (d, c)) // block), near) for (d, c), near in partners.items()],
                                  "dim long, cell long, pieces long, near array<struct<cell: long, pieces: long>>")
    dealt = cells.join(F.broadcast(table.select("dim", "cell", "pieces")), ["dim", "cell"]).withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))

    def build(keys: tuple, rows: pa.Table) -> pa.Table:
        frame = rows.select(["key", "copies", "vec"]).to_pandas().sort_values("key", ignore_index=True)
        vectors = np.stack([np.frombuffer(v, number) for v in frame.vec])
        blob = pickle.dumps((frame.key.tolist(), vectors, CoverTree(unit_rows(vectors), frame.copies.to_numpy(), reach)), protocol=5)
        return pa.table({"dim": [keys[0].as_py()], "cell": [keys[1].as_py()], "piece": [keys[2].as_py()], "blob": pa.array([blob], pa.binary())})
    blocks = dealt.groupBy("dim", "cell", "piece").applyInArrow(build, "dim long, cell long, piece long, blob binary")
    mine = F.struct("cell", "piece")
    pairs = (blocks.join(F.broadcast(table.select("dim", "cell", "near")), ["dim", "cell"]).select("dim", mine.alias("me"), "blob", F.explode("near").alias("o"))
             .select("dim", "me", "blob", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("o.pieces") - 1), lambda p: F.struct(F.col("o.cell").alias("cell"), p.alias("piece")))).alias("it"))
             .select("dim", F.least("me", "it").alias("x"), F.greatest("me", "it").alias("y"), "me", "blob"))

    def walk(keys: tuple, rows: pa.Table) -> pa.Table:
        # partners are mutual, so both blobs of a pair arrive; a block with itself arrives once
        sides = []
        for names, vectors, tree in map(pickle.loads, sorted(rows["blob"].to_pylist())):
            tree.units = unit_rows(vectors)
            sides.append((names, tree))
        (ka, a), (kb, b) = sides[0], sides[-1]
        w = DualWalk(a, b, threshold)
        names = np.array(ka + ([] if b is a else kb), dtype=object)
        counts = w.count[0] if b is a else np.concatenate(w.count)
        hit = np.flatnonzero(counts)
        i, j = w.i[0], w.j[0]
        return pa.Table.from_pandas(pd.DataFrame({"key": np.concatenate([names[hit], names[i]]), "n": pd.array([*counts[hit], *[None] * len(i)], "Int64"),
                                                  "other": np.concatenate([np.full(len(hit), None, object), names[j]])}),
                                    schema=pa.schema([("key", pa.string()), ("n", pa.int64()), ("other", pa.string())]), preserve_index=False)
    return pairs.groupBy("dim", "x", "y").applyInArrow(walk, "key string, n long, other string")
