"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Capacity flows from patterns to source quotas; the r-th repetition of a pattern's
words costs r, so that nothing repeats while unused words could serve. Every augmenting path costs what its pattern's repetition costs, so raising all capacities
one repetition at a time and augmenting in between gives the min-cost flow. Each pattern's intake is then drawn from its documents in the order of a
seeded hash: whole passes first, then a prefix of hash buckets, and in the last bucket documents as they fit, there even repeated to come near the quota.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from txrisk.llm.common import SPACE, discard, store

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
# Documents that the last bucket of a pattern holds on average, and the most buckets of a pattern.
BUCKET_DOCS = 500
MAX_BITS = 16


@dataclass
class Mix:
    """Quotas (source, size, target) and intakes (pattern key, bits, whole passes, words left over)."""

    sources: list[tuple[str | None, int, float]]
    patterns: list[tuple[str, int, int, int]]


def words_in(text: Column) -> Column:
    """Number of runs between ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def pattern_key(members: Column) -> Column:
    """One string for a list of sources, in which null differs from any name."""
    names = F.transform(members, lambda s: F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.hex(s))))
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit(""))


def quotas(sizes: dict[str | None, int], total: int, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Targets by weight in code point order, null last; what is above ``most`` times a source's size is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict[str | None, float] = {}
    while True:
        free = [s for s in names if s not in fixed]
        left, whole = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


def route(capacity: dict[str, int], members: dict[str, list], quota: dict, most: int = MOST) -> dict[str, int]:
    """Intake of every pattern in a min-cost flow to the quotas, repetitions costing more and more."""
    taken = {p: 0 for p in capacity}
    flow: dict[tuple, int] = {}
    open_ = {s: int(round(q)) for s, q in quota.items()}
    users: dict = {}
    for p, ss in members.items():
        for s in ss:
            users.setdefault(s, []).append(p)
    for repetition in range(1, most + 1):
        for p in sorted(capacity):
            while taken[p] < repetition * capacity[p]:
                # breadth first: pattern -> source with open quota, over sources that can hand a pattern's flow on
                came, queue, end = {("p", p): None}, deque([("p", p)]), None
                while queue and end is None:
                    kind, x = node = queue.popleft()
                    for nxt in ([("s", s) for s in members[x]] if kind == "p" else [("p", q) for q in users.get(x, ()) if flow.get((q, x), 0) > 0]):
                        if nxt not in came:
                            came[nxt] = node
                            if nxt[0] == "s" and open_[nxt[1]] > 0:
                                end = nxt
                                break
                            queue.append(nxt)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min([repetition * capacity[p] - taken[p], open_[end[1]]]
                             + [flow[path[i + 1][1], path[i][1]] for i in range(1, len(path) - 1, 2)])
                for i in range(len(path) - 1):
                    a, b = path[i][1], path[i + 1][1]
                    if path[i][0] == "p":
                        flow[a, b] = flow.get((a, b), 0) + amount
                    else:
                        flow[b, a] -= amount
                taken[p] += amount
                open_[end[1]] -= amount
    return taken


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> Mix:
    """Quotas and intakes for (members, key, size) rows. The driver sees one row per pattern, a number that the sources bound, not the documents."""
    found = rows.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    members = {r.key: sorted(set(r.members or ()), key=lambda s: (s is None, s or "")) for r in found}
    capacity, count = {r.key: r["size"] for r in found}, {r.key: r.n for r in found}
    sizes: dict[str | None, int] = {}
    for p, ss in members.items():
        for s in ss:
            sizes[s] = sizes.get(s, 0) + capacity[p]
    target = quotas(sizes, sum(capacity.values()), weights, most) if sizes else {}
    taken = route(capacity, members, target, most)
    patterns = []
    for p in sorted(capacity):
        bits = min(MAX_BITS, max(0, (count[p] // BUCKET_DOCS).bit_length() - 1))
        whole, left = divmod(taken[p], capacity[p]) if capacity[p] else (0, 0)
        patterns.append((p, bits, whole, left))
    return Mix([(s, sizes[s], target[s]) for s in target], patterns)


def _fill(most: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """In the order of the hash, documents that still fit, again while repetitions are left; one more copy if that comes nearer."""
        frame = frame.sort_values(["hash", "id", "size"], ignore_index=True)
        left, extra, sizes = int(frame["left"].iloc[0]), most - int(frame["whole"].iloc[0]), frame["size"].tolist()
        copies = [0] * len(sizes)
        for _ in range(extra):
            for i, size in enumerate(sizes):
                if 0 < size <= left:
                    copies[i] += 1
                    left -= size
        nearest = min(((abs(left - s), i) for i, s in enumerate(sizes) if copies[i] < extra), default=(left, 0))
        if nearest[0] < left:
            copies[nearest[1]] += 1
        return frame.assign(n=copies).groupby(["key", "id", "hash", "size"], as_index=False, dropna=False)["n"].sum()
    return run


def mix(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST,
        seed: int = 11) -> tuple[DataFrame, Mix]:
    """All rows with ``mix_size`` (words) and ``mix_copies`` (0 to ``most``) appended, and the plan.

    ``members`` is a list of sources per row. Size is the number of words, 0 for null text; rows without words or sources get no copies. Equal input gives
    equal copies whatever its order. Columns that already have the two names are replaced. A null source is a source of its own; rows that repeat count each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.withColumns({"mix_size": words_in(docs[text_col].cast("string")), "__key": pattern_key(members), "__hash": F.xxhash64(docs[id_col], F.lit(seed)),
                              "__id": docs[id_col].cast("string")})
    slim, path = store(named.select("__id", members.alias("members"), "__key", "__hash", "mix_size"), "mix-sizes")
    mix_plan = plan_mix(slim.select("members", F.col("__key").alias("key"), F.col("mix_size").alias("size")), weights, most)
    plan = F.broadcast(spark.createDataFrame(mix_plan.patterns, "__key string, __bits int, __whole int, __rest long"))   # one row per pattern
    bucket = F.when(F.col("__bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(__hash, 64 - __bits)"))
    totals = slim.join(plan, "__key").groupBy("__key", bucket.alias("bucket"), "__rest").agg(F.sum("mix_size").alias("words"))
    totals = totals.withColumn("over", F.sum("words").over(W.partitionBy("__key").orderBy("bucket")) - F.col("__rest"))
    # one row per pattern: the bucket in which its intake ends and what is left for it
    last = totals.where((F.col("__rest") > 0) & (F.col("over") >= 0) & (F.col("over") < F.col("words")))
    edges = {r[0]: (r[1], r[2]) for r in last.select("__key", "bucket", F.col("words") - F.col("over")).collect()}
    final = F.broadcast(spark.createDataFrame([(k, b, w, *edges.get(k, (-1, 0))) for k, b, w, _ in mix_plan.patterns],
                                              "__key string, __bits int, __whole int, __edge long, __left long"))
    border = slim.join(final, "__key").where(bucket == F.col("__edge"))
    border = border.select(F.col("__key").alias("key"), F.col("__id").alias("id"), F.col("__hash").alias("hash"), F.col("mix_size").alias("size"), F.col("__left").alias("left"), F.col("__whole").alias("whole"))
    picks, _ = store(border.groupBy("key").applyInPandas(_fill(most), "key string, id string, hash long, size long, n long"), "mix-picks")
    discard(spark, path)
    placed = named.join(final, "__key").withColumn("__bucket", bucket)
    sure = placed.where(F.col("__bucket") != F.col("__edge")).withColumn("mix_copies", F.col("__whole") + (F.col("__bucket") < F.col("__edge")).cast("int"))
    # rows that are alike in id, hash and size share the copies picked for them
    alike = W.partitionBy("__key", "__id", "__hash", "mix_size")
    chosen = picks.select(*[F.col(c).alias(f"__pick_{c}") for c in picks.columns])
    open_ = placed.where(F.col("__bucket") == F.col("__edge"))
    open_ = open_.join(chosen, (F.col("__key") == F.col("__pick_key")) & F.col("__id").eqNullSafe(F.col("__pick_id")) & (F.col("__hash") == F.col("__pick_hash"))
                       & (F.col("mix_size") == F.col("__pick_size")), "left")
    open_ = open_.withColumns({"__row": F.row_number().over(alike.orderBy(F.lit(0))), "__alike": F.count("*").over(alike)})
    share = F.floor((F.coalesce(F.col("__pick_n"), F.lit(0)) - F.col("__row") + F.col("__alike")) / F.col("__alike"))
    open_ = open_.withColumn("mix_copies", F.col("__whole") + share.cast("int"))
    columns = [*[c for c in docs.columns if c not in ("mix_size", "mix_copies")], "mix_size", "mix_copies"]
    pick = [F.col(f"`{c}`") for c in columns]
    return sure.select(*pick).unionByName(open_.select(*pick)), mix_plan
