"""Exact, SimHash, substring and embedding duplicates against brute force."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from txrisk.llm import exact_dedup as E, simhash as S
from txrisk.llm.common import components
from txrisk.llm.cover_tree import near_vectors
from txrisk.llm.sharding import Cells, level_cuts, minimax_cuts, shard_by_bytes
from txrisk.llm.substring_dedup import remove_repeats


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_exact(docs, rows, none, keep, best):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    want = []
    for r in rows:
        ids = groups[r.text or ""]
        owner = best([i for i in ids if i is not None], default=None)
        want.append((r.doc_id, owner, len(ids), r.doc_id == owner, hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in E.exact_dedup(docs, keep=keep).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert E.exact_dedup(none).collect() == []
    assert E.exact_dedup(docs, extra=("source",)).columns[-1] == "source"


def test_trie_spills_by_subtree_and_tells_equal_hashes_apart():
    rng = random.Random(1)
    entries = [((rng.randrange(3) if i % 2 else rng.randrange(1 << 60)).to_bytes(8, "big") + bytes(rng.choices(b"ab", k=rng.randrange(0, 60))), rng.randrange(1000), 1)
               for i in range(3000)]
    want = {}
    for k, o, n in entries:
        old = want.get(k, (0, 0))
        want[k] = (max(o, old[0]), n + old[1])
    for limit in (1 << 30, 5000, 300):
        assert {k: (o, n) for k, o, n in E.owners_of(iter(entries), True, limit)} == want


def test_spilling_pass_gives_the_same(docs):
    assert sorted(E.owners(docs, trie_bytes=400).collect()) == sorted(E.owners(docs).collect())


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, none):
    prints = [brute_fingerprint(r.text) for r in rows]
    group = roots(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4])
    low = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            low[group[p]] = min(low.get(group[p], r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{p:016x}", low.get(group[p])) for r, p in zip(rows, prints)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in S.simhash_groups(docs).collect())
    assert S.simhash_groups(none).collect() == []


def test_masks_catch_every_pair_in_the_radius():
    rng = random.Random(2)
    masks = [m & (1 << 64) - 1 for m in S.masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(difference & m == 0 for m in masks)


def test_large_buckets_are_compared_piece_by_piece(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4])
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    distinct = spark.createDataFrame([(sign(p),) for p in prints], "fp long")
    for piece in (3, 4096):
        edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(distinct, piece=piece).collect()]
        assert roots(prints, edges) == want
        assert len(edges) < 31 * 500


def test_links_broadcast_nothing(spark):
    """Spark sizes the exploded tables as if a fingerprint had one row in them, so these would be broadcast at many times the threshold."""
    edges = S.links(spark.range(300).select(F.col("id").alias("fp")))
    assert set(roots(range(300), edges.collect()).values()) == {0}
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 300)] + [(rng.randrange(1000, 2000), rng.randrange(1000, 2000)) for _ in range(600)] + [(5000, i) for i in range(5001, 5100)]
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs + pairs[:9], "a long, b long")).collect()}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removal(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    ids = [r.doc_id if r.doc_id is not None else float("inf") for r in rows]
    first = {}
    for w, i in zip(words, ids):
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for r, w, i in zip(rows, words, ids):
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [13, 7])
def test_substring(docs, rows, none, window):
    got = [tuple(r) for r in remove_repeats(docs, window=window).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_removal(rows, window)))
    assert sum(g[2] for g in got) > 100
    assert remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(docs, window=3)


@pytest.mark.parametrize("hot", [77, None])
def test_substring_of_a_hot_id_spreads(spark, hot, monkeypatch):
    from txrisk.llm import substring_dedup as S
    seen = []
    monkeypatch.setattr(S, "chunk_of", lambda *a, keep=S.chunk_of: seen.append(keep(*a)) or seen[-1])
    shared = " ".join(f"s{i}" for i in range(20))
    made = [(hot if i % 3 == 0 else i, f"{shared if i % 5 == 0 else ''} " + " ".join(f"w{i}_{j}" for j in range(15))) for i in range(300)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = [tuple(r) for r in remove_repeats(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_removal(df.collect())))
    spread = df.select(df.doc_id.alias("id"), df.text.cast("binary").alias("text")).where(F.col("id").eqNullSafe(F.lit(hot))).select(seen[0].alias("c"))
    assert spread.distinct().count() > 8


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings(spark, block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    x = np.vstack([x, x[:20] + rng.normal(size=(20, 8)) * 0.1, np.repeat(x[:1], 25, axis=0) + rng.normal(size=(25, 8)) * 0.3, x[:5], x[:2] * 1e200])
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    group = roots(range(len(x)), np.argwhere(link).tolist())
    want = [(i, int(link[i].sum()), group[i], group[i] == i) for i in range(len(x))]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] * 8]
    rows += [(200 + i, v) for i, v in enumerate(odd)] + [(300, [1.0, 0.0]), (301, [2.0, 0.1])]
    want += [(200 + i, 0, 200 + i, True) for i in range(len(odd))] + [(300, 1, 300, True), (301, 1, 300, False)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, key int, n string").repartition(4)
    assert sorted(tuple(r) for r in near_vectors(table, 0.9, block=block).collect()) == sorted(want)
    assert near_vectors(table.where("false")).collect() == []


def brute_cuts(sizes, shards):
    def fill(capacity):
        cuts, load = [], 0
        for i, s in enumerate(sizes):
            if s > capacity:
                return None
            if load + s > capacity:
                cuts.append(i)
                load = 0
            load += s
        return cuts if len(cuts) < shards else None
    capacity = next(c for c in range(max(sizes), sum(sizes) + 1) if fill(c) is not None)
    return capacity, fill(capacity)


@pytest.mark.parametrize("shards,most", [(3, 9), (40, 9), (7, 500)])
def test_minimax(spark, monkeypatch, shards, most):
    import txrisk.llm.sharding as H
    monkeypatch.setattr(H, "FIRST_DIGITS", 1)
    rng = random.Random(shards)
    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), rng.randrange(1, most)) for i in range(300))
    groups[50] = (groups[50][0], most * 20)
    capacity, cuts = minimax_cuts(spark.createDataFrame(groups, "key string, bytes long"), shards)
    want, at = brute_cuts([b for _, b in groups], shards)
    assert capacity == want
    keys = [k for k, _ in groups]
    assert [next(i for i, k in enumerate(keys) if k >= c) for c in cuts] == at


def test_sharding(docs, rows, none):
    import zlib
    got = shard_by_bytes(docs, 5).collect()
    assert len(got) == len(rows)
    raw = lambda r: (r.text or "").encode()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(r.doc_id), len(raw(r)) + 16, zlib.crc32(raw(r))) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in got:
        assert where.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    assert shard_by_bytes(none).collect() == []
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


@pytest.mark.parametrize("shards,most", [(3, 9), (25, 9), (7, 500), (40, 40)])
def test_level_cuts(spark, monkeypatch, shards, most):
    import txrisk.llm.sharding as H
    monkeypatch.setattr(H, "FIRST_DIGITS", 1)
    rng = random.Random(shards)
    groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), rng.randrange(1, most)) for i in range(300))
    cuts = level_cuts(spark.createDataFrame(groups, "key string, bytes long"), shards)
    sizes = [0] * shards
    for key, size in groups:
        sizes[sum(c.ljust(64, "0") <= key for c in cuts)] += size
    assert max(sizes) == brute_cuts([b for _, b in groups], shards)[0]
    assert min(sizes) > 0 and max(sizes) - min(sizes) < 2 * max(b for _, b in groups)


@pytest.mark.parametrize("copies,alone", [([3000], 1), ([3000, 2500], 2), ([400], 1), ([5], 0)])
def test_sharding_of_a_hot_text(spark, copies, alone):
    """A text with a third of all bytes fills its own shard and leaves the others near equal, none empty."""
    texts = [f"{i:05d}" + "x" * (i % 50) for i in range(2000)] + [t for n, c in enumerate(copies) for t in [f"hot {n}" + "y" * 20] * c]
    got = shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40).collect()
    sizes, within = [0] * 40, defaultdict(set)
    for r in got:
        sizes[r.shard] += r["size"]
        within[r.shard].add(texts[r.doc_id])
    assert len(got) == len(texts) and min(sizes) > 0
    hot = [s for s in within if any(t.startswith("hot") for t in within[s])]
    assert sum(len(within[s]) == 1 for s in hot) == alone
    rest = [b for s, b in enumerate(sizes) if len(within[s]) > 1]
    assert len(rest) == 40 - alone and max(rest) - min(rest) <= max(50 + 5 + 16, 42 * 5)


def test_sharding_of_fewer_texts_than_shards(spark):
    got = shard_by_bytes(spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "b", "ccc"])], "doc_id long, text string"), 40).collect()
    assert len({r.shard for r in got}) == 3 and all(0 <= r.shard < 40 for r in got)


def test_empty_summary():
    assert Cells([]).fill(10, 3, True) == ([], True)


def test_sharding_runs_without_python(docs):
    plan = shard_by_bytes(docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
