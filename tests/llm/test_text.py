"""License scan, mixing, tokens, language and quality."""
import base64
import hashlib
import random
import re
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from os.path import dirname

from tests.conftest import SF
from txrisk.llm import byte_bpe as B, language as L, license_scan as N, mixing as M, quality as Q

SF_LABELLED = f"{dirname(SF)}/sf0.01"
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ------------------------------------------------------------------------------------------------ licenses

def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in N.BASE.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    joined, near = " ".join(words), set()
    for label, notices in N.NOTICES.items():
        for n in notices:
            k = len(n) // N.CHARS_PER_EDIT
            if regex.search(f"(?:{regex.escape(n, literal_spaces=True)}){{e<={k}}}", joined):
                near.add(label)
    return len(words), places, near


def test_license_scan(spark, docs, rows, none):
    rng = random.Random(7)
    more = []
    for label, notices in N.NOTICES.items():
        for n in notices:
            for edits in (0, 1, len(n) // N.CHARS_PER_EDIT):
                t = list(n)
                for _ in range(edits):
                    t[rng.randrange(len(t))] = rng.choice(["", "q", "zz"[:1]])
                more.append((label, edits, "Some words. " + "".join(t).title() + "! more words"))
    table = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(more)], "doc_id long, text string")
    for r in N.license_scan(table).collect():
        label, edits, text = more[r.doc_id]
        assert label in r.labels.split(","), text
        assert any(s.label == label and s.edits <= edits for s in r.spans)
    for r, got in zip(sorted(rows, key=lambda r: (str(r.doc_id), str(r.text))), sorted(N.license_scan(docs).join(docs.withColumnRenamed("size", "s").distinct(), "doc_id", "left").collect(),
                                                                                       key=lambda g: (str(g.doc_id), str(g.text)))):
        if r.doc_id is None:
            continue
        n, places, near = brute_scan(r.text)
        starts = sorted(p for p, _ in places)
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (n, len(places), starts[0] if starts else None, starts[-1] if starts else None)
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
        assert got.labels == ",".join(sorted({x for _, x in places} | near)) and 0 <= got.score <= 1
    assert N.license_scan(none).collect() == []


def test_overlapping_base_places():
    s = N.Scanner(N.BASE, N.NOTICES).scan("MIT License, mit license; the MIT-licence and General Public License")
    assert (s["n_base"], s["first_word"], s["last_word"], s["base_labels"]) == (3, 0, 8, "gpl,mit")


@pytest.mark.parametrize("text,want", [
    ("releasd undr the mit license x released under the mit license", [(0, 4, 2), (6, 10, 0)]),
    ("released under the mit license releasd undr the mit license", [(0, 4, 0), (5, 9, 2)]),
    ("released under the mit licen released under the mit license released under te mit licens", [(0, 4, 2), (5, 9, 0), (10, 14, 2)]),
    (" ".join(["releasd under the mit license"] * 500), [(5 * i, 5 * i + 4, 1) for i in range(500)])])
def test_adjacent_notices_keep_their_spans(text, want):
    spans = N.Scanner(N.BASE, N.NOTICES).scan(text)["spans"]
    assert [(s["first_word"], s["last_word"], s["edits"]) for s in spans] == want and {s["label"] for s in spans} == {"mit"}


# ------------------------------------------------------------------------------------------------ mixing

def test_quotas_fill_and_stop():
    sizes = {"b": 100, "a": 10, None: 5, "ç": 400}
    got = M.quotas(sizes, 515)
    assert list(got) == ["a", "b", "ç", None] or set(got) == set(sizes)
    assert got["a"] == 30 and got[None] == 15 and abs(sum(got.values()) - 515) < 1e-9
    assert all(v <= 3 * sizes[k] for k, v in got.items())
    assert abs(got["b"] / 2 - got["ç"] / 1) < 1e-9 or got["b"] == 300
    assert M.quotas({"a": 0}, 0) == {"a": 0.0}


def test_route_is_a_min_cost_flow():
    rng = random.Random(8)
    for _ in range(60):
        sources, patterns = ["a", "b", "c"], ["p", "q", "r"]
        members = {p: sorted(rng.sample(sources, rng.randrange(1, 4))) for p in patterns}
        capacity, quota = {p: rng.randrange(1, 4) for p in patterns}, {s: rng.randrange(0, 5) for s in sources}
        taken = M.route(capacity, members, quota)
        cost = lambda t: sum(sum(-(-u // c) for u in range(1, t[p] + 1)) for p, c in capacity.items())

        def feasible(t):
            # Hall's condition: what a set of patterns sends fits into the quotas it reaches
            return all(sum(t[p] for p in sub) <= sum(q for s, q in quota.items() if any(s in members[p] for p in sub))
                       for k in range(1, 8) for sub in [[p for i, p in enumerate(patterns) if k >> i & 1]])
        best = None
        for amounts in product(*[range(3 * capacity[p] + 1) for p in patterns]):
            t = dict(zip(patterns, amounts))
            if feasible(t):
                value = (-sum(amounts), cost(t))
                best = value if best is None or value < best else best
        assert feasible(taken) and (-sum(taken.values()), cost(taken)) == best


def test_mix_meets_targets_and_reruns_agree(spark, docs, rows, none):
    first, plan = M.mix(docs, F.array("source"))
    again, _ = M.mix(docs.orderBy(F.desc("text")).repartition(3), F.array("source"))
    got = first.collect()
    assert len(got) == len(rows) and first.columns == [*docs.columns, "mix_size", "mix_copies"]
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.mix_copies <= 3
    for source, size, target in plan.sources:
        own = [r for r in got if r.source == source]
        assert size == sum(r.mix_size for r in own)
        assert abs(sum(r.mix_size * r.mix_copies for r in own) - target) <= 2
    assert [s for s, _, _ in plan.sources][-1] is None or {s for s, _, _ in plan.sources} >= {None}
    assert M.mix(none, F.array("source"))[0].collect() == []


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i < 50 else ["a", "b"] if i < 80 else ["b"]) for i in range(100)] + [(100, "w", []), (101, "w", None)]
    mixed, plan = M.mix(spark.createDataFrame(rows, "doc_id long, text string, sets array<string>"), F.col("sets"), weights=(1.0, 1.0))
    got = mixed.collect()
    assert {s: (n, round(t)) for s, n, t in plan.sources} == {"a": (800, 501), "b": (500, 501)}
    # each word serves once: together the sources need no more than there is
    assert sum(r.mix_size * r.mix_copies for r in got) in range(990, 1003) and max(r.mix_copies for r in got) == 1
    assert [r.mix_copies for r in got if r.doc_id > 99] == [0, 0]


def test_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_DOCS", 4)
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, "w " * rng.randrange(1, 30), f"s{i % 3 if i % 2 else 0}") for i in range(600)], "doc_id long, text string, source string")
    mixed, plan = M.mix(docs, F.array("source"))
    got = mixed.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies"))).collect()
    target = {s: t for s, _, t in plan.sources}
    assert all(abs(r[1] - target[r[0]]) <= 30 for r in got)


# ------------------------------------------------------------------------------------------------ tokens

@pytest.fixture(scope="module")
def ranks(spark):
    return B.read_ranks(spark, RANK_FILE)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_splitting_follows_the_pattern(texts):
    rng = random.Random(10)
    chars = "ab Z9 '\n\t.,é漢²  \x1c\x85٣_-st"
    samples = [t or "" for t in texts] + ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    want = regex.compile(public_tokenizers.PATTERN)
    chunk = B.ChunkWords(pa.array(samples), public_tokenizers.PATTERN)
    names = list(chunk.words)
    assert len(chunk.texts) == len(samples)
    for t, spans in zip(samples, chunk.texts):
        parts, _ = B._ragged(chunk.parts, chunk.offsets, spans)
        assert [names[i] for i in parts] == want.findall(t), t


def test_encoding_equals_the_library(spark, docs, rows, none, ranks, library):
    got = B.encode(docs, ranks, public_tokenizers.PATTERN).withColumn("back", B.decoded(F.col("ids"), ranks)).collect()
    want = [(r.doc_id, library.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in rows]
    assert sorted(str((r.doc_id, r.ids, bytes(r.back))) for r in got) == sorted(str(w) for w in want)
    assert B.encode(none, ranks, public_tokenizers.PATTERN).collect() == []


def test_long_words_merge_like_folded_ones(spark, ranks, library):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdethionrs") for _ in range(n)) for n in (2, 3, 60, 127, 128, 129, 400)] + ["a" * 100, "ab" * 64, "漢字" * 20]
    table = spark.createDataFrame([(w, [ranks[bytes([b])] for b in w.encode()]) for w in words], "word string, symbols array<int>")
    folded = {r.word: r.ids for r in table.select("word", B.folded(F.col("symbols"), ranks).alias("ids")).collect()}
    for w in words:
        assert folded[w] == B.merged(w.encode(), ranks) == library._encode_single_piece(w.encode())


def test_unknown_ids_decode_to_null(spark, ranks):
    assert spark.range(1).select(B.decoded(F.array(F.lit(5), F.lit(10_000_000)), ranks).alias("x")).first().x is None


# ------------------------------------------------------------------------------------------------ language

def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_LABELLED}/documents.parquet")
    model = L.fit_language_model(docs)
    got = L.predict_language(docs, model).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and set(model.langs) == {"de", "en", "es", "fr"}
    again = L.fit_language_model(docs.repartition(7))
    assert np.array_equal(model.scores, again.scores) and model.temperature == again.temperature


def plain_prediction(model, text):
    """Language and score of a text, n-gram by n-gram in plain Python."""
    if text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0
    data = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    total, n = [0.0] * len(model.langs), 0
    for width in (1, 2, 3, 4):
        for i in range(len(data) - width + 1):
            code = width
            for c in data[i:i + width]:
                code = (code * 0x01000193) % 2 ** 32 ^ c
            row = model.scores[(code * 0x9E3779B1) % 2 ** 32 >> 16]
            total, n = [t + float(v) for t, v in zip(total, row)], n + 1
    z = [(t / n + b) / model.temperature for t, b in zip(total, model.bias)]
    top = max(z)
    p = [np.exp(v - top) for v in z]
    return model.langs[int(np.argmax(z))], max(p) / sum(p)


def test_language_equals_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF_LABELLED}/documents.parquet")
    model = L.fit_language_model(docs)
    got = L.predict_language(docs.where("doc_id % 10 = 3"), model).join(docs, "doc_id").collect()
    assert len(got) > 20
    for r in got:
        lang, score = plain_prediction(model, r.text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_language_sample_is_bounded_in_bytes(spark, monkeypatch):
    text = "Grüße an alle 世界 " * 5000
    whole = L.drawn_grams(text, 1 << 30)
    some = L.drawn_grams(text)
    assert len(whole) > len(some) == L.ROW_GRAMS and set(some.tolist()) <= set(whole.tolist())
    monkeypatch.setattr(L, "BLOCK", 1000)
    assert len(L.drawn_grams(text)) == L.ROW_GRAMS
    assert L.drawn_grams("").size == 0
    docs = spark.createDataFrame([(1, "very long text " * 20000, "en"), (3, "kurz", "de"), (5, "", "de")] * 20, "doc_id long, text string, lang string")
    sample = L.training_sample(docs, "doc_id", "text", "lang", 10)
    assert 0 < len(sample) <= 10 and all(len(r.grams) <= 2 * L.ROW_GRAMS for r in sample)


def test_labelled_ids_that_repeat_stay_within_the_sample(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = [Q.training_rows(d, labels, "doc_id", "text", "quality", 50) for d in (docs, docs.repartition(5))]
    assert len(got[0]) == 50 and got[0] == got[1]


def test_language_edges(spark, docs, rows, none):
    model = L.LanguageModel(["en", "xx"], np.random.default_rng(0).normal(size=(L.BUCKETS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.6)
    got = L.predict_language(docs, model).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in got:
        if len(texts[r.doc_id]) == 1:
            t = next(iter(texts[r.doc_id]))
            assert (r.lang_pred == "und") == (t is None or not regex.search(r"\p{L}", t))
        assert r.lang_pred != "und" or r.score == 0
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert L.predict_language(none, model).collect() == []
    empty = L.fit_language_model(none)
    assert {r.lang_pred for r in L.predict_language(docs, empty).collect()} == {"und"}
    assert L.fit_language_model(docs.where("lang = 'en'")).langs == ["en"]


def test_blocks_of_a_long_text_see_every_gram(monkeypatch):
    text = "".join(random.Random(12).choice("abcdeé ") for _ in range(5000))
    model = L.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(L.BUCKETS, 2)), np.zeros(2), 1.0, 0.5)
    whole = model.logits(text)
    assert abs(whole).max() > 0
    monkeypatch.setattr(L, "BLOCK", 1 << 14)
    assert np.allclose(whole, model.logits(text))


# ------------------------------------------------------------------------------------------------ quality

def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF_LABELLED}/documents.parquet"), spark.read.parquet(f"{SF_LABELLED}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = Q.quality_scores(docs, Q.fit_classifier(docs, train), F.col("source"), F.col("lang")).join(test, "doc_id").collect()
    good, bad = [r.keep for r in got if r.quality], [r.keep for r in got if not r.quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_rates_shrink_as_computed_by_hand(spark, docs, rows):
    rng = np.random.default_rng(13)
    model = Q.Classifier(np.zeros(3 * Q.N_FEATURES), np.ones(3 * Q.N_FEATURES), rng.normal(size=3 * Q.N_FEATURES), 0.3)
    got = Q.quality_scores(docs, model, F.col("source"), F.col("lang")).toPandas()
    assert len(got) == len(rows)
    want = pd.DataFrame([(str(r.source), str(r.lang), 1 / (1 + np.exp(-np.clip(model.log_odds(Q.features(r.text or "")[None, :])[0], -30, 30)))) for r in rows], columns=["h", "p", "d"])
    rate = want.d.mean()

    def strength(groups, centre):
        n, k = groups.n.sum(), len(groups)
        inside = max((groups.s2 - groups.s1 ** 2 / groups.n).sum() / (n - k), 1e-9)
        between = ((groups.n * (groups.s1 / groups.n - centre) ** 2).sum() - (k - 1) * inside) / max(n - (groups.n ** 2).sum() / n, 1)
        return min(max(inside / between, 1), 1e6) if between > 0 else 1e6
    by = lambda keys: want.groupby(keys).d.agg(n="count", s1="sum", s2=lambda x: (x ** 2).sum()).reset_index()
    hosts, paths = by(["h"]), by(["h", "p"])
    up = paths.merge(hosts, on="h", suffixes=("", "_h"))
    kh, kp = strength(hosts, rate), strength(up, up.s1_h / up.n_h)
    full = want.merge(up, on=["h", "p"])
    host = (full.s1_h - full.d + kh * rate) / (full.n_h - 1 + kh)
    path = (full.s1 - full.d + kp * host) / (full.n - 1 + kp)
    assert np.allclose(sorted(got.host_rate), sorted(host)) and np.allclose(sorted(got.path_rate), sorted(path))
    odds = lambda q: np.log(q / (1 - q))
    score = 1 / (1 + np.exp(-(odds(full.d.clip(1e-12, 1 - 1e-12)) + odds(path) - odds(rate))))
    assert np.allclose(sorted(got.score), sorted(score), atol=1e-6)


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (7, 1), (14, None)], "doc_id long, quality int")
    one = Q.fit_classifier(docs, labels)
    assert set(one.weights) == {0.0} and one.bias > 0
    blank = Q.fit_classifier(none, labels.where("false"))
    assert Q.quality_scores(none, blank, F.col("source"), F.col("lang")).collect() == []
    assert all(r.keep is not None and r.score is not None for r in Q.quality_scores(docs, blank, F.col("source"), F.lit(None)).collect())
