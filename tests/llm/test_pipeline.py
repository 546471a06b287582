"""The pipeline and the contracts of the registered queries against brute force."""
import base64
import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_dedup import brute_fingerprint, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """What every stage returns, from the given documents and some rows that break careless code."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90001, None, "en", "src1", 0), (90002, "", None, None, 0), (None, "a text without an id, but with some words in it", "en", "src1", 1),
           (5, "another text under a known id, long enough to be kept by all", "en", "src2", 1)] + [(90003, "this row stands here twice and is long enough to be kept", "en", "src3", 9)] * 2
    docs = docs.select(COLUMNS).unionByName(spark.createDataFrame(odd, docs.select(COLUMNS).schema)).cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns(steps):
    assert all(c == COLUMNS for c in steps[1][:-1])
    assert steps[1][-1] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_stage_keeps_the_kept(spark, steps):
    before, after = steps[0][:2]
    verdict = {}
    scored = entry.queries()["op8_quality_classifier"](spark, SF).collect()
    for r in scored:
        verdict[r.doc_id] = r.keep
    got = {r.doc_id for r in after}
    assert all((r.doc_id in got) == verdict[r.doc_id] for r in before if r.doc_id in verdict and r.doc_id != 5)
    assert None in got and len(after) < len(before)


def test_exact_stage(steps):
    before, after = steps[0][1:3]
    groups = defaultdict(list)
    for r in before:
        groups[r.text or ""].append(r.doc_id)
    assert Counter(r.text or "" for r in after) == Counter(groups.keys())
    assert all(r.doc_id == max((i for i in groups[r.text or ""] if i is not None), default=None) for r in after)


def test_near_stage(steps):
    before, after = steps[0][2:4]
    prints = [brute_fingerprint(r.text) for r in before]
    group = roots(set(prints), [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4])
    low = {}
    for r, p in zip(before, prints):
        low.setdefault(group[p], set()).add(r.doc_id)
    names = {g: min((i for i in ids if i is not None), default=None) for g, ids in low.items()}
    want = [r for r, p in zip(before, prints) if r.doc_id == names[group[p]]]
    assert sorted(map(str, after)) == sorted(map(str, want))


def test_near_stage_broadcasts_no_exploded_table(spark, monkeypatch):
    from txrisk.llm import simhash
    seen = []
    monkeypatch.setattr(simhash, "links", lambda *a, keep=simhash.links: seen.append(keep(*a)) or seen[-1])
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(50)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate([*texts, *texts[:5]])]   # a copy is a near copy as well
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    assert sorted(r.doc_id for r in got) == list(range(50)) and len(seen) == 1
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_mixing_stage(steps):
    before, after = steps[0][3:5]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    copies = Counter(map(str, after))
    assert set(copies) <= set(map(str, before)) and max(copies.values()) <= 3
    from txrisk.llm.mixing import quotas
    by = defaultdict(int)
    for r in before:
        by[r.source] += size(r)
    target = quotas(dict(by), sum(by.values()))
    taken = defaultdict(int)
    for r in after:
        taken[r.source] += size(r)
    least = {s: min(n for r in before if r.source == s and (n := size(r))) for s, t in target.items() if t}
    assert all(abs(taken[s] - t) <= max(least[s], 0.02 * t) for s, t in target.items() if t)


def test_token_stage(steps):
    before, after = steps[0][4:6]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in before:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in after)


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_empty_documents_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"op\d+_", n)])
def test_queries_return_every_row(spark, name):
    table, key = {"op7": ("embeddings", "vec_id"), "op12": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = entry.queries()[name](spark, SF)
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    whole = whole.select(key).distinct() if name.startswith("op12_") else whole
    assert got.count() == whole.count() and got.select(key).exceptAll(whole.select(key)).isEmpty()
    assert not got.where(F.col(key).isNull()).count()


CLASHING = """id key chunk bucket text_binary words ids decoded runs collapsed n_words n_runs start length period size source_size target taken mix_size mix_copies shard slot law
n_tokens ids_sha256 keep keep_id kept group_size text_sha256 score labels base_labels fingerprint component_id node root lang_pred held_out __id __key __words __copies part block
conv place codes hash vec n_links value rate host path name a b""".split()


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """The given tables with a column named like every column that a query returns or might use."""
    folder = str(tmp_path_factory.mktemp("clash"))
    for table in ("documents", "labels", "embeddings", "conversations", "benchmark", "pages"):
        df = spark.read.parquet(f"{SF}/{table}.parquet")
        df = df.limit(60) if table == "documents" else df
        df.select("*", *[F.lit(i if i % 2 else f"x{i}").alias(c) for i, c in enumerate(CLASHING) if c not in df.columns]).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"op\d+_", n)])
def test_clashing_columns(spark, clashing, tmp_path_factory, name):
    plain = str(tmp_path_factory.mktemp("plain"))
    for table in ("documents", "labels", "embeddings", "conversations"):
        own = spark.read.parquet(f"{SF}/{table}.parquet").columns
        spark.read.parquet(f"{clashing}/{table}.parquet").select(own).write.parquet(f"{plain}/{table}.parquet")
    got = [sorted(map(str, entry.queries()[name](spark, d).collect())) for d in (clashing, plain)]
    assert got[0] == got[1] and got[0]


def test_pipeline_with_clashing_columns(spark, clashing):
    assert corpus_pipeline.run(spark, clashing).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
