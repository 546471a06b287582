"""Word BPE, periodic runs and conversation repair against the library or brute force."""
import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from txrisk.llm import conversation_repair as R, periodic_runs as P, queries as Q, word_bpe as W

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------------------------------------ word BPE

@pytest.fixture(scope="module")
def tokenizer():
    return W.WordTokenizer.read(WORD_FILE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_spans_and_words_follow_the_library(tokenizer, library):
    rng, splitter = random.Random(3), W.Splitter(tokenizer)
    chars = list("ab'sreldmvtZé9 \n\t.,<|>/wΣςİ½²́̈각  ​\u0085\x1c\x1d\x1f 　漢٣🙂̀ͅÅﬁ\x00\x7fßŉǅ") + ["<|endoftext|>", "<|startoftext|>", "'re", "'ll"]
    for _ in range(8000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 16)))
        got = [i for span in text.encode().split() for w in splitter.words(span)
               for i in ([tokenizer.special[w[1:].decode()]] if w[0] == 0xFF else tokenizer.encode_word(w))]
        assert got == ids_of(library, text), repr(text)


def test_word_ids_and_text_equal_the_library(spark, docs, rows, none, tokenizer, library):
    for chunk_bytes in (W.CHUNK_BYTES, 1 << 12):
        got = W.decode_words(W.encode_words(docs, tokenizer, chunk_bytes=chunk_bytes), tokenizer).collect()
        want = [(r.doc_id, ids := ids_of(library, r.text), library.decode(ids, skip_special_tokens=False)) for r in rows]
        assert sorted(str((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(map(str, want))
    assert W.encode_words(none, tokenizer).collect() == []


def test_forgotten_words_are_encoded_again(spark, docs, rows, tokenizer, library, monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 3)
    got = W.encode_words(docs, tokenizer).collect()
    assert sorted(str((r.doc_id, r.ids)) for r in got) == sorted(str((r.doc_id, ids_of(library, r.text))) for r in rows)


def test_ids_without_a_piece(spark, tokenizer):
    df = spark.createDataFrame([([320, 49407],), ([],), (None,), ([5, 10_000_000],), ([-1],)], "ids array<int>")
    assert [r.decoded for r in W.decode_words(df, tokenizer).collect()] == ["a</w> <|endoftext|>", "", None, None, None]


def test_op13_contract(spark, library):
    got = {tuple(r) for r in Q.op13(spark, SF).collect()}
    want = set()
    for r in Q.documents(spark, SF).collect():
        ids = ids_of(library, r.text)
        back = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want


# ------------------------------------------------------------------------------------------------ periodic runs

def brute_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                run = words[i:i + length]
                if not any(run[d:] == run[:length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(6, 4), (3, 3), (20, 5)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(2)
    for _ in range(500):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            k = rng.choice([1, 2, 2, 3, 5])
            own = [rng.randrange(k) for _ in range(rng.randrange(60))]
            if rng.random() < .7:
                p = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
                own = own[:20] + p * rng.randrange(2, 8) + p[:rng.randrange(len(p))] + own[20:]
            docs.append(own)
        starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64)
        want = [(s + int(starts[d]), n, q) for d, own in enumerate(docs) for s, n, q in brute_runs(own, least, times)]
        assert P.find_runs(np.array([x for own in docs for x in own], np.int64), starts, least, times) == want


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_runs_of_documents(spark, docs, rows, none, monkeypatch):
    for held in (P.BATCH_WORDS, 50):
        monkeypatch.setattr(P, "BATCH_WORDS", held)
        got = P.periodic_runs(docs).collect()
        want = []
        for r in rows:
            runs = brute_runs(split(r.text)) if len(split(r.text)) < 2000 else [(0, 4000, 1)]
            want.append((r.doc_id, len(split(r.text)), runs, collapsed(split(r.text), runs)))
        assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(map(str, want))
    assert P.periodic_runs(none).collect() == []


def test_op11_contract(spark):
    got = {r.doc_id: tuple(r) for r in Q.op11(spark, SF).collect()}
    some = 0
    for r in Q.documents(spark, SF).collect():
        words, h = split(r.text), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        some += len(runs)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert got[r.doc_id] == (r.doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
                                 hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    assert some > 10


# ------------------------------------------------------------------------------------------------ conversation repair

def brute_repair(rows):
    """Cheapest (cost, audit) of rows (initial, must go, truncated), from a table of the best by state."""
    best = {0: (0, "")}

    def inserted(b):
        for _ in range(3):
            for s, (c, p) in list(b.items()):
                t, v = R.NEXT[s, R.WANTED[s][0]], (c + 2, p + "I")
                b[t] = min(b.get(t, v), v)
        return b
    for initial, must, truncated in rows:
        after = {}
        for s, (c, p) in inserted(best).items():
            options = [(s, 3, "D")]
            if not must:
                options.append((R.NEXT[s, R.WANTED[s][0]], 2 + truncated, "R"))
                options += [(R.NEXT[s, initial], truncated, "K")] if (s, initial) in R.NEXT else []
            for t, k, letter in options:
                v = (c + k, p + letter)
                after[t] = min(after.get(t, v), v)
        best = after
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_search_equals_brute_force_whole_and_in_blocks():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(rng.choice("suaoua"), rng.random() < .15, int(rng.random() < .3)) for _ in range(rng.randrange(14))]
        codes = "".join("x" if must else i.upper() if t else i for i, must, t in rows)
        want = brute_repair([(i if i != "o" else "?", m, t) for i, m, t in rows])[1]
        assert R.first_repair(codes, R.START, R.ends(), True)[0] == want
        a, b = sorted(rng.choices(range(len(codes) + 1), k=2))
        parts = [p for p in (codes[:a], codes[a:b], codes[b:]) if p]
        behind = [R.ends()]
        for p in reversed(parts[1:]):
            behind.insert(0, R.costs_before(p, behind[0]))
        state, out = R.START, ""
        for k, p in enumerate(parts):
            edits, state = R.first_repair(p, state, behind[k], k == len(parts) - 1)
            out += edits
        assert not parts or out == want


def brute_report(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fault == 1 else x.translate({ord(k): None for k in ".!?"}) if fault == 2 else x
        convs[c] += [(t, "user" if fault == 4 else r, x)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.md5(z[2].encode()).digest()))
        seen, count, codes = set(), [0, 0, 0], []
        for _, r, x in own:
            bare = x.rstrip(" \t\n\x0b\f\r")
            kind = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((r, x))
            if kind is not None:
                count[kind] += 1
            codes.append((r[:1], kind in (0, 1), int(kind == 2)))
        illegal = sum(p[1][:1] + q[1][:1] not in ("su", "ua", "au") for p, q in zip(own, own[1:]))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute_repair(codes)
        state, left, it = R.START, [], iter(own)
        for letter in audit:
            row = next(it) if letter != "I" else None
            if letter != "D":
                role = row[1] if letter == "K" else R.WANTED[state]
                left.append(f"{role}:{row[2] if row else ''}")
                state = R.NEXT[state, role[0]]
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(map(str, out))


def test_op12_contract(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted(str(tuple(r)) for r in Q.op12(spark, SF).collect()) == brute_report([tuple(r) for r in rows])


@pytest.fixture(scope="module")
def odd_conversations():
    """Nulls, ties, a long conversation, one text under many turns, one row many times."""
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["a.", "b!", "c", "", None, " ", "d?\n", "é."]
    rows = [(rng.choice([1, 2, 3, None, 7, 7, 7]), rng.choice([None, *range(30)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(9, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(400)] + [(11, 5, "user", "same.")] * 300
    return rows + [(12, i, "user", "again.") for i in range(300)] + [(13, None, None, None)]


def test_repair_edges(spark, odd_conversations):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in odd_conversations], "conv_id long, turn long, role string, text string, key string, part int, conv string").repartition(7)
    want = brute_report(odd_conversations)
    got = R.repair_conversations(Q.damaged(df), every=df)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    whole = R.repair_conversations(df).collect()
    left = R.repaired_rows(df).orderBy("conv_id", "part", "block", "at", "step").groupBy("conv_id").agg(F.count("*").alias("n")).collect()
    n = {r.conv_id: r.n for r in left}
    for r in whole:
        assert n.get(r.conv_id, 0) == len(r.audit.replace("D", ""))
    assert R.repair_conversations(df.where("false")).collect() == [] and R.repaired_rows(df.where("false")).collect() == []
    lost = R.repair_conversations(df.where("false"), every=df).collect()
    assert len(lost) == 9 and {(r.cost, r.audit, r.repaired_sha256) for r in lost} == {(0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows_read_as_conversations(spark, odd_conversations):
    df = spark.createDataFrame([r for r in odd_conversations if r[0] in (9, 7, 12)], "conv_id long, turn long, role string, text string")
    report = {r.conv_id: r for r in R.repair_conversations(df).collect()}
    rows = defaultdict(list)
    for r in R.repaired_rows(df).orderBy("conv_id", "part", "block", "at", "step").collect():
        rows[r.conv_id].append(r)
    for c, own in rows.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == report[c].repaired_sha256
