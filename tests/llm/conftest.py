import random

import pytest

# Texts that break careless code, among ordinary ones.
ODD = [None, "", "   ", "\n", "a", "A a", "x" * 3000, "word " * 4000, "é ü ñ 漢字 🙂", "a\x00b", "end ", " start", "two  blanks", "tab\tand\nline", "MIT License", "don't stop, we'll go"]
WORDS = "the of license mit apache general public river stone water under light paper green wood small great house".split()


@pytest.fixture(scope="session")
def texts():
    """Ordinary texts with exact and near copies and shared passages, then the odd ones."""
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) + str(rng.randrange(40) or "") for _ in range(n))
    out = [make(rng.randrange(5, 90)) for _ in range(60)]
    passage = make(30)
    out += [make(20) + " " + passage + " " + make(5) for _ in range(6)]
    out += [out[3]] * 5 + [out[10] + " tail", out[11].replace("the", "a", 1), out[12].upper()]
    return out + ODD


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every text twice under other ids, a repeated row, null ids, and columns named as operators might name theirs."""
    rows = [(i * 7 % 997, t, "en", f"src{i % 4}", "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[2], (None, "no id", None, None, "x", 1, "y"), (None, None, "en", "src1", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, size int, kept string").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def rows(docs):
    return docs.collect()
