import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score double, key string, label string"


@pytest.fixture(scope="session")
def docs(spark, docs_schema):
    """Small documents: nulls, empty and very long texts, copies and near copies, repeated rows, clashing columns."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    texts = dict(enumerate(base))
    for k in range(30, 45):  # near copies: one word in forty changed
        words = base[k - 30].split()
        for i in range(7, len(words), 60):
            words[i] = "changed"
        texts[k] = " ".join(words)
    texts |= {50: base[0], 51: base[0].upper(), 52: base[1], 60: None, 61: None, 62: "", 63: "  \n\t ", 64: "one two", 65: "one two", 66: "one two three four five", 67: "Ärger ÉTÉ été ÉTÉ naïve"}
    texts[70] = prose(rng, 30_000)
    rows = [(i, t, "en", "s", len(t or ""), -1, "x", 0.5, "k", None) for i, t in texts.items()]
    rows += [rows[3], rows[3], (None, "no id here at all five", None, None, None, 1, None, None, None, None)]
    return spark.createDataFrame(rows, docs_schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
