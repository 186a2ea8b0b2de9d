import hashlib
import random
import re

import pytest

from tallystone.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    wins = [(i, tuple(w[k : k + 10])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - 9))]
    for d, t in docs:
        w, hit, held = words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    held.add(str(i))
        out[d] = (len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    long = [" ".join(f"t{rng.randrange(40)}" for _ in range(n)) for n in (10, 11, 25, 40)]
    return [(i, t) for i, t in enumerate([*long, "short one", "Ärger été", long[0], None, "", "...", "the the the the the the the the the the the"])]


def test_against_brute_force(spark, items, docs_schema):
    rng = random.Random(4)
    noise = lambda n: " ".join(f"t{rng.randrange(60)}" for _ in range(n))
    docs = [(1, noise(30)), (2, f"{noise(20)} {items[2][1].upper()} {noise(5)}"), (3, items[0][1]), (4, None), (5, ""), (6, "a short, ONE!"), (7, "ärger été"), (8, "Ärger été Ärger"), (9, "the " * 30), (10, " ".join(items[3][1].split()[5:17]) + " x " + items[1][1]), (11, noise(20_000))]
    df = spark.createDataFrame([(i, t, None, None, None, 0, "r", None, None, None) for i, t in docs], docs_schema).repartition(3)
    bench = spark.createDataFrame([(i, t, "extra", 1) for i, t in items], "item_id long, text string, term string, n long")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(df, bench).collect()}
    assert got == brute(docs, items)


def test_shared_fixture(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    long = next(t for i, t in rows if i == 4)
    items = [(1, " ".join(long.split()[10:30])), (2, "no id here at all five")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(dict(rows).items(), items)


def test_proximity(spark, items):
    w = words(items[0][1])
    docs = [(1, " ".join(w[:3] + ["gap"] + w[3:])), (2, "nothing of this here")]
    got = {r.doc_id: r for r in D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string")).collect()}
    assert not got[1].contaminated and got[1].n_near == 1 and got[2].n_near == 0


def test_empty_tables(spark, no_docs, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(no_docs, none).collect() == []
    assert not any(r.contaminated for r in D.decontaminate(docs, none).collect())
