import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallystone.llm import near_dedup as N
from tallystone.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(s and 100 * len(s & t) >= 75 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = N.near_dedup(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in got)
    assert sizes == sorted((i if i is not None else -1, len(shingles(t))) for i, t in rows)


def test_against_all_pairs(docs):
    check(docs)


def test_empty(no_docs):
    assert N.near_dedup(no_docs).collect() == []


def test_large_family_and_shared_passage(spark):
    """A family larger than a node and a passage that most documents share."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(120, 300):
        own = [f"y{rng.randrange(10**6)}" for _ in range(rng.choice([5, 10, 60]))]
        rows.append((i, " ".join(passage + own)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_lone_pairs_among_texts_with_one_long_passage(spark, monkeypatch):
    """Texts of 80-85 percent one passage, not similar to each other, with pairs of similarity just over 0.75 among them."""
    monkeypatch.setattr(N, "NODE", 8)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(164)]  # 160 shingles
    own = lambda n: [f"y{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(i, " ".join(passage + own(rng.randint(30, 38)))) for i in range(160)]
    for i in range(160, 190, 2):  # 160 + 10 shingles of 160 + 10 + 2 * 26 in common
        both = own(10)
        rows += [(i, " ".join(passage + both + own(26))), (i + 1, " ".join(passage + both + own(26)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sum(i != c for i, c in brute(rows).items()) == 15
    check(df)


def test_threshold_is_exact(spark):
    """75 of 100 shingles in common is a link, 74 of 100 is none."""
    words = [f"w{i}" for i in range(91)]  # 87 shingles
    a = " ".join(words)
    b = " ".join([*words[:79], *(f"z{i}" for i in range(13))])
    check(spark.createDataFrame([(1, a), (2, b), (3, b + " end")], "doc_id long, text string"))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 150), (200, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[200] == got[150] == 150
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_random_edits(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(1, 4)):
            words = [w if rng.random() > 0.03 else f"e{rng.randrange(5000)}" for w in base]
            rows.append((n, " ".join(words)))
            n += 1
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_first_round_proposes_few_pairs_that_connect():
    """One node whose agreements lie around CLEAR and one of unlike rows: at most two pairs a row, and the clear ones connect
    what all clear pairs connect."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, N.HASHES, dtype=np.uint8)
    marks = []
    for _ in range(300):
        row = base.copy()
        at = rng.random(N.HASHES) < 0.08
        row[at] = rng.integers(0, 256, int(at.sum()))
        marks.append(row.tobytes())
    marks += [rng.integers(0, 256, N.HASHES, dtype=np.uint8).tobytes() for _ in range(50)]
    keys, ids = [1] * 300 + [2] * 50, rng.permutation(1000)[:350]
    table = pa.table({"key": pa.array(keys, pa.int64()), "id": pa.array(ids), "n": pa.array([100] * 350), "marks": pa.array(marks, pa.binary())})
    _, i, j, same = N._close(table)
    clear = same >= N.CLEAR
    assert 5_000 < clear.sum() < 40_000
    got = [p for batch in N._first_round(table) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert len(got) <= 2 * 350

    def parts(pairs):
        label = {int(x): int(x) for x in ids}
        for _ in range(350):
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        return label

    all_clear = [(int(a), int(b)) for a, b in zip(ids[i[clear]], ids[j[clear]], strict=True)]
    taken, label = N._forest(350, i[clear], j[clear])
    forest = [all_clear[k] for k in taken]
    assert len(forest) == 350 - len(set(label.tolist()))
    assert parts(forest) == parts(all_clear)
    assert {(min(p), max(p)) for p in forest} <= set(got)
    assert not any(x in ids[300:] for p in got for x in p)


def test_forest_of_odd_links():
    assert [len(x) for x in N._forest(0, np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0]
    for i, j in (([0, 0, 1], [1, 2, 2]), ([5, 4, 3, 2, 1], [4, 3, 2, 1, 0]), ([9] * 9, range(9)), ([0, 0, 0], [1, 1, 1])):
        taken, label = N._forest(10, np.array(i), np.array(j))
        assert len(taken) == 10 - len(np.unique(label)) and len(np.unique(label[[*i, *j]])) == 1


def test_rows_met_in_nodes_grow_with_a_family_and_end_at_the_exact_level(spark, monkeypatch):
    """Families of near copies, larger than nodes: at most a row a document, tree and level, double the family double the rows."""
    monkeypatch.setattr(N, "NODE", 8)
    whole, met = N.materialize, []

    def counted(df, name):
        out = whole(df, name)
        if name in ("frontier", "large", "members"):
            met.append(out.count())
        return out

    monkeypatch.setattr(N, "materialize", counted)
    totals = []
    for family in (60, 120):
        rng, base = random.Random(2), [f"b{i}" for i in range(300)]
        rows = []
        for i in range(family):
            words = list(base)
            words[rng.randrange(300)] = f"x{i}"
            rows.append((i, " ".join(words)))
        met.clear()
        check(spark.createDataFrame(rows, "doc_id long, text string"))
        totals.append(sum(met))
        assert totals[-1] <= 1.25 * family * N.TREES * (N.EXACT + 2)
    assert totals[1] <= 2.5 * totals[0]
