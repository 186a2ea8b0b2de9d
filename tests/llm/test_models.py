"""Quality, language models and license scans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import licenses, lm_scoring, quality


def corpus(spark, n=240):
    rng = random.Random(8)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "lamp", "river", "stone", "walks", "home", "slowly"]) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(rng.randint(2, 8)))
    bad = lambda: "\n".join(" ".join(rng.choice(["BUY", "CHEAP", "WIN"]) + "!!" for _ in range(rng.randint(6, 14))) for _ in range(rng.randint(2, 8)))
    rows = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(n)]
    return spark.createDataFrame([(i, t, 9.0, "x") for i, t, _ in rows], "doc_id long, text string, score double, predicted string"), spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    rows = quality.score(docs, model).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_depends_on_text_only_and_takes_odd_texts(spark, docs, no_docs):
    train, labels = corpus(spark, 90)
    model = quality.train(train, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert by_text[None] == by_text[""] == by_text["  \n\t "] == {model.prior}
    assert quality.score(no_docs, model).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, 1)], [(1, 0)]])
def test_quality_without_two_labels(spark, docs, rows):
    model = quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, model).collect()} == {model.prior}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    counts, trans = np.array([3, 0, 1, 5]), rng.normal(size=(2, 2))
    scores = rng.normal(size=9)
    good, pairs, norm = quality.forward_backward(scores, trans, counts)
    at, want_pairs = 0, np.zeros((2, 2))
    for k, n in enumerate(counts):
        paths = [[(c >> i) & 1 for i in range(n)] for c in range(2**n)]
        logs = [sum(scores[at + i] * y for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths]
        if n:
            total = np.logaddexp.reduce(logs)
            assert abs(total - norm[k]) < 1e-9
            for i in range(n):
                assert abs(good[at + i] - sum(np.exp(v - total) for p, v in zip(paths, logs, strict=True) if p[i])) < 1e-9
            for p, v in zip(paths, logs, strict=True):
                for a, b in zip(p, p[1:], strict=False):
                    want_pairs[a, b] += np.exp(v - total)
        at += n
    assert np.allclose(pairs, want_pairs)


def test_line_features_do_not_depend_on_the_chunk():
    texts = [b"One two two.\n\nTHREE!! x|y", None, b"", b"a" * 1000 + b"\n", "é\n%%% 12".encode()]
    together = quality.lines_of(texts)
    alone = [quality.lines_of([t]) for t in texts]
    assert np.allclose(together[0], np.concatenate([a[0] for a in alone])) and together[2].tolist() == [3, 1, 1, 2, 2]


def brute_losses(rows, target):
    """Losses of each text from dictionaries of words; None is the end mark and "" the unknown word."""
    known = {i: (t or "").encode().lower().split() for i, t in rows}
    often = {w for w, n in Counter(w for ws in known.values() for w in ws).items() if n >= lm_scoring.MIN_COUNT}
    chains = {i: [None, *(w if w in often else "" for w in ws), None] for i, ws in known.items()}
    counts = []
    for keep in (lambda i: i in target, lambda i: True):
        uni, bi = Counter(), Counter()
        for i, chain in chains.items():
            if keep(i):
                uni.update(chain[1:])
                bi.update(zip(chain, chain[1:], strict=False))
        counts.append((uni, bi))
    out = {}
    for i, chain in chains.items():
        losses = []
        for uni, bi in counts:
            total, loss = sum(uni.values()), 0.0
            for v, x in zip(chain, chain[1:], strict=False):
                single = (uni[x] + lm_scoring.ADD) / (total + lm_scoring.ADD * (len(often) + 2))
                paired = bi[v, x] / uni[v] if uni[v] else single
                loss -= np.log2(lm_scoring.WEIGHT * paired + (1 - lm_scoring.WEIGHT) * single)
            losses.append(loss / (len(chain) - 1))
        out[i] = (len(chain) - 1, *losses)
    return out


def test_lm_scores_against_dictionaries(spark, no_docs):
    rng = random.Random(6)
    rows = [(i, " ".join(f"v{rng.randrange(30)}" for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(90, None), (91, "  "), (92, "Only ONCE Here")]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n_tokens int, target_loss double").repartition(3)
    target = {i for i, _ in rows if i % 2}
    labels = spark.createDataFrame([(i,) for i in target] + [(None,), (1,)], "doc_id long")
    want = brute_losses(rows, target)
    for r in lm_scoring.score(docs, labels).collect():
        assert np.allclose((r.n_tokens, r.target_loss, r.background_loss, r.score), (*want[r.doc_id], want[r.doc_id][1] - want[r.doc_id][2]))
    assert lm_scoring.score(no_docs, labels).collect() == []
    assert len(lm_scoring.score(docs, labels.limit(0)).collect()) == len(rows)


def test_lm_counts_each_of_many_words_apart(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 40_000)  # many parts and ranges
    rng = random.Random(7)
    rows = [(i, " ".join(f"v{rng.randrange(60_000)}" for _ in range(500))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = set(range(0, 120, 3))
    want = brute_losses(rows, target)
    got = lm_scoring.score(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.n_tokens, r.target_loss, r.background_loss), want[r.doc_id], rtol=1e-9)


def test_lm_packs_numbers_and_keys():
    for x in ([], [0, 255], [256, 3], [1 << 40, 0]):
        assert lm_scoring._unpacked(lm_scoring._packed(np.array(x, np.int64))).tolist() == x
    keys = np.array([0, 5, 1 << 63, (1 << 64) - 1], np.uint64)
    assert lm_scoring._unpacked_keys(lm_scoring._packed_keys(keys)).tolist() == keys.tolist()
    cut = lm_scoring._slices(7, keys, np.arange(4), np.arange(4), 3)
    assert cut["bucket"] == [0, 1, 2] and [len(lm_scoring._unpacked_keys(k)) for k in cut["keys"]] == [2, 1, 1]


def test_lm_prefers_target_texts(spark):
    rows = [(i, "alpha beta gamma delta " * 5) for i in range(10)] + [(i, "one two three four " * 5) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, docs.where("doc_id < 5").select("doc_id")).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 20))


def brute_licenses(text):
    """license -> best share of its shingles in any stretch of the text, template and a half long."""
    out = {}
    plain = licenses.plain((text or "").encode()).lower().split()
    runs = [b" ".join(plain[i : i + 5]) for i in range(len(plain) - 4)] if len(plain) >= 5 else [b" ".join(plain)] if plain else []
    for name, t in licenses.TEMPLATES.items():
        w = licenses.plain(t.encode()).lower().split()
        own = {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)}
        reach = (len(w) - 4) * 3 // 2
        best = max((len(own & set(runs[p : p + max(1, reach)])) for p in range(len(runs))), default=0) / len(own)
        if best >= licenses.CONTAINED:
            out[name] = best
    return out


def test_license_scan_against_brute_force(spark, docs, no_docs):
    rng = random.Random(9)
    fill = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    rows = []
    for k, (_, t) in enumerate(licenses.TEMPLATES.items()):
        words = t.split()
        spoiled = list(words)
        for i in range(0, len(words), 40):
            spoiled[i] = "other"
        rows += [(10 * k, f"{fill(37)} {t} {fill(11)}"), (10 * k + 1, t.upper()), (10 * k + 2, fill(60) + "\n" + " ".join(spoiled)), (10 * k + 3, " ".join(words[: len(words) // 2]))]
    rows += [(900, None), (901, ""), (902, "MIT License"), (903, fill(5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in licenses.scan(df).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.containment
        assert r.first_word <= r.last_word
    assert got == {i: f for i, t in rows if (f := brute_licenses(t))}
    assert licenses.scan(docs).collect() == [] and licenses.scan(no_docs).collect() == []
    with pytest.raises(ValueError):
        licenses.Scanner({"x": "too short"})
