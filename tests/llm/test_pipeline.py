"""The pipeline against its parts on a small folder of tables, and the queries' names."""

import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from tallystone.llm import catalog

from .test_decontamination import brute as contaminated
from .test_near_dedup import brute as groups


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = [f"word{i}" for i in range(800)]
    good = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    bad = lambda n: "\n".join(" ".join(rng.choice(words).upper() + "!!" for _ in range(12)) for _ in range(n))
    rows = [(i, good(6) if i % 4 else bad(6)) for i in range(160)]
    rows += [(200, rows[1][1]), (201, rows[2][1] + " tail"), (202, rows[5][1].upper()), (203, None), (204, "")]
    rows.append(rows[9])
    items = [(0, " ".join(rows[13][1].split()[5:30])), (1, "words that nowhere else are seen in any of these texts")]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows, items


def test_stages(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, {i: t for i, t in rows}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = sorted((r.doc_id for r in docs.collect()))
    good = set(seen["quality"])
    assert all(i in good for i in range(160) if i % 4) and not any(i in good for i in range(0, 160, 4))
    component = groups([(i, t) for i, t in rows if i in good])
    assert seen["near_dedup"] == sorted(i for i in good if component[i] == i)
    dirty = {i for i, x in contaminated([(i, kept[i]) for i in seen["near_dedup"]], items).items() if x[4]}
    assert dirty and seen["decontamination"] == sorted(set(seen["near_dedup"]) - dirty)
    assert sorted({r.doc_id for r in docs.collect()}) == seen["decontamination"]


def test_run(spark, folder):
    at, rows, _ = folder
    got = corpus_pipeline.run(spark, at)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100


def test_names():
    names = list(catalog.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) and len(names) == 10
    assert set(catalog.oracle_sql()) <= set(names) and "pipeline" in __spark_entry__.queries()


def test_odd_rows_in_every_stage(spark, folder):
    """Null ids and texts, ids with several texts, repeated rows, and columns with the operators' names."""
    at, rows, items = folder
    long = next(t for i, t in rows if i == 21)
    odd = [(None, items[0][1] + " after"), (None, long), (7, rows[7][1]), (7, rows[10][1]), (7, rows[7][1]), (300, None), (301, ""), (302, "word1 " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 5, 1.5, "k", 2, 3) for i, t in odd], "doc_id long, text string, _n string, predicted int, score double, row_key string, row long, id int")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and {(r.predicted, r.score, r.row_key) for r in out.collect()} <= {(5, 1.5, "k")}
        empty = stage(spark, docs.limit(0), at)
        assert empty.columns == docs.columns and empty.collect() == []
        kept = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "near_dedup":  # of the repeated row one, and both texts of id 7
            assert kept == Counter(set(odd))
        if name == "decontamination":
            assert kept == Counter(odd[1:])
    pieces = corpus_pipeline.packing_stage(spark, docs, at).collect()
    assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(i for i, _ in odd)
