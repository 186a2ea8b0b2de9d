import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallystone.llm import packing, topk

PATH = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.15, 16))]) for i in range(120)]
    same = rows[7][1]
    rows += [(i, same) for i in range(120, 170)]  # ties
    rows += [(200, None), (220, []), (240, [1.0, None]), (260, [float("nan")] * 16), (280, [float("inf")] * 16), (300, [0.5] * 3), (None, same), (320, [0.0] * 16), rows[0], rows[20]]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    return rows, df


@pytest.mark.parametrize("values", [(topk.QUERY_VALUES, topk.BLOCK_VALUES), (60, 500)])
def test_top_k(spark, values):
    rows, df = vectors(spark)
    known = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_values=values[0], block_values=values[1]).collect()
    want = Counter()  # ids 0 and 20 stand in two rows, and each row is a query and a candidate
    for n, (q, own) in enumerate(known):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for m, (i, v) in enumerate(known) if m != n)[:20]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(tuple(r) for r in got) == want


def test_top_k_refuses_scores_beyond_64_bits(spark):
    big = spark.createDataFrame([(0, [1e19]), (1, [1e19])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(big, F.col("vec_id") % 20 == 0)


def test_top_k_empty_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


ODD = ["a\x1cb \x85 c", "é ́x \xa0y\u2028z", "<|endoftext|> x<|startoftext|>y", "it's 'S İstanbul ΑΣ 1234 ...!? don't", "", None, "中文字 測試 foo,bar;baz  ", "x" * 5000, "don't!! it's, 'tis...", "naïve ÉTÉ ... été***"]


def test_pack_gives_every_id_once(spark, docs):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(extra)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(ids(r.text))
    rows = packing.pack(df).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        data = np.array(texts[doc][0], "<u4")
        assert sum(p.length for p in own) == sum(len(x) for x in texts[doc])
        for p in own:
            assert p.doc_tokens == len(data) and p.ids_crc32 == zlib.crc32(data[p.start : p.start + p.length].tobytes())
        covered = sorted((p.start, p.length) for p in own)
        assert covered == sorted(covered) and sum(1 for s, _ in covered if s == 0) == len(texts[doc])
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0


def test_pack_empty(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_packer_packs_each_tier_and_balances():
    rng = random.Random(0)
    tiers, lengths = (16, 32, 64), [rng.choice([rng.randint(1, 16), rng.randint(17, 32), rng.randint(33, 64), rng.randint(65, 200)]) for _ in range(800)]
    packer, rows = packing.Packer(5, window=64, tiers=tiers, step=4, round_tokens=4000), []
    for d, n in enumerate(lengths):
        rows += packer.add(d, b"".join(bytes([d % 256, i % 256, 0, 0]) for i in range(n)))
    in_rounds = len(rows)
    rows += packer.finish()
    windows = {}
    for k, row in enumerate(rows):
        windows.setdefault(row[5], (k < in_rounds, []))[1].append(row)
    for in_round, own in windows.values():
        size = own[0][7]
        assert sum(r[2] for r in own) == size and [r[6] for r in own] == [sum(r[2] for r in own[:k]) for k in range(len(own))]  # full and gapless
        if in_round:
            assert size in tiers and (size == tiers[0] or own[0][2] > size // 2)  # begins with a piece of its tier
    assert {own[0][7] for in_round, own in windows.values() if in_round} == set(tiers)
    assert min(windows) == 5 and sum(r[2] for r in rows) == sum(lengths)
    covered = {}
    for d, start, n, *_ in rows:
        covered.setdefault(d, []).append((start, n))
    for d, own in covered.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[d]
    groups = {}
    for in_round, own in windows.values():
        if in_round:
            groups.setdefault((own[0][7], own[0][8]), []).append(sum(r[2] ** 2 for r in own))
    for (size, _), costs in groups.items():
        assert len(costs) * size <= 4 * 64  # tokens of a step
    assert len({g for _, g in groups}) == len(groups)


def brute_fewest_pieces(lengths, sizes):
    """The fewest pieces in which documents can fill windows of these sizes, by trying every order."""
    best = None
    for order in itertools.permutations(lengths):
        ends = set(itertools.accumulate(order)) | set(itertools.accumulate(sizes))
        best = min(best or len(ends), len(ends))
    return best


@pytest.mark.parametrize("lengths", [(8, 4, 4), (7, 6, 3), (5, 5, 6), (3, 3, 3, 3, 4), (16, 9, 7), (13, 2, 1)])
def test_packer_cuts_little(lengths):
    packer = packing.Packer(0, window=16, tiers=(4, 8, 16), step=2, round_tokens=10**6)
    rows = [r for d, n in enumerate(lengths) for r in packer.add(d, bytes(4 * n))] + packer.finish()
    sizes = [own[0][7] for own in ([r for r in rows if r[5] == s] for s in sorted({r[5] for r in rows}))]
    assert sum(r[2] for r in rows) == sum(lengths) == sum(sizes)
    fewest = brute_fewest_pieces(lengths, sizes)
    print(f"{lengths}: {len(rows)} pieces in windows of {sizes}, fewest {fewest}")
    assert len(rows) <= fewest + 2


def test_added_tokens_match_raw_text_only():
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> Some Words<|endoftext|>X <|StartOfText|>, <|startoftext|>", "Plain WORDS here<|endOfText|>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(PATH)(texts)] == [ids(t) for t in texts]


def test_small_cache_gives_the_same_ids():
    texts = [f"word{i} Other{i}, été{i}!" for i in range(300)] * 2
    small, large = packing.Encoder(PATH, kept_words=50), packing.Encoder(PATH)
    assert sum((small(texts[i : i + 20]) for i in range(0, 600, 20)), []) == large(texts)
