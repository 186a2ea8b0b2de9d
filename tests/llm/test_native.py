"""Chat formatting, URL filters and sharding."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallystone.llm import chat_format as C
from tallystone.llm import sharding, url_filters

CHATS = "conv_id long, turn long, role string, text string, formatted string, starts int"
TEXTS = [C.HOSTILE, "", None, "<\\|im_end\\|> <|", "a<|im_sep|>b", "<\\\\|x", "line\nfeed\n", "ünï çødé 🎉", "|<", "<|", "%0A%25"]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "odd\nrole%0A<|"]), rng.choice(TEXTS), "x", 1) for c in range(25) for t in range(rng.randint(1, 7))]
    rows += [(99, 0, "assistant", "again", "x", 1)] * 3 + [(None, 0, "user", "no id", "x", 1), (98, None, "user", "first", "x", 1), (98, 1, "user", "x" * 200_000, "x", 1)]
    return rows


def test_round_trip(spark, turns):
    df = spark.createDataFrame(turns, CHATS).repartition(3)
    got = {r.conv_id: r for r in C.digest(C.format_chat(df)).collect()}
    by = {}
    for c, t, role, text, *_ in turns:
        by.setdefault(c, []).append(((-1 if t is None else t), role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_control_strings_only_mark(spark, turns):
    for r in C.format_chat(spark.createDataFrame(turns, CHATS)).select("formatted", F.aggregate("segments", F.lit(0), lambda n, s: n + F.length(s["text"])).alias("n")).collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") >= 1 and r.n == len(r.formatted)
        roles = [b.split("\n")[0] for b in r.formatted.split("<|im_start|>")[1:]]
        assert all(a != b for a, b in zip(roles, roles[1:], strict=False))  # neighbours are merged


def test_no_chats(spark):
    assert C.format_chat(spark.createDataFrame([], CHATS)).collect() == []


URLS = [None, "", "no scheme", "http://x.org", "http://x.org/", "https://A.EXAMPLE.org/es/1?x=/es/", "http://example.org/en/12", "http://notexample.org/en/1", "http://example.org/en/2", "https://b.com/fr/", "https://b.com/de/x#y", "http://com/de/", "a://b://c.org/x", "http://.org/", "http://org.com/de/", "http://u@x.org:80/", "http://x.com\n/fr/"]


def verdict(url):
    head, sep, rest = (url or "").partition("://")
    rest = rest if sep else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h + p, a) for h, p, a in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda x: (-len(x[0]), x[0])) if fits else (None, "allow")
    return host, path, *best


@pytest.mark.parametrize("bound", [0, 100])
def test_url_rules(spark, bound):
    pages = spark.createDataFrame([(i % 9, u, "rule", "host") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, host string").repartition(3)
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    got = Counter(tuple(r) for r in url_filters.url_filter(pages, rules, max_broadcast_rules=bound).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == Counter((i % 9, *verdict(u)) for i, u in enumerate(URLS * 2))


def test_url_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    assert url_filters.url_filter(none, rules).collect() == []
    assert [r.verdict for r in url_filters.url_filter(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), rules.limit(0)).collect()] == ["allow"]


def shards_ok(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    counts = [len(by.get(s, [])) for s in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(n_shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_sharding_law_and_sizes(docs):
    rows = sharding.shard(docs, 7).collect()
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == texts
    shards_ok(rows, 7)


def test_sharding_keeps_groups_together(spark):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(600)]
    rows = [t for t in texts[:200] for _ in range(rng.randint(2, 4))] + texts[200:540] + [t for t in texts[540:543] for _ in range(60)] + ["hot"] * 500
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(4)
    found = sharding.shard(df, 10)
    got = found.collect()
    shards_ok(got, 10)
    by = {}
    for r in got:
        by.setdefault(rows[r.doc_id], Counter())[r.shard] += 1
    pairs = lambda n: n * (n - 1) // 2
    links = sum(pairs(sum(c.values())) for c in by.values())
    cut = links - sum(pairs(n) for c in by.values() for n in c.values())
    assert tuple(sharding.cut_edges(found).first()) == (links, cut)
    assert all(len(c) == 1 for t, c in by.items() if t != "hot")  # all fit: the best there is
    size, n = len(rows) // 10, 500
    best = pairs(n) - sum(pairs(x) for x in [size + 1] * (n // (size + 1)) + [n % (size + 1)])
    assert pairs(n) - sum(pairs(x) for x in by["hot"].values()) <= best + n  # shards differ by one


def best_cut(sizes, quotas):
    """The fewest cut pairs of any split of the groups over shards of these quotas, by brute force."""
    if not sizes:
        return 0

    def splits(n, room):
        if not room:
            if n == 0:
                yield ()
            return
        for x in range(min(n, room[0]) + 1):
            for rest in splits(n - x, room[1:]):
                yield (x, *rest)

    best = None
    for taken in splits(sizes[0], quotas):
        own = (sum(taken) ** 2 - sum(x * x for x in taken)) // 2
        after = best_cut(sizes[1:], tuple(q - x for q, x in zip(quotas, taken, strict=True)))
        if after is not None and (best is None or own + after < best):
            best = own + after
    return best


@pytest.mark.parametrize("sizes, singles", [((2, 2, 2), 6), ((4, 3, 2), 9), ((3, 3, 3), 3), ((7, 2, 2), 4), ((5, 2), 5), ((7, 2, 2), 1), pytest.param((3, 3, 3), 0, marks=pytest.mark.xfail(reason="without free documents moves are few: 7 links cut where none need be"))])
def test_sharding_against_brute_force(spark, sizes, singles):
    rows = [f"g{k}" for k, n in enumerate(sizes) for _ in range(n)] + [f"single {k}" for k in range(singles)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    found = sharding.shard(df, 3)
    shards_ok(found.collect(), 3)
    quotas = tuple(len(rows) // 3 + (s < len(rows) % 3) for s in range(3))
    cut, best = sharding.cut_edges(found).first().cut_links, best_cut(sizes, quotas)
    start = sum(n * (n - 1) / 2 for n in sizes) * 2 / 3  # what chance alone cuts
    print(f"cut links {cut}, least possible {best}, by chance {start:.1f}")
    assert best <= cut <= (best + start) / 2 + 1


def test_flows_keep_within_room():
    rng = random.Random(4)
    import numpy as np

    for _ in range(200):
        wanted = np.array([[0 if i == j else rng.randrange(50) for j in range(5)] for i in range(5)])
        room = np.array([rng.randrange(-20, 40) for _ in range(5)])
        f = sharding.flows(wanted, room)
        assert (f >= 0).all() and (f <= wanted).all()
        gain = f.sum(axis=0)
        assert all(g == 0 or g - o <= r for g, o, r in zip(gain, f.sum(axis=1), room, strict=True))


def test_sharding_empty(no_docs):
    assert sharding.shard(no_docs).collect() == []
