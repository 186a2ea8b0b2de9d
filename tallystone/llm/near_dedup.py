"""MinHash near-deduplication by a chosen-path set similarity join.

1. Each document gets the size and a 128-bit sum of its set of distinct 5-word shingles, and a MinHash sketch. Documents
   with the same set form a class; only a class's smallest document goes on.
2. In each of TREES trees a node is the documents whose paths agree so far; a path is a chain of minwise tokens, one
   chosen sketch function a level. Nodes of at most NODE documents compare their sketches exhaustively; larger ones
   branch on their next token, down to the third level (EXACT, from 0). All documents of nodes that are larger there
   take part in the exact join of step 4, which finds every link inside them, so branching further would find nothing more;
   they are only dealt to blocks of at most about NODE, anew in every tree, each with the node's smallest document, which proposes
   links early. A pair of similarity 0.75 whose nodes are small at once is missed with a chance of 0.25**TREES, at the
   third level with 0.58**TREES (5e-5).
3. Sketches only propose: the full sets of the proposed documents are made again and each pair is confirmed on them.
   The first round proposes what should connect the documents of a node, two pairs a document at most: a forest of
   the clearly similar pairs, and each document's best other outside its tree of that forest. The second goes through all nodes again with every pair that sketches
   allow and that the links found so far do not connect, and confirms them inside the node, so none is left out.
4. The exact join, before the second round: similar sets share a shingle among the 25 percent that each set has first,
   common shingles coming last. The documents of each such shingle become a node of the second round, less those that even
   all shingles from that one on could not link with the shortest one there. A list of over NODE documents is dealt to
   pairs of blocks, so that all its pairs of different components meet.
5. Connected components of the confirmed links.

Defined cases: words are runs of other than ASCII white space, A-Z lower-cased; a text of under five words is one shingle; a
null text or one without words has an empty set, no links and itself as component; repeated rows are copies and each
has a result row; rows that share a doc_id are linked with each other and keep all the links of their texts; a null doc_id has no
component and is kept; very long texts are handled alone, in memory proportional to their length; an empty table gives an
empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.llm.arrow_text import Words, chunks, give_back, mixed
from tallystone.llm.common import arrow_rows, broadcast_within, materialize
from tallystone.llm.components import components

SHINGLE, PERCENT = 5, 75
HASHES, TREES, NODE = 256, 18, 1024
#: Sketches must agree this far for a pair to be proposed (4.4 standard errors below 0.75), and this far to be clearly similar.
PROPOSE, CLEAR, BEST = 0.63, 0.85, 1
#: The last level (from 0), whose larger nodes are joined exactly; shingles of more documents than COMMON come last in the order, the
#: most frequent COMMON_TOKENS at most. Any order gives the same links.
EXACT, COMMON, COMMON_TOKENS = 2, 16, 1_000_000
#: Ids or small rows that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Rows with full sets in an Arrow batch; pairs of rows that are compared at once.
SET_ROWS, PART_PAIRS = 500, 500_000

_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: The sketch function that tree t reads at level l.
CHOSEN = np.stack([_RANDOM.permutation(HASHES)[: EXACT + 1] for _ in range(TREES)])


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, text after text, and where each text's begin."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    parts = [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] if len(text) else []
    sizes = np.array([len(p) for p in parts] or [0] * (len(at) - 1), np.int64)
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum(sizes)])


def sketches(sets: np.ndarray, at: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values, a row a text; texts without shingles get zeros."""
    out = np.zeros((len(at) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(at))
    low, starts = (sets >> np.uint64(17)).astype(np.uint32), at[full]
    step = 1 << 15  # so many shingles at once stay in the cache
    cut = 0
    while cut < len(full):
        end = max(cut + 1, int(np.searchsorted(starts, starts[cut] + step)))
        a, b = starts[cut], at[full[end - 1] + 1]
        for k in range(hashes):
            out[full[cut:end], k] = np.minimum.reduceat((low[a:b] ^ _XOR[k]) * _MUL[k], starts[cut:end] - a)
        cut = end
    return out


def _signatures(batches):
    for batch, texts in chunks(batches, 1):
        hashes, at = Words(texts).shingles(SHINGLE)
        sets, at = _distinct(hashes, at)
        n, full = np.diff(at), np.flatnonzero(np.diff(at))
        sums = np.zeros((2, len(texts)), np.uint64)
        if len(full):
            sums[0, full], sums[1, full] = np.add.reduceat(sets, at[full]), np.add.reduceat(mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), at[full])
        sketch = sketches(sets, at)
        root = mixed(sketch[:, CHOSEN[:, 0]].astype(np.uint64) + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([s.tobytes() for s in sketch.astype(np.uint8)], pa.binary()),
             pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * TREES, TREES, dtype=np.int32)), pa.array(root.view(np.int64).ravel()))],
            names=["id", "n", "s1", "s2", "marks", "roots"],
        )


def _by_node(compare):
    """A function of Arrow batches that hands compare() the rows of whole nodes; rows (key, ...) come sorted by key."""

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the last node, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if held and keys[-1] == held[0].column(0)[-1].as_py():
                held.append(batch)
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from _in_parts(compare, pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
            give_back()
        if held:
            yield from _in_parts(compare, pa.Table.from_batches(held))
        give_back()

    return run


def _in_parts(compare, table):
    """compare() for some whole nodes at a time, so many that they have about PART_PAIRS pairs."""
    keys = table.column(0).to_numpy()
    if not len(keys):
        return
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1
    sizes = np.diff(ends, prepend=0)
    part = np.cumsum(sizes * sizes // 2) // PART_PAIRS
    cuts = [0, *ends[np.flatnonzero(part[1:] != part[:-1])].tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield from compare(table.slice(a, b - a))


def _pairs(a, b):
    for k in range(0, len(a), 1 << 16):
        x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _close(table, apart=None):
    """(ids, i, j, agreement) of the pairs of rows of one node whose sizes and sketches allow a link.

    table: key, id, n, marks. apart: only pairs with different values of it.
    """
    keys, ids, n = (table.column(i).to_numpy() for i in range(3))
    marks = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(ids), HASHES)
    found = []
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))).max()) if len(ids) else 0
    for k in range(1, longest):
        i = np.flatnonzero(keys[:-k] == keys[k:])
        j = i + k
        fits = 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
        if apart is not None:
            fits &= apart[i] != apart[j]
        i, j = i[fits], j[fits]
        for lo in range(0, len(i), 1 << 14):
            x, y = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            same = (marks[x] == marks[y]).mean(axis=1)
            ok = same >= PROPOSE
            found.append((x[ok], y[ok], same[ok]))
    i, j, same = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return ids, i, j, same


def _forest(rows: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the pairs taken, label of each row): under `rows` pairs that connect what all pairs (i, j) connect.

    In each pass every label takes its pair with its smallest neighbour if that is smaller, so pairs form no circle.
    """
    label, left, taken = np.arange(rows), np.arange(len(i)), []
    while len(left := left[label[i[left]] != label[j[left]]]):
        x, y = label[i[left]], label[j[left]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        parent = np.arange(rows)
        np.minimum.at(parent, high, low)
        smallest = np.flatnonzero(parent[high] == low)
        taken.append(left[smallest[np.unique(high[smallest], return_index=True)[1]]])
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(taken) if taken else left, label


def _first_round(table):
    """Pairs that should connect the rows of each node, at most two a row: a forest of the clearly similar ones, and each row's
    best others of other trees of it."""
    ids, i, j, same = _close(table)
    clear = np.flatnonzero(same >= CLEAR)
    taken, label = _forest(len(ids), i[clear], j[clear])
    wanted = clear[taken]
    others = np.flatnonzero((same < CLEAR) & (label[i] != label[j]))
    x, y, s = (np.concatenate([u[others], v[others]]) for u, v in ((i, j), (j, i), (same, same)))
    order = np.lexsort((y, -s, x))
    x, y = x[order], y[order]
    best = np.arange(len(x)) - np.searchsorted(x, x) < BEST
    yield from _pairs(ids[np.concatenate([i[wanted], x[best]])], ids[np.concatenate([j[wanted], y[best]])])


def _apart(table):
    """The rows of a node that sketches allow a link with one of another component."""
    if table.num_rows:
        _, i, j, _ = _close(table, table.column(4).to_numpy())
        yield from table.take(pa.array(np.union1d(i, j))).to_batches()


def _joined(table):
    """Links between different components of a node, confirmed on the full sets (column 5), until it has none apart."""
    if not table.num_rows:
        return
    component = table.column(4).to_numpy().copy()
    ids, i, j, _ = _close(table, component)
    sets = [np.frombuffer(x, np.uint64) for x in table.column(5).to_pylist()]
    found = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if component[x] != component[y] and _similar(sets[x], sets[y]):
            component[component == component[y]] = component[x]
            found.append((x, y))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    yield from _pairs(ids[a], ids[b])


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets share enough."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return False
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _shingle_sets(batches):
    for batch, texts in chunks(batches, 1):
        hashes, at = Words(texts).shingles(SHINGLE)
        sets, at = _distinct(hashes, at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["id", "shingles"])


def _token_counts(batches):
    for batch, texts in chunks(batches, 1):
        hashes, at = Words(texts).shingles(SHINGLE)
        token, n = np.unique(_distinct(hashes, at)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])


def _prefixes(sent):
    """A function of Arrow batches (id, text): the first shingles of each set and how many the set has from each on.

    sent: the broadcast sorted hashes of common shingles, which come last.
    """

    def run(batches):
        common = sent.value
        for batch, texts in chunks(batches, 1):
            hashes, at = Words(texts).shingles(SHINGLE)
            sets, at = _distinct(hashes, at)
            n = np.diff(at)
            text = np.repeat(np.arange(len(n)), n)
            often = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] == sets if len(common) else np.zeros(len(sets), bool)
            order = np.argsort(text * 2 + often, kind="stable")
            place = np.arange(len(sets)) - np.repeat(at[:-1], n)
            first = place < np.repeat(n + PERCENT * -n // 100 + 1, n)
            ids = batch.column(0).take(pa.array(text[first]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[text[first]]), pa.array(sets[order][first].view(np.int64)), pa.array((n[text] - place)[first])], names=["id", "n", "token", "rest"])

    return run


def _confirmed(batches):
    for batch in batches:
        keep = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def nodes_to_compare(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, id) of the nodes to compare, and the ids of what is still large at the last level, to join exactly.

    reps: id, marks (the low byte of each sketch value, which chains of tokens are made of), roots.
    """
    frontier = reps.select("id", F.posexplode("roots").alias("tree", "key"))
    members, exact = [], None
    for level in range(EXACT + 1):
        nodes = frontier.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min("id").alias("pivot")).where("size > 1")
        nodes = materialize(nodes, "nodes")
        n_small, n_large = nodes.agg(F.count_if(F.col("size") <= NODE), F.count_if(F.col("size") > NODE)).first()
        hint = lambda df, n: F.broadcast(df) if n <= MAX_BROADCAST_ROWS else df
        # nodes of several trees with the same documents are compared once
        small = nodes.where(F.col("size") <= NODE).groupBy("size", "mark").agg(F.min("key").alias("key")).select("key")
        members.append(frontier.join(hint(small, n_small), "key").select("key", "id"))
        if not n_large:
            break
        inside = frontier.join(hint(nodes.where(F.col("size") > NODE).select("key", "size", "pivot"), n_large), "key")
        if level < EXACT:
            token = F.array(*(F.lit(int(f + 1)) for f in CHOSEN[:, level + 1]))
            step = F.xxhash64("key", F.substring("marks", F.element_at(token, F.col("tree") + 1), F.lit(1)))
            if level == 0:  # from here on the few rows that branch carry their marks
                inside = inside.join(reps.select("id", "marks"), "id")
            frontier = materialize(inside.select("id", "tree", "marks", step.alias("key")), "frontier")
        else:
            inside = materialize(inside, "large")
            exact = materialize(inside.select("id").distinct(), "exact")
            # a node's smallest document is in all of its blocks and connects them
            blocks = F.ceil(F.col("size") * 2 / NODE)
            members.append(inside.where("id <> pivot").select(F.xxhash64("key", F.pmod(F.xxhash64("id", "tree"), blocks)).alias("key"), "id"))
            every = inside.where("id = pivot").select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
            members.append(every.select(F.xxhash64("key", "block").alias("key"), "id"))
    together = members[0]
    for m in members[1:]:
        together = together.unionByName(m)
    return materialize(together, "members"), exact


def full_sets(ids: DataFrame, own: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ids. own: id, text of all documents."""
    wanted = materialize(ids.select("id").distinct(), "wanted")
    return materialize(own.join(broadcast_within(wanted, MAX_BROADCAST_ROWS), "id", "left_semi").mapInArrow(_shingle_sets, "id long, shingles binary"), "sets")


def confirm(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar."""
    sets = full_sets(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), own)
    # a node's hub is always a: with the sets of b on its pairs they are large enough for adaptive execution to split them
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(_confirmed, "a long, b long"), "confirmed")


def exact_nodes(ids: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id) of nodes in which all similar pairs of ids meet that found (node, component) does not connect."""
    texts = own.join(broadcast_within(ids, MAX_BROADCAST_ROWS), "id", "left_semi")
    counts = texts.mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    counts = materialize(counts, "token-counts")
    least, taken = None, 0
    for n, tokens in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        taken += tokens
        if taken > COMMON_TOKENS:
            break
        least = n
    common = np.sort(counts.where(F.col("n") >= F.lit(least)).select("token").toArrow()["token"].to_numpy().view(np.uint64))
    sent = ids.sparkSession.sparkContext.broadcast(common)
    prefixes = materialize(texts.mapInArrow(_prefixes(sent), "id long, n long, token long, rest long"), "prefixes")
    placed = prefixes.join(broadcast_within(found.withColumnRenamed("node", "id"), MAX_BROADCAST_ROWS), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = materialize(placed, "placed")
    apart = lambda df, *more: df.groupBy("token").agg(*more, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").drop("low", "high")
    lists = materialize(apart(placed, F.min("n").alias("shortest")), "lists")
    able = placed.join(broadcast_within(lists, MAX_BROADCAST_ROWS), "token").where((100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("n") + F.col("shortest")))
    able = materialize(able.select("token", "id", "component"), "able")
    # lists of the same documents are compared once; an id may have several rows, so hashes are summed
    marks = [F.sum(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 31))).alias(f"mark{k}") for k in (1, 2)]
    lists = materialize(apart(able, F.count("*").alias("size"), *marks).groupBy("size", "mark1", "mark2").agg(F.min("token").alias("token")), "lists").select("token", "size")
    small, large = lists.where(F.col("size") <= NODE), lists.where(F.col("size") > NODE)
    nodes = able.join(broadcast_within(small, MAX_BROADCAST_ROWS), "token").select(F.xxhash64("token", F.lit("list")).alias("key"), "id")
    if large.isEmpty():
        return materialize(nodes, "exact-nodes")
    inside = materialize(able.join(broadcast_within(large, MAX_BROADCAST_ROWS), "token"), "long-lists")
    by = inside.groupBy("token", "component").count().groupBy("token").agg(F.max_by("component", "count").alias("most"), (F.sum("count") - F.max("count")).alias("others"))
    inside = inside.join(broadcast_within(materialize(by, "most"), MAX_BROADCAST_ROWS), "token")
    # each document outside the largest component meets every document of the list
    blocks, parts = F.ceil(F.col("size") * 2 / NODE), F.ceil(F.col("others") * 2 / NODE)
    every = inside.select("token", "id", F.pmod(F.xxhash64("id"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    others = inside.where("component <> most").select("token", "id", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(3)), parts).alias("part"))
    pairs = every.unionByName(others).select(F.xxhash64("token", "block", "part").alias("key"), "id")
    return materialize(nodes.unionByName(pairs.distinct()), "exact-nodes")


def similar(reps: DataFrame, own: DataFrame) -> DataFrame:
    """(node, component) of all similar documents among reps (id, n, marks, roots)."""
    spark = reps.sparkSession
    together, exact = nodes_to_compare(reps)
    with_marks = lambda df: df.join(reps.select("id", "n", "marks"), "id").select("key", "id", "n", "marks")
    rows = materialize(with_marks(together), "node-rows")
    arranged = lambda df: df.repartition("key").sortWithinPartitions("key", "id")
    first = materialize(arranged(rows).mapInArrow(_by_node(_first_round), "a long, b long").distinct(), "pairs")
    with arrow_rows(spark, SET_ROWS):
        links = confirm(first, own)
    found = materialize(components(links), "components")
    schema = "key long, id long, n long, marks binary, component long"
    if exact is not None:
        rows = rows.unionByName(with_marks(exact_nodes(exact, own, found)))
    labelled = rows.join(broadcast_within(found.withColumnRenamed("node", "id"), MAX_BROADCAST_ROWS), "id", "left").select("key", "id", "n", "marks", F.coalesce("component", "id").alias("component"))
    apart = materialize(arranged(labelled).mapInArrow(_by_node(_apart), schema), "apart")
    if apart.isEmpty():
        return found
    whole = apart.join(full_sets(apart, own), "id").select("key", "id", "n", "marks", "component", "shingles")
    with arrow_rows(spark, SET_ROWS):
        more = materialize(arranged(whole).mapInArrow(_by_node(_joined), "a long, b long").distinct(), "more-links")
    return found if more.isEmpty() else materialize(components(found.toDF("a", "b").unionByName(more)), "components")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = own.mapInArrow(_signatures, "id long, n long, s1 long, s2 long, marks binary, roots array<long>")
    signed = materialize(signed, "sketches")
    if not signed.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        found = _by_row(own)
    else:
        component = _components(signed, own)
        out = signed.select("id", "n").join(broadcast_within(component, MAX_BROADCAST_ROWS), F.col("id") == F.col("node"), "left")
        found = out.select("id", "n", F.coalesce("component", "id").alias("component"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _components(signed: DataFrame, own: DataFrame) -> DataFrame:
    """(node, component) of the documents that are linked with others; ids are not repeated."""
    # classes of equal sets, by their smallest document; only classes of several need rows of their own
    full = signed.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size"), "classes")
    named = full.select("id", "n", "s1", "s2").join(broadcast_within(classes, MAX_BROADCAST_ROWS), ["n", "s1", "s2"]).select("id", "rep").where("id <> rep")
    named = materialize(named, "copies")
    reps = materialize(full.join(named.select("id"), "id", "left_anti").select("id", "n", "marks", "roots"), "reps")
    found = similar(reps, own)
    of_copies = named.withColumnRenamed("id", "copy").join(broadcast_within(found, MAX_BROADCAST_ROWS), F.col("rep") == F.col("node"), "left").select(F.col("copy").alias("node"), F.coalesce("component", "rep").alias("component"))
    return materialize(found.select("node", "component").unionByName(of_copies), "components")


def _by_row(own: DataFrame) -> DataFrame:
    """(id, n, component) where ids repeat: rows are the documents, and rows of one id belong together."""
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = near_dedup(rows.where("id is not null").select("row", "text"), "row").select("row", F.col("n_shingles").alias("n"), F.col("component_id").alias("part"))
    found = materialize(found.join(rows.select("row", "id"), "row"), "row-parts")
    first = found.groupBy("id").agg(F.min("part").alias("first"))
    joined = materialize(components(found.join(first, "id").select(F.col("part").alias("a"), F.col("first").alias("b")).distinct()), "part-components")
    found = found.join(joined, F.col("part") == F.col("node"), "left").select("id", "n", F.coalesce("component", "part").alias("part"))
    smallest = found.groupBy("part").agg(F.min("id").alias("component"))
    found = found.join(smallest, "part").select("id", "n", "component")
    without = rows.where("id is null").select("id", "text").mapInArrow(_signatures, "id long, n long, s1 long, s2 long, marks binary, roots array<long>")
    return found.unionByName(without.select("id", "n", F.lit(None).cast("long").alias("component")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, to_node) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.to_node = e.a),
c AS (SELECT node AS doc_id, min(to_node) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
