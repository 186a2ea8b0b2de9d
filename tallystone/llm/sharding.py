"""Sharding by balanced label propagation (after Ugander and Backstrom, 2013): linked documents move towards their
neighbours' shards while quotas last.

Documents with equal text are linked. Members of a group in one shard are alike, so the state is a table (group, shard, n) and
no pairs are made. Every linked document starts in a shard drawn by its own hash. In each round, from the shards as they
are then, each group looks for the shard with most of its members, one with room first, and its smaller parts propose to move
there. What moves between two shards is bounded by flows that keep every shard within its quota, a matrix of shards by
shards, and proposals are taken in the order of a hash until the flow is used up. A part moves only to a larger one of its
group, so every move joins more links than it cuts, links in one shard grow from round to round, and the rounds end by
themselves: when no proposal fits. Groups that are still split then move as a whole to where all of them fit, as long as
any do. A group that is larger than a shard fills whole shards from the start.

In the end, what a shard holds beyond its quota, members of split groups first, goes with the unlinked documents to wherever
there is room, so that the numbers of documents of any two shards differ by one at most. DataFrame functions only; no group
and no shard meets in one task, and the driver sees tables of shards, pairs of shards and groups larger than a shard only.

Defined cases: a null text has no bytes and no links; empty texts are equal texts; each repeated row takes a slot of its
own; a null doc_id is kept; very long texts count by their hash and size; an empty table gives an empty result; columns beside
doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import broadcast_within, materialize, numbered, running

N_SHARDS, DRAWS = 40, 3
MAX_BROADCAST_ROWS = 1_000_000


def flows(wanted: np.ndarray, room: np.ndarray) -> np.ndarray:
    """At most what is wanted from shard i to shard j, in whole documents, so that no shard that gains goes beyond its room."""
    f = wanted.astype(np.int64)
    while True:
        gain, loss = f.sum(axis=0), f.sum(axis=1)
        over = (gain > 0) & (gain - loss > room)
        if not over.any():
            return f
        share = np.clip((room + loss)[over], 0, None) / gain[over]
        f[:, over] = np.floor(f[:, over] * np.minimum(share, 1.0)).astype(np.int64)


def _by_shard(values, shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(int(v)) for v in values)), shard + 1)


def propagate(state: DataFrame, quota: np.ndarray) -> DataFrame:
    """The state (key, shard, n) of the groups after the last round that moves anything."""
    n_shards = len(quota)
    total = state.agg(F.sum("n")).first()[0] or 0
    while total:
        room = quota - _loads(state, n_shards)
        rank = F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard")
        goal = state.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct((_by_shard(room, F.col("shard")) > 0).alias("open"), rank.alias("rank"))).alias("goal"))
        goal = goal.where("parts > 1").select("key", "goal.rank")
        asked = state.join(goal, "key").where(rank < F.col("rank")).select("key", "shard", "n", F.col("rank.shard").alias("to"))
        asked = materialize(asked, "shard-proposals")
        wanted = np.zeros((n_shards, n_shards), np.int64)
        for r in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # a row a pair of shards
            wanted[r["shard"], r["to"]] = r["n"]
        flow = flows(wanted, room)
        if not flow.any():
            return state
        bound = F.element_at(F.array(*(F.lit(int(x)) for x in flow.ravel())), F.col("shard") * n_shards + F.col("to") + 1)
        taken = running(asked, ["shard", "to"], "key", "n", total, n_groups=n_shards).withColumn("n", F.least(F.col("n"), bound - F.col("before")))
        taken = materialize(taken.where("n > 0").select("key", "shard", "to", "n"), "shard-moves")
        moved = taken.select("key", "shard", (-F.col("n")).alias("n")).unionByName(taken.select("key", F.col("to").alias("shard"), "n"))
        state = state.unionByName(moved).groupBy("key", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        state = materialize(state, "shard-state")
    return state


def _loads(state: DataFrame, n_shards: int) -> np.ndarray:
    load = np.zeros(n_shards, np.int64)
    for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row a shard
        load[r["shard"]] = r["n"]
    return load


def unite(state: DataFrame, quota: np.ndarray) -> DataFrame:
    """The state after split groups have moved as a whole to a shard with room for all that is elsewhere: the one of these
    with most members, or one drawn by room. Ends when draws of DRAWS rounds in a row fit nothing."""
    n_shards, fruitless, k = len(quota), 0, 0
    while fruitless < DRAWS:
        k += 1
        room = np.clip(quota - _loads(state, n_shards), 0, None)
        ends = np.cumsum(room)
        if not ends[-1]:
            return state
        draw = F.floor(F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1 << 30)) / float(1 << 30) * int(ends[-1]))
        drawn = F.size(F.filter(F.array(*(F.lit(int(e)) for e in ends)), lambda e: e <= draw)).cast("int")
        own_room = _by_shard(room, F.col("shard"))
        groups = state.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("n", "shard", own_room.alias("room"))), asc=False).alias("at"))  # n_shards parts at most
        fits = F.filter("at", lambda p: p["room"] >= F.col("all") - p["n"])
        there = F.get(fits, F.lit(0))
        groups = groups.where("parts > 1").select("key", F.coalesce(there["shard"], drawn).alias("to"), (F.col("all") - F.coalesce(there["n"], F.lit(0))).alias("m"))
        asked = materialize(groups, "shard-wholes")
        if asked.isEmpty():
            return state
        taken = running(asked, ["to"], "key", "m", int(ends[-1]), n_groups=n_shards).where(F.col("before") + F.col("m") <= _by_shard(room, F.col("to")))
        taken = materialize(taken.select("key", "to"), "shard-united")
        if taken.isEmpty():
            fruitless += 1
            continue
        fruitless = 0
        state = state.join(taken, "key", "left").groupBy("key", F.coalesce("to", "shard").alias("shard")).agg(F.sum("n").alias("n"))
        state = materialize(state, "shard-state")
    return state


def shard(docs: DataFrame, n_shards: int = N_SHARDS, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of docs, with text_key (a hash of the text) and linked (it has copies)."""
    data = F.encode(F.col(text_col), "UTF-8")
    base = docs.select(
        F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).cast("long").alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base, "shard-rows")
    total = base.count()
    quota = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)

    groups = base.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups, "shard-groups")  # a table, so that a hot group's join can be split
    # groups larger than a shard, n_shards at most, fill shards one after the other
    spans, free, at = [], quota.copy(), 0
    for r in groups.where(F.col("n") > int(quota.min())).orderBy("key").collect() if total else []:
        begin = 0
        while begin < r["n"]:
            step = min(int(free[at]), r["n"] - begin)
            spans.append((bytes(r["key"]), begin, begin + step, at))
            free[at], begin = free[at] - step, begin + step
            at += int(free[at] == 0)
    ends = np.cumsum(free)
    draw = F.floor(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30) * int(ends[-1]))
    start = F.size(F.filter(F.array(*(F.lit(int(e)) for e in ends)), lambda e: e <= draw)).cast("int")
    linked = base.select("row", "key").join(groups, "key").select("row", "key", "n", start.alias("start"))
    linked = materialize(linked, "shard-links")
    small = linked.where(F.col("n") <= int(quota.min()))
    state = unite(propagate(materialize(small.groupBy("key", F.col("start").alias("shard")).agg(F.count("*").alias("n")), "shard-state"), free), free)

    # members by number: groups in one shard go there, those in several by ranges
    where = state.groupBy("key").agg(F.count("*").alias("parts"), F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("at"))  # n_shards parts at most
    ranges = where.select("key", (F.col("parts") > 1).alias("split"), F.posexplode("at").alias("k", "p"), "at")
    before = F.aggregate(F.slice("at", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    ranges = ranges.select("key", "split", before.alias("begin"), (before + F.col("p.n")).alias("end"), F.col("p.shard").alias("to"))
    if spans:
        ranges = ranges.unionByName(base.sparkSession.createDataFrame([(k, True, b, e, s) for k, b, e, s in spans], "key binary, split boolean, begin long, end long, to int"))
    ranges = broadcast_within(materialize(ranges, "shard-ranges"), MAX_BROADCAST_ROWS)
    whole = linked.join(ranges.where("not split"), "key").select("row", F.col("to").alias("shard"), F.lit(0).alias("loose"))
    parted = linked.join(materialize(ranges.where("split").select("key").distinct(), "shard-split"), "key", "left_semi")
    parted = numbered(parted, ["key"], "row", total=total, n_groups=n_shards).join(ranges.where("split"), "key").where("idx >= begin and idx < end")
    parted = parted.select("row", F.col("to").alias("shard"), F.when(F.col("n") > int(quota.min()), 0).otherwise(1).alias("loose"))
    # what a shard holds beyond its quota, members of split groups first, joins the unlinked ones in the pool
    placed = numbered(whole.unionByName(parted), ["shard"], "row", first=F.col("loose"), total=total, n_groups=n_shards)
    placed = materialize(placed.withColumn("stays", F.col("idx") < _by_shard(quota, F.col("shard"))), "shard-placed")
    held = np.zeros(n_shards, np.int64)
    for r in placed.where("stays").groupBy("shard").agg(F.count("*").alias("n")).collect():  # a row a shard
        held[r["shard"]] = r["n"]
    ends = np.cumsum(quota - held)
    fixed = placed.where("stays").select("row", "shard")
    pool = base.select("row").join(fixed, "row", "left_anti")
    pool = numbered(pool, [], "row", total=total) if total else pool.withColumn("idx", F.lit(0))
    filled = pool.select("row", F.size(F.filter(F.array(*(F.lit(int(e)) for e in ends)), lambda e: e <= F.col("idx"))).cast("int").alias("shard"))
    all_placed = base.join(fixed.unionByName(filled), "row").join(placed.select("row", F.lit(True).alias("linked")), "row", "left")
    out = numbered(all_placed, ["shard"], "row", total=total, n_groups=n_shards, out="slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), F.col("key").alias("text_key"), F.coalesce("linked", F.lit(False)).alias("linked"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """links and cut_links of a result of shard(): pairs of equal texts, and those of them in different shards; one row."""
    parts = sharded.where("text_key is not null").groupBy("text_key", "shard").agg(F.count("*").alias("n"))
    groups = parts.groupBy("text_key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("kept"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return groups.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum(pairs - F.col("kept")), F.lit(0)).cast("long").alias("cut_links"))


def query(spark, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
