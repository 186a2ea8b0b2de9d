"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models of the same form are counted, one from the target texts and one from all texts: same order, smoothing
and vocabulary. The vocabulary is the words (runs of other than ASCII white space, A-Z lower-cased) that occur at least
MIN_COUNT times in all texts, and an end mark; all other words are one unknown word. With V words in it, the unknown one
included, and N words and end marks in a model's texts, a word's probability is

    p(w | v) = L * count(v w) / count(v) + (1 - L) * (count(w) + A) / (N + A * V)

(the second factor alone where count(v) is 0), and a document's losses are the means of -log2 p over its words and an end
mark, under each model. The score is the mean of the per-token differences, target loss less background loss: the lower,
the more a document is like the target.

Every word and bigram is counted exactly, by a 64-bit hash, in tables that grow with the input:

1. One pass over the texts writes them as parts of about PART_BYTES of text: the sorted distinct words of a part and each
   token as its number there. Parts are counted alone first, so a frequent word is one entry of a part.
2. A part's sorted hashes are cut into slices by ranges of the hash, with target and background counts. The slices of
   one range meet in one task, are summed, and the totals go back to each part in the order of its own slice, without
   the hashes. Ranges are even, as hashes are, and as many as parts, so a task holds about as much as one part.
3. The totals of words tell a part its vocabulary; its bigrams over that vocabulary are then cut, summed and sent back in the same
   way, and the part scores its documents. Only sums over all words reach the driver.

Defined cases: a null or empty text has its end mark only; the labels decide which texts are target by id, so repeated
rows of a target id all count; each row of docs has its own result, a null id too; without target texts the target model
is the smoothed uniform one; an empty table gives an empty result; other columns are ignored; a text longer than a part
is a part of its own, in memory proportional to its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.arrow_text import Words, chunks, give_back, mixed
from tallystone.llm.common import broadcast_within, materialize

MIN_COUNT, WEIGHT, ADD = 2, 0.7, 0.1
MAX_BROADCAST_ROWS = 2_000_000
PART_BYTES = 16 << 20
_END, _RARE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xAEF17502108EF2D9)
_SLICE = {"bucket": pa.int64(), "part": pa.int64(), "keys": pa.binary(), "near": pa.binary(), "far": pa.binary()}
_SLICES = "bucket long, part long, keys binary, near binary, far binary"
_REPLIES = "bucket long, part long, near binary, far binary, sums array<long>"


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as bytes, the first bytes of all, then the second ones and so on, compressed if that pays."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 256 else raw
    return bytes([x.itemsize]) + (len(x).to_bytes(8, "little") + small if len(small) < len(raw) else bytes(8) + raw)


def _opened(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], n * width, codec="zstd", asbytes=True) if n else data[9:]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest width that holds them all."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w))
    return _squeezed(x.astype(f"<u{width}"))


def _unpacked(data: bytes) -> np.ndarray:
    return _opened(data).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, whose highest bytes are zero."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_opened(data), dtype=np.uint64)


def _slices(part: int, keys: np.ndarray, near: np.ndarray, far: np.ndarray, buckets: int) -> dict[str, list]:
    """The slices of a part's sorted keys by ranges of the key, as columns."""
    bounds = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    bucket = np.searchsorted(bounds, keys, side="right") - 1
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
    return {"bucket": bucket[cuts[:-1]].tolist(), "part": [part] * len(ranges), "keys": [_packed_keys(keys[a:b]) for a, b in ranges], "near": [_packed(near[a:b]) for a, b in ranges], "far": [_packed(far[a:b]) for a, b in ranges]}


def _parts(buckets: int):
    """A function of batches (id, target, text) to rows of two kinds: parts, and slices of their words (with a bucket)."""

    def rows(part, ids, target, counts, hashes):
        target, counts = np.concatenate(target), np.concatenate(counts)
        words, token = np.unique(np.concatenate(hashes), return_inverse=True)
        far = np.bincount(token, minlength=len(words))
        near = np.bincount(token[np.repeat(target, counts)], minlength=len(words))
        own = pa.chunked_array(ids).combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        whole = [pa.array([part]), one(own), one(pa.array(target)), one(pa.array(counts)), pa.array([_packed_keys(words)], pa.binary()), pa.array([_packed(token)], pa.binary())]
        cut = _slices(part, words, near, far, buckets)
        whole_names, cut_names = ["part", "ids", "target", "counts", "words", "tokens"], ["bucket", "keys", "near", "far"]
        yield pa.RecordBatch.from_arrays([*whole, *(pa.nulls(1, _SLICE[c]) for c in cut_names)], names=[*whole_names, *cut_names])
        n = len(cut["part"])
        empty = [pa.nulls(n, a.type) for a in whole[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(cut["part"], pa.int64()), *empty, *(pa.array(cut[c], _SLICE[c]) for c in cut_names)], names=[*whole_names, *cut_names])

    def run(batches):
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() << 40, ([], [], [], []), 0
        for batch, texts in chunks(batches, 2):
            words = Words(texts)
            every = np.arange(len(words.starts))
            for kept, x in zip(held, (batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), words.counts, words.hashes(every, every)), strict=True):
                kept.append(x)
            size += sum(len(t or b"") for t in texts)
            if size >= PART_BYTES:
                yield from rows(part, *held)
                part, held, size = part + 1, ([], [], [], []), 0
                give_back()
        if held[0]:
            yield from rows(part, *held)

    return run


def _totals(table: pa.Table) -> pa.Table:
    """For the slices of one bucket, the totals of their keys in their own order, and one row of sums over all keys:
    target and background tokens, those of rare keys, and the keys that are not rare."""
    rows = table.select(list(_SLICE)).to_pylist()
    keys = [_unpacked_keys(r["keys"]) for r in rows]
    cuts = np.cumsum([0, *map(len, keys)])
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    near, far = (np.bincount(which, weights=np.concatenate([_unpacked(r[m]) for r in rows]), minlength=len(found)).astype(np.int64) for m in ("near", "far"))
    rare = far < MIN_COUNT
    sums = [int(near.sum()), int(far.sum()), int(near[rare].sum()), int(far[rare].sum()), int((~rare).sum())]
    ranges = [which[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    give_back()
    return pa.table(
        {"bucket": pa.array([r["bucket"] for r in rows] + [rows[0]["bucket"]], pa.int64()), "part": pa.array([r["part"] for r in rows] + [None], pa.int64()),
         "near": pa.array([_packed(near[x]) for x in ranges] + [None], pa.binary()), "far": pa.array([_packed(far[x]) for x in ranges] + [None], pa.binary()),
         "sums": pa.array([None] * len(rows) + [sums], pa.list_(pa.int64()))}
    )


def _answers(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(near, far) totals of a part's sorted keys from its replies."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    return tuple(np.concatenate([np.empty(0, np.int64), *(_unpacked(r[m]) for r in rows)]) for m in ("near", "far"))


class _Part:
    """A part with the totals of its words: its tokens as numbers of `codes` (the words, the end mark, the unknown word)."""

    def __init__(self, row: dict, word_replies: list[dict]):
        self.ids, self.target, self.counts = row["ids"], np.array(row["target"], bool), np.array(row["counts"], np.int64)
        words = _unpacked_keys(row["words"])
        self.near, self.far = _answers(word_replies)
        end, rare = len(words), len(words) + 1
        token = _unpacked(row["tokens"])
        token[self.far[token] < MIN_COUNT] = rare
        self.lengths = self.counts + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.full(int(self.lengths.sum()), end, np.int64)
        self.word[np.arange(len(token)) + np.repeat(np.arange(len(self.counts)), self.counts)] = token
        self.before = np.concatenate([[end], self.word[:-1]])  # a text's first word follows the end mark of another
        codes = np.concatenate([words, [_END, _RARE]])
        self.keys = mixed(codes[self.before] * _ODD + codes[self.word])

    def cut(self, part: int, buckets: int) -> dict[str, list]:
        keys, far = np.unique(self.keys, return_counts=True)
        own, n = np.unique(self.keys[np.repeat(self.target, self.lengths)], return_counts=True)
        near = np.zeros_like(far)
        near[np.searchsorted(keys, own)] = n
        return _slices(part, keys, near, far, buckets)

    def losses(self, replies: list[dict], model: dict) -> list[np.ndarray]:
        """The mean loss of each text under the target and the background model."""
        _, which = np.unique(self.keys, return_inverse=True)
        out = []
        for k, (pair, single) in enumerate(zip(_answers(replies), (self.near, self.far), strict=True)):
            count = np.concatenate([single, [model["docs"][k], model["rare"][k]]])
            alone = ((count + ADD) / (model["tokens"][k] + model["docs"][k] + ADD * model["size"]))[self.word]
            follows = count[self.before]
            paired = np.where(follows > 0, pair[which] / np.maximum(follows, 1), alone)
            loss = -np.log2(WEIGHT * paired + (1 - WEIGHT) * alone)
            out.append(np.add.reduceat(loss, self.starts) / self.lengths)
        return out


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, target_loss, background_loss and score of every row of docs. target: ids of the target texts."""
    ids = materialize(target.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_target", F.lit(True)), "target-ids")
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(broadcast_within(ids, MAX_BROADCAST_ROWS), "_id", "left")
    marked = marked.select("_id", F.coalesce("_target", F.lit(False)).alias("target"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = 1 + n_bytes // PART_BYTES
    id_type = docs.schema[id_col].dataType
    columns = {"part": T.LongType(), "ids": T.ArrayType(id_type), "target": T.ArrayType(T.BooleanType()), "counts": T.ArrayType(T.LongType()), "words": T.BinaryType(), "tokens": T.BinaryType(), "bucket": T.LongType(), "keys": T.BinaryType(), "near": T.BinaryType(), "far": T.BinaryType()}
    table = materialize(marked.mapInArrow(_parts(1 + buckets // 8), T.StructType([T.StructField(c, k) for c, k in columns.items()])), "lm-parts")
    parts = table.where("bucket is null").select("part", "ids", "target", "counts", "words", "tokens")
    words = materialize(table.where("bucket is not null").select(*_SLICE).groupBy("bucket").applyInArrow(_totals, _REPLIES), "lm-words")
    sums = words.where("part is null").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(5))).first()
    n_docs = parts.agg(F.sum(F.size(F.filter("target", lambda t: t))), F.sum(F.size("target"))).first()
    model = {"tokens": sums[:2], "rare": sums[2:4], "size": sums[4] + 2, "docs": [n or 0 for n in n_docs]}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        found = _Part(row, right.to_pylist()).cut(row["part"], buckets)
        give_back()
        return pa.table({c: pa.array(found[c], k) for c, k in _SLICE.items()})

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        part = _Part(left.to_pylist()[0], [r for r in replies if not r["paired"]])
        near, far = part.losses([r for r in replies if r["paired"]], model)
        give_back()
        return pa.table({id_col: pa.array(part.ids, left.schema.field("ids").type.value_type), "n_tokens": part.lengths, "target_loss": near, "background_loss": far, "score": near - far})

    words = words.where("part is not null").select("part", "bucket", "near", "far")
    pairs = parts.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(cut, _SLICES).groupBy("bucket").applyInArrow(_totals, _REPLIES)
    pairs = pairs.where("part is not null").select("part", "bucket", "near", "far")
    replies = words.withColumn("paired", F.lit(False)).unionByName(pairs.withColumn("paired", F.lit(True)))
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])
    return parts.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(judge, schema)


def good_labels(labels: DataFrame) -> DataFrame:
    good: Column = F.col("quality") == 1
    return labels.where(good).select("doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, good_labels(labels))
    return found.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, target, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
u AS (SELECT w, count(*) AS far, count(*) FILTER (target) AS near FROM t GROUP BY 1),
-- the unknown word is '' and the end mark a line feed, which no word is
k AS (SELECT r, target, i, CASE WHEN far >= 2 THEN w ELSE '' END AS w FROM t JOIN u USING (w)
  UNION ALL SELECT r, target, len(w) + 1, chr(10) FROM d),
p AS (SELECT r, target, w, coalesce(lag(w) OVER (PARTITION BY r ORDER BY i), chr(10)) AS v FROM k),
c AS (SELECT w, CAST(count(*) AS DOUBLE) AS far, CAST(count(*) FILTER (target) AS DOUBLE) AS near FROM p GROUP BY 1),
b AS (SELECT v, w, CAST(count(*) AS DOUBLE) AS far, CAST(count(*) FILTER (target) AS DOUBLE) AS near FROM p GROUP BY 1, 2),
s AS (SELECT sum(far) AS far, sum(near) AS near, count(*) FILTER (w <> '') + 1 AS size FROM c),
l AS (SELECT b.v, b.w,
    (c.near + 0.1) / (s.near + 0.1 * size) AS near1, (c.far + 0.1) / (s.far + 0.1 * size) AS far1,
    CASE WHEN cv.near > 0 THEN b.near / cv.near END AS near2, b.far / cv.far AS far2
  FROM b JOIN c USING (w) JOIN c cv ON cv.w = b.v, s),
m AS (SELECT v, w, -log2(0.7 * coalesce(near2, near1) + 0.3 * near1) AS near, -log2(0.7 * far2 + 0.3 * far1) AS far FROM l),
g AS (SELECT r, count(*) AS n_tokens, avg(near) AS near, avg(far) AS far FROM p JOIN m USING (v, w) GROUP BY 1)
SELECT doc_id, n_tokens, round(near, 6) AS target_loss, round(far, 6) AS background_loss, round(near - far, 6) AS score FROM d JOIN g USING (r)
"""
