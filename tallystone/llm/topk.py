"""Exact top-k search by inner product: term-at-a-time accumulation over postings, then partition selection and merge.

Components are terms. A block of candidates keeps for each component the postings (candidate, weight) that are not 0; one
that most candidates have is kept as a whole column. The non-zero components of the queries scatter their weighted
postings into a dense array of scores, one row a query; selection keeps the k best of a block, and a window over the blocks' winners
merges them. Queries and candidates are dealt to blocks of bounded size by a hash, and every block of queries meets every block of
candidates in one cell of a grid, so that no vector passes through the driver and no task holds more than a cell.

Defined cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; each row is
a candidate and a query of its own, so rows that repeat an id are candidates of each other and are ranked each; vectors may differ in length (a
missing component is 0) and a block takes its rows times its longest vector of memory; an empty vector scores 0; ties go
to the smaller id; scores that 64 bits may not hold are an error; without queries or candidates the result is empty; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.llm.common import materialize

#: Components (8 bytes each) of the queries and of the candidates of a cell, queries scored together.
QUERY_VALUES, BLOCK_VALUES, QUERY_ROWS = 1 << 22, 1 << 18, 32


def _matrix(lists: list, width: int = 0) -> np.ndarray:
    width = max([width, *map(len, lists)], default=0)
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class Block:
    """Postings of some candidates, which are sorted by id; rows tell them apart."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, vectors = ids[order], rows[order], vectors[order]
        self.top = int(np.abs(vectors).max(initial=0))
        self.postings = []
        for d in range(vectors.shape[1]):
            at = np.flatnonzero(vectors[:, d])
            self.postings.append((at, vectors[at, d], vectors[:, d] if 2 * len(at) > len(ids) else None))

    def scores(self, queries: np.ndarray) -> np.ndarray:
        bound = self.top * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.int32 if bound < 2**31 else np.int64
        total = np.zeros((len(queries), len(self.ids)), kind)
        weights, part = queries.astype(kind), np.empty_like(total)
        for d in range(min(queries.shape[1], len(self.postings))):
            at, w, dense = self.postings[d]
            rows = np.flatnonzero(weights[:, d])
            if not len(at) or not len(rows):
                continue
            if dense is not None and 2 * len(rows) > len(queries):
                total += np.multiply.outer(weights[:, d], dense.astype(kind), out=part)
            else:
                total[np.ix_(rows, at)] += np.multiply.outer(weights[rows, d], w.astype(kind))
        return total

    def best(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of each query's k best candidates, its own row left out."""
        total, n = self.scores(queries).astype(np.int64), len(self.ids)
        lowest = np.iinfo(np.int64).min
        total[query_rows[:, None] == self.rows[None, :]] = lowest
        if n > k:
            edge = np.partition(total, n - k, axis=1)[:, n - k, None]
            # all above the k-th score, then of those equal to it the smallest ids
            above, equal = total > edge, total == edge
            keep = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        else:
            keep = np.ones_like(total, bool)
        q, c = np.nonzero(keep & (total != lowest))
        return q, self.ids[c], total[q, c]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", query_values: int = QUERY_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best. Components are floor(scale * x)."""
    x = F.col(vec_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf"))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, finite))
    scaled = F.transform(x, lambda v: v.cast("double") * scale)
    whole = whole.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"), is_query.alias("asked"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(whole, "vectors")
    size, largest = F.greatest(F.size("v"), F.lit(1)), F.array_max(F.transform("v", lambda c: F.abs(c)))
    n_values, n_asked, top, width = rows.agg(F.sum(size), F.sum(F.when(F.col("asked"), size)), F.max(largest), F.max(F.size("v"))).first()
    if top and (top + 1) ** 2 * width >= 2.0**62:
        raise ValueError(f"components of {top / scale:.3g} give scores beyond 64 bits")
    parts, blocks = -(-(n_asked or 0) // query_values), -(-(n_values or 0) // block_values)
    rows = rows.withColumn("v", F.transform("v", lambda c: F.floor(c).cast("long")))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(max(n, 1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    asked = rows.where("asked").select(deal(parts, 1).alias("part"), every(blocks).alias("block"), "vec_id", "row", "v")
    held = rows.select(every(parts).alias("part"), deal(blocks, 2).alias("block"), "vec_id", "row", "v")

    def cell(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            vectors = _matrix(candidates["v"].to_pylist())
            block = Block(candidates["vec_id"].to_numpy(), candidates["row"].to_numpy(), vectors)
            ids, own, weights = queries["vec_id"].to_numpy(), queries["row"].to_numpy(), _matrix(queries["v"].to_pylist())
            for lo in range(0, len(ids), QUERY_ROWS):
                q, c, score = block.best(own[lo : lo + QUERY_ROWS], weights[lo : lo + QUERY_ROWS], k)
                found.append((own[lo + q], ids[lo + q], c, score))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), columns, strict=True)))

    found = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(cell, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
