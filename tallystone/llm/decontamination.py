"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. Benchmark items fall into windows of 10 consecutive words; a shorter item is one window. Equal windows count once.
2. One pass over the training texts stores the index: a posting (row, position, term) of every word that the benchmark has,
   terms by number, and for each row a posting at position 0 with its id and number of words. Texts are read and split
   once; all else reads the postings.
3. The postings tell how often each term occurs. A window's terms are ordered from the rarest to the commonest.
4. Proximity matches: the postings of a window's rarest term, intersected with the lists of its second and third term within
   NEAR words, in any order. Positions are cut into strips for that, so a posting meets a bounded number of others.
5. Exact matches: for what is left, the lists of all terms, each adjusted by its offset in the window, must hold the
   window's start. An exact match is a proximity match too, as a window has at most NEAR + 1 words.

Texts are never shuffled: what is are postings (three numbers), candidates, and one row a document. Joins are by row and
position, so that neither a frequent term nor an id that many rows share meets in one task.

Defined cases: null texts and texts without words have no words and are not contaminated; an item without words has no
window; equal items each count; each row of docs has its own result, so repeated rows have equal ones and a null id is kept;
very long texts become many postings and no longer rows; an empty table gives no documents, an empty benchmark no hits;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.llm.common import ascii_lower, broadcast_within, materialize

WINDOW, NEAR = 10, 9
#: Rows of the benchmark's tables that may be broadcast; larger ones are joined by shuffles.
MAX_BROADCAST_ROWS = 500_000
_NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(col: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(col, F.lit(""))), _NOT_WORDS), "")


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window) for every window of every item."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return items.select("item_id", F.explode(starts).alias("at"), "w").select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("window"))


def ranked_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window_id, window, terms) of the distinct windows; terms (n, offset, term) stand rarest first. counts: word, term, n."""
    numbered = materialize(windows.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()), "distinct-windows")
    own = numbered.select("window_id", F.posexplode("window").alias("offset", "word")).join(counts, "word")
    return own.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("terms")).join(numbered, "window_id")


def build_index(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (row, at, term, id, n_words) of texts (id, w); id and n_words are set at position 0, whose term is 0.

    terms: (word, term) with numbers from 1.
    """
    known = terms.select(F.col("word").alias("_word"), "term").unionByName(terms.sparkSession.createDataFrame([("", 0)], "_word string, term long"))
    marked = texts.select("id", F.concat(F.array(F.lit("")), "w").alias("w"), F.monotonically_increasing_id().alias("row"))
    posted = marked.select("row", "id", F.size("w").alias("_n"), F.posexplode("w").alias("at", "_word")).join(broadcast_within(known, MAX_BROADCAST_ROWS), "_word")
    own = F.col("term") == 0
    return posted.select("row", "at", "term", F.when(own, F.col("id")).alias("id"), F.when(own, F.col("_n") - 1).cast("long").alias("n_words"))


def _beside(found: DataFrame, postings: DataFrame, k: int, near: int) -> DataFrame:
    """Those of the candidates (row, window_id, at, terms) with the window's k-th term within `near` words, or without one."""
    term, width = F.get("terms", F.lit(k))["term"], near + 1
    some = found.where(F.size("terms") > k).withColumn("_term", term)
    wanted = materialize(some.select("_term").distinct(), "list-terms")
    lists = postings.join(broadcast_within(wanted.withColumnRenamed("_term", "term"), MAX_BROADCAST_ROWS), "term", "left_semi")
    lists = lists.select(F.col("row").alias("_row"), F.col("term").alias("_of"), F.col("at").alias("_at"), F.floor(F.col("at") / width).alias("_strip"))
    strip = F.floor(F.col("at") / width)
    around = some.withColumn("strip", F.explode(F.array(strip - 1, strip, strip + 1)))
    close = (F.col("row") == F.col("_row")) & (F.col("_term") == F.col("_of")) & (F.col("strip") == F.col("_strip")) & (F.abs(F.col("at") - F.col("_at")) <= near)
    kept = around.join(lists, close, "left_semi").select("row", "window_id", "at").distinct()
    return kept.unionByName(found.where(F.size("terms") <= k).select("row", "window_id", "at"))


def matches(postings: DataFrame, ranked: DataFrame, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(row, window_id, start, length) of exact matches and (row, window_id, at) of proximity matches, at being that of the
    rarest term; positions count words from 1."""
    postings = postings.where("term > 0").select("row", "at", "term")
    lists = broadcast_within(ranked.select("window_id", "terms"), MAX_BROADCAST_ROWS)
    found = postings.join(broadcast_within(ranked.select("window_id", "terms", F.col("terms")[0]["term"].alias("term")), MAX_BROADCAST_ROWS), "term").select("row", "window_id", "at", "terms")
    for k in (1, 2):
        found = materialize(_beside(found, postings, k, near), "near-matches")
        rows, found = found, found.join(lists, "window_id")
    near_matches = rows
    start = F.col("at") - F.col("terms")[0]["offset"]
    starts = found.where(start >= 1).select("row", "window_id", start.alias("start"), F.size("terms").alias("length"), F.explode("terms").alias("t"))
    asked = starts.select("row", "window_id", "start", "length", (F.col("start") + F.col("t.offset")).alias("at"), F.col("t.term").alias("term"))
    # only postings of rows with a candidate can be asked for
    some = materialize(near_matches.select("row").distinct(), "near-rows")
    there = postings.join(broadcast_within(some, 4 * MAX_BROADCAST_ROWS), "row", "left_semi")
    held = asked.join(there, ["row", "at", "term"]).groupBy("row", "window_id", "start", "length").agg(F.count("*").alias("n"))
    return materialize(held.where("n = length").drop("n"), "exact-matches"), near_matches


def _covered(spans: Column) -> Column:
    """How many words the spans (start, length), sorted, cover."""
    grown = lambda acc, s: F.struct((acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], s["start"] + s["length"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), grown)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (windows with a proximity match) of each row of docs."""
    near = max(near, size - 1)
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    windows = materialize(benchmark_windows(benchmark, size), "windows")
    terms = materialize(windows.select(F.explode("window").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id() + 1), "terms")
    postings = materialize(build_index(texts, terms), "postings")
    counts = postings.where("term > 0").groupBy("term").agg(F.count("*").alias("n"))
    counts = materialize(terms.join(counts, "term", "left").select("word", "term", F.coalesce("n", F.lit(0)).alias("n")), "term-counts")
    ranked = materialize(ranked_windows(windows, counts), "ranked-windows")
    exact, close = matches(postings, ranked, near)

    hits = exact.select("row", F.struct("start", "length").alias("span")).distinct()
    hits = hits.groupBy("row").agg(_covered(F.sort_array(F.collect_list("span"))).cast("long").alias("n_hit"))
    holders = materialize(windows.distinct().join(ranked.select("window", "window_id"), "window").select("window_id", F.col("item_id").cast("string").alias("item")), "window-items")
    items = exact.select("row", "window_id").distinct().join(broadcast_within(holders, MAX_BROADCAST_ROWS), "window_id").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    close = close.select("row", "window_id").distinct().groupBy("row").agg(F.count("*").alias("n_near"))
    out = postings.where("term = 0").select("row", "id", "n_words")
    for part in (hits, items, close):
        out = out.join(part, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, win FROM dw WHERE win IN (SELECT win FROM bw)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit JOIN bw USING (win)) GROUP BY 1),
-- proximity: the three rarest terms of a window, ties by offset, within nine words of the rarest
dp AS (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) WHERE t IN (SELECT unnest(w) FROM b)),
tc AS (SELECT t, count(*) AS n FROM dp GROUP BY 1),
wt AS (SELECT win, unnest(string_split(win, ' ')) AS t, unnest(range(0, len(string_split(win, ' ')))) AS o FROM (SELECT DISTINCT win FROM bw)),
rk AS (SELECT win, t, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), o) AS k FROM wt LEFT JOIN tc USING (t)),
q AS (SELECT win, max(t) FILTER (k = 1) AS t1, max(t) FILTER (k = 2) AS t2, max(t) FILTER (k = 3) AS t3 FROM rk GROUP BY 1),
nr AS (SELECT a.doc_id, count(DISTINCT q.win) AS n_near FROM dp a JOIN q ON a.t = q.t1
  WHERE (t2 IS NULL OR EXISTS (SELECT 1 FROM dp x WHERE x.doc_id = a.doc_id AND x.t = q.t2 AND x.p BETWEEN a.p - 9 AND a.p + 9))
    AND (t3 IS NULL OR EXISTS (SELECT 1 FROM dp x WHERE x.doc_id = a.doc_id AND x.t = q.t3 AND x.p BETWEEN a.p - 9 AND a.p + 9)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
