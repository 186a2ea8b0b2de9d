"""The corpus pipeline: quality, near-duplicates, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next stage's docs. All stages but the last return the columns of documents.

Defined cases of the stages that filter: decisions are by row, under a key of the stage's own, so rows with a null id, rows that
share an id and repeated rows are each judged by their text; columns beside doc_id and text come out as they went in, whatever
their names; very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm import decontamination, near_dedup, packing, quality
from tallystone.llm.common import broadcast_within, materialize, new_name

#: Ids of dropped documents that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 2_000_000
#: Words whose ids a packing worker keeps: fewer than packing alone does, as earlier stages have filled the executors' heap.
KEPT_WORDS = 150_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for every row, written so that it stays, and the name of that column."""
    key = new_name(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """docs whose key is not among dropped (one column), without that key."""
    dropped = materialize(dropped, "dropped")
    return docs.join(broadcast_within(dropped, MAX_BROADCAST_ROWS), key, "left_anti").drop(key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts to be good, held-out labels unseen. Null and blank texts have the share of good texts in
    training as their score; of equal texts all stay or none; a row on the threshold stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~quality.held_out(F.col("doc_id")))
    score, predicted = new_name(docs, "_score"), new_name(docs, "_predicted")
    return quality.score(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 1).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id, null ids last, and of several such rows the first.
    Null texts and texts without words are nobody's duplicate and stay; different texts that share an id stay."""
    keyed, key = _keyed(docs)
    found = materialize(near_dedup.near_dedup(keyed, id_col=key).select(key, "component_id"), "components")
    several = found.join(broadcast_within(materialize(found.groupBy("component_id").count().where("count > 1").select("component_id"), "groups"), MAX_BROADCAST_ROWS), "component_id")
    named = materialize(several.join(keyed.select(key, F.col("doc_id").alias("_doc")), key), "members")
    first = F.min(F.struct(F.col("_doc").isNull().alias("without"), "_doc", key))[key]
    best = named.groupBy("component_id").agg(first.alias(key)).select(key)
    return _without(keyed, key, named.select(key).join(best, key, "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark. Null texts and texts without words hold none and stay; of equal texts all
    stay or none."""
    keyed, key = _keyed(docs)
    found = decontamination.decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(keyed, key, found.where("contaminated").select(key))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens. Every row is packed, a null or empty text as its end
    token, under its doc_id, which may be null or repeat."""
    return packing.pack(docs, kept_words=KEPT_WORDS)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: The classifier, the components and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
