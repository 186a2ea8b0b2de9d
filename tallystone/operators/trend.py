"""Differences between two summaries: snapshots of one tree, or two trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import scores
from tallystone.operators import aggregate

METRICS = {"files": "files", "lines": "total", "code": "code", "comment": "comment", "blank": "blank", "complexity": "cyclomatic", "functions": "functions"}


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, signed and percent for two rows of aggregate.summary()."""
    side = lambda df, name: df.select(*(F.col(c).cast("long").alias(f"{name}_{k}") for k, c in METRICS.items()))
    both = side(before, "b").crossJoin(side(after, "a"))  # a row each
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), scores.delta(F.col(f"b_{k}"), F.col(f"a_{k}")).alias("d")) for k in METRICS))
    return both.select(F.inline(rows)).select("metric", "d.*")


def language_trend(before: DataFrame, after: DataFrame) -> DataFrame:
    """A full outer join by language: status and the deltas of files and code, the largest change of code first.

    A language that both sides have counts as changed even if its numbers are the same.
    """
    side = lambda df, name: aggregate.by_language(df).select("language", F.col("files").alias(f"{name}_files"), F.col("code").alias(f"{name}_code"))
    rows = side(before, "b").join(side(after, "a"), "language", "full_outer")
    status = F.when(F.col("b_files").isNull(), "added").when(F.col("a_files").isNull(), "removed").otherwise("changed")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = rows.select("language", status.alias("status"), scores.delta(zero("b_files"), zero("a_files")).alias("files"), scores.delta(zero("b_code"), zero("a_code")).alias("code"))
    return out.orderBy(F.desc(F.abs("code.signed")), "language")
