"""Churn by day of a commit log, as a table or as a stream with a watermark for late commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_churn(commit_files: DataFrame, late: str = "1 day") -> DataFrame:
    """path, day, commits and lines_added. On a stream, days older than the watermark are final."""
    rows = commit_files.withColumn("at", F.timestamp_seconds("ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    found = rows.groupBy("path", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("commits"), F.sum("added").alias("lines_added"))
    return found.select("path", F.col("w.start").alias("day"), "commits", "lines_added")
