"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.sources.work import work_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder (spark.checkpoint.dir) and read again: cuts the lineage and survives lost
    executors. The table is deleted when the driver ends."""
    return work_table(df, name)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """At most n rows in an Arrow batch for the jobs that run inside, for rows that carry much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes, as JSON text, that a broadcast may have.
MAX_BROADCAST_BYTES = 256 << 20


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether df has at most max_rows rows and max_bytes bytes; reads little more than that many rows."""
    n, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_within(df: DataFrame, max_rows: int, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes stay in the bounds; otherwise left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df


def new_name(df: DataFrame, wanted: str) -> str:
    """wanted, or the first of wanted_1, wanted_2, ... that df has no column of."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (wanted, *(f"{wanted}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def _bucketed(df: DataFrame, groups: list[str], key: str, total: int, n_groups: int, rows_per_bucket: int, first: Column | None) -> DataFrame:
    buckets = max(16, total // (max(n_groups, 1) * rows_per_bucket))
    place = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(buckets)).cast("int")
    return df.withColumn("_bucket", place if first is None else first.cast("int") * buckets + place)


def _starts(df: DataFrame, groups: list[str], weight: Column) -> DataFrame:
    """(groups, _bucket, _start): what the buckets before each one hold. Blocks of 1000 buckets are added up first, then the
    buckets of a block, so that no task orders all buckets."""
    before = lambda within, order: Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*groups, "_bucket").agg(F.sum(weight).alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / 1000))
    blocks = sums.groupBy(*groups, "_block").agg(F.sum("_n").alias("_all"))
    blocks = blocks.select(*groups, "_block", F.coalesce(F.sum("_all").over(before(groups, "_block")), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum("_n").over(before([*groups, "_block"], "_bucket")), F.lit(0))
    return sums.select(*groups, "_bucket", "_block", inner.alias("_inner")).join(blocks, [*groups, "_block"]).select(*groups, "_bucket", (F.col("_before") + F.col("_inner")).alias("_start"))


def numbered(df: DataFrame, groups: list[str], key: str, first: Column | None = None, rows_per_bucket: int = 2000, total: int | None = None, n_groups: int = 1, out: str = "idx") -> DataFrame:
    """A gapless number from 0 for every row of its group, without bringing a group into one task.

    Rows of a group are spread over buckets by a hash of `key`; the counts by bucket give each bucket its start and
    a window numbers the rows of one bucket only. Rows with a smaller `first` (0 or 1) come before all others.
    """
    df = _bucketed(df, groups, key, df.count() if total is None else total, n_groups, rows_per_bucket, first)
    by = [*groups, "_bucket"]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)
    return ranked.join(_starts(df, groups, F.lit(1)), by).withColumn(out, F.col("_start") + F.col("_rank")).drop("_bucket", "_rank", "_start")


def running(df: DataFrame, groups: list[str], key: str, weight: str, total: int, n_groups: int = 1, rows_per_bucket: int = 2000) -> DataFrame:
    """df with before: the sum of weight over the rows of the group that come before in the order of a hash of key, again
    without bringing a group into one task."""
    df = _bucketed(df, groups, key, total, n_groups, rows_per_bucket, None)
    by = [*groups, "_bucket"]
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_inside", inside).join(_starts(df, groups, F.col(weight)), by).withColumn("before", F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_start")
