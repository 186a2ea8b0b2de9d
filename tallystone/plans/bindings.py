"""The driver's tables as inputs of the engine: a corpus of files, file statistics, and two commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import aggregate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown files: path, language, lang, content."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(path.alias("path"), F.lit("Markdown").alias("language"), "lang", F.coalesce("text", F.lit("")).alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTML files."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("HTML").alias("language"), F.coalesce("html", F.lit("")).alias("content"))


def file_stats(spark: SparkSession, sf_dir: str, shipped_before: str | None = None) -> DataFrame:
    """part and lineitem as file statistics; shipped_before makes the older of two trees."""
    part, items = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    if shipped_before:
        items = items.where(F.col("l_shipdate") < F.lit(shipped_before).cast("timestamp"))
    sums = items.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"), F.sum("l_linenumber").cast("long").alias("comment"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    rows = part.join(sums, F.col("p_partkey") == F.col("l_partkey"))
    end = F.when(F.col("p_partkey") % 11 == 0, "_test.rs").otherwise(".rs")
    language = F.element_at(F.array(*map(F.lit, ["Rust", "Go", "Python", "Markdown"])), F.col("p_size") % 4 + 1)
    rows = rows.withColumn("code", F.greatest(F.col("total") - F.col("n") - F.col("comment"), F.lit(0))).withColumn("functions", F.floor(F.col("p_size") / 5))
    lines = F.struct(F.col("total"), F.col("code"), F.col("comment"), F.col("n").alias("blank"))
    none = F.lit(None).cast("long")
    complexity = F.struct(
        (F.col("functions") > 0).alias("functions_measured"), F.lit(True).alias("control_flow_measured"), F.col("functions"), (F.col("p_size") + F.col("n")).alias("cyclomatic"), F.lit(0).cast("long").alias("cognitive"),
        (F.col("p_size") % 9).cast("long").alias("max_depth"), (F.col("p_partkey") % 97 * 1.5).cast("double").alias("avg_func_lines"), none.alias("legacy_functions"), none.alias("legacy_cyclomatic"), none.alias("legacy_max_depth"), F.lit(None).cast("double").alias("legacy_avg_func_lines"),
    )
    path = F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string"), end)
    return rows.select(path.alias("path"), language.alias("language"), lines.alias("lines"), (F.col("code") * 30).alias("size"), (F.col("r") * 20).alias("duplicate_lines"), complexity.alias("complexity"))


def tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the paths that commit log A touches."""
    part = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("path")).agg(F.max("p_size").cast("long").alias("cyclomatic"))
    return part.select("path", F.lit("Rust").alias("language"), F.struct("cyclomatic").alias("complexity"))


def log_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders, lineitem and part as a commit log."""
    o, i, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    rows = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("o_orderkey").alias("commit"), F.col("o_custkey").cast("string").alias("author"), F.unix_timestamp("o_orderdate").alias("ts"), F.concat("p_brand", F.lit("/"), "p_type").alias("path"),
        F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"),
    )


def log_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a commit log of one file a commit."""
    e = table(spark, sf_dir, "events")
    path = F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("commit"), F.col("user_id").cast("string").alias("author"), F.unix_timestamp("ts").alias("ts"), path.alias("path"), F.floor("value").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"))


def plain_stats(files: DataFrame) -> DataFrame:
    return aggregate.plain_file_stats(files)
