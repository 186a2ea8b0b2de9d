"""Roll-ups of file statistics: project, languages, directories, duplicates, tests, tokens.

file_stats rows: path, language, lines (total, code, comment, blank), size, duplicate_lines, complexity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions import paths, scores, text

LINES = T.StructType([T.StructField(c, T.LongType()) for c in ("total", "code", "comment", "blank")])
COMPLEXITY = T.StructType([
    T.StructField("functions_measured", T.BooleanType()), T.StructField("control_flow_measured", T.BooleanType()),
    *(T.StructField(c, T.LongType()) for c in ("functions", "cyclomatic", "cognitive", "max_depth")), T.StructField("avg_func_lines", T.DoubleType()),
    *(T.StructField(c, T.LongType()) for c in ("legacy_functions", "legacy_cyclomatic", "legacy_max_depth")), T.StructField("legacy_avg_func_lines", T.DoubleType()),
])
FILE_STATS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("lines", LINES),
    T.StructField("size", T.LongType()), T.StructField("duplicate_lines", T.LongType()), T.StructField("complexity", COMPLEXITY),
])
SORTS = {"lines": "total", "files": "files", "code": "code", "size": "size"}


def totals() -> list[Column]:
    """The additive statistics of a group of files, merged complexity included."""
    f, c = F.col("complexity.functions"), F.col("complexity.avg_func_lines")
    return [
        F.count("*").alias("files"),
        *(F.coalesce(F.sum(f"lines.{k}"), F.lit(0)).alias(k) for k in ("total", "code", "comment", "blank")),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.coalesce(F.sum("duplicate_lines"), F.lit(0)).alias("duplicate_lines"),
        F.coalesce(F.sum(f), F.lit(0)).alias("functions"), F.coalesce(F.sum("complexity.cyclomatic"), F.lit(0)).alias("cyclomatic"),
        F.coalesce(F.sum("complexity.cognitive"), F.lit(0)).alias("cognitive"), F.coalesce(F.max("complexity.max_depth"), F.lit(0)).alias("max_depth"),
        scores.ratio(F.sum(c * f), F.sum(f)).alias("avg_func_lines"),
        F.coalesce(F.bool_or("complexity.functions_measured"), F.lit(False)).alias("functions_measured"),
        F.coalesce(F.bool_or("complexity.control_flow_measured"), F.lit(False)).alias("control_flow_measured"),
        F.coalesce(F.sum(scores.estimated_tokens(F.col("language"), F.col("size"))), F.lit(0)).alias("tokens"),
        F.count_if(paths.is_test_path(F.col("path"))).alias("test_files"),
        F.coalesce(F.sum(F.when(paths.is_test_path(F.col("path")), F.col("lines.code"))), F.lit(0)).alias("test_code"),
    ]


def summary(files: DataFrame) -> DataFrame:
    """One row for all files."""
    sizes = [F.count_if(scores.size_class(F.col("size")) == name).alias(f"size_{name}") for name, _ in scores.SIZE_CLASSES]
    out = files.agg(*totals(), *sizes, F.count_distinct("language").alias("languages"))
    return out.withColumn("test_ratio", scores.test_ratio(F.col("test_code"), F.col("code")))


def by_language(files: DataFrame, sort: str = "lines") -> DataFrame:
    """A row a language in report order: the sort key from the largest, then the name."""
    return files.groupBy("language").agg(*totals()).orderBy(F.desc(SORTS[sort]), "language")


def files_table(files: DataFrame, sort: str = "lines", top: int | None = None) -> DataFrame:
    """The files in report order, the first `top` of them if given."""
    key = {"lines": "lines.total", "files": "lines.total", "code": "lines.code", "size": "size"}[sort]
    out = files.orderBy(F.desc(key), paths.components(F.col("path")))
    return out if top is None else out.limit(top)


def by_directory(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Cumulative totals of every directory down to max_depth, files at the root under '.'."""
    up = paths.ancestors(F.col("path"), max_depth)
    out = files.withColumn("directory", F.explode(up)).groupBy("directory").agg(*totals())
    return out.withColumn("depth", F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/"))))


def directory_tree(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """by_directory with parents before children and siblings by code, as `position`."""
    rows = by_directory(files, max_depth)
    code = rows.select(F.col("directory").alias("up"), F.struct((-F.col("code")).alias("less"), F.col("directory").alias("name")).alias("key"))
    place = rows.select("directory", F.posexplode(paths.ancestors(F.concat("directory", F.lit("/x")))).alias("level", "up"))
    keys = place.join(code, "up").groupBy("directory").agg(F.sort_array(F.collect_list(F.struct("level", "key"))).alias("place"))
    return rows.join(keys, "directory").orderBy("place").drop("place")


def size_distribution(files: DataFrame) -> DataFrame:
    return files.groupBy(scores.size_class(F.col("size")).alias("size_class")).agg(F.count("*").alias("files"))


def context_fit(total_tokens: DataFrame) -> DataFrame:
    """tokens with the share of each context window they fill and whether they fit."""
    out = total_tokens
    for name, size in scores.CONTEXT_WINDOWS.items():
        out = out.withColumn(f"{name}_ratio", F.col("tokens") / float(size)).withColumn(name, F.col("tokens") <= size)
    return out


def unique_lines(lines: DataFrame) -> DataFrame:
    """uloc: how many different non-blank lines there are. Lines are grouped before they are counted."""
    return lines.groupBy("line").agg(F.lit(1)).agg(F.count("*").alias("uloc"))


def duplicates(lines: DataFrame, keys: list[str], everywhere: DataFrame | None = None) -> DataFrame:
    """duplicate_lines for each value of keys: eligible lines that occur twice or more in all files.

    Lines are counted for each key and line first, so that a line which is in every file comes as one row a file; the
    counts by line are small next to the lines and no line's rows meet in one task.
    """
    here = lines.where("eligible").groupBy(*keys, "line").agg(F.count("*").alias("n"))
    counted = (lines if everywhere is None else everywhere).groupBy("line").agg(F.count("*").alias("all")).where("all > 1").select("line")
    return here.join(counted, "line", "left_semi").groupBy(*keys).agg(F.sum("n").alias("duplicate_lines"))


def with_duplicates(files: DataFrame, counts: DataFrame) -> DataFrame:
    """file_stats with duplicate_lines from duplicates(), 0 where a file has none."""
    own = counts.select(F.col("path"), F.col("duplicate_lines").alias("_n"))
    return files.join(own, "path", "left").withColumn("duplicate_lines", F.coalesce("_n", F.lit(0))).drop("_n").select("path", "language", "lines", "size", "duplicate_lines", "complexity")


def exact_duplicates(files: DataFrame, content: str = "content") -> DataFrame:
    """path, first (the path of the same content that is kept) and kept. The kept one is the smallest by components."""
    keyed = files.select("path", F.sha2(F.col(content).cast("binary"), 256).alias("key"))
    kept = keyed.groupBy("key").agg(F.min_by("path", paths.components(F.col("path"))).alias("first"))
    return keyed.join(kept, "key").select("path", "first", (F.col("path") == F.col("first")).alias("kept"))


def dryness(lines: DataFrame, files: DataFrame) -> DataFrame:
    """uloc, non_blank and dryness (percent of non-blank lines that are different)."""
    non_blank = files.agg(F.coalesce(F.sum(F.col("lines.total") - F.col("lines.blank")), F.lit(0)).alias("non_blank"))
    both = unique_lines(lines).crossJoin(non_blank)  # a row each
    return both.select("uloc", "non_blank", scores.dryness(F.col("uloc"), F.col("non_blank")).alias("dryness"))


def plain_file_stats(files: DataFrame, content: str = "content") -> DataFrame:
    """file_stats of texts without code (path, language, content): lines and sizes only, in built-in expressions."""
    lines = text.plain_line_stats(F.col(content))
    none = F.from_json(F.lit('{"functions_measured":false,"control_flow_measured":false,"functions":0,"cyclomatic":0,"cognitive":0,"max_depth":0,"avg_func_lines":0.0,"legacy_functions":0,"legacy_cyclomatic":0,"legacy_max_depth":0,"legacy_avg_func_lines":0.0}'), COMPLEXITY)
    return files.select("path", "language", lines.alias("lines"), F.octet_length(content).cast("long").alias("size"), F.lit(0).cast("long").alias("duplicate_lines"), none.alias("complexity"))


def first_by_path(files: DataFrame, order: Column | None = None) -> DataFrame:
    """The first row of each path, leading './' aside, by the path as written unless another order is given."""
    w = Window.partitionBy("_path").orderBy(F.col("path") if order is None else order)
    return files.withColumn("_path", paths.relative(F.col("path"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_path", "_n")
