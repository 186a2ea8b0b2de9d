"""Text columns: lines, emptiness, binary and generated content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that is trimmed, marks of generated files, and limits.
ASCII_SPACE = " \t\n\r\f"
GENERATED_MARKS = ["code generated by", "do not edit", "@generated", "autogenerated", "automatically generated"]
BINARY_PROBE, LONG_LINE, LEAST_DUPLICATE = 10_240, 255, 8


def trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(ASCII_SPACE))


def split_lines(content: Column) -> Column:
    """The lines of a text; a line feed at the end begins no line."""
    ends = F.endswith(content, F.lit("\n"))
    lines = F.split(content, "\n", -1)
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).when(ends, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def plain_line_stats(content: Column) -> Column:
    """struct(total, code, comment, blank) of a text in a language without comments and strings that span lines."""
    lines = split_lines(content)
    blank = F.size(F.filter(lines, lambda x: trimmed(x) == ""))
    total = F.size(lines)
    return F.struct(total.cast("long").alias("total"), (total - blank).cast("long").alias("code"), F.lit(0).cast("long").alias("comment"), blank.cast("long").alias("blank"))


def is_binary(content: Column) -> Column:
    """Whether a NUL byte is among the first bytes. content: binary."""
    return F.contains(F.substring(content, 1, BINARY_PROBE), F.lit(b"\x00"))


def without_bom(content: Column) -> Column:
    """Binary content without a UTF-8 byte order mark."""
    return F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)


def is_generated(content: Column) -> Column:
    """Whether the first line says that a file is generated, or lines are long as in minified files. content: string."""
    first = F.lower(F.substring_index(content, "\n", 1))
    feeds = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    marked = F.greatest(*(F.contains(first, F.lit(m)) for m in GENERATED_MARKS))
    return marked | (F.floor(F.octet_length(content) / F.greatest(feeds, F.lit(1))) > LONG_LINE)


def explode_lines(files: DataFrame, keep: list[str], content: str = "content", eligible: Column | None = None) -> DataFrame:
    """One row for each non-blank line: `keep`, line (trimmed) and eligible (counts as a duplicate)."""
    rows = files.select(*keep, F.explode(F.split(content, "\n", -1)).alias("line"), *([eligible.alias("_ok")] if eligible is not None else []))
    rows = rows.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    long = F.octet_length("line") >= LEAST_DUPLICATE
    return rows.select(*keep, "line", (long if eligible is None else long & F.col("_ok")).alias("eligible"))
