"""From files (path, content) to file statistics: one pass of the kernel over every file, all else in built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions import paths, text
from tallystone.kernel import complexity as C
from tallystone.kernel import scan
from tallystone.kernel.languages import Language, Registry
from tallystone.operators import aggregate, filters
from tallystone.operators.aggregate import COMPLEXITY, LINES
from tallystone.sources.attributes import Attributes

SPAN = T.StructType([T.StructField("name", T.StringType()), T.StructField("start_line", T.LongType()), T.StructField("end_line", T.LongType()), T.StructField("cyclomatic", T.LongType())])
_PART = [T.StructField("lines", LINES), T.StructField("size", T.LongType()), T.StructField("complexity", COMPLEXITY)]
REGION = T.StructType([*_PART, T.StructField("text", T.StringType())])
KERNEL = T.StructType([
    T.StructField("status", T.StringType()), T.StructField("language", T.StringType()), T.StructField("measurable", T.BooleanType()), *_PART,
    T.StructField("spans", T.ArrayType(SPAN)), T.StructField("production", REGION), T.StructField("tests", REGION), T.StructField("reason", T.StringType()),
])
BOM = b"\xef\xbb\xbf"


@dataclass
class Options:
    """What an analysis does. Defaults: all languages, no limits, line duplicates counted."""

    languages: list[str] = field(default_factory=list)
    min_lines: int | None = None
    max_lines: int | None = None
    no_duplicates: bool = False
    no_min_gen: bool = False
    everything: bool = False
    spans: bool = False
    duplication: bool = True
    attributes: Attributes | None = None
    attributes_root: str = ""  # the folder that the attribute file's paths start from
    linguist: bool = True


def _lines(content: str, lang: Language) -> dict:
    return dict(zip(("total", "code", "comment", "blank"), scan.line_stats(content, lang), strict=True))


def _region(content: str, lang: Language) -> dict:
    return {"lines": _lines(content, lang), "size": len(content.encode()), "complexity": vars(C.analyze(content, lang)), "text": content}


def _spans(content: str, lang: Language, found: list[C.Span]) -> list[dict]:
    lines = content.split("\n")
    return [{**vars(s), "cyclomatic": C.cyclomatic("\n".join(lines[s.start_line - 1 : s.end_line]), lang)} for s in found]


def analyze_file(path: str, content: bytes, registry: Registry, options: Options) -> dict:
    """The kernel's row of one file; status is 'ok', 'filtered' or 'error'."""
    try:
        attributes, relative = options.attributes if options.linguist else None, path.removeprefix("./")
        inside = path.removeprefix(options.attributes_root).lstrip("/").removeprefix("./")
        if attributes and not options.everything and attributes.excluded(inside):
            return {"status": "filtered"}
        named = attributes.language(inside) if attributes else None
        lang = (registry.named(named) if named else None) or registry.detect(path, content)
        if lang is None or (options.languages and lang.name.lower() not in {x.lower() for x in options.languages}):
            return {"status": "filtered"}
        if b"\0" in content[: text.BINARY_PROBE]:
            return {"status": "filtered"}
        content = content.removeprefix(BOM)
        if options.no_min_gen and generated(content):
            return {"status": "filtered"}
        source = content.decode("utf-8", "replace")
        complexity, found = C.analyze_with_spans(source, lang)
        out = {"status": "ok", "language": lang.name, "measurable": lang.measurable, "lines": _lines(source, lang), "size": len(content), "complexity": vars(complexity)}
        if options.spans:
            out["spans"] = _spans(source, lang, found)
        if lang.inline_test_res and not _is_test(relative) and (parts := C.split_tests(source, lang)):
            out["production"], out["tests"] = _region(parts[0], lang), _region(parts[1], lang)
        return out
    except Exception as e:  # a file that the kernel fails on is counted as unreadable and says why; others go on
        return {"status": "error", "reason": f"{type(e).__name__}: {e}"}


def generated(content: bytes) -> bool:
    """text.is_generated() for the bytes of one file."""
    if not content:
        return False
    first = content.split(b"\n", 1)[0].lower()
    return any(m.encode() in first for m in text.GENERATED_MARKS) or len(content) // max(1, content.count(b"\n")) > text.LONG_LINE


def _is_test(path: str) -> bool:
    from tallystone.operators.history import _test_name

    return _test_name(path)


def kernel(registry: Registry | None = None, options: Options | None = None):
    """A column function of (path, content) that gives KERNEL structs, Arrow batch by Arrow batch. To Spark it is not
    deterministic, or a filter on its status would run it once more for every file."""
    registry, options = registry or Registry(), options or Options()
    arrow = _arrow_type(KERNEL)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, contents in batches:
            rows = [analyze_file(p.as_py() or "", c.as_py() or b"", registry, options) for p, c in zip(names, contents, strict=True)]
            yield pa.array(rows, arrow)

    return F.arrow_udf(run, KERNEL).asNondeterministic()


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@dataclass
class Analysis:
    """Lazy results of one analysis."""

    rows: DataFrame  # path, content, k (KERNEL): files that were analysed
    all_rows: DataFrame
    options: Options

    @cached_property
    def _source(self) -> DataFrame:
        return self.rows.select("path", F.make_valid_utf8(text.without_bom(F.col("content")).cast("string")).alias("content"), F.col("k.measurable").alias("ok"))

    @cached_property
    def lines(self) -> DataFrame:
        """path, line, eligible of every non-blank line. Lines of languages without code are never duplicates."""
        return text.explode_lines(self._source.withColumn("ok", F.col("ok")), ["path"], eligible=F.col("ok"))

    @cached_property
    def file_stats(self) -> DataFrame:
        plain = self.rows.select("path", "k.language", "k.lines", "k.size", F.lit(0).cast("long").alias("duplicate_lines"), "k.complexity")
        return aggregate.with_duplicates(plain, aggregate.duplicates(self.lines, ["path"])) if self.options.duplication else plain

    @cached_property
    def regions(self) -> DataFrame:
        """path, region, lines, size, duplicate_lines, complexity of files with inline tests."""
        each = [self.rows.where(F.col(f"k.{r}").isNotNull()).select("path", F.lit(r).alias("region"), F.col(f"k.{r}").alias("r")) for r in ("production", "tests")]
        parts = each[0].unionByName(each[1])
        out = parts.select("path", "region", "r.lines", "r.size", "r.complexity")
        if not self.options.duplication:
            return out.withColumn("duplicate_lines", F.lit(0).cast("long"))
        inside = text.explode_lines(parts.select("path", "region", F.col("r.text").alias("content")), ["path", "region"])
        counts = aggregate.duplicates(inside, ["path", "region"], everywhere=self.lines)
        return out.join(counts, ["path", "region"], "left").withColumn("duplicate_lines", F.coalesce("duplicate_lines", F.lit(0)))

    @cached_property
    def spans(self) -> DataFrame:
        """path, name, start_line, end_line, cyclomatic of every function, if options.spans is set."""
        return self.rows.select("path", F.inline("k.spans"))

    @cached_property
    def counters(self) -> DataFrame:
        return self.all_rows.agg(F.count_if(F.col("k.status") == "ok").alias("scanned"), F.count_if(F.col("k.status") == "filtered").alias("skipped"), F.count_if(F.col("k.status") == "error").alias("errors"))

    @cached_property
    def uloc(self) -> DataFrame:
        return aggregate.unique_lines(self.lines)


def analyze(files: DataFrame, registry: Registry | None = None, options: Options | None = None) -> Analysis:
    """files: path, content (bytes). Filters come in the order attributes, language, binary, generated, duplicates, line limits."""
    options = options or Options()
    rows = files.select("path", F.col("content").cast("binary").alias("content")).withColumn("k", kernel(registry, options)("path", "content"))
    ok = rows.where(F.col("k.status") == "ok")
    if options.no_duplicates:
        first = Window.partitionBy(F.sha2("content", 256)).orderBy(paths.components(F.col("path")))
        ok = ok.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    if options.min_lines is not None:
        ok = ok.where(F.col("k.lines.total") >= options.min_lines)
    if options.max_lines is not None:
        ok = ok.where(F.col("k.lines.total") <= options.max_lines)
    return Analysis(ok, rows, options)


def detect_languages(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """files with language by path alone: a join by file name, then by extension. The tables are as small as the registry."""
    registry, spark = registry or Registry(), files.sparkSession
    table = lambda names, key: F.broadcast(spark.createDataFrame([(k, registry.languages[v].name) for k, v in names.items()], f"{key} string, _{key} string"))
    rows = files.withColumn("name", F.lower(paths.file_name(F.col("path")))).withColumn("ext", paths.extension(F.col("path")))
    rows = rows.join(table(registry.by_filename, "name"), "name", "left").join(table(registry.by_extension, "ext"), "ext", "left")
    return rows.withColumn("language", F.coalesce("_name", "_ext")).drop("name", "ext", "_name", "_ext")


def analyze_paths(spark: SparkSession, roots: list[str], rules: filters.PathRules | None = None, registry: Registry | None = None, options: Options | None = None, **walking) -> tuple[Analysis, dict]:
    """An analysis of trees on the driver's disk, with the counters of the walk. Paths stay as walked, so files of several
    roots never share one. Attributes come from the first root."""
    from pathlib import Path

    from tallystone.sources import tree

    options = options or Options()
    home = Path(roots[0]) if Path(roots[0]).is_dir() else Path(roots[0]).parent
    if options.attributes is None and options.linguist and (found := home / ".gitattributes").is_file():
        options.attributes, options.attributes_root = Attributes.parse(found.read_text(errors="replace")), "" if str(home) == "." else str(home)
    files, counters = tree.scan_tree(spark, roots, rules, **walking)
    return analyze(files, registry, options), dict(counters)
