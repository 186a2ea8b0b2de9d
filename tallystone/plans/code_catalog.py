"""Queries that run the kernel on source code in several languages, built from the part table, with closed-form oracles.

Each file repeats one block of its language n times under a head comment, so SQL can tell what the kernel must find: comments in strings,
strings in comments, nesting, decisions and functions are counted by hand once for a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.operators import aggregate, analyze, filters, history
from tallystone.plans import bindings as B
from tallystone.plans import oracle as O
from tallystone.plans.catalog import query

#: By extension: language, head, block, and a block's numbers: (lines, code, comment, blank; functions, decisions, cognitive sum,
#: depth, lines of its function, depth of brackets). The head is one line of comment.
BLOCKS = {
    "rs": ("Rust", "/* head \" */\n", 'fn f(x: i32) -> i32 {\n    let s = "if // no comment {";\n    if x > 1 {\n        for y in z {\n            if y && w { g(); }\n        }\n    }\n\n    x // tail\n}\n', (10, 9, 0, 1, 1, 4, 9, 3, 10.0, 5)),
    "py": ("Python", "# head '\n", 'def f(x):\n    """doc if\n    for"""\n    if x and y:\n        for z in x:\n            while z:\n                z = "# if"\n\n    return x\n', (9, 6, 2, 1, 1, 4, 7, 3, 9.0, 1)),
    "js": ("JavaScript", "// head `\n", "function f(a) {\n  const s = `if {\n// in a string`;\n  if (a || b) {\n    return a;\n  }\n  /* note */\n}\n", (8, 7, 1, 0, 1, 2, 2, 1, 8.0, 2)),
    "c": ("C", "/* head */\n", "int f(int a) {\n    while (a) {\n        a--;\n    }\n    return '\"';\n}\n", (6, 6, 0, 0, 1, 1, 1, 1, 6.0, 2)),
    "go": ("Go", "// head\n", "func f(a int) int {\n\tif a > 0 && a < 9 {\n\t\treturn `/* if`\n\t}\n\treturn 0\n}\n\n", (7, 6, 0, 1, 1, 2, 2, 1, 6.0, 2)),
}
_EXTENSIONS = list(BLOCKS)

_NUMBERS = ", ".join(f"('{e}', '{b[0]}', {len(b[1].encode())}, {len(b[2].encode())}, {', '.join(map(str, b[3]))})" for e, b in BLOCKS.items())
CODE = f"""blocks(ext, language, head, size, lines, code, comment, blank, functions, decisions, cognitive, depth, func_lines, brackets) AS (VALUES {_NUMBERS}),
files AS (SELECT p_partkey AS k, p_size % 7 + 1 AS n, {_EXTENSIONS!r}[p_partkey % {len(BLOCKS)} + 1] AS ext FROM part),
code AS (SELECT 'd' || k % 4 || '/f' || k || '.' || ext AS path, k, n, language, head + n * size AS size, 1 + n * lines AS total, n * b.code AS code, 1 + n * comment AS comment, n * blank AS blank,
  n * functions AS functions, n * (decisions + functions) AS cyclomatic, n * cognitive AS cognitive, depth AS max_depth, func_lines AS avg_func_lines, brackets AS legacy_max_depth FROM files JOIN blocks b USING (ext))"""


#: Files that a task of the kernel gets.
TASK_FILES = 2000


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content (bytes) and k of a file for each part; every third begins with a byte order mark. The rows are dealt anew
    before they get their content: the whole table may be one row group, which one task reads."""
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") % 7 + 1).cast("int").alias("n"), (F.col("p_partkey") % len(BLOCKS)).cast("int").alias("at"))
    part = part.repartition(part.count() // TASK_FILES + 1, "k")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("at") + 1)
    text = F.concat(pick([b[1] for b in BLOCKS.values()]), F.repeat(pick([b[2] for b in BLOCKS.values()]), F.col("n")))
    content = F.concat(F.when(F.col("k") % 3 == 0, F.lit(analyze.BOM)).otherwise(F.lit(b"")), F.encode(text, "UTF-8"))
    path = F.concat(F.lit("d"), (F.col("k") % 4).cast("string"), F.lit("/f"), F.col("k").cast("string"), F.lit("."), pick(_EXTENSIONS))
    return part.select(path.alias("path"), content.alias("content"), "k")


@query("code_metrics", f"WITH {CODE} SELECT path, language, CAST(total AS BIGINT) AS total, CAST(code AS BIGINT) AS code, CAST(comment AS BIGINT) AS comment, CAST(blank AS BIGINT) AS blank, CAST(size AS BIGINT) AS size, CAST(functions AS BIGINT) AS functions, CAST(cyclomatic AS BIGINT) AS cyclomatic, CAST(cognitive AS BIGINT) AS cognitive, CAST(max_depth AS BIGINT) AS max_depth, CAST(avg_func_lines AS DOUBLE) AS avg_func_lines, CAST(legacy_max_depth AS BIGINT) AS legacy_max_depth FROM code")
def code_metrics(spark, sf_dir):
    """Line classes, masking, functions, decisions and nesting of code in five languages; marks of byte order do not count."""
    found = analyze.analyze(sources(spark, sf_dir), options=analyze.Options(duplication=False)).file_stats
    c = [F.col(f"complexity.{x}") for x in ("functions", "cyclomatic", "cognitive", "max_depth", "avg_func_lines", "legacy_max_depth")]
    return found.select("path", "language", "lines.*", "size", *c)


@query("code_filters", f"WITH {CODE} SELECT path, language FROM code WHERE language IN ('Rust', 'Python', 'Go') AND total BETWEEN 20 AND 60 AND split_part(path, '/', 1) <> 'd3'")
def code_filters(spark, sf_dir):
    """Filters by language, directory and numbers of lines, in their order."""
    rules = filters.PathRules.parse(exclude_dirs="^d3$")
    files = sources(spark, sf_dir).where(rules.keeps(F.col("path")))
    options = analyze.Options(languages=["rust", "PYTHON", "Go"], min_lines=20, max_lines=60, duplication=False)
    return analyze.analyze(files, options=options).file_stats.select("path", "language")


@query("scan_counters", "SELECT count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 7 > 0) AS scanned, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS skipped, CAST(0 AS BIGINT) AS errors FROM part")
def scan_counters(spark, sf_dir):
    """Counters of a scan in which some files are binary and some of no language."""
    files = sources(spark, sf_dir)
    content = F.when(F.col("k") % 5 == 0, F.concat("content", F.lit(b"\x00"))).otherwise(F.col("content"))
    path = F.when(F.col("k") % 7 == 0, F.concat(F.col("path"), F.lit(".unknown"))).otherwise(F.col("path"))
    return analyze.analyze(files.select(path.alias("path"), content.alias("content")), options=analyze.Options(duplication=False)).counters


@query("no_duplicates", f"WITH {CODE} SELECT arg_min(path, string_split(path, '/')) AS path FROM code GROUP BY language, n, k % 3 = 0")
def no_duplicates(spark, sf_dir):
    """Of files with equal bytes the first by path stays."""
    return analyze.analyze(sources(spark, sf_dir), options=analyze.Options(no_duplicates=True, duplication=False)).file_stats.select("path")


@query("code_spans", f"WITH {CODE}, s AS (SELECT *, unnest(range(0, n)) AS i FROM code) SELECT path, CAST(2 + i * lines AS BIGINT) AS start_line, CAST(1 + i * lines + func_lines AS BIGINT) AS end_line, CAST(decisions + blocks.functions AS BIGINT) AS cyclomatic FROM s JOIN blocks USING (language)")
def code_spans(spark, sf_dir):
    """Where each function begins and ends, and its own decisions."""
    return analyze.analyze(sources(spark, sf_dir), options=analyze.Options(spans=True, duplication=False)).spans.select("path", "start_line", "end_line", "cyclomatic")


_TOUCHED = """SELECT p_brand AS path, 'fn_' || p_partkey AS name, p_partkey AS start_line, p_size AS cyclomatic, count(*) AS commits FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4"""


@query("function_hotspots", f"WITH t AS ({_TOUCHED}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY commits DESC, cyclomatic DESC, start_line) AS n FROM t) SELECT path, name, commits FROM r WHERE n <= 5")
def function_hotspots(spark, sf_dir):
    """The five most touched functions of each file."""
    part, items = B.table(spark, sf_dir, "part"), B.table(spark, sf_dir, "lineitem")
    rows = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("path"), F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("start_line"), F.col("p_size").alias("cyclomatic"))
    return history.function_hotspots(rows.agg(F.count("*").alias("commits"))).select("path", "name", "commits")


@query("dir_tree_order", f"""WITH {O.stats()}, a AS (SELECT string_split(path, '/') AS p, code FROM fs), u AS (SELECT unnest([array_to_string(p[1:i], '/') for i in range(1, least(len(p) - 1, 3) + 1)]) AS directory, code FROM a),
d AS (SELECT directory, CAST(sum(code) AS BIGINT) AS code FROM u GROUP BY 1), e AS (SELECT directory, unnest(range(1, len(string_split(directory, '/')) + 1)) AS i FROM d),
k AS (SELECT e.directory, list([lpad(CAST(1000000000000 - d.code AS VARCHAR), 13, '0'), d.directory] ORDER BY i) AS place FROM e JOIN d ON d.directory = array_to_string(string_split(e.directory, '/')[1:i], '/') GROUP BY 1)
SELECT row_number() OVER (ORDER BY place) - 1 AS position, directory, code FROM k JOIN d USING (directory)""")  # fmt: skip
def dir_tree_order(spark, sf_dir):
    """Directories in the order of the tree: parents first, siblings by code. A report's rows are few."""
    rows = aggregate.directory_tree(B.file_stats(spark, sf_dir), 3).select("directory", "code")
    return rows.coalesce(1).select(F.monotonically_increasing_id().alias("position"), "directory", "code")
