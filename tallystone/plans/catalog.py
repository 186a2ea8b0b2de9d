"""The catalogue of named queries on the driver tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions import paths, scores, text
from tallystone.operators import aggregate, analyze, estimate, filters, health, history, regression, trend
from tallystone.plans import bindings as B
from tallystone.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASELINE = "1998-01-01"
NOW = 1_706_745_600  # 2024-02-01


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded: sums differ in their last bits by the order of rows."""
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name) for f in df.schema.fields))


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


# --- lines, sizes, tokens ---------------------------------------------------------------------------------------------

_LINE_COUNTS = f"""n AS (SELECT path, language, lang, content, string_split(content, chr(10)) AS a FROM corpus),
m AS (SELECT path, language, lang, CAST(strlen(content) AS BIGINT) AS size, CASE WHEN content = '' THEN 0 WHEN ends_with(content, chr(10)) THEN len(a) - 1 ELSE len(a) END AS total,
  CASE WHEN content = '' THEN 0 ELSE len(list_filter(a, lambda x: trim(x, {O.SPACE}) = '')) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS blank FROM n)"""


@query("line_stats_by_document", f"WITH {O.CORPUS}, {_LINE_COUNTS} SELECT path, total, total - blank AS code, CAST(0 AS BIGINT) AS comment, blank FROM m")
def line_stats_by_document(spark, sf_dir):
    return B.plain_stats(B.corpus(spark, sf_dir)).select("path", "lines.*")


@query("summary_by_lang", f"""WITH {O.CORPUS}, {_LINE_COUNTS} SELECT lang AS language, count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(total - blank) AS BIGINT) AS code, CAST(0 AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank,
  CAST(sum(size) AS BIGINT) AS size, CAST(sum(round(size / 3.5)) AS BIGINT) AS tokens FROM m GROUP BY 1""")  # fmt: skip
def summary_by_lang(spark, sf_dir):
    """Totals of the corpus by natural language, the largest first."""
    files = B.plain_stats(B.corpus(spark, sf_dir).withColumn("language", F.col("lang")))
    return aggregate.by_language(files).select("language", "files", "total", "code", "comment", "blank", "size", "tokens")


@query("summary_project", f"""WITH {O.stats()} SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(code) AS BIGINT) AS code, CAST(sum(comment) AS BIGINT) AS comment, CAST(sum(blank) AS BIGINT) AS blank, CAST(sum(size) AS BIGINT) AS size,
  CAST(sum(dup) AS BIGINT) AS duplicate_lines, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic, max(depth) AS max_depth, round(sum(avg_lines * functions) / sum(functions), 6) AS avg_func_lines, count(DISTINCT language) AS languages FROM fs""")  # fmt: skip
def summary_project(spark, sf_dir):
    return aggregate.summary(B.file_stats(spark, sf_dir)).select("files", "total", "code", "comment", "blank", "size", "duplicate_lines", "functions", "cyclomatic", "max_depth", "avg_func_lines", "languages")


@query("summary_by_language", f"""WITH {O.stats()} SELECT language, count(*) AS files, CAST(sum(code) AS BIGINT) AS code, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic, max(depth) AS max_depth, round(sum(avg_lines * functions) / sum(functions), 6) AS avg_func_lines,
  CAST(sum(round(size / CASE WHEN language IN ('Rust', 'Go') THEN 3.3 WHEN language = 'Markdown' THEN 4.0 ELSE 3.5 END::DOUBLE)) AS BIGINT) AS tokens FROM fs GROUP BY 1""")  # fmt: skip
def summary_by_language(spark, sf_dir):
    return aggregate.by_language(B.file_stats(spark, sf_dir), "code").select("language", "files", "code", "functions", "cyclomatic", "max_depth", "avg_func_lines", "tokens")


@query("files_table_top", f"WITH {O.stats()} SELECT path, language, total, code, comment, blank, size FROM fs ORDER BY code DESC, string_split(path, '/') LIMIT 25")
def files_table_top(spark, sf_dir):
    return aggregate.files_table(B.file_stats(spark, sf_dir), "code", 25).select("path", "language", "lines.*", "size")


@query("size_distribution", f"""WITH {O.CORPUS} SELECT CASE WHEN strlen(content) < 1024 THEN 'tiny' WHEN strlen(content) < 10240 THEN 'small' WHEN strlen(content) < 102400 THEN 'medium' WHEN strlen(content) < 1048576 THEN 'large' ELSE 'huge' END AS size_class,
  count(*) AS files FROM corpus GROUP BY 1""")  # fmt: skip
def size_distribution(spark, sf_dir):
    return aggregate.size_distribution(B.plain_stats(B.corpus(spark, sf_dir)))


@query("tokens_by_lang", f"""WITH {O.CORPUS}, t AS (SELECT lang, CAST(sum(round(strlen(content) / 4.0)) AS BIGINT) AS tokens FROM corpus GROUP BY 1)
SELECT lang, tokens, round(tokens / 200000.0, 6) AS fits_200k_ratio, tokens <= 200000 AS fits_200k, round(tokens / 1000000.0, 6) AS fits_1m_ratio, tokens <= 1000000 AS fits_1m FROM t""")  # fmt: skip
def tokens_by_lang(spark, sf_dir):
    sized = B.corpus(spark, sf_dir).select("lang", scores.estimated_tokens(F.col("language"), F.octet_length("content")).alias("tokens"))
    return aggregate.context_fit(sized.groupBy("lang").agg(F.sum("tokens").alias("tokens")))


# --- duplicates -------------------------------------------------------------------------------------------------------


@query("uloc_and_dryness", f"WITH {O.CORPUS}, {O.LINES} SELECT count(DISTINCT line) AS uloc, count(*) AS non_blank, round(count(DISTINCT line) * 100 / count(*), 6) AS dryness FROM lines")
def uloc_and_dryness(spark, sf_dir):
    files = B.corpus(spark, sf_dir)
    return aggregate.dryness(text.explode_lines(files, []), B.plain_stats(files))


@query("duplicate_lines_by_file", f"""WITH {O.CORPUS}, {O.LINES}, twice AS (SELECT line FROM lines GROUP BY 1 HAVING count(*) > 1),
d AS (SELECT path, count(*) AS n FROM lines WHERE strlen(line) >= 8 AND line IN (SELECT line FROM twice) GROUP BY 1) SELECT path, coalesce(n, 0) AS duplicate_lines FROM corpus LEFT JOIN d USING (path)""")  # fmt: skip
def duplicate_lines_by_file(spark, sf_dir):
    files = B.corpus(spark, sf_dir)
    return aggregate.with_duplicates(B.plain_stats(files), aggregate.duplicates(text.explode_lines(files, ["path"]), ["path"])).select("path", "duplicate_lines")


@query("exact_duplicate_files", f"""WITH {O.CORPUS}, f AS (SELECT content, arg_min(path, string_split(path, '/')) AS first FROM corpus GROUP BY 1) SELECT path, first, path = first AS kept FROM corpus JOIN f USING (content)""")
def exact_duplicate_files(spark, sf_dir):
    return aggregate.exact_duplicates(B.corpus(spark, sf_dir))


@query("generated_or_minified", """WITH c AS (SELECT page_id || '.html' AS path, coalesce(html, '') AS content FROM pages) SELECT path,
  lower(split_part(content, chr(10), 1)) SIMILAR TO '.*(code generated by|do not edit|@generated|autogenerated|automatically generated).*' OR strlen(content) // greatest(length(content) - length(replace(content, chr(10), '')), 1) > 255 AS generated,
  contains(content[1:10240], chr(0)) AS "binary" FROM c""")  # fmt: skip
def generated_or_minified(spark, sf_dir):
    return B.pages(spark, sf_dir).select("path", text.is_generated(F.col("content")).alias("generated"), text.is_binary(F.col("content").cast("binary")).alias("binary"))


# --- directories and tests --------------------------------------------------------------------------------------------


@query("dir_rollup_depth2", f"""WITH {O.stats()}, a AS (SELECT string_split(path, '/') AS p, * FROM fs), u AS (SELECT unnest([array_to_string(p[1:i], '/') for i in range(1, least(len(p) - 1, 2) + 1)]) AS directory, * FROM a)
SELECT directory, len(string_split(directory, '/')) AS depth, count(*) AS files, CAST(sum(total) AS BIGINT) AS total, CAST(sum(code) AS BIGINT) AS code, CAST(sum(size) AS BIGINT) AS size, CAST(sum(cyclomatic) AS BIGINT) AS cyclomatic FROM u GROUP BY 1""")  # fmt: skip
def dir_rollup_depth2(spark, sf_dir):
    rows = aggregate.by_directory(B.file_stats(spark, sf_dir), 2)
    return rows.select("directory", F.col("depth").cast("long").alias("depth"), "files", "total", "code", "size", "cyclomatic")


@query("dir_tree", f"""WITH {O.stats()}, a AS (SELECT string_split(path, '/') AS p, * FROM fs), u AS (SELECT unnest([array_to_string(p[1:i], '/') for i in range(1, least(len(p) - 1, 3) + 1)]) AS directory, * FROM a)
SELECT directory, count(*) AS files, CAST(sum(code) AS BIGINT) AS code FROM u GROUP BY 1""")  # fmt: skip
def dir_tree(spark, sf_dir):
    return aggregate.directory_tree(B.file_stats(spark, sf_dir), 3).select("directory", "files", "code")


@query("test_path_split", f"""WITH {O.stats()} SELECT count(*) FILTER (is_test) AS test_files, CAST(sum(code) FILTER (is_test) AS BIGINT) AS test_code, CAST(sum(code) AS BIGINT) AS code,
  round(sum(code) FILTER (is_test) / (sum(code) - sum(code) FILTER (is_test)), 6) AS test_ratio FROM fs""")  # fmt: skip
def test_path_split(spark, sf_dir):
    return aggregate.summary(B.file_stats(spark, sf_dir)).select("test_files", "test_code", "code", "test_ratio")


@query("test_paths", """SELECT p_partkey, p_partkey % 8 < 7 AND p_partkey % 8 <> 4 AS is_test FROM part""")
def test_paths(spark, sf_dir):
    shapes = ["src/Tests/a.rs", "a/b_test.go", "conftest.py", "x/test_y.py", "x/test_y.rs", "x/y_spec.rb", "x/YTests.java", "x/YTests.rs"]
    part = B.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("path"))
    return part.select("p_partkey", paths.is_test_path(F.col("path")).alias("is_test"))


# --- health -----------------------------------------------------------------------------------------------------------


@query("raw_metrics_project", f"""WITH {O.stats()}, {O.pooled_v1('')} SELECT file_count, code_lines, round(complexity, 6) AS complexity, round(func_size, 6) AS func_size, round(comment_ratio, 6) AS comment_ratio, round(file_size, 6) AS file_size, nesting_depth, round(duplication, 6) AS duplication FROM pooled""")
def raw_metrics_project(spark, sf_dir):
    return health.pooled_metrics(B.file_stats(spark, sf_dir), [])


@query("health_v1_files", f"WITH {O.stats()}, {O.scored_v1()} SELECT path, round(score, 6) AS score, {O.grade('score')} AS grade, top_issue FROM fs_v")
def health_v1_files(spark, sf_dir):
    return health.health_v1(B.file_stats(spark, sf_dir))["files"].select("path", "score", "grade", "top_issue")


@query("health_v1_worst", f"WITH {O.stats()}, {O.scored_v1(duplication=False)} SELECT path, round(score, 6) AS score FROM fs_v ORDER BY fs_v.score, string_split(path, '/') LIMIT 10")
def health_v1_worst(spark, sf_dir):
    return health.health_v1(B.file_stats(spark, sf_dir), duplication=False, top=10)["files"].select("path", "score")


@query("health_v1_dirs", f"WITH {O.stats()}, {O.pooled_v1('dir')} SELECT dir AS directory, round(score, 6) AS score, {O.grade('score')} AS grade, file_count FROM pooled")
def health_v1_dirs(spark, sf_dir):
    return health.health_v1(B.file_stats(spark, sf_dir))["directories"].select("directory", "score", "grade", "file_count")


@query("health_v1_languages", f"WITH {O.stats()}, {O.pooled_v1('language')} SELECT language, round(score, 6) AS score, {O.grade('score')} AS grade, file_count, code_lines FROM pooled")
def health_v1_languages(spark, sf_dir):
    return health.health_v1(B.file_stats(spark, sf_dir))["languages"].select("language", "score", "grade", "file_count", "code_lines")


@query("health_v1_project", f"WITH {O.stats()}, {O.pooled_v1('')} SELECT round(score, 6) AS score, {O.grade('score')} AS grade, file_count, code_lines, 'default' AS model, 'legacy-all' AS scope FROM pooled")
def health_v1_project(spark, sf_dir):
    return health.health_v1(B.file_stats(spark, sf_dir))["project"].select("score", "grade", "file_count", "code_lines", "model", "scope")


@query("health_v2_files", f"WITH {O.stats()}, {O.scored_v2()} SELECT path, round(score, 6) AS score, {O.grade('score')} AS grade, top_issue, round(coverage, 6) AS coverage FROM fs_v")
def health_v2_files(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["files"].select("path", "score", "grade", "top_issue", "coverage")


@query("health_v2_dirs", f"""WITH {O.stats()}, {O.scored_v2()}, up AS (SELECT *, unnest(['.', brand, dir]) AS directory FROM fs_v), {O.group_v2('directory', 'up')} SELECT directory, round(score, 6) AS score, {O.grade('score')} AS grade, file_count FROM grp""")
def health_v2_dirs(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["directories"].select("directory", "score", "grade", "file_count")


@query("health_v2_languages", f"WITH {O.stats()}, {O.scored_v2()}, {O.group_v2('language')} SELECT {O.group_columns('language')} FROM grp")
def health_v2_languages(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["languages"]


@query("health_v2_project", f"WITH {O.stats()}, {O.scored_v2()}, {O.group_v2('')} SELECT {O.group_columns()}, 'default-v2' AS model, 'production' AS scope FROM grp")
def health_v2_project(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["project"]


@query("health_v2_tests", f"WITH {O.stats()}, {O.scored_v2(tests=True)}, {O.group_v2('')} SELECT {O.group_columns()} FROM grp")
def health_v2_tests(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["tests"]


_V2 = scores.Model(2).weights
_DIMS = " UNION ALL ".join(f"SELECT '{d}' AS dimension, sum(s_{d} * w) / sum(w) FILTER (s_{d} IS NOT NULL) AS score, sum(CASE WHEN s_{d} IS NOT NULL THEN {x} / held * w END) / sum(w) FILTER (s_{d} IS NOT NULL) AS share FROM fs_v" for d, x in _V2.items())


@query("health_v2_dimensions", f"WITH {O.stats()}, {O.scored_v2()}, d AS ({_DIMS}) SELECT dimension, round(score, 6) AS score, round(share / sum(share) OVER (), 6) AS weight, {O.grade('score')} AS grade FROM d")
def health_v2_dimensions(spark, sf_dir):
    return health.health_v2(B.file_stats(spark, sf_dir))["dimensions"]


@query("tail_risk_by_lang", f"WITH {O.stats()}, {O.scored_v2()}, {O.tail('language', 'fs_v')} SELECT language, round(tail_score, 6) AS tail_score FROM tail")
def tail_risk_by_lang(spark, sf_dir):
    production = health.with_regions(B.file_stats(spark, sf_dir), None).where("region = 'production'")
    return health.tail(health.score_files_v2(production, scores.Model(2)), ["language"])


# --- comparisons ------------------------------------------------------------------------------------------------------

_BOTH = f"{O.stats()}, {O.stats('old', BASELINE)}, {O.scored_v2()}, {O.scored_v2('old')}"
_MOVED = f"""f AS (SELECT n.path, o.path IS NULL AS is_new, coalesce(o.score, 100.0) AS from_score, CASE WHEN o.path IS NULL THEN 'A' ELSE {O.grade('o.score')} END AS from_grade, n.score AS to_score, {O.grade('n.score')} AS to_grade FROM fs_v n LEFT JOIN old_v o USING (path)),
g AS (SELECT *, CASE WHEN is_new AND to_grade = 'F' THEN 'regressed' WHEN is_new THEN 'new' WHEN to_grade > from_grade OR from_score - to_score >= 5 - 1e-9 THEN 'regressed' WHEN to_grade < from_grade OR to_score - from_score >= 5 - 1e-9 THEN 'improved' ELSE 'unchanged' END AS status FROM f)"""


def _two(spark, sf_dir):
    return B.file_stats(spark, sf_dir, BASELINE), B.file_stats(spark, sf_dir)


@query("health_regression_files", f"WITH {_BOTH}, {_MOVED} SELECT path, is_new, round(from_score, 6) AS from_score, from_grade, round(to_score, 6) AS to_score, to_grade FROM g WHERE status = 'regressed'")
def health_regression_files(spark, sf_dir):
    return regression.compare(*_two(spark, sf_dir))["regressed"]


@query("health_regression_counts", f"WITH {_BOTH}, {_MOVED} SELECT count(*) FILTER (status = 'regressed') AS regressed_files, count(*) FILTER (status = 'improved') AS improved_files FROM g")
def health_regression_counts(spark, sf_dir):
    return regression.compare(*_two(spark, sf_dir))["project"].select("regressed_files", "improved_files")


@query("health_regression_lang", f"""WITH {_BOTH}, {O.group_v2('language', 'fs_v', 'gn')}, {O.group_v2('language', 'old_v', 'go')} SELECT language, CASE WHEN o.language IS NULL THEN 'added' WHEN n.language IS NULL THEN 'removed' WHEN {O.grade('o.score')} <> {O.grade('n.score')} OR abs(n.score - o.score) >= 0.05 THEN 'changed' ELSE 'unchanged' END AS status,
  round(o.score, 6) AS from_score, {O.grade('o.score')} AS from_grade, round(n.score, 6) AS to_score, {O.grade('n.score')} AS to_grade, round(n.score - o.score, 6) AS score_delta FROM gn n FULL JOIN go o USING (language)""")  # fmt: skip
def health_regression_lang(spark, sf_dir):
    return regression.compare(*_two(spark, sf_dir))["languages"]


_SUMS = "SELECT count(*) AS files, sum(total) AS lines, sum(code) AS code, sum(comment) AS comment, sum(blank) AS blank, sum(cyclomatic) AS complexity, sum(functions) AS functions FROM"


@query("trend_delta", f"""WITH {O.stats()}, {O.stats('old', BASELINE)}, b AS (UNPIVOT ({_SUMS} old) ON COLUMNS(*) INTO NAME metric VALUE v), a AS (UNPIVOT ({_SUMS} fs) ON COLUMNS(*) INTO NAME metric VALUE v)
SELECT metric, CAST(b.v AS BIGINT) AS before, CAST(a.v AS BIGINT) AS after, CAST(greatest(a.v - b.v, 0) AS BIGINT) AS delta, CAST(a.v - b.v AS BIGINT) AS signed, round(CASE WHEN b.v <> 0 THEN (a.v - b.v) / b.v * 100 WHEN a.v > 0 THEN 100 ELSE 0 END, 6) AS percent FROM b JOIN a USING (metric)""")  # fmt: skip
def trend_delta(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    return trend.deltas(aggregate.summary(before), aggregate.summary(after))


@query("lang_trend_full_outer", f"""WITH {O.stats()}, {O.stats('old', BASELINE)}, b AS (SELECT language, count(*) AS f, sum(code) AS c FROM old WHERE language <> 'Go' GROUP BY 1), a AS (SELECT language, count(*) AS f, sum(code) AS c FROM fs WHERE language <> 'Rust' GROUP BY 1)
SELECT language, CASE WHEN b.f IS NULL THEN 'added' WHEN a.f IS NULL THEN 'removed' ELSE 'changed' END AS status, CAST(coalesce(a.f, 0) - coalesce(b.f, 0) AS BIGINT) AS files, CAST(coalesce(a.c, 0) - coalesce(b.c, 0) AS BIGINT) AS code FROM b FULL JOIN a USING (language)""")  # fmt: skip
def lang_trend_full_outer(spark, sf_dir):
    before, after = _two(spark, sf_dir)
    rows = trend.language_trend(before.where("language <> 'Go'"), after.where("language <> 'Rust'"))
    return rows.select("language", "status", F.col("files.signed").alias("files"), F.col("code.signed").alias("code"))


# --- history ----------------------------------------------------------------------------------------------------------


@query("churn_by_path", f"WITH {O.LOG_A}, {O.ONCE}, {O.CHURN} SELECT * FROM churn")
def churn_by_path(spark, sf_dir):
    return history.churn(B.log_a(spark, sf_dir))


@query("churn_since", f"WITH {O.LOG_B}, {O.ONCE.replace('FROM log', 'FROM log WHERE ts >= ' + str(NOW - 14 * 86400))}, {O.CHURN} SELECT * FROM churn")
def churn_since(spark, sf_dir):
    return history.churn(history.since(B.log_b(spark, sf_dir), F.lit(NOW - 14 * 86400)))


@query("ownership_by_path", f"WITH {O.LOG_B}, {O.ONCE}, {O.OWNERS} SELECT path, authors, main_author, round(ownership, 6) AS ownership FROM owners")
def ownership_by_path(spark, sf_dir):
    return history.ownership(B.log_b(spark, sf_dir))


@query("hotspot_top", f"WITH {O.LOG_A}, {O.ONCE}, {O.CHURN}, {O.TREE} SELECT path, commits, lines_added, lines_deleted, last_commit_ts, language, cyclomatic, lines_churn, round(score, 6) AS score, risk FROM risky ORDER BY risky.score DESC, commits DESC, string_split(path, '/') LIMIT 20")
def hotspot_top(spark, sf_dir):
    return history.hotspots(history.churn(B.log_a(spark, sf_dir)), B.tree_stats(spark, sf_dir))


@query("hotspot_islands", f"WITH {O.LOG_A}, {O.ONCE}, {O.CHURN}, {O.TREE}, {O.OWNERS} SELECT path, risk, authors, main_author, round(ownership, 6) AS ownership, risk <> 'LOW' AND ownership >= 0.75 AS knowledge_island FROM risky LEFT JOIN owners USING (path)")
def hotspot_islands(spark, sf_dir):
    log = B.log_a(spark, sf_dir)
    spots = history.with_knowledge(history.hotspots(history.churn(log), B.tree_stats(spark, sf_dir), top=None), history.ownership(log))
    return spots.select("path", "risk", "authors", "main_author", "ownership", "knowledge_island")


@query("file_age_days", f"WITH {O.LOG_B} SELECT path, greatest({NOW} - min(ts), 0) // 86400 AS age_days FROM log GROUP BY 1")
def file_age_days(spark, sf_dir):
    first = history.first_commits(B.log_b(spark, sf_dir))
    return history.with_ages(first.select("path"), first, F.lit(NOW)).select("path", "age_days")


_PAIRS = """once AS (SELECT DISTINCT commit, path FROM log), sizes AS (SELECT commit, count(*) AS n FROM once GROUP BY 1), per AS (SELECT path, count(*) AS n FROM once GROUP BY 1), small AS (SELECT once.* FROM once JOIN sizes USING (commit) WHERE n <= 6),
p AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS shared_commits FROM small a JOIN small b ON a.commit = b.commit AND string_split(a.path, '/') < string_split(b.path, '/') GROUP BY 1, 2 HAVING count(*) >= 5),
q AS (SELECT file_a, file_b, shared_commits, x.n AS commits_a, y.n AS commits_b, shared_commits / ((x.n + y.n) / 2.0::DOUBLE) * 100 AS degree FROM p JOIN per x ON x.path = file_a JOIN per y ON y.path = file_b)"""


@query("coupling_pairs", f"WITH {O.LOG_A}, {_PAIRS} SELECT file_a, file_b, shared_commits, commits_a, commits_b, round(degree, 6) AS degree FROM q WHERE degree >= 1.5")
def coupling_pairs(spark, sf_dir):
    return history.coupling(B.log_a(spark, sf_dir), min_degree=1.5, max_changeset=6, top=None)


@query("coupling_top", f"WITH {O.LOG_A}, {_PAIRS} SELECT file_a, file_b, shared_commits, round(degree, 6) AS degree FROM q WHERE degree >= 2 ORDER BY q.degree DESC, shared_commits DESC, string_split(file_a, '/'), string_split(file_b, '/') LIMIT 20")
def coupling_top(spark, sf_dir):
    return history.coupling(B.log_a(spark, sf_dir), min_degree=2.0, max_changeset=6).select("file_a", "file_b", "shared_commits", "degree")


_FOCUS = "Brand#11/PROMO"


@query("coupling_focus", f"WITH {O.LOG_A}, {_PAIRS} SELECT file_a, file_b, shared_commits, round(degree, 6) AS degree FROM q WHERE degree >= 1 AND '{_FOCUS}' IN (file_a, file_b)")
def coupling_focus(spark, sf_dir):
    return history.coupling(B.log_a(spark, sf_dir), min_degree=1.0, max_changeset=6, focus=_FOCUS, top=None).select("file_a", "file_b", "shared_commits", "degree")


@query("coupling_bulk_skipped", f"WITH {O.LOG_A}, s AS (SELECT commit, count(DISTINCT path) AS n FROM log GROUP BY 1) SELECT count(*) AS total_commits, count(*) FILTER (n > 6) AS skipped_large_commits FROM s")
def coupling_bulk_skipped(spark, sf_dir):
    log = B.log_a(spark, sf_dir)
    return history.coupling_totals(log, log.select("commit").distinct(), 6)


@query("function_touches", """WITH s AS (SELECT p_brand AS path, 'fn_' || p_partkey AS name, p_partkey AS start_line, p_partkey + p_size AS end_line FROM part),
h AS (SELECT p_brand AS path, l_orderkey AS commit, greatest(l_partkey - l_linenumber, 1) AS start, CAST(l_quantity AS BIGINT) AS len FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT path, name, start_line, end_line, count(DISTINCT commit) AS commits FROM s LEFT JOIN h USING (path) WHERE h.commit IS NULL OR (start <= end_line AND start + greatest(len - 1, 0) >= start_line) GROUP BY 1, 2, 3, 4""")  # fmt: skip
def function_touches(spark, sf_dir):
    part, items = B.table(spark, sf_dir, "part"), B.table(spark, sf_dir, "lineitem")
    spans = part.select(F.col("p_brand").alias("path"), F.concat(F.lit("fn_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"))
    hunks = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("path"), F.col("l_orderkey").alias("commit"), F.greatest(F.col("l_partkey") - F.col("l_linenumber"), F.lit(1)).alias("start"), F.col("l_quantity").cast("long").alias("len"))
    return history.function_touches(spans, hunks)


# --- estimates --------------------------------------------------------------------------------------------------------

_E = 0.91 + 0.01 * sum(estimate.COCOMO_2_SCALE)
_FX = 0.28 + 0.2 * (_E - 0.91)
_WAGE = "* (56286.0::DOUBLE / 12) * 2.4"
_YEARS = "pow(c / (8000.0::DOUBLE * pow(15.0::DOUBLE, 1.0::DOUBLE / 3)), 3.0::DOUBLE / 7)"
_ROOT = "sqrt(cc / c::DOUBLE)"
_MODELS = f"""m AS (SELECT 'COCOMO Basic' AS model, c, 2.4 * pow(c / 1000.0::DOUBLE, 1.05) AS e, 2.5 * pow(2.4 * pow(c / 1000.0::DOUBLE, 1.05), 0.38) AS s, 2.4 * pow(c / 1000.0::DOUBLE, 1.05) {_WAGE} AS cost FROM t
UNION ALL SELECT 'COCOMO II', c, 2.94 * pow(c / 1000.0::DOUBLE, {_E!r}), 3.67 * pow(2.94 * pow(c / 1000.0::DOUBLE, {_E!r}), {_FX!r}), 2.94 * pow(c / 1000.0::DOUBLE, {_E!r}) {_WAGE} FROM t
UNION ALL SELECT 'Putnam (SLIM)', c, 15.0 * pow({_YEARS}, 3) * 12, {_YEARS} * 12, 15.0 * pow({_YEARS}, 3) * 12 {_WAGE} FROM t
UNION ALL SELECT 'LOCOMO', c, c * 0.1::DOUBLE / 60 / 160, c * 10 * (1.5 + {_ROOT} * 2) / 50 / (730 * 3600), c * 20 * (1 + {_ROOT} * 5) * (1.5 + {_ROOT} * 2) / 1e6 * 3 + c * 10 * (1.5 + {_ROOT} * 2) / 1e6 * 15 FROM t)"""


@query("estimate_all_models", f"""WITH {O.stats()}, t AS (SELECT CAST(sum(code) AS BIGINT) AS c, CAST(sum(cyclomatic) AS BIGINT) AS cc FROM fs), {_MODELS}
SELECT model, c AS code_lines, round(e, 6) AS effort_months, round(s, 6) AS schedule_months, round(e / s, 6) AS people, round(cost, 4) AS cost FROM m""")  # fmt: skip
def estimate_all_models(spark, sf_dir):
    rows = estimate.estimate_all(aggregate.summary(B.file_stats(spark, sf_dir)))
    return rows.withColumn("cost", F.round("cost", 4))


@query("estimate_by_lang", f"""WITH {O.stats()}, t AS (SELECT language, CAST(sum(code) AS BIGINT) AS c FROM fs GROUP BY 1)
SELECT language, c AS code_lines, round(2.4 * pow(c / 1000.0::DOUBLE, 1.05), 6) AS effort_months, round(2.4 * pow(c / 1000.0::DOUBLE, 1.05) {_WAGE}, 4) AS cost FROM t WHERE c > 0""")  # fmt: skip
def estimate_by_lang(spark, sf_dir):
    rows = estimate.estimate_by_language(aggregate.by_language(B.file_stats(spark, sf_dir)))
    return rows.select("language", "code_lines", "effort_months", F.round("cost", 4).alias("cost"))


# --- paths, languages, kernel -----------------------------------------------------------------------------------------


@query("path_glob_filter", f"WITH {O.CORPUS} SELECT path FROM corpus WHERE NOT regexp_matches(path, '(^|/)src1[0-9]/') AND NOT regexp_matches(path, '_[0-9]*7[.]md$') AND NOT contains(path, '/de/')")
def path_glob_filter(spark, sf_dir):
    rules = filters.PathRules.parse(excludes="*_*7.md,src1?/**", exclude_dirs="^de$")
    return B.corpus(spark, sf_dir).where(rules.keeps(F.col("path"))).select("path")


@query("path_include_filter", f"WITH {O.CORPUS} SELECT path FROM corpus WHERE regexp_matches(path, '/doc_1[0-9]*[.]md$') OR regexp_matches(path, '^src5/.*3[.]md$')")
def path_include_filter(spark, sf_dir):
    rules = filters.PathRules.parse(includes="doc_1*.md", include_files="^src5/.*3[.]md$")
    return B.corpus(spark, sf_dir).where(rules.keeps(F.col("path"))).select("path")


@query("smart_exclude", """WITH p AS (SELECT p_partkey, ['src/a.rs', 'target/a.rs', 'x/node_modules/y.js', 'pkg.egg-info/z.py', 'a/targets/b.rs', 'deep/.git/config'][p_partkey % 6 + 1] AS path FROM part) SELECT p_partkey, path FROM p WHERE p_partkey % 6 IN (0, 4)""")
def smart_exclude(spark, sf_dir):
    shapes = ["src/a.rs", "target/a.rs", "x/node_modules/y.js", "pkg.egg-info/z.py", "a/targets/b.rs", "deep/.git/config"]
    part = B.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("path"))
    return part.where(filters.PathRules().keeps(F.col("path")))


@query("language_detect", """SELECT p_partkey, ['Rust', 'Objective-C', 'Makefile', 'R', NULL, 'CMake', 'C', NULL][p_partkey % 8 + 1] AS language FROM part""")
def language_detect(spark, sf_dir):
    names = ["a/b.RS", "x.m", "sub/Makefile", "y.R", "z.unknown", "CMakeLists.txt", "h.h", "README"]
    part = B.table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("path"))
    return analyze.detect_languages(part).select("p_partkey", "language")


@query("kernel_line_stats", f"WITH {O.CORPUS}, {_LINE_COUNTS} SELECT path, language, total, total - blank AS code, CAST(0 AS BIGINT) AS comment, blank, size, false AS functions_measured FROM m")
def kernel_line_stats(spark, sf_dir):
    """The kernel on texts without code: the same numbers as built-in expressions give."""
    found = analyze.analyze(B.corpus(spark, sf_dir), options=analyze.Options(duplication=False)).file_stats
    return found.select("path", "language", "lines.*", "size", "complexity.functions_measured")


@query("complexity_pages")
def complexity_pages(spark, sf_dir):
    """Line classes and metrics of HTML pages by the kernel; markup has comments but no functions."""
    found = analyze.analyze(B.pages(spark, sf_dir), options=analyze.Options(duplication=False)).file_stats
    return found.select("path", "language", "lines.*", "size", "complexity.*")


_RUST = "fn work_{k}(x: i32) -> i32 {{\n    if x > {k} && x < 9 {{ x }} else {{ 0 }}\n}}\n// note {k}\n\n#[cfg(test)]\nmod tests {{\n    #[test]\n    fn works() {{\n        assert_eq!(1, 1);\n    }}\n}}\n"


@query("inline_test_regions", """SELECT 'src/f' || p_partkey || '.rs' AS path, r AS region, CASE r WHEN 'production' THEN 5 ELSE 7 END AS total, CASE r WHEN 'production' THEN 3 ELSE 7 END AS code, CASE r WHEN 'production' THEN 1 ELSE 0 END AS comment, CAST(1 AS BIGINT) AS functions,
  CASE r WHEN 'production' THEN 4 ELSE 1 END AS cyclomatic FROM part, (VALUES ('production'), ('tests')) v(r)""")  # fmt: skip
def inline_test_regions(spark, sf_dir):
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"))
    content = F.replace(F.lit(_RUST.replace("{k}", "\x01").replace("{{", "{").replace("}}", "}")), F.lit("\x01"), F.col("k"))
    rows = part.select(F.concat(F.lit("src/f"), "k", F.lit(".rs")).alias("path"), content.alias("content"))
    found = analyze.analyze(rows, options=analyze.Options(duplication=False)).regions
    return found.select("path", "region", F.col("lines.total").cast("int").alias("total"), F.col("lines.code").cast("int").alias("code"), F.col("lines.comment").cast("int").alias("comment"), "complexity.functions", F.col("complexity.cyclomatic").cast("int").alias("cyclomatic"))


@query("streaming_churn", f"WITH {O.LOG_B} SELECT path, CAST(to_timestamp(ts // 86400 * 86400) AS TIMESTAMP) AS day, count(*) AS commits, CAST(sum(added) AS BIGINT) AS lines_added FROM log GROUP BY 1, 2")
def streaming_churn(spark, sf_dir):
    """An extension: churn by day, the same expression on a table and on a stream with a watermark."""
    from tallystone.streaming.churn import daily_churn

    return daily_churn(B.log_b(spark, sf_dir)).select("path", F.col("day").cast("timestamp_ntz").alias("day"), "commits", "lines_added")


from tallystone.plans import code_catalog  # noqa: E402, F401  (registers its queries here)
