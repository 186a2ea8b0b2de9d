"""DuckDB SQL for the catalogue's queries, built from the same constants as the queries but not from their plans."""

from __future__ import annotations

from tallystone.functions import scores

SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"

CORPUS = """corpus AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.md' AS path, 'Markdown' AS language, lang, coalesce(text, '') AS content FROM documents)"""

LOG_A = """log AS (SELECT o_orderkey AS commit, CAST(o_custkey AS VARCHAR) AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, p_brand || '/' || p_type AS path,
  CAST(l_quantity AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

LOG_B = """log AS (SELECT event_id AS commit, CAST(user_id AS VARCHAR) AS author, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type || '/' || json_extract_string(props, '$.k') AS path,
  CAST(floor(value) AS BIGINT) AS added, CAST(0 AS BIGINT) AS deleted FROM events)"""

ONCE = """once AS (SELECT commit, path, min(author) AS author, max(ts) AS ts, sum(added) AS added, sum(deleted) AS deleted FROM log GROUP BY 1, 2)"""

CHURN = """churn AS (SELECT path, count(*) AS commits, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted, greatest(max(ts), 0) AS last_commit_ts FROM once GROUP BY 1)"""

OWNERS = """points AS (SELECT path, author, sum(added + 1) AS points FROM once GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY points DESC, author) AS k, sum(points) OVER (PARTITION BY path) AS total, count(*) OVER (PARTITION BY path) AS authors FROM points),
owners AS (SELECT path, authors, author AS main_author, points / total AS ownership FROM ranked WHERE k = 1)"""

TREE = """tree AS (SELECT p_brand || '/' || p_type AS path, CAST(max(p_size) AS BIGINT) AS cyclomatic FROM part GROUP BY 1),
spots AS (SELECT path, 'Rust' AS language, commits, lines_added, lines_deleted, lines_added + lines_deleted AS lines_churn, last_commit_ts, cyclomatic,
  sqrt((1 - pow(2.0, -commits / 10.0)) * (1 - pow(2.0, -cyclomatic / 15.0))) AS score FROM churn JOIN tree USING (path)),
risky AS (SELECT *, CASE WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MED' ELSE 'LOW' END AS risk FROM spots)"""

LINES = f"""lines AS (SELECT path, line FROM (SELECT path, trim(unnest(string_split(content, chr(10))), {SPACE}) AS line FROM corpus) WHERE line <> '')"""


def curve(x: str, points) -> str:
    out = [f"WHEN {x} <= {float(points[0][0])} THEN {float(points[0][1])}"]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out.append(f"WHEN {x} <= {float(x1)}::DOUBLE THEN {float(y0)} + ({x} - {float(x0)}::DOUBLE) / {float(x1 - x0)!r}::DOUBLE * {float(y1 - y0)}")
    return f"CAST(CASE {' '.join(out)} ELSE {float(points[-1][1])} END AS DOUBLE)"


def grade(s: str) -> str:
    return f"CASE WHEN {s} + 1e-9 >= 90 THEN 'A' WHEN {s} + 1e-9 >= 80 THEN 'B' WHEN {s} + 1e-9 >= 70 THEN 'C' WHEN {s} + 1e-9 >= 60 THEN 'D' ELSE 'F' END"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END)"


def stats(name: str = "fs", shipped_before: str | None = None) -> str:
    where = f"WHERE l_shipdate < TIMESTAMP '{shipped_before}'" if shipped_before else ""
    return f"""{name}_l AS (SELECT l_partkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, CAST(sum(l_linenumber) AS BIGINT) AS comment, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem {where} GROUP BY 1),
{name} AS (SELECT p_brand || '/' || p_type || '/' || p_partkey || CASE WHEN p_partkey % 11 = 0 THEN '_test.rs' ELSE '.rs' END AS path, ['Rust', 'Go', 'Python', 'Markdown'][p_size % 4 + 1] AS language,
  total, greatest(total - n - comment, 0) AS code, comment, n AS blank, 20 * r AS dup, 30 * greatest(total - n - comment, 0) AS size, CAST(p_size // 5 AS BIGINT) AS functions, CAST(p_size + n AS BIGINT) AS cyclomatic, CAST(p_size % 9 AS BIGINT) AS depth,
  p_partkey % 97 * 1.5 AS avg_lines, p_partkey % 11 = 0 AS is_test, p_brand || '/' || p_type AS dir, p_brand AS brand FROM part JOIN {name}_l ON p_partkey = l_partkey)"""


def _weighted(model, names) -> tuple[str, float]:
    return " + ".join(f"s_{d} * {w}" for d, w in names), sum(w for _, w in names)


def scored_v1(fs: str = "fs", duplication: bool = True) -> str:
    m = scores.Model(1, duplication)
    x = {"complexity": ratio("cyclomatic", "functions"), "func_size": "CAST(avg_lines AS DOUBLE)", "comment_ratio": ratio("comment", "code"), "file_size": "CAST(total AS DOUBLE)", "nesting_depth": "CAST(depth AS DOUBLE)", "duplication": ratio("dup", "greatest(total - blank, 0)")}
    total = sum(m.weights.values())
    each = ", ".join(f"{curve(x[d], m.curves[d])} AS s_{d}" for d in m.weights)
    score = f"least(greatest(({' + '.join(f's_{d} * {w / total!r}::DOUBLE' for d, w in m.weights.items())}) / ({' + '.join(f'{w / total!r}::DOUBLE' for w in m.weights.values())}), 0), 100)"
    low = f"least({', '.join(f's_{d}' for d in m.weights)})"
    top = "CASE " + " ".join(f"WHEN s_{d} = {low} THEN '{d}'" for d in m.weights) + " END"
    return f"{fs}_s AS (SELECT *, {each} FROM {fs}), {fs}_v AS (SELECT *, {score} AS score, {top} AS top_issue, sqrt(greatest(code, 1)) AS w FROM {fs}_s)"


def pooled_v1(keys: str, fs: str = "fs", name: str = "pooled", duplication: bool = True) -> str:
    m = scores.Model(1, duplication)
    by = f"GROUP BY {keys}" if keys else ""
    own = f"{keys}, " if keys else ""
    x = {d: d for d in m.weights}
    each = ", ".join(f"{curve(x[d], m.curves[d])} AS s_{d}" for d in m.weights)
    total = sum(m.weights.values())
    score = f"least(greatest(({' + '.join(f's_{d} * {w / total!r}::DOUBLE' for d, w in m.weights.items())}) / ({' + '.join(f'{w / total!r}::DOUBLE' for w in m.weights.values())}), 0), 100)"
    return f"""{name}_m AS (SELECT {own}count(*) AS file_count, CAST(sum(code) AS BIGINT) AS code_lines, {ratio('sum(cyclomatic)', 'sum(functions)')} AS complexity, {ratio('sum(CASE WHEN functions > 0 THEN avg_lines * functions ELSE 0 END)', 'sum(functions)')} AS func_size,
  {ratio('sum(comment)', 'sum(code)')} AS comment_ratio, CAST(sum(total) AS DOUBLE) / count(*) AS file_size, list_sort(list(depth))[CAST(ceil((count(*) - 1) * 0.9::DOUBLE) AS BIGINT) + 1] AS nesting_depth, {ratio('sum(dup)', 'greatest(sum(total) - sum(blank), 0)')} AS duplication FROM {fs} {by}),
{name}_s AS (SELECT *, {each} FROM {name}_m), {name} AS (SELECT *, {score} AS score FROM {name}_s)"""


def scored_v2(fs: str = "fs", duplication: bool = True, tests: bool = False) -> str:
    m = scores.Model(2, duplication)
    x = {"complexity": "(1.0 + CAST(greatest(cyclomatic - functions, 0) AS DOUBLE) / greatest(functions, CAST(ceil(code / 50.0::DOUBLE) AS BIGINT), 1))", "func_size": "CAST(avg_lines AS DOUBLE)", "comment_ratio": ratio("comment", "code"), "file_size": "CAST(total AS DOUBLE)", "nesting_depth": "CAST(depth AS DOUBLE)", "duplication": ratio("dup", "greatest(total - blank, 0)")}
    has = {"func_size": "functions > 0"}
    each = ", ".join(f"CASE WHEN {has.get(d, 'true')} THEN {curve(x[d], m.curves[d])} END AS s_{d}" for d in m.weights)
    add = " + ".join(f"coalesce(s_{d} * {w}::DOUBLE, 0)" for d, w in m.weights.items())
    held = " + ".join(f"CASE WHEN s_{d} IS NULL THEN 0 ELSE {w}::DOUBLE END" for d, w in m.weights.items())
    gain = {d: f"((100.0::DOUBLE - s_{d}) * {w}::DOUBLE)" for d, w in m.weights.items()}
    top = "CASE " + " ".join(f"WHEN {gain[d]} = greatest({', '.join(gain.values())}) THEN '{d}'" for d in reversed(m.weights)) + " END"
    return f"""{fs}_s AS (SELECT *, {each} FROM {fs} WHERE language <> 'Markdown' AND {'' if tests else 'NOT '}is_test),
{fs}_v AS (SELECT *, ({add}) / ({held}) AS score, ({held}) / {sum(m.weights.values())!r}::DOUBLE AS coverage, {held} AS held, {top} AS top_issue, sqrt(greatest(code, 1)) AS w FROM {fs}_s)"""


def tail(keys: str, rows: str, name: str = "tail") -> str:
    own, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    by = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_w AS (SELECT {own}score, w, sum(w) OVER ({part}) * 0.1::DOUBLE AS lim, coalesce(sum(w) OVER ({part} ORDER BY score, string_split(path, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {rows}),
{name} AS (SELECT {own}sum(score * greatest(0, least(w, lim - before))) / max(lim) AS tail_score FROM {name}_w {by})"""


def group_v2(keys: str, rows: str = "fs_v", name: str = "grp") -> str:
    own = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    join = f"JOIN {name}_tail USING ({keys})" if keys else f"CROSS JOIN {name}_tail"
    return f"""{tail(keys, rows, name + '_tail')},
{name}_c AS (SELECT {own}count(*) AS file_count, CAST(sum(code) AS BIGINT) AS code_lines, sum(score * w) / sum(w) AS center, least(greatest(sum(coverage * w) / sum(w), 0), 1) AS coverage,
  count(*) FILTER (score < 60) AS failing_files, count(*) FILTER (score < 60) / count(*) AS failing_ratio, min(score) AS worst_score FROM {rows} {by}),
{name} AS (SELECT *, 0.9::DOUBLE * center + 0.1::DOUBLE * tail_score AS score FROM {name}_c {join})"""


def group_columns(keys: str = "") -> str:
    own = f"{keys}, " if keys else ""
    return f"""{own}round(score, 6) AS score, {grade('score')} AS grade, file_count, code_lines, round(coverage, 6) AS coverage,
  CASE WHEN coverage >= 0.8 THEN 'high' WHEN coverage >= 0.6 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN coverage < 0.6 THEN 'insufficient-data' ELSE 'scored' END AS assessment,
  round(tail_score, 6) AS tail_score, failing_files, round(failing_ratio, 6) AS failing_ratio, round(worst_score, 6) AS worst_score"""
