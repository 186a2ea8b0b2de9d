"""Renderers: each takes a Report and gives a text."""

from __future__ import annotations

import html as H
import json
import re
from datetime import date, datetime

from tallystone import __version__
from tallystone.functions.formats import csv_field, metric_label, py_bytes, py_money, py_number, py_tokens
from tallystone.sinks.report import DIMENSION_NAMES, Report

_f = lambda digits: lambda x: "" if x is None else f"{x:.{digits}f}"
_dimension = lambda d: DIMENSION_NAMES.get(d, d)
_flat = lambda x: "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)

# Columns of the tables as (title, key, format).
LANGUAGES = [("Language", "language", _flat), ("Files", "files", _flat), ("Code", "code", _flat), ("Comment", "comment", _flat), ("Blank", "blank", _flat), ("Total", "total", _flat), ("Size", "size", _flat)]
FILES = [("File", "path", _flat), ("Language", "language", _flat), ("Code", "code", _flat), ("Comment", "comment", _flat), ("Blank", "blank", _flat), ("Total", "total", _flat), ("Size", "size", _flat)]
DIRECTORIES = [("Directory", "directory", _flat), ("Depth", "depth", _flat), ("Files", "files", _flat), ("Code", "code", _flat), ("Comment", "comment", _flat), ("Blank", "blank", _flat), ("Total", "total", _flat), ("Size", "size", _flat), ("CC", "cyclomatic", _flat)]
HEALTH = [("File", "path", _flat), ("Score", "score", _f(1)), ("Grade", "grade", _flat), ("TopIssue", "top_issue", _dimension)]
HOTSPOTS = [
    ("File", "path", _flat), ("Commits", "commits", _flat), ("Added", "lines_added", _flat), ("Deleted", "lines_deleted", _flat), ("Churn", "lines_churn", _flat), ("CC", "cyclomatic", _flat), ("AgeDays", "age_days", _flat), ("Authors", "authors", _flat),
    ("MainAuthor", "main_author", _flat), ("Ownership", "ownership", _f(2)), ("KnowledgeIsland", "knowledge_island", _flat), ("Score", "score", _f(2)), ("Risk", "risk", _flat),
]
COUPLING = [("FileA", "file_a", _flat), ("FileB", "file_b", _flat), ("SharedCommits", "shared_commits", _flat), ("CommitsA", "commits_a", _flat), ("CommitsB", "commits_b", _flat), ("Coupling", "degree", _f(1))]
TREND = [("Metric", "metric", _flat), ("Before", "before", _flat), ("After", "after", _flat), ("Delta", "signed", _flat), ("Percent", "percent", _f(1))]
ESTIMATE = [("Language", "language", _flat), ("Code", "code_lines", _flat), ("Effort(PM)", "effort_months", _f(2)), ("Cost", "cost", _f(2))]
COMPARISON = [("Model", "model", _flat), ("SLOC", "code_lines", _flat), ("Effort(PM)", "effort_months", _f(2)), ("Schedule(M)", "schedule_months", _f(2)), ("People", "people", _f(2)), ("Cost", "cost", _f(2))]
METRIC_NAMES = {"files": "Files", "lines": "Lines", "code": "Code", "comment": "Comments", "blank": "Blank", "complexity": "Complexity", "functions": "Functions"}
GRADE_COLORS = {"A": "brightgreen", "B": "green", "C": "yellow", "D": "orange", "F": "red"}


def _flattened(row: dict) -> dict:
    return {**row, **(row["lines"] if isinstance(row.get("lines"), dict) else {})}


def _cells(columns, rows: list[dict]) -> list[list[str]]:
    return [[f(r.get(key)) for _, key, f in columns] for r in map(_flattened, rows)]


def _changes(report: Report) -> list[dict]:
    """Rows (metric, before, after, signed) of a comparison of trees: scores, five counts, regressed files."""
    p = report.one("project")
    score = lambda name, a, b: {"metric": name, "before": f"{a:.1f}", "after": f"{b:.1f}", "signed": f"{b - a:.1f}"}
    rows = [score("HealthScore", p["baseline_score"], p["current_score"])] if p else []
    rows += [{**r, "metric": METRIC_NAMES[r["metric"]]} for r in report.rows("deltas") if r["metric"] in ("files", "code", "comment", "complexity", "functions")]
    return rows + [score(f"Regressed:{r['path']}", r["from_score"], r["to_score"]) for r in report.rows("regressed")]


def main_table(report: Report) -> tuple[list, list[dict]]:
    """The table that stands for a report: columns and rows. A by-directory or by-file table goes before languages."""
    kind = report.kind
    if kind == "combined":
        return main_table(report.part("analysis") or report.parts[0])
    if kind == "analysis":
        if "directories" in report.tables:
            return DIRECTORIES, report.rows("directories")
        return (FILES, report.rows("files")) if "files" in report.tables else (LANGUAGES, report.rows("languages"))
    if kind == "diff":
        return TREND[:4], _changes(report)
    if kind == "trend":
        return TREND, [{**r, "metric": METRIC_NAMES[r["metric"]]} for r in report.rows("deltas")]
    return {"health": (HEALTH, report.rows("files")), "hotspot": (HOTSPOTS, report.rows("files")), "coupling": (COUPLING, report.rows("pairs")), "estimate": (ESTIMATE, report.rows("languages")), "comparison": (COMPARISON, report.rows("models"))}[kind]


def csv(report: Report) -> str:
    columns, rows = main_table(report)
    lines = [",".join(t for t, _, _ in columns), *(",".join(map(csv_field, r)) for r in _cells(columns, rows))]
    return "\n".join(lines) + "\n"


def to_json(report: Report) -> str:
    def plain(x):
        if isinstance(x, (datetime, date)):
            return x.isoformat()
        raise TypeError(type(x))

    def body(r: Report) -> dict:
        return {"kind": r.kind, **r.values, **r.tables, **({"parts": [body(p) for p in r.parts]} if r.parts else {})}

    return json.dumps(body(report), indent=2, ensure_ascii=False, default=plain) + "\n"


def _facts(report: Report) -> list[tuple[str, str]]:
    """Headline facts of a report as (name, value)."""
    kind = report.kind
    if kind == "analysis":
        s, c = report.one("summary"), report.one("counters")
        out = [("Files", py_number(s.get("files", 0))), ("Lines", py_number(s.get("total", 0))), ("Code", py_number(s.get("code", 0))), ("Size", py_bytes(s.get("size", 0))), ("Tokens", py_tokens(s.get("tokens", 0)))]
        for name, window in (("Fits 200K context", 200_000), ("Fits 1M context", 1_000_000)):
            share = s.get("tokens", 0) / window
            out.append((name, f"{'yes' if share <= 1 else 'no'} ({share * 100:.0f}%)"))
        if s.get("test_ratio") is not None:
            out.append(("Test / code", f"{s['test_ratio']:.2f}"))
        if d := report.one("dryness"):
            out += [("ULOC", py_number(d["uloc"])), ("DRYness", f"{d['dryness']:.1f}%")]
        return out + [(k.capitalize(), py_number(v)) for k, v in c.items()]
    if kind == "health":
        p = report.one("project")
        if not p:
            return [("Health", "no files")]
        return [("Score", f"{p['score']:.1f}"), ("Grade", p["grade"]), ("Model", p["model"]), ("Scope", p["scope"]), ("Assessment", p["assessment"]), ("Confidence", f"{p['confidence']} ({p['coverage'] * 100:.0f}%)"), ("Tail score", f"{p['tail_score']:.1f}"), ("Failing files", str(p["failing_files"]))]
    if kind in ("hotspot", "coupling"):
        return [("Since", str(report.values.get("since", "all"))), *((k.replace("_", " ").capitalize(), str(v)) for k, v in report.one("totals").items())]
    if kind == "diff":
        p = report.one("project")
        return [("Health", f"{p['baseline_score']:.1f} ({p['baseline_grade']}) → {p['current_score']:.1f} ({p['current_grade']})"), ("Regressed", str(p["regressed_files"])), ("Improved", str(p["improved_files"])), ("Gate", "fails" if p["gate_failed"] else "passes")] if p else []
    if kind == "estimate":
        e = report.one("total")
        return [("Model", e["model"]), ("Code", py_number(e["code_lines"])), ("Effort", f"{e['effort_months']:.2f} person-months"), ("Schedule", f"{e['schedule_months']:.2f} months"), ("People", f"{e['people']:.2f}"), ("Cost", "$" + py_money(e["cost"]))] if e else []
    return []


def _sections(report: Report) -> list[tuple[str, list[tuple[str, str]], list[tuple[list[str], list[list[str]]]]]]:
    """(title, facts, tables) of a report and its parts."""
    if report.kind == "combined":
        return [s for p in report.parts for s in _sections(p)]
    columns, rows = main_table(report)
    tables = [([t for t, _, _ in columns], _cells(columns, rows))]
    if report.kind == "health":
        tables.insert(0, (["Dimension", "Score", "Grade", "Weight"], [[_dimension(d["dimension"]), f"{d['score']:.1f}", d["grade"], f"{d['weight'] * 100:.0f}%"] for d in report.rows("dimensions")]))
        tables += [([name, "Score", "Grade", "Files"], [[r[key], f"{r['score']:.1f}", r["grade"], str(r["file_count"])] for r in report.rows(table)]) for name, key, table in (("Directory", "directory", "directories"), ("Language", "language", "languages"))]
    if report.kind == "hotspot" and report.rows("functions"):
        tables.append((["Function", "File", "Lines", "Commits", "CC"], [[r["name"], r["path"], f"{r['start_line']}-{r['end_line']}", str(r["commits"]), str(r["cyclomatic"])] for r in report.rows("functions")]))
    if report.kind in ("trend", "diff") and report.rows("languages"):
        tables.append((["Language", "Status"], [[r["language"], r["status"]] for r in report.rows("languages")]))
    return [(report.kind.capitalize(), _facts(report), [t for t in tables if t[1]])]


def console(report: Report, color: bool = False) -> str:
    bold = (lambda s: f"\x1b[1m{s}\x1b[0m") if color else (lambda s: s)
    out = []
    for title, facts, tables in _sections(report):
        out += [bold(title), "=" * len(title)]
        out += [f"{name + ':':<20}{value}" for name, value in facts]
        for head, rows in tables:
            widths = [max(map(len, c)) for c in zip(head, *rows, strict=True)]
            left = [not all(re.fullmatch(r"[-+\d.,%]*", r[i]) for r in rows) for i in range(len(head))]
            line = lambda cells, w=widths, side=left: "  ".join(c.ljust(n) if s else c.rjust(n) for c, n, s in zip(cells, w, side, strict=True)).rstrip()
            out += ["", bold(line(head)), "-" * (sum(widths) + 2 * len(widths) - 2), *map(line, rows)]
        out.append("")
    return "\n".join(out)


def plain(text: str) -> str:
    """A console text without color codes."""
    return re.sub(r"\x1b\[[0-9;]*m", "", text)


def markdown(report: Report) -> str:
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ")
    out = []
    for title, facts, tables in _sections(report):
        out += [f"## {title}", "", *(f"- **{name}**: {cell(value)}" for name, value in facts), ""]
        for head, rows in tables:
            out += ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]
    return "\n".join(out)


def html(report: Report) -> str:
    out = ["<!DOCTYPE html>", '<html lang="en"><head><meta charset="utf-8"><title>Tallystone</title><style>', "body{font-family:sans-serif;margin:2rem}table{border-collapse:collapse;margin:1rem 0}td,th{border:1px solid #ccc;padding:.2rem .6rem;text-align:left}", "</style></head><body>"]
    for title, facts, tables in _sections(report):
        out += [f"<h2>{H.escape(title)}</h2>", "<dl>", *(f"<dt>{H.escape(n)}</dt><dd>{H.escape(v)}</dd>" for n, v in facts), "</dl>"]
        for head, rows in tables:
            out += ["<table><thead><tr>" + "".join(f"<th>{H.escape(h)}</th>" for h in head) + "</tr></thead><tbody>", *("<tr>" + "".join(f"<td>{H.escape(c)}</td>" for c in r) + "</tr>" for r in rows), "</tbody></table>"]
    return "\n".join([*out, "</body></html>", ""])


def openmetrics(report: Report) -> str:
    """Gauges for scrapers. Labels carry the model, scope, language and the like."""
    out: list[str] = []

    def gauge(name: str, *samples: tuple[dict, object]) -> None:
        if samples:
            out.append(f"# TYPE tallystone_{name} gauge")
        for labels, value in samples:
            marks = ",".join(f'{k}="{metric_label(str(v))}"' for k, v in labels.items())
            out.append(f"tallystone_{name}{'{' + marks + '}' if marks else ''} {value}")

    for r in report.parts or [report]:
        if r.kind == "analysis":
            s = r.one("summary")
            gauge("files", ({}, s["files"]))
            gauge("lines", *(({"kind": k}, s[k]) for k in ("code", "comment", "blank", "total")))
            gauge("language_code_lines", *(({"language": x["language"]}, x["code"]) for x in r.rows("languages")))
        elif r.kind == "health" and (p := r.one("project")):
            m = {"model": p["model"]}
            gauge("health_score", (m, p["score"]))
            gauge("health_confidence_ratio", ({**m, "scope": p["scope"]}, p["coverage"]))
            gauge("health_assessment_info", ({**m, "scope": p["scope"], "assessment": p["assessment"]}, 1))
            gauge("health_tail_score", (m, p["tail_score"]))
            gauge("health_failing_files", (m, p["failing_files"]))
            gauge("health_dimension_score", *(({**m, "dimension": _dimension(d["dimension"])}, d["score"]) for d in r.rows("dimensions")))
            named = lambda x: {**m, "language": x["language"]}  # noqa: B023, E731
            gauge("language_health_score", *((named(x), x["score"]) for x in r.rows("languages")))
            gauge("language_health_confidence_ratio", *((named(x), x["coverage"]) for x in r.rows("languages")))
            gauge("language_health_assessment_info", *(({**named(x), "assessment": x["assessment"]}, 1) for x in r.rows("languages")))
            gauge("language_health_files", *((named(x), x["file_count"]) for x in r.rows("languages")))
            if t := r.one("tests"):
                gauge("test_health_score", (m, t["score"]))
                gauge("test_health_assessment_info", ({**m, "assessment": t.get("assessment", "scored")}, 1))
        elif r.kind in ("hotspot", "coupling"):
            gauge("hotspot_files" if r.kind == "hotspot" else "coupling_pairs", ({}, len(main_table(r)[1])))
            gauge(f"{r.kind}_commits", ({}, r.one("totals").get("total_commits", 0)))
        elif r.kind in ("diff", "trend"):
            code = next((d["signed"] for d in r.rows("deltas") if d["metric"] == "code"), 0)
            gauge(f"{r.kind}_code_delta", ({}, code))
            if p := r.one("project"):
                m = {"model": r.values.get("model", "")}
                gauge("diff_health_delta", (m, f"{p['score_delta']:.1f}"))
                gauge("diff_health_assessment_info", ({**m, "assessment": p["assessment"]}, 1))
                gauge("diff_regressed_files", (m, p["regressed_files"]))
        elif r.kind == "estimate" and r.one("total"):
            gauge("estimated_cost_dollars", ({}, r.one("total")["cost"]))
        elif r.kind == "comparison":
            gauge("estimated_cost_dollars", *(({"model": x["model"]}, x["cost"]) for x in r.rows("models")))
    return "\n".join([*out, "# EOF", ""])


def badge(report: Report) -> str:
    """A shields endpoint document."""
    r = report.part("health") or report
    label, message, color = r.kind, "n/a", "blue"
    if r.kind == "health":
        p, label = r.one("project"), "code health"
        if not p or p["assessment"] == "insufficient-data":
            message, color = "insufficient data", "lightgrey"
        else:
            message, color = f"{p['grade']} ({p['score']:.1f})", GRADE_COLORS[p["grade"]]
    elif r.kind == "analysis":
        label, message = "lines of code", py_number(r.one("summary").get("code", 0))
    elif r.kind in ("hotspot", "coupling"):
        n = len(main_table(r)[1])
        label, message, color = "hotspots" if r.kind == "hotspot" else "coupled pairs", str(n), "orange" if n else "brightgreen"
    elif r.kind == "diff":
        p, label = r.one("project"), "health diff"
        if p["assessment"] == "insufficient-data":
            message, color = "insufficient data", "lightgrey"
        else:
            message = f"{p['current_grade']} ({p['current_score']:.1f}) Δ {p['score_delta']:+.1f}"
            color = "red" if p["failed"] else "brightgreen" if p["score_delta"] >= 0 else "yellow"
    elif r.kind == "trend":
        label, message = "code trend", f"{next((d['signed'] for d in r.rows('deltas') if d['metric'] == 'code'), 0):+d} lines"
    elif r.kind in ("estimate", "comparison"):
        rows = r.rows("total") or r.rows("models")
        label, message = "est. cost", f"${rows[0]['cost']:.0f}" if rows else "n/a"
    return json.dumps({"schemaVersion": 1, "label": label, "message": message, "color": color}, ensure_ascii=False) + "\n"


# The rules of the SARIF log.
SARIF_RULES = {
    "health-insufficient-data": "Health score has insufficient measurement coverage", "health-grade": "File health grade is poor", "health-regression": "File health regressed against the baseline",
    "hotspot": "File is a change hotspot (high churn x complexity)", "change-coupling": "Files change together without a structural link",
}


def sarif(report: Report) -> str:
    """A SARIF 2.1.0 log: poor grades, regressions, hotspots and coupled pairs. Locations have no leading './'."""
    results = []

    def add(rule: str, level: str, message: str, *files: str) -> None:
        where = [{"physicalLocation": {"artifactLocation": {"uri": f.removeprefix("./")}}} for f in files]
        results.append({"ruleId": f"tallystone/{rule}", "level": level, "message": {"text": message}, **({"locations": where} if where else {})})

    for r in report.parts or [report]:
        p = r.one("project")
        if r.kind == "health":
            if p and p["assessment"] == "insufficient-data":
                add("health-insufficient-data", "warning", f"Health measurement coverage is {p['coverage'] * 100:.0f}% for model {p['model']}; score {p['score']:.1f} is an estimate")
            for f in r.rows("files"):
                if f["grade"] in ("D", "F"):
                    add("health-grade", "error" if f["grade"] == "F" else "warning", f"Health grade {f['grade']} (score {f['score']:.1f}); top issue: {_dimension(f['top_issue'])}", f["path"])
        if r.rows("regressed") or (r.kind == "diff" and p and p["assessment"] == "insufficient-data"):
            base = r.values.get("baseline", "the baseline")
            if p and p.get("assessment") == "insufficient-data":
                add("health-insufficient-data", "warning", f"Health comparison against {base} has insufficient measurement coverage; the score delta is an estimate")
            for f in r.rows("regressed"):
                told = f"New file fails the health gate against {base}: {f['to_grade']} ({f['to_score']:.1f})" if f["is_new"] else f"Health regressed against {base}: {f['from_grade']} ({f['from_score']:.1f}) → {f['to_grade']} ({f['to_score']:.1f})"
                add("health-regression", "error", told, f["path"])
        if r.kind == "hotspot":
            for f in r.rows("files"):
                if f["risk"] != "LOW":
                    add("hotspot", "warning" if f["risk"] == "HIGH" else "note", f"Change hotspot: {f['commits']} commits in {r.values.get('since', 'all')}, cyclomatic complexity {f['cyclomatic']}, score {f['score']:.2f}", f["path"])
        if r.kind == "coupling":
            for f in r.rows("pairs"):
                add("change-coupling", "note", f"Changes together with {f['file_b']} in {f['degree']:.0f}% of commits ({f['shared_commits']} shared)", f["file_a"])
    rules = [{"id": f"tallystone/{k}", "shortDescription": {"text": v}} for k, v in SARIF_RULES.items()]
    log = {"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": "tallystone", "version": __version__, "rules": rules}}, "results": results}]}
    return json.dumps(log, indent=2, ensure_ascii=False) + "\n"


RENDERERS = {"console": console, "json": to_json, "csv": csv, "markdown": markdown, "html": html, "openmetrics": openmetrics, "badge": badge, "sarif": sarif}


def write(report: Report, style: str = "console", path: str | None = None, quiet: bool = False, color: bool = False) -> str:
    """Renders a report; to a file if a path is given, else to the terminal unless quiet."""
    text = console(report, color and not path) if style == "console" else RENDERERS[style](report)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    elif not quiet:
        print(text, end="")
    return text
