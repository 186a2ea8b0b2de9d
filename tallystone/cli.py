"""The command line: python -m tallystone.cli [analyze|health|hotspot|coupling|diff|trend|estimate|tools|languages] ..."""

from __future__ import annotations

import argparse
import contextlib
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone import __version__
from tallystone.functions import paths
from tallystone.kernel.languages import Registry
from tallystone.operators import aggregate, estimate, filters, health, history, regression, trend
from tallystone.operators.analyze import Analysis, Options, analyze_paths
from tallystone.sinks import render
from tallystone.sinks.report import Report, collected, combined
from tallystone.sources import config as C
from tallystone.sources.gitlog import Git, commit_files, commits_frame, hunks_frame, parse_refs
from tallystone.sources.snapshots import SnapshotStore
from tallystone.sources.work import work_table

# Defaults of the commands.
DEFAULTS = {"output": "console", "sort": "lines", "since": "90d", "min_shared": 5, "min_coupling": 30.0, "max_changeset": 30, "health_model": "v2", "by_dir_depth": 3, "top": None}
TOP = {"health": 10, "hotspot": 20, "coupling": 20}
EXIT_GATE = 1


def session() -> SparkSession:
    return SparkSession.builder.appName("tallystone").config("spark.ui.showConsoleProgress", "false").getOrCreate()


class Run:
    """One command over some paths: settings, registry and the analysis they give."""

    def __init__(self, spark: SparkSession, roots: list[str], settings: dict):
        self.spark, self.roots, self.s = spark, roots or ["."], settings
        self.registry = Registry()
        if settings.get("languages_file"):
            self.registry.load(settings["languages_file"])
        for ext, lang in C.count_as(settings.get("count_as")):
            self.registry.map_extension(ext, lang)
        self.version = 1 if settings.get("health_model") == "v1" else 2
        self.duplication = not settings.get("no_dup_scan")

    def rules(self) -> filters.PathRules:
        s = self.s
        return filters.PathRules.parse(s.get("includes"), s.get("excludes"), s.get("include_files"), s.get("exclude_files"), s.get("exclude_dirs"), smart=not s.get("no_smart_exclude"), everything=bool(s.get("all")), depth=s.get("depth"))

    def options(self, **more) -> Options:
        s = self.s
        names = [x.strip() for x in (s.get("lang") or "").split(",") if x.strip()]
        return Options(names, s.get("min_lines"), s.get("max_lines"), bool(s.get("no_duplicates")), bool(s.get("no_min_gen")), bool(s.get("all")), duplication=self.duplication, linguist=not s.get("no_linguist"), **more)

    def analyze(self, roots: list[str] | None = None, **more) -> Analysis:
        found, self.counters = analyze_paths(self.spark, roots or self.roots, self.rules(), self.registry, self.options(**more), ignore=not self.s.get("no_gitignore"), follow_links=bool(self.s.get("follow_links")))
        return found

    def top(self, command: str) -> int:
        return self.s.get("top") or TOP[command]


def analysis_report(run: Run, a: Analysis) -> Report:
    files = a.file_stats.persist()
    frames: dict[str, DataFrame | None] = {"summary": aggregate.summary(files), "languages": aggregate.by_language(files, run.s["sort"]), "sizes": aggregate.size_distribution(files), "counters": a.counters}
    if run.duplication:
        frames["dryness"] = aggregate.dryness(a.lines, files)
    if run.s.get("by_dir"):
        frames["directories"] = aggregate.directory_tree(files, run.s["by_dir_depth"])
    elif run.s.get("by_file"):
        frames["files"] = aggregate.files_table(files, run.s["sort"], run.s.get("top"))
    return collected("analysis", frames)


def health_report(run: Run, files: DataFrame, regions: DataFrame | None, top: int | None) -> Report:
    found = dict(health.health(files, run.version, regions, run.duplication, top))
    found["files"] = found["files"].select("path", "language", "score", "grade", "top_issue", "coverage")
    return collected("health", found, model=f"v{run.version}")


def baseline(run: Run, ref: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """File statistics and regions of a snapshot or, if there is none of that name, of a reference, and whether they count
    duplicate lines."""
    store = SnapshotStore(os.path.join(run.roots[0], ".tallystone", "snapshots"))
    try:
        snap = store.resolve(ref)
        return store.files(run.spark, snap), store.regions(run.spark, snap), snap.duplication
    except ValueError:
        files, regions, _ = tree_at(run, Git(run.roots[0]), ref)
        return files, regions, run.duplication


def in_repository(run: Run, git: Git, df: DataFrame) -> DataFrame:
    """df with paths from the repository's root, as its log has them."""
    folders = {}
    for root in run.roots:
        with contextlib.suppress(ValueError):
            folders[root] = git.inside(root)
    return df.withColumn("path", paths.moved(F.col("path"), folders))


def _repository(run: Run) -> Git | None:
    try:
        return Git(run.roots[0])
    except (RuntimeError, OSError):
        return None


def _without_submodules(run: Run, *frames: DataFrame) -> list[DataFrame]:
    """Statistics without what lies in submodules, which old trees do not hold."""
    try:
        inside = Git(run.roots[0]).submodules()
    except (RuntimeError, OSError):
        inside = []
    return [filters.without_submodules(f, inside) for f in frames]


def tree_at(run: Run, git: Git, ref: str) -> tuple[DataFrame, DataFrame, dict]:
    """Statistics, regions and counters of the run's paths in an old tree, with paths from the repository's root. They are
    written while its worktree is there. A path that the tree lacks is an error: all of it would be another scope."""
    if not git.exists(ref):
        raise SystemExit(f"{ref!r} is neither a snapshot nor a reference of the repository")
    with git.tree(ref) as folder:
        wanted = {}
        for root in run.roots:
            inside = git.inside(root)
            if not os.path.exists(os.path.join(folder, inside)):
                raise SystemExit(f"path {root!r} does not exist in {ref!r}; compare a path that both trees have")
            wanted[os.path.join(folder, inside) if inside else folder] = inside
        a = run.analyze(list(wanted))
        at_root = lambda df: df.withColumn("path", paths.moved(F.col("path"), wanted))
        counts = a.counters.first().asDict()
        return work_table(at_root(a.file_stats), "old-files"), work_table(at_root(a.regions), "old-regions"), {**counts, "errors": counts["errors"] + run.counters.get("error", 0)}


def cmd_analyze(run: Run) -> tuple[Report, int]:
    a = run.analyze()
    report = analysis_report(run, a)
    if run.s.get("save_snapshot"):
        info = _git_info(run.roots[0])
        SnapshotStore(os.path.join(run.roots[0], ".tallystone", "snapshots")).save(a.file_stats, a.regions, run.s.get("label"), info.get("commit"), info.get("branch"), run.duplication)
    if run.s.get("full"):
        files = a.file_stats.persist()
        totals = estimate.estimate(aggregate.summary(files), estimate.cocomo_basic())
        return combined(report, health_report(run, files, a.regions, TOP["health"]), collected("estimate", {"total": totals, "languages": estimate.estimate_by_language(aggregate.by_language(files))})), 0
    return report, 0


def _git_info(root: str) -> dict:
    try:
        return Git(root).info()
    except (RuntimeError, OSError):
        return {}


def cmd_health(run: Run) -> tuple[Report, int]:
    threshold = regression.parse_threshold(run.s["fail_under"]) if run.s.get("fail_under") else None
    gated = threshold is not None or run.s.get("fail_on_regression")
    a = run.analyze()
    counts = a.counters.first()
    if gated and (why := regression.scan_reason(counts["scanned"], counts["errors"] + run.counters.get("error", 0))):
        raise SystemExit(f"gate failed: {why}")
    files, moved = a.file_stats.persist(), None
    report = health_report(run, files, a.regions, run.top("health"))
    if run.s.get("baseline"):
        old, old_regions, counted = baseline(run, run.s["baseline"])
        here, regions = files, a.regions
        if git := _repository(run):
            here, regions = in_repository(run, git, here), in_repository(run, git, regions)
            old, old_regions = in_repository(run, git, old), old_regions and in_repository(run, git, old_regions)
        old, here = _without_submodules(run, old, here)
        # lines that only one side compared would look like a change
        found = regression.compare(old, here, run.version, old_regions, regions, run.duplication and counted)
        more = collected("diff", {"project": found["project"], "regressed": found["regressed"], "languages": found["languages"]}, baseline=run.s["baseline"])
        report.tables["regressed"], report.values["baseline"], report.values["regression"] = more.rows("regressed"), run.s["baseline"], more.one("project")
        moved = more.one("project") if run.s.get("fail_on_regression") else None
    p = report.one("project")
    why = regression.gate_reason(p["assessment"], p["score"], threshold, moved) if p and gated else None
    report.values["gate"] = why
    return report, EXIT_GATE if why else 0


def cmd_hotspot(run: Run) -> tuple[Report, int]:
    git, since = Git(run.roots[0]), run.s["since"]
    a = run.analyze(spans=bool(run.s.get("functions")))
    log = git.log(since)
    frame = commit_files(run.spark, log).persist()
    files = in_repository(run, git, a.file_stats).persist()
    spots = history.hotspots(history.churn(frame), files, run.top("hotspot")).persist()
    spots = history.with_knowledge(spots, history.ownership(frame))
    spots = history.with_ages(spots, history.first_commits(commit_files(run.spark, git.log())), F.lit(int(time.time()))).orderBy(F.desc("score"), F.desc("commits"), "path")
    report = collected("hotspot", {"files": spots}, since=since)
    report.tables["totals"] = [{"total_commits": len(log)}]
    if run.s.get("functions"):
        named = [r["path"] for r in report.rows("files")[:10]]
        hunks = None
        for path in named:
            one = hunks_frame(run.spark, path, git.hunks(path, since))
            hunks = one if hunks is None else hunks.unionByName(one)
        if hunks is not None:
            spans = in_repository(run, git, a.spans).where(F.col("path").isin(named))
            touched = history.function_touches(spans, hunks).join(spans, ["path", "name", "start_line", "end_line"])
            report.tables["functions"] = [r.asDict() for r in history.function_hotspots(touched).orderBy("path", F.desc("commits")).collect()]
    return report, 0


def cmd_coupling(run: Run) -> tuple[Report, int]:
    git = Git(run.roots[0])
    log = git.log(run.s["since"])
    frame = commit_files(run.spark, log)
    universe = in_repository(run, git, run.analyze().rows.select("path"))
    pairs = history.coupling(frame, universe, run.s["min_shared"], run.s["min_coupling"], run.s["max_changeset"], run.s.get("focus"), bool(run.s.get("include_tests")), run.top("coupling"))
    return collected("coupling", {"pairs": pairs, "totals": history.coupling_totals(frame, commits_frame(run.spark, log), run.s["max_changeset"])}, since=run.s["since"], focus=run.s.get("focus")), 0


def cmd_diff(run: Run) -> tuple[Report, int]:
    git = Git(run.roots[0])
    before_ref, after_ref = parse_refs(run.s["from"], run.s.get("to"), git)
    (before, b_regions, b_counts), (after, a_regions, a_counts) = tree_at(run, git, before_ref), tree_at(run, git, after_ref)
    for ref, counts in ((before_ref, b_counts), (after_ref, a_counts)):
        if why := regression.scan_reason(counts["scanned"], counts["errors"]):
            raise SystemExit(f"gate failed: {ref}: {why}")
    before, after = _without_submodules(run, before, after)
    found = regression.compare(before, after, run.version, b_regions, a_regions, run.duplication)
    frames = {"project": found["project"], "regressed": found["regressed"], "languages": trend.language_trend(before, after), "deltas": trend.deltas(aggregate.summary(before), aggregate.summary(after))}
    report = collected("diff", frames, baseline=before_ref, current=after_ref, model=f"v{run.version}")
    return report, EXIT_GATE if run.s.get("fail_on_regression") and report.one("project")["gate_failed"] else 0


def cmd_trend(run: Run) -> tuple[Report, int]:
    store = SnapshotStore(os.path.join(run.roots[0], ".tallystone", "snapshots"))
    if run.s.get("save"):
        a, info = run.analyze(), _git_info(run.roots[0])
        store.save(a.file_stats, a.regions, run.s.get("label"), info.get("commit"), info.get("branch"), run.duplication)
    if run.s.get("list"):
        return Report("trend", values={"history": [vars(s) for s in store.list()]}), 0
    old, new = store.resolve(run.s.get("from") or "latest~1"), store.resolve(run.s.get("to") or "latest")
    before, after = store.files(run.spark, old), store.files(run.spark, new)
    return collected("trend", {"deltas": trend.deltas(aggregate.summary(before), aggregate.summary(after)), "languages": trend.language_trend(before, after)}, before=vars(old), after=vars(new)), 0


def estimation_models(s: dict) -> dict[str, estimate.EstimationModel]:
    """The models by name with the parameters of the command; what is not given keeps its usual value."""
    given = lambda **names: {k: s[v] for k, v in names.items() if s.get(v) is not None}
    scale = {"scale": (s["sf_sum"],)} if s.get("sf_sum") is not None else {}
    return {
        "cocomo-basic": estimate.cocomo_basic(**given(project="project_type", eaf="eaf")), "cocomo2": estimate.cocomo_2(**given(eaf="eaf"), **scale), "putnam": estimate.putnam(**given(ck="ck", d0="d0")),
        "locomo": estimate.locomo(**given(preset="locomo_preset", input_price="llm_input_price", output_price="llm_output_price", tokens_per_second="llm_tps")),
    }


def cmd_estimate(run: Run) -> tuple[Report, int]:
    files = run.analyze().file_stats.persist()
    usual = estimate.Salary()
    salary = estimate.Salary(*(own if own is not None else x for own, x in ((run.s.get("average_wage"), usual.average_wage), (run.s.get("overhead"), usual.overhead))))
    totals, models = aggregate.summary(files), estimation_models(run.s)
    wanted = run.s.get("model") or "all"
    if wanted == "all":
        return collected("comparison", {"models": estimate.estimate_all(totals, list(models.values()), salary=salary)}), 0
    model = models[wanted]
    return collected("estimate", {"total": estimate.estimate(totals, model, salary), "languages": estimate.estimate_by_language(aggregate.by_language(files), model, salary)}, params=model.params), 0


def tool(spark: SparkSession, name: str, root: str = ".", **args) -> dict:
    """The tools for agents: repo_overview, code_health, hotspots, change_coupling, file_metrics. Errors come back as values."""
    settings = {**DEFAULTS, **args}
    try:
        run = Run(spark, [root], settings)
        if name == "repo_overview":
            return json.loads(render.to_json(cmd_analyze(run)[0]))
        if name == "code_health":
            return json.loads(render.to_json(cmd_health(run)[0]))
        if name == "hotspots":
            run.s["top"] = args.get("top") or 10
            return json.loads(render.to_json(cmd_hotspot(run)[0]))
        if name == "change_coupling":
            git = Git(root)
            pairs = history.coupling(commit_files(spark, git.log(settings["since"])), None, settings["min_shared"], settings["min_coupling"], settings["max_changeset"], args.get("focus"), True, args.get("top") or 10)
            return json.loads(render.to_json(collected("coupling", {"pairs": pairs}, since=settings["since"])))
        if name == "file_metrics":
            wanted = args.get("file") or os.path.join(root, args["path"])
            own = Run(spark, [wanted], settings)
            a = own.analyze(spans=True)
            found = a.rows.select("path", "k.language", "k.lines", "k.size", "k.complexity", "k.spans").collect()
            if not found:
                return {"error": f"{wanted} is not a source file"}
            scored = health.health(a.file_stats, own.version, a.regions, own.duplication, 1)["files"].select("path", "score", "grade", "top_issue", "coverage").collect()
            return {**found[0].asDict(recursive=True), "health": scored[0].asDict() if scored else None}
        return {"error": f"unknown tool {name!r}"}
    except (Exception, SystemExit) as e:
        return {"error": str(e)}


# The protocol of agents, its tools and their arguments.
PROTOCOL = "2025-06-18"
_TEXT, _NUMBER = {"type": "string"}, {"type": "integer"}
TOOLS = {
    "repo_overview": ("Files, lines, languages, complexity and tokens of a folder.", {"path": _TEXT}, []),
    "code_health": ("Health of a folder: score and grade, dimensions, worst folders and files.", {"path": _TEXT, "top": _NUMBER}, []),
    "hotspots": ("Files that are complex and often changed, with their authors and age.", {"path": _TEXT, "since": _TEXT, "top": _NUMBER}, []),
    "change_coupling": ("Pairs of files that commits change together.", {"path": _TEXT, "since": _TEXT, "top": _NUMBER}, []),
    "file_metrics": ("Lines, size, complexity, functions and health of one file.", {"file": _TEXT}, ["file"]),
}


def _answer(spark: SparkSession, asked: dict) -> dict | None:
    """The result of one JSON-RPC request of the Model Context Protocol; None for methods that are not known."""
    method, params = asked["method"], asked.get("params") or {}
    if method == "initialize":
        return {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "tallystone", "version": __version__}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, "required": r}} for n, (d, a, r) in TOOLS.items()]}
    if method == "tools/call":
        given = dict(params.get("arguments") or {})
        found = tool(spark, params.get("name", ""), given.pop("path", None) or ".", **given)
        return {"content": [{"type": "text", "text": json.dumps(found)}], "isError": set(found) == {"error"}}
    return None


def serve(spark: SparkSession, lines=sys.stdin, out=sys.stdout) -> None:
    """Requests one a line, answered one a line: JSON-RPC of the Model Context Protocol, or plain {"tool": name, "arguments": {...}}."""
    for line in filter(str.strip, lines):
        try:
            asked = json.loads(line)
            if "method" not in asked:
                answer = tool(spark, asked.get("tool", ""), **asked.get("arguments", {}))
            elif "id" not in asked:
                continue  # a notification
            else:
                found = _answer(spark, asked)
                answer = {"jsonrpc": "2.0", "id": asked["id"], **({"result": found} if found is not None else {"error": {"code": -32601, "message": f"no method {asked['method']!r}"}})}
        except (ValueError, TypeError, AttributeError) as e:
            answer = {"error": str(e)}
        print(json.dumps(answer), file=out, flush=True)


COMMANDS = {"analyze": cmd_analyze, "health": cmd_health, "hotspot": cmd_hotspot, "coupling": cmd_coupling, "diff": cmd_diff, "trend": cmd_trend, "estimate": cmd_estimate}


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False, argument_default=None)
    for flag in ("excludes", "includes", "exclude-files", "include-files", "exclude-dirs", "lang", "count-as", "languages-file", "output-file", "config"):
        common.add_argument(f"--{flag}")
    for flag in ("min-lines", "max-lines", "depth", "top"):
        common.add_argument(f"--{flag}", type=int)
    for flag in ("no-dup-scan", "no-gitignore", "no-smart-exclude", "no-duplicates", "no-min-gen", "all", "quiet", "no-config", "follow-links", "no-linguist"):
        common.add_argument(f"--{flag}", action="store_true", default=None)
    common.add_argument("-o", "--output", choices=list(render.RENDERERS))
    common.add_argument("--sort", choices=list(aggregate.SORTS))
    common.add_argument("--health-model", choices=["v1", "v2"])
    main = argparse.ArgumentParser(prog="tallystone", description=__doc__)
    sub = main.add_subparsers(dest="command")
    add = lambda name, *more: sub.add_parser(name, parents=[common, *more])
    p = add("analyze")
    p.add_argument("paths", nargs="*")
    for flag in ("by-file", "by-dir", "save-snapshot", "full"):
        p.add_argument(f"--{flag}", action="store_true", default=None)
    p.add_argument("--by-dir-depth", type=int)
    p.add_argument("--label")
    p = add("health")
    p.add_argument("paths", nargs="*")
    p.add_argument("--fail-under")
    p.add_argument("--baseline")
    p.add_argument("--fail-on-regression", action="store_true", default=None)
    for name in ("hotspot", "coupling"):
        p = add(name)
        p.add_argument("paths", nargs="*")
        p.add_argument("--since")
        if name == "hotspot":
            p.add_argument("--functions", action="store_true", default=None)
        else:
            p.add_argument("--min-shared", type=int)
            p.add_argument("--min-coupling", type=float)
            p.add_argument("--max-changeset", type=int)
            p.add_argument("--focus")
            p.add_argument("--include-tests", action="store_true", default=None)
    p = add("diff")
    p.add_argument("from")
    p.add_argument("to", nargs="?")
    p.add_argument("--path", dest="paths", action="append")
    p.add_argument("--fail-on-regression", action="store_true", default=None)
    p = add("trend")
    p.add_argument("paths", nargs="*")
    p.add_argument("--save", action="store_true", default=None)
    p.add_argument("--list", action="store_true", default=None)
    for flag in ("from", "to", "label"):
        p.add_argument(f"--{flag}")
    p = add("estimate")
    p.add_argument("paths", nargs="*")
    p.add_argument("--model", choices=[*estimation_models({}), "all"])
    p.add_argument("--project-type", choices=list(estimate.COCOMO_BASIC))
    p.add_argument("--locomo-preset", choices=list(estimate.LOCOMO_PRESETS))
    for flag in ("avg-wage", "overhead", "eaf", "sf-sum", "ck", "d0", "llm-input-price", "llm-output-price", "llm-tps"):
        p.add_argument(f"--{flag}", type=float, dest="average_wage" if flag == "avg-wage" else None)
    sub.add_parser("languages")
    sub.add_parser("tools")
    return main


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in (*COMMANDS, "languages", "tools", "-h", "--help"):
        argv = ["analyze", *argv]
    flags = vars(parser().parse_args(argv))
    command, roots = flags.pop("command"), flags.pop("paths", None) or ["."]
    if command == "languages":
        for name, extensions in Registry().listing():
            print(f"{name:<20}{' '.join(extensions)}")
        return 0
    spark = spark or session()
    if command == "tools":
        serve(spark)
        return 0
    found = {} if flags.get("no_config") else C.load_config(flags["config"]) if flags.get("config") else C.load_config(p) if (p := C.find_config(roots[0])) else {}
    settings = C.merged(DEFAULTS, found, flags)
    report, code = COMMANDS[command](Run(spark, roots, settings))
    render.write(report, settings["output"], settings.get("output_file"), bool(settings.get("quiet")), color=sys.stdout.isatty())
    if report.values.get("gate"):
        print(f"gate failed: {report.values['gate']}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
