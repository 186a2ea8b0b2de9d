import io
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tallystone import cli
from tallystone.functions import paths
from tallystone.operators.analyze import analyze_paths
from tallystone.sinks import render
from tallystone.sinks.report import Report, combined
from tallystone.sources import config, gitlog, tree
from tallystone.sources.attributes import Attributes
from tallystone.sources.snapshots import SnapshotStore

MARK, SEP = gitlog.MARK, gitlog.FIELD


def test_log_parser():
    text = f"{MARK}h3{SEP}Al{SEP}300\n\n3\t1\tnew.rs\n-\t-\timg.png\n{MARK}h2{SEP}Bo{SEP}x\n1\t1\tsrc/{{old => new}}/f.rs\n2\t0\told.rs => new.rs\nnot a record\n{MARK}h1{SEP}Al{SEP}100\n5\t0\told.rs\n4\t0\tsrc/old/f.rs\n1\t0\ta{{ => /b}}/c.rs\n"
    c = gitlog.parse_log("1\t1\tbefore any header\n" + text)
    assert [(x.commit, x.author, x.ts) for x in c] == [("h3", "Al", 300), ("h2", "Bo", 0), ("h1", "Al", 100)]
    assert c[0].files == [("new.rs", 3, 1), ("img.png", 0, 0)]
    assert c[1].files == [("src/new/f.rs", 1, 1), ("new.rs", 2, 0)] and c[2].files[:2] == [("new.rs", 5, 0), ("src/new/f.rs", 4, 0)]
    again = gitlog.parse_log(f"{MARK}n{SEP}a{SEP}3\n1\t0\ta.rs\n{MARK}r{SEP}a{SEP}2\n0\t0\ta.rs => b.rs\n{MARK}o{SEP}a{SEP}1\n9\t0\ta.rs\n")
    assert [x.files[0][0] for x in again] == ["a.rs", "b.rs", "b.rs"]


def test_small_parsers():
    assert [gitlog.parse_since(x) for x in ("30d", "4w", "6m", "1y", "2025-01-01", "yesterday")] == ["30 days ago", "28 days ago", "6 months ago", "1 years ago", "2025-01-01", "yesterday"]
    assert gitlog.parse_hunks(f"{MARK}a\n@@ -1,2 +3,4 @@ fn\n@@ -5 +0,0 @@\n{MARK}b\n{MARK}c\n@@ -1 +7 @@\n") == [[(3, 4), (1, 1)], [(7, 1)]]
    assert gitlog.parse_refs("a..b") == ("a", "b") and gitlog.parse_refs("a..") == ("a", "HEAD") and gitlog.parse_refs("v1") == ("v1", "HEAD")
    with pytest.raises(ValueError):
        gitlog.parse_refs("a..b", "c")
    assert gitlog.rename("a => b") == ("a", "b") and gitlog.rename("a/b") is None and gitlog.rename("{a => }/x") == ("a/x", "x")


def test_attributes():
    a = Attributes.parse("# c\n*.tpl linguist-language=HTML\nvendor/** linguist-vendored\nvendor/own/** -linguist-vendored\n/gen.rs linguist-generated=true\n*.pb.go linguist-generated\nkeep.pb.go linguist-generated=false\n")
    assert a.language("x/y.tpl") == "HTML" and a.language("y.rs") is None
    assert [a.excluded(p) for p in ("vendor/a.c", "vendor/own/a.c", "gen.rs", "x/gen.rs", "x/gen.rst", "a.pb.go", "keep.pb.go")] == [True, False, True, True, False, True, False]


def test_walk(tmp_path):
    for p in ("a.rs", "target/b.rs", "skip/c.rs", "keep/d.rs", "keep/e.log", "keep/f.log", ".hidden/g.py", "keep/sub/h.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n*.log\n!keep/f.log\n/keep/sub\n")
    names = lambda **k: sorted(f.removeprefix(str(tmp_path) + "/") for f in tree.walk(str(tmp_path), **k).files)
    assert names() == [".gitignore", ".hidden/g.py", "a.rs", "keep/d.rs", "keep/f.log"]
    assert "skip/c.rs" in names(ignore=False) and "keep/sub/h.rs" in names(ignore=False)
    assert names(rules=tree.PathRules(depth=1)) == [".gitignore", "a.rs"]
    with pytest.raises(FileNotFoundError):
        tree.walk(str(tmp_path / "none"))


def test_scans_read_the_same(spark, tmp_path):
    for p in ("src/a b+c.rs", "src/%41.rs", "bin/x.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    df, _ = tree.scan_tree(spark, [str(tmp_path)])
    got = {r.path.removeprefix(str(tmp_path) + "/"): bytes(r.content).decode() for r in df.collect()}
    assert got == {p: p for p in ("src/a b+c.rs", "src/%41.rs")}
    far = {r.path: bytes(r.content).decode() for r in tree.scan_distributed(spark, str(tmp_path)).collect()}
    assert far == got


def test_config(tmp_path):
    f = tmp_path / config.FILE_NAME
    f.write_text('lang = "Rust"\nmin_lines = 3\nlanguages_file = "own.toml"\nhealth_model = "v1"\n')
    got = config.load_config(f)
    assert got["languages_file"] == str(tmp_path / "own.toml") and config.find_config(str(tmp_path)) == f
    assert config.merged({"top": 1, "lang": None}, got, {"lang": "Go", "top": None})["lang"] == "Go"
    for bad in ("unknown = 1", "min_lines = -1", "min_lines = true", 'health_model = "v9"', "x ="):
        f.write_text(bad)
        with pytest.raises(ValueError):
            config.load_config(f)
    assert config.count_as("jsp:html, tpl:php") == [("jsp", "html"), ("tpl", "php")]
    with pytest.raises(ValueError):
        config.count_as("jsp")


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=Al", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for k in range(6):
        (at / "a.rs").write_text("fn a() {\n" + "    if x { y(); }\n" * (k + 1) + "}\n")
        (at / "b.py").write_text("def b():\n" + f"    return {k}\n")
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    return at


def test_git(repo):
    g = gitlog.Git(str(repo))
    log = g.log()
    assert len(log) == g.commit_count() == 6 and log[0].author == "Al" and {p for p, _, _ in log[0].files} == {"a.rs", "b.py"}
    assert g.exists("HEAD~2") and not g.exists("nope") and len(g.hunks("a.rs")) == 6 and g.submodules() == [] and g.info()["branch"] == "main"
    with g.tree("HEAD~5") as folder:
        assert open(folder + "/a.rs").read().count("if") == 1


def run(spark, capsys, *argv):
    code = cli.main([*argv, "--no-config"], spark)
    return code, capsys.readouterr().out


def test_commands(spark, repo, capsys, monkeypatch):
    monkeypatch.chdir(repo)
    code, out = run(spark, capsys, "analyze", ".", "-o", "json")
    assert code == 0 and json.loads(out)["summary"][0]["files"] == 2
    assert run(spark, capsys, "analyze", ".", "-o", "csv")[1].splitlines() == ["Language,Files,Code,Comment,Blank,Total,Size", "Rust,1,8,0,0,8,119", "Python,1,2,0,0,2,22"]
    code, out = run(spark, capsys, "health", ".", "-o", "json", "--fail-under", "A")
    assert code in (0, 1) and json.loads(out)["project"][0]["scope"] == "production"
    code, out = run(spark, capsys, "hotspot", ".", "--functions", "-o", "json")
    found = json.loads(out)
    assert code == 0 and found["files"][0]["path"] == "a.rs" and found["files"][0]["commits"] == 6 and found["functions"][0]["commits"] >= 5
    code, out = run(spark, capsys, "coupling", ".", "-o", "csv")
    assert out.splitlines()[1] == "a.rs,b.py,6,6,6,100.0"
    code, out = run(spark, capsys, "diff", "HEAD~5..HEAD", "-o", "json")
    assert code == 0 and {d["metric"]: d["signed"] for d in json.loads(out)["deltas"]}["code"] == 5
    assert run(spark, capsys, "estimate", ".", "--model", "all", "-o", "csv")[1].startswith("Model,SLOC,")
    for k in range(2):
        run(spark, capsys, "analyze", ".", "--save-snapshot", "--label", f"s{k}", "--quiet")
    code, out = run(spark, capsys, "trend", ".", "-o", "json")
    assert code == 0 and all(d["signed"] == 0 for d in json.loads(out)["deltas"])
    code, out = run(spark, capsys, "health", ".", "--baseline", "s0", "--fail-on-regression", "-o", "json")
    assert code == 0 and json.loads(out)["regression"]["score_delta"] == 0
    assert cli.tool(spark, "file_metrics", ".", path="a.rs")["complexity"]["functions"] == 1 and "error" in cli.tool(spark, "nope", ".")
    assert cli.tool(spark, "change_coupling", ".")["pairs"][0]["degree"] == 100


def test_several_roots_keep_their_paths(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for folder in ("src", "lib", "tests"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.py").write_text("alpha = compute(1)\nbeta = compute(2)\ngamma = compute(3)\ndelta = compute(4)\n")
    a, _ = analyze_paths(spark, ["src", "lib", "./src"])
    assert {(r.path, r.duplicate_lines) for r in a.file_stats.collect()} == {("src/x.py", 4), ("lib/x.py", 4)}
    tested, _ = analyze_paths(spark, ["tests"])
    assert [r.path for r in tested.file_stats.where(paths.is_test_path(F.col("path"))).collect()] == ["tests/x.py"]
    rows = spark.createDataFrame([(p,) for p in ("src/x.py", "./src/x.py", "srcs/x.py", "/abs/a", "src")], "path string")
    at = lambda folders: [r.p for r in rows.select(paths.moved(F.col("path"), folders).alias("p")).collect()]
    assert at({"src": "top/src"}) == ["top/src/x.py", "top/src/x.py", "srcs/x.py", "/abs/a", "top/src"]
    assert at({".": "sub", "/abs": ""}) == ["sub/src/x.py", "sub/src/x.py", "sub/srcs/x.py", "a", "sub/src"]


def test_commands_on_a_folder_of_the_repository(spark, tmp_path, capsys, monkeypatch):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Al", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "src").mkdir()
    (tmp_path / "other.py").write_text("def o():\n    if x: pass\n" * 9)
    for k in range(6):
        for name in ("a.py", "b.py"):
            (tmp_path / "src" / name).write_text(f"def f():\n    if x:\n        return {k}\n")
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    monkeypatch.chdir(tmp_path)
    found = json.loads(run(spark, capsys, "hotspot", "src", "-o", "json")[1])
    assert {r["path"]: r["commits"] for r in found["files"]} == {"src/a.py": 6, "src/b.py": 6}
    assert run(spark, capsys, "coupling", "src", "-o", "csv")[1].splitlines()[1].startswith("src/a.py,src/b.py,6")
    code, out = run(spark, capsys, "health", "src", "--baseline", "HEAD", "--fail-on-regression", "-o", "json")
    assert code == 0 and json.loads(out)["regression"]["score_delta"] == 0
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "n.py").write_text("n = 1\n")
    with pytest.raises(SystemExit, match="does not exist"):
        cli.main(["health", "new", "--baseline", "HEAD", "--no-config"], spark)
    ask = lambda **x: json.dumps({"jsonrpc": "2.0", "id": 1, **x})
    lines = [ask(method="initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(method="tools/list"), ask(method="tools/call", params={"name": "file_metrics", "arguments": {"file": "src/a.py"}}), ask(method="no/such")]
    out = io.StringIO()
    cli.serve(spark, lines, out)
    first, tools, metrics, unknown = map(json.loads, out.getvalue().splitlines())
    assert first["result"]["serverInfo"]["name"] == "tallystone" and len(tools["result"]["tools"]) == 5 and unknown["error"]["code"] == -32601
    found = json.loads(metrics["result"]["content"][0]["text"])
    assert found["lines"]["total"] == 3 and found["health"]["grade"] == "A" and not metrics["result"]["isError"]


def test_estimate_takes_parameters():
    models = cli.estimation_models({"project_type": "embedded", "eaf": 2.0, "sf_sum": 20.0, "ck": 5000.0, "locomo_preset": "small", "llm_output_price": 9.0})
    assert models["cocomo-basic"].params == {"Project Type": "embedded", "EAF": 2.0} and models["cocomo2"].params["SF sum"] == 20.0
    assert models["putnam"].params["Ck"] == 5000.0 and models["locomo"].params["output price"] == 9.0 and models["locomo"].params["input price"] == 0.5


def test_ignore_rules_from_above(tmp_path, monkeypatch):
    (tmp_path / ".git").mkdir()
    (tmp_path / ".gitignore").write_text("sub/gone.py\n*.tmp\n")
    (tmp_path / "sub").mkdir()
    for name in ("gone.py", "kept.py", "x.tmp", "y.mine"):
        (tmp_path / "sub" / name).write_text("x\n")
    (tmp_path / "home" / "git").mkdir(parents=True)
    (tmp_path / "home" / "git" / "ignore").write_text("*.mine\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    assert [f.rsplit("/", 1)[-1] for f in tree.walk(str(tmp_path / "sub")).files] == ["kept.py"]


def test_snapshots(spark, tmp_path):
    from tests.test_operators import SMALL, stats

    store = SnapshotStore(tmp_path / "snaps")
    ids = [store.save(stats(spark, SMALL), label=x, now_ns=1_700_000_000_123_456_789).id for x in ("one", "two")]
    assert len(set(ids)) == 2 and ids[1] == ids[0] + "~1"
    last = store.save(stats(spark, SMALL[:1]), now_ns=1_800_000_000_000_000_000)
    (tmp_path / "snaps" / "broken").mkdir()
    (tmp_path / "snaps" / "broken" / "snapshot.json").write_text("{")
    assert [s.id for s in store.list()] == [*ids, last.id]
    assert store.resolve("latest").id == last.id and store.resolve("latest~1").id == ids[1] and store.resolve("one").id == ids[0] and store.resolve("2023-11").id == ids[1]
    assert store.files(spark, last).count() == 1
    with pytest.raises(ValueError):
        store.resolve("latest~9")


PROJECT = {"score": 87.44, "grade": "B", "model": "default-v2", "scope": "production", "assessment": "scored", "confidence": "high", "coverage": 1.0, "tail_score": 50.0, "failing_files": 1}
HEALTH = Report("health", {"project": [PROJECT], "files": [{"path": "./src/lib.rs", "score": 43.64, "grade": "F", "top_issue": "complexity"}], "dimensions": [{"dimension": "complexity", "score": 40.0, "grade": "F", "weight": 1.0}], "languages": [{"language": 'R"x', "score": 1.0, "grade": "F", "coverage": 1.0, "assessment": "scored", "file_count": 1}], "directories": []})
SPOTS = Report("hotspot", {"files": [{"path": "a.rs", "commits": 9, "lines_added": 1, "lines_deleted": 2, "lines_churn": 3, "cyclomatic": 40, "age_days": 3, "authors": 2, "main_author": "O, P", "ownership": 0.9, "knowledge_island": True, "score": 0.8, "risk": "HIGH"}], "totals": [{"total_commits": 9}]}, {"since": "90d"})


def test_csv_of_health_is_stable():
    assert render.csv(HEALTH) == "File,Score,Grade,TopIssue\n./src/lib.rs,43.6,F,Complexity\n"
    assert render.csv(SPOTS).splitlines()[1] == 'a.rs,9,1,2,3,40,3,2,"O, P",0.90,true,0.80,HIGH'


def test_badges():
    badge = lambda r: json.loads(render.badge(r))
    assert badge(HEALTH) == {"schemaVersion": 1, "label": "code health", "message": "B (87.4)", "color": "green"}
    assert badge(combined(SPOTS, HEALTH))["label"] == "code health" and badge(SPOTS)["color"] == "orange"
    thin = Report("health", {"project": [{**PROJECT, "assessment": "insufficient-data"}]})
    assert badge(thin)["color"] == "lightgrey"


def test_sarif_metrics_and_texts():
    log = json.loads(render.sarif(combined(HEALTH, SPOTS)))
    results = log["runs"][0]["results"]
    assert log["version"] == "2.1.0" and len(log["runs"][0]["tool"]["driver"]["rules"]) == 5
    assert [(r["ruleId"].split("/")[1], r["level"]) for r in results] == [("health-grade", "error"), ("hotspot", "warning")]
    assert results[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "src/lib.rs"
    text = render.openmetrics(combined(HEALTH, SPOTS))
    assert text.endswith("# EOF\n") and 'language="R\\"x"' in text and "tallystone_hotspot_files 1" in text
    assert "| File |" in render.markdown(HEALTH) and "<table>" in render.html(HEALTH) and "&quot;" in render.html(HEALTH)
    assert render.plain(render.console(HEALTH, color=True)) == render.console(HEALTH)
    assert json.loads(render.to_json(combined(HEALTH)))["parts"][0]["project"][0]["grade"] == "B"


def test_writing(tmp_path, capsys):
    at = tmp_path / "out.csv"
    render.write(HEALTH, "csv", str(at), quiet=True)
    assert at.read_text().startswith("File,") and capsys.readouterr().out == ""
    render.write(HEALTH, "console")
    assert "Health" in capsys.readouterr().out
