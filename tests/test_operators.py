import math

import pytest
from pyspark.sql import functions as F

from tallystone.functions import formats, paths, scores
from tallystone.operators import aggregate, analyze, estimate, filters, health, history, regression, trend
from tallystone.operators.aggregate import FILE_STATS


def file(path, total, code, comment, blank, size, functions, cyclomatic, depth, mean, language="Rust", duplicate=0, flags=(True, True)):
    return (path, language, (total, code, comment, blank), size, duplicate, (*flags, functions, cyclomatic, 0, depth, float(mean), None, None, None, None))


def stats(spark, rows):
    return spark.createDataFrame(rows, FILE_STATS)


SMALL = [file("src/good.rs", 50, 40, 5, 5, 1000, 3, 6, 2, 13), file("src/bad.rs", 500, 400, 10, 90, 10000, 2, 30, 8, 200), file("lib/utils.rs", 80, 60, 10, 10, 1500, 5, 10, 3, 12)]
TREE = [
    file("src/main.rs", 120, 90, 15, 15, 3000, 5, 12, 3, 18), file("src/parser/mod.rs", 350, 280, 30, 40, 8000, 8, 35, 6, 35), file("src/parser/expr.rs", 600, 500, 40, 60, 15000, 12, 60, 8, 42),
    file("./src/utils.rs", 80, 60, 10, 10, 2000, 6, 8, 2, 10), file("tests/test_parser.py", 200, 150, 20, 30, 4000, 10, 15, 3, 15, "Python"),
]


def one(df):
    return df.first().asDict()


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_curves_and_grades(spark):
    v = lambda x, points: value(spark, scores.curve(F.lit(x), points))
    points = scores.V2["complexity"][1]
    assert [v(float(x), points) for x in (0, 3, 4.5, 6, 40, 99)] == [100, 100, 90, 80, 1, 1]
    assert v(float("nan"), points) == v(float("inf"), points) == 1 and v(5.0, []) == 50
    grades = [value(spark, scores.grade(F.lit(x))) for x in (90.0, 89.9999999999, 89.99, 80.0, 70.0, 60.0, 59.0, float("nan"))]
    assert grades == ["A", "A", "B", "B", "C", "D", "F", "F"]


def test_percentile_is_the_upper_one(spark):
    p = lambda xs: value(spark, scores.p90(F.array(*(F.struct(F.lit(x).cast("long").alias("value"), F.lit(1).cast("long").alias("n")) for x in xs))))
    assert p(range(1, 11)) == 10 and p([7]) == 7 and p(range(1, 22)) == 19


def test_health_v1_of_a_small_tree(spark):
    found = health.health_v1(stats(spark, SMALL))
    project = one(found["project"])
    assert abs(project["score"] - 80.153333) < 0.01 and project["grade"] == "B" and project["assessment"] == "scored"
    assert [r.path for r in found["files"].collect()][0] == "src/bad.rs"
    assert {r.directory for r in found["directories"].collect()} == {"src", "lib"}


def test_health_v2_of_a_tree(spark):
    found = health.health_v2(stats(spark, TREE))
    files = found["files"].collect()
    assert files[0].path == "src/parser/expr.rs" and len(files[0].dimensions) == 6 and len(files) == 4
    project = one(found["project"])
    low, high = min(f.score for f in files), max(f.score for f in files)
    assert low <= project["score"] <= high and low <= project["tail_score"] <= project["score"] and project["scope"] == "production"
    assert one(found["tests"])["file_count"] == 1
    assert {r.directory for r in found["directories"].collect()} == {"src", "src/parser"}  # from the common parent on
    assert abs(sum(r.weight for r in found["dimensions"].collect()) - 1) < 1e-9


def test_health_v2_edges(spark):
    only_tests = health.health_v2(stats(spark, TREE[4:]))
    assert one(only_tests["project"])["scope"] == "tests-only"
    nothing = health.health_v2(stats(spark, [file("a.md", 9, 9, 0, 0, 9, 0, 0, 0, 0, "Markdown", flags=(False, False))]))
    empty = one(nothing["project"])
    assert (empty["score"], empty["grade"], empty["scope"], empty["assessment"], empty["file_count"]) == (0, "F", "empty", "insufficient-data", 0)
    assert one(health.health_v1(stats(spark, []))["project"])["scope"] == "empty"
    blind = health.health_v2(stats(spark, [file("a.xyz", 9, 9, 0, 0, 9, 0, 0, 0, 0, "X", flags=(False, False))]))
    p = one(blind["project"])
    assert p["assessment"] == "insufficient-data" and abs(p["coverage"] - 0.45) < 1e-9


def test_tail_is_the_worst_tenth_of_the_weight(spark):
    rows = [(f"p{i % 3}", float(i * 7 % 101), 1.0 + i % 5) for i in range(300)] + [("one", 50.0, 2.0)]
    got = {r.k: r.tail_score for r in health.tail(spark.createDataFrame(rows, "k string, score double, weight double"), ["k"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((s, w) for g, s, w in rows if g == k)
        left = limit = sum(w for _, w in own) * 0.1
        total = 0.0
        for s, w in own:
            taken = min(w, max(left, 0))
            total += s * taken
            left -= taken
        assert abs(got[k] - total / limit) < 1e-9


def test_regression(spark):
    worse = [SMALL[0], file("src/bad.rs", 500, 400, 10, 90, 10000, 2, 90, 12, 300), file("new/f.rs", 5000, 4800, 0, 10, 10, 1, 900, 15, 900, duplicate=4500)]
    found = regression.compare(stats(spark, SMALL), stats(spark, worse))
    rows = found["regressed"].collect()
    assert [(r.path, r.is_new) for r in rows] == [("new/f.rs", True), ("src/bad.rs", False)]
    assert rows[0].from_score == 100 and rows[0].from_grade == "A"
    project = one(found["project"])
    assert project["failed"] and project["gate_failed"] and project["regressed_files"] == 2
    same = one(regression.compare(stats(spark, SMALL), stats(spark, SMALL))["project"])
    assert not same["failed"] and same["score_delta"] == 0
    blind = [file(p, 9, 9, 0, 0, 9, 0, 0, 0, 0, "X", flags=(False, False)) for p in ("src/good.rs", "x.rs")]
    assert one(regression.compare(stats(spark, blind), stats(spark, SMALL))["project"])["assessment"] == "insufficient-data"


def test_gates():
    assert [regression.parse_threshold(x) for x in ("A", "b", "72.5", "0")] == [90, 80, 72.5, 0]
    for bad in ("E", "101", "-1", "nan"):
        with pytest.raises(ValueError):
            regression.parse_threshold(bad)
    assert regression.gate_reason("insufficient-data", 99, 60) and regression.gate_reason("scored", 59, 60)
    assert regression.gate_reason("insufficient-data", 99) is None and regression.gate_reason("scored", 60, 60) is None
    assert regression.gate_reason("scored", 99, 60, {"gate_failed": True, "assessment": "scored"})
    assert regression.scan_reason(0, 0) and regression.scan_reason(3, 1) and regression.scan_reason(3, 0) is None


def test_paths(spark):
    yes = ["tests/a.rs", "a/Spec/b.x", "conftest.py", "a_test.go", "x.test.js", "x.spec.tsx", "test_a.py", "a_spec.rb", "FooTest.java", "FooTests.CS", "a/__tests__/b"]
    no = ["testing/a.rs", "attest.rs", "contest.java", "test_a.rs", "a_spec.py", "Test", "my_tests.rs", "FooTest.rs", "test"]
    df = spark.createDataFrame([(p, p in yes) for p in yes + no], "path string, want boolean")
    assert df.where(paths.is_test_path(F.col("path")) != F.col("want")).collect() == []
    assert all(history._test_name(p) for p in yes) and not any(history._test_name(p) for p in no)
    order = [r[0] for r in spark.createDataFrame([("a-b",), ("a/b",), ("a",), ("a.c",)], "p string").orderBy(paths.components(F.col("p"))).collect()]
    assert order == ["a", "a/b", "a-b", "a.c"]
    v = lambda f, p: value(spark, f(F.lit(p)))
    assert [v(paths.parent, p) for p in ("a/b/c", "./a", "a")] == ["a/b", ".", "."]
    assert [v(paths.lexical, p) for p in ("./a/./b", "a/../b", "/x")] == ["a/b", "a/../b", "/x"]
    assert v(paths.ancestors, "a/b/c.x") == ["a", "a/b"] and v(paths.ancestors, "c") == ["."]
    assert [v(paths.extension, p) for p in ("a.TXT", ".bashrc", "b.tar.gz", "c")] == [".txt", "", ".gz", ""]


def test_directories_and_summary(spark):
    files = stats(spark, TREE)
    rows = {r.directory: r for r in aggregate.by_directory(files, 2).collect()}
    assert set(rows) == {"src", "src/parser", "tests"} and rows["src"].files == 4 and rows["src"].depth == 1 and rows["src/parser"].code == 780
    assert [r.directory for r in aggregate.directory_tree(files).collect()] == ["src", "src/parser", "tests"]
    s = one(aggregate.summary(files))
    assert s["files"] == 5 and s["test_files"] == 1 and s["max_depth"] == 8 and abs(s["avg_func_lines"] - sum(n * m for n, m in ((5, 18), (8, 35), (12, 42), (6, 10), (10, 15))) / 41) < 1e-9
    assert [r.language for r in aggregate.by_language(files).collect()] == ["Rust", "Python"]
    assert one(aggregate.summary(files.limit(0)))["files"] == 0


def test_duplicates(spark):
    same, other = "a line of eight\n", "another long line\n"
    files = spark.createDataFrame([("a.rs", f"{same}  {same}\nshort\n"), ("b.rs", f"{same}{other}short\n"), ("c.md", other)], "path string, content string")
    a = analyze.analyze(files)
    assert {r.path: r.duplicate_lines for r in a.file_stats.collect()} == {"a.rs": 2, "b.rs": 2, "c.md": 0}
    assert a.uloc.first().uloc == 3


def test_file_filters(spark):
    rows = [("a.rs", b"fn a() {}\n"), ("b.rs", b"fn a() {}\n"), ("bin.rs", b"fn\0\n"), ("gen.rs", b"// Code Generated by x\n"), ("min.js", b"x" * 600 + b"\n"), ("what.zzz", b"?"), ("bom.rs", b"\xef\xbb\xbf// c\n"), ("long.rs", b"x;\n" * 9), ("bad.rs", b"\xff\xfe x\n")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    a = analyze.analyze(df, options=analyze.Options(no_duplicates=True, no_min_gen=True, max_lines=8))
    got = {r.path: r for r in a.file_stats.collect()}
    assert set(got) == {"a.rs", "bom.rs", "bad.rs"} and got["bom.rs"].size == 5 and got["bom.rs"].lines.comment == 1
    assert one(a.counters) == {"scanned": 5, "skipped": 4, "errors": 0}
    only = analyze.analyze(df, options=analyze.Options(languages=["javascript"]))
    assert [r.path for r in only.file_stats.collect()] == ["min.js"]


def test_rules_on_both_sides(spark):
    names = ["src/a.rs", "target/x.rs", "a/node_modules/b.js", "x.egg-info/y", "docs/a.md", "docs/sub/b.md", ".git/c", "deep/a/b/c/d.rs", "build.rs"]
    for rules in (filters.PathRules(), filters.PathRules(everything=True), filters.PathRules(smart=False, excludes=["*.md"]), filters.PathRules.parse(includes="docs/**,*.rs"), filters.PathRules.parse(exclude_dirs="^sub$", exclude_files="build"), filters.PathRules.parse(excludes="docs")):
        kept = [r[0] for r in spark.createDataFrame([(n,) for n in names], "path string").where(rules.keeps(F.col("path"))).collect()]
        above = lambda n: ["/".join(n.split("/")[:i]) for i in range(1, n.count("/") + 1)]
        assert kept == [n for n in names if all(rules.keeps_dir(d) for d in above(n)) and rules.keeps_file(n)], rules
    assert [r[0] for r in filters.without_submodules(spark.createDataFrame([("lib/a",), ("library/a",)], "path string"), ["lib"]).collect()] == ["library/a"]


def test_history(spark):
    log = [(1, "bob", 10, "hot.rs", 5, 1), (1, "bob", 10, "hot.rs", 2, 0), (2, "al", 20, "hot.rs", 0, 0), (3, "al", 30, "gone.rs", 9, 9), (3, "al", 30, "hot.rs", 6, 0), (4, "al", 40, "./warm.rs", 1, 1), (5, "zed", 50, "tie.rs", 1, 0), (6, "amy", 60, "tie.rs", 1, 0)]
    df = spark.createDataFrame(log, "commit long, author string, ts long, path string, added long, deleted long")
    churn = {r.path: (r.commits, r.lines_added, r.lines_deleted, r.last_commit_ts) for r in history.churn(df).collect()}
    assert churn["hot.rs"] == (3, 13, 1, 30) and churn["gone.rs"] == (1, 9, 9, 30)
    owners = {r.path: (r.authors, r.main_author, r.ownership) for r in history.ownership(df).collect()}
    assert owners["hot.rs"] == (2, "al", 0.5) and owners["tie.rs"][1] == "amy"  # of equals, the first by name
    files = stats(spark, [file("hot.rs", 9, 9, 0, 0, 9, 1, 40, 1, 1), file("warm.rs", 9, 9, 0, 0, 9, 1, 10, 1, 1)])
    fifty = history.churn(df).withColumn("commits", F.when(F.col("path") == "hot.rs", 50).otherwise(F.col("commits")))
    spots = history.with_ages(history.with_knowledge(history.hotspots(fifty, files), history.ownership(df)), history.first_commits(df), F.lit(86_400 * 3 + 10)).collect()
    assert [r.path for r in spots] == ["hot.rs", "./warm.rs"] and abs(spots[0].score - math.sqrt((1 - 2**-5) * (1 - 2 ** -(40 / 15)))) < 1e-12
    assert spots[0].risk == "HIGH" and not spots[0].knowledge_island and spots[0].age_days == 3


def test_function_touches(spark):
    spans = spark.createDataFrame([("f", "alpha", 1, 10), ("f", "beta", 11, 30), ("g", "alpha", 1, 500)], "path string, name string, start_line long, end_line long")
    hunks = spark.createDataFrame([("f", 1, 5, 2), ("f", 2, 9, 5), ("f", 3, 25, 1), ("f", 3, 28, 2), ("f", 4, 100, 3), ("g", 5, 64, 0), ("g", 5, 65, 200)], "path string, commit long, start long, len long")
    assert {(r.path, r.name): r.commits for r in history.function_touches(spans, hunks).collect()} == {("f", "alpha"): 2, ("f", "beta"): 2, ("g", "alpha"): 1}


def test_coupling(spark):
    rows = [(c, p) for c in range(5) for p in ("a.rs", "b.rs")] + [(9, "a.rs")] + [(10 + c, f"bulk{i}.rs") for c in range(6) for i in range(40)]
    df = spark.createDataFrame([(c, "x", 0, p, 1, 0) for c, p in rows], "commit long, author string, ts long, path string, added long, deleted long")
    got = [tuple(r) for r in history.coupling(df).collect()]
    assert [g[:5] for g in got] == [("a.rs", "b.rs", 5, 6, 5)] and abs(got[0][5] - 90.909) < 0.001
    assert history.coupling(df, focus="b.rs").count() == 1 and history.coupling(df, focus="z").count() == 0 and history.coupling(df, min_degree=95).count() == 0
    assert history.coupling(df, universe=spark.createDataFrame([("a.rs",)], "path string")).count() == 0
    assert tuple(history.coupling_totals(df, df.select("commit").distinct()).first()) == (12, 6)


def test_renames_in_tables(spark):
    changes = spark.createDataFrame([(1, "c"), (3, "b"), (5, "a"), (2, "a"), (4, "x")], "seq long, path string")
    renames = spark.createDataFrame([(2, "b", "c"), (4, "a", "b")], "seq long, old string, new string")
    assert sorted((r.seq, r.path) for r in history.resolve_renames(changes, renames).collect()) == [(1, "c"), (2, "a"), (3, "c"), (4, "x"), (5, "c")]


def test_estimates(spark):
    t = spark.createDataFrame([(10_000, 0)], "code long, cyclomatic long")
    got = {r.model: r for r in estimate.estimate_all(t).collect()}
    assert abs(got["COCOMO Basic"].effort_months - 26.93) < 0.1 and abs(got["COCOMO Basic"].schedule_months - 8.74) < 0.2 and abs(got["COCOMO Basic"].cost - 303_222) < 500
    assert abs(got["COCOMO II"].effort_months - 37.01) < 0.5 and abs(got["COCOMO II"].schedule_months - 11.6) < 0.5
    assert abs(got["Putnam (SLIM)"].effort_months - 75.1) < 1 and abs(got["Putnam (SLIM)"].schedule_months - 8.82) < 0.2
    assert abs(got["LOCOMO"].effort_months - 0.104) < 0.01
    none = {r.model: r for r in estimate.estimate_all(spark.createDataFrame([(0, 0)], "code long, cyclomatic long")).collect()}
    assert all(r.effort_months == 0 and r.people == 0 for r in none.values())


def test_trend_and_deltas(spark):
    d = {r.metric: r for r in trend.deltas(aggregate.summary(stats(spark, SMALL)), aggregate.summary(stats(spark, SMALL[:1]))).collect()}
    assert d["files"].delta == 0 and d["files"].signed == -2 and abs(d["code"].percent + 92) < 1e-9
    rows = {r.language: r.status for r in trend.language_trend(stats(spark, SMALL), stats(spark, TREE)).collect()}
    assert rows == {"Rust": "changed", "Python": "added"}
    up = value(spark, scores.delta(F.lit(0), F.lit(5)))
    assert up.percent == 100 and value(spark, scores.delta(F.lit(0), F.lit(0))).percent == 0


def test_formats(spark):
    assert [formats.py_bytes(x) for x in (5, 2048, 3 << 20)] == ["5 B", "2.00 KB", "3.00 MB"] and formats.py_tokens(12_300) == "≈12.3K"
    assert [value(spark, formats.age_text(F.lit(d))) for d in (12, 150, 766)] == ["12d", "5mo", "2.1y"]
    assert formats.csv_field('a,"b"') == '"a,""b"""'
