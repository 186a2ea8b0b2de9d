"""Version-control history: churn, ownership, hotspots, ages, function touches and change coupling.

commit_files rows: commit, author, ts (seconds), path, added, deleted; commits rows: commit, author, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions import paths, scores
from tallystone.sources.work import work_table

ISLAND_OWNERSHIP, DAY = 0.75, 86_400
MIN_SHARED, MIN_DEGREE, MAX_CHANGESET = 5, 30.0, 30


def since(commits: DataFrame, start: Column) -> DataFrame:
    """Rows from a time on; start in epoch seconds."""
    return commits.where(F.col("ts") >= start)


def _once(commit_files: DataFrame) -> DataFrame:
    """A row for each commit and path; renames can leave several."""
    return commit_files.groupBy("commit", "path").agg(F.min("author").alias("author"), F.max("ts").alias("ts"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def churn(commit_files: DataFrame) -> DataFrame:
    """path, commits, lines_added, lines_deleted, last_commit_ts."""
    return _once(commit_files).groupBy("path").agg(F.count("*").alias("commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.greatest(F.max("ts"), F.lit(0)).alias("last_commit_ts"))


def ownership(commit_files: DataFrame) -> DataFrame:
    """path, authors, main_author and ownership, the main author's share of added lines plus one a commit."""
    by_author = _once(commit_files).groupBy("path", "author").agg(F.sum(F.col("added") + 1).alias("points"))
    best = F.min(F.struct((-F.col("points")).alias("less"), "author", "points"))
    owned = by_author.groupBy("path").agg(F.count("*").alias("authors"), best.alias("best"), F.sum("points").alias("all"))
    return owned.select("path", "authors", F.col("best.author").alias("main_author"), scores.ratio(F.col("best.points"), F.col("all")).alias("ownership"))


def first_commits(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("path").agg(F.min("ts").alias("first_ts"))


def hotspots(churned: DataFrame, files: DataFrame, top: int | None = 20) -> DataFrame:
    """Files that change often and are complex, the highest score first; files without statistics are gone."""
    stats = files.select(paths.relative(F.col("path")).alias("_path"), "language", F.col("complexity.cyclomatic").alias("cyclomatic"))
    rows = churned.withColumn("_path", paths.relative(F.col("path"))).join(stats, "_path").drop("_path")
    rows = rows.withColumn("lines_churn", F.col("lines_added") + F.col("lines_deleted")).withColumn("score", scores.hotspot_score(F.col("commits"), F.col("cyclomatic")))
    rows = rows.withColumn("risk", scores.risk(F.col("score"))).orderBy(F.desc("score"), F.desc("commits"), paths.components(F.col("path")))
    return rows if top is None else rows.limit(top)


def with_knowledge(spots: DataFrame, owners: DataFrame) -> DataFrame:
    """Hotspots with authors; knowledge_island: a risk above LOW that one author mostly owns."""
    own = owners.withColumnRenamed("path", "_path")
    rows = spots.join(own, paths.relative(F.col("path")) == F.col("_path"), "left").drop("_path")
    return rows.withColumn("knowledge_island", (F.col("risk") != "LOW") & (F.col("ownership") >= ISLAND_OWNERSHIP))


def with_ages(spots: DataFrame, first: DataFrame, now: Column) -> DataFrame:
    own = first.withColumnRenamed("path", "_path")
    rows = spots.join(own, paths.relative(F.col("path")) == F.col("_path"), "left").drop("_path")
    return rows.withColumn("age_days", F.floor(F.greatest(now - F.col("first_ts"), F.lit(0)) / DAY)).drop("first_ts")


def function_touches(spans: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """spans (path, name, start_line, end_line) with commits, the number of commits with a hunk (start, len) in them.

    A range join: both sides are cut at multiples of `width` lines and joined by path and strip, so only neighbours meet.
    """
    strips = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))).alias("strip")
    key = ["path", "name", "start_line", "end_line"]
    changed = hunks.select("path", "commit", "start", (F.col("start") + F.greatest(F.col("len") - 1, F.lit(0))).alias("end")).distinct()
    changed = changed.select("*", strips(F.col("start"), F.col("end")))
    cut = spans.select(*key, strips(F.col("start_line"), F.col("end_line")))
    hit = cut.join(changed, ["path", "strip"]).where("start <= end_line and `end` >= start_line").select(*key, "commit").distinct()
    counts = hit.groupBy(*key).agg(F.count("*").alias("commits"))
    return spans.select(*key).join(counts, key, "left").select(*key, F.coalesce("commits", F.lit(0)).alias("commits"))


def function_hotspots(touched: DataFrame, files: int = 10, functions: int = 5, order: Column | None = None) -> DataFrame:
    """The most touched functions of each file: rows of function_touches with cyclomatic and position (of the file)."""
    w = Window.partitionBy("path").orderBy(F.desc("commits"), F.desc("cyclomatic"), "start_line")
    near = touched if order is None else touched.where(order < files)
    return near.where("commits > 0").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= functions).drop("_n")


def changesets(commit_files: DataFrame, universe: DataFrame | None = None, include_tests: bool = True) -> tuple[DataFrame, DataFrame]:
    """(commit, path) once each within the universe, and (commit, size) of all paths a commit touched."""
    once = commit_files.select("commit", "path").distinct()
    sizes = once.groupBy("commit").agg(F.count("*").alias("size"))
    if universe is not None:
        once = once.join(universe.select("path").distinct(), "path", "left_semi")
    return (once if include_tests else once.where(~paths.is_test_path(F.col("path")))), sizes


def coupling(commit_files: DataFrame, universe: DataFrame | None = None, min_shared: int = MIN_SHARED, min_degree: float = MIN_DEGREE, max_changeset: int = MAX_CHANGESET, focus: str | None = None, include_tests: bool = True, top: int | None = 20) -> DataFrame:
    """Pairs of files that commits change together: file_a, file_b, shared_commits, commits_a, commits_b, degree.

    Only commits of at most max_changeset files make pairs, so a commit gives at most max_changeset**2 / 2 of them.
    """
    tests_too = include_tests or (focus is not None and _test_name(focus))
    once, sizes = changesets(commit_files, universe, tests_too)
    per_file = once.groupBy("path").agg(F.count("*").alias("n"))
    small = once.join(sizes.where(F.col("size").between(2, max_changeset)).select("commit"), "commit")
    small = small.withColumn("key", paths.components(F.col("path")))
    a, b = small.select("commit", F.col("path").alias("file_a"), F.col("key").alias("key_a")), small.select("commit", F.col("path").alias("file_b"), F.col("key").alias("key_b"))
    if focus is not None:
        near = F.lit(focus)
        pairs = a.join(b, "commit").where("key_a < key_b").where((F.col("file_a") == near) | (F.col("file_b") == near))
    else:
        pairs = a.join(b, "commit").where("key_a < key_b")
    shared = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("shared_commits")).where(F.col("shared_commits") >= min_shared)
    side = lambda name: per_file.select(F.col("path").alias(f"file_{name}"), F.col("n").alias(f"commits_{name}"))
    rows = shared.join(side("a"), "file_a").join(side("b"), "file_b")
    rows = rows.withColumn("degree", F.col("shared_commits") / ((F.col("commits_a") + F.col("commits_b")) / 2.0) * 100).where(F.col("degree") >= min_degree)
    rows = rows.select("file_a", "file_b", "shared_commits", "commits_a", "commits_b", "degree")
    rows = rows.orderBy(F.desc("degree"), F.desc("shared_commits"), paths.components(F.col("file_a")), paths.components(F.col("file_b")))
    return rows if top is None else rows.limit(top)


def _test_name(path: str) -> bool:
    """is_test_path() for one path on the driver."""
    *dirs, name = path.split("/")
    stem, dot, ext = name.rpartition(".")
    ext = ext.lower()
    if name == "conftest.py" or any(d.lower() in paths.TEST_DIRS for d in dirs):
        return True
    named = stem.endswith(tuple(paths.TEST_STEM_ENDS)) or (ext == "py" and stem.startswith("test_")) or (ext == "rb" and stem.endswith("_spec"))
    return bool(dot and stem) and (named or (ext in paths.CLASS_SUFFIX_EXTENSIONS and stem.endswith(("Test", "Tests"))))


def coupling_totals(commit_files: DataFrame, commits: DataFrame, max_changeset: int = MAX_CHANGESET) -> DataFrame:
    """total_commits and skipped_large_commits, in one row."""
    _, sizes = changesets(commit_files)
    skipped = sizes.agg(F.count_if(F.col("size") > max_changeset).alias("skipped_large_commits"))
    return commits.agg(F.count("*").alias("total_commits")).crossJoin(skipped)  # a row each


def resolve_renames(changes: DataFrame, renames: DataFrame, max_steps: int = 100) -> DataFrame:
    """changes (seq, path, ...) with each path under its newest name; renames: (seq, old, new). Smaller seq is newer.

    A path is renamed by the oldest rename of it that is newer than its row, and so on; a name that comes to life again
    after a rename keeps its own later rows. Chains are resolved on the distinct (path, seq) by repeated joins, each step
    written to the shared folder; a chain of over max_steps renames is an error.
    """
    steps = work_table(renames.select(F.col("old").alias("path"), F.col("new").alias("_new"), F.col("seq").alias("_at")), "renames")
    rows = work_table(changes.select(F.col("path").alias("_from"), F.col("seq").alias("_seq")).distinct().select("*", F.col("_from").alias("path"), F.col("_seq").alias("_upto")), "names")
    done = None
    for _ in range(max_steps):
        hit = rows.join(steps, "path").where("_at < _upto").groupBy("_from", "_seq").agg(F.max(F.struct("_at", "_new")).alias("_to"))
        moved = work_table(rows.join(hit, ["_from", "_seq"], "left").select("_from", "_seq", F.coalesce("_to._new", "path").alias("path"), F.coalesce("_to._at", "_upto").alias("_upto"), F.col("_to").isNotNull().alias("_open")), "names")
        ended = moved.where("not _open").drop("_open")
        done = ended if done is None else done.unionByName(ended)
        rows = moved.where("_open").drop("_open")
        if rows.isEmpty():
            break
    else:
        raise RuntimeError(f"a path was renamed over {max_steps} times")
    names = done.select(F.col("_from").alias("path"), F.col("_seq").alias("seq"), F.col("path").alias("_name"))
    return changes.join(names, ["path", "seq"], "left").withColumn("path", F.col("_name")).select(*changes.columns)
