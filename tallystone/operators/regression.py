"""What became worse or better between two sets of file statistics, and whether a gate lets it pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import paths
from tallystone.operators import health as H
from tallystone.operators.aggregate import first_by_path

DROP, SLACK = 5.0, 1e-9


def comparable(before: DataFrame, after: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Both sides with measurement flags that are set only where both sides measured.

    A kind of measurement that no file of one side has is cleared in all files; a file of both sides keeps what both have.
    """
    if version != 2:
        return before, after
    flags = ("functions_measured", "control_flow_measured")
    have = lambda side, name: side.agg(*(F.coalesce(F.bool_or(f"complexity.{f}"), F.lit(False)).alias(f"{name}_{f}") for f in flags))
    both = F.broadcast(have(before, "b").crossJoin(have(after, "a")))  # one row

    def cleared(own: DataFrame, other: DataFrame) -> DataFrame:
        seen = other.select(paths.relative(F.col("path")).alias("_path"), *(F.col(f"complexity.{f}").alias(f"_{f}") for f in flags))
        out = own.withColumn("_path", paths.relative(F.col("path"))).join(seen, "_path", "left").crossJoin(both)
        c = F.col("complexity")
        for f in flags:
            c = c.withField(f, F.col(f"complexity.{f}") & F.coalesce(f"_{f}", F.lit(True)) & F.col(f"b_{f}") & F.col(f"a_{f}"))
        return out.withColumn("complexity", c).select(*own.columns)

    return cleared(before, after), cleared(after, before)


def compare_scored(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each current file (path, score, grade on both sides): status, is_new and both scores.

    'regressed': a worse grade, a drop of five points, or a new file of grade F; 'improved' likewise; else 'unchanged' or 'new'.
    """
    old = before.select(paths.relative(F.col("path")).alias("_path"), F.col("score").alias("from_score"), F.col("grade").alias("from_grade"))
    rows = after.select(F.col("path"), paths.relative(F.col("path")).alias("_path"), F.col("score").alias("to_score"), F.col("grade").alias("to_grade")).join(old, "_path", "left")
    new, drop = F.col("from_score").isNull(), F.col("from_score") - F.col("to_score")
    status = (
        F.when(new & (F.col("to_grade") == "F"), "regressed").when(new, "new")
        .when((F.col("to_grade") > F.col("from_grade")) | (drop >= DROP - SLACK), "regressed")
        .when((F.col("to_grade") < F.col("from_grade")) | (-drop >= DROP - SLACK), "improved").otherwise("unchanged")
    )
    return rows.select("path", status.alias("status"), new.alias("is_new"), F.coalesce("from_score", F.lit(100.0)).alias("from_score"), F.coalesce("from_grade", F.lit("A")).alias("from_grade"), "to_score", "to_grade")


def regressed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """The regressed files, the worst grade and then the lowest score first."""
    return compare_scored(before, after).where("status = 'regressed'").drop("status").orderBy(F.desc("to_grade"), "to_score", paths.components(F.col("path")))


def language_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """A full outer join of language health by name: added, removed, changed (another grade or 0.05 points) or unchanged."""
    side = lambda df, name: df.select("language", F.col("score").alias(f"{name}_score"), F.col("grade").alias(f"{name}_grade"))
    moved = F.col("to_score") - F.col("from_score")
    status = (
        F.when(F.col("from_score").isNull(), "added").when(F.col("to_score").isNull(), "removed")
        .when((F.col("from_grade") != F.col("to_grade")) | (F.abs(moved) >= 0.05), "changed").otherwise("unchanged")
    )
    return side(before, "from").join(side(after, "to"), "language", "full_outer").select("language", status.alias("status"), "from_score", "from_grade", "to_score", "to_grade", moved.alias("score_delta"))


def compare(before: DataFrame, after: DataFrame, version: int = 2, before_regions: DataFrame | None = None, after_regions: DataFrame | None = None, duplication: bool = True) -> H.Reports:
    """project, regressed, files and languages of a comparison with a baseline; regions count only if both sides have them."""
    if before_regions is None or after_regions is None:
        before_regions = after_regions = None
    before, after = comparable(first_by_path(before), first_by_path(after), version)
    old, new = H.health(before, version, before_regions, duplication), H.health(after, version, after_regions, duplication)
    return H.Reports({
        "project": lambda: _project_change(old["project"], new["project"], compare_scored(old["files"], new["files"])),
        "files": lambda: compare_scored(old["files"], new["files"]),
        "regressed": lambda: regressed_files(old["files"], new["files"]),
        "languages": lambda: language_changes(old["languages"], new["languages"]),
    })


def _project_change(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    counts = files.agg(F.count_if(F.col("status") == "regressed").alias("regressed_files"), F.count_if(F.col("status") == "improved").alias("improved_files"))
    side = lambda df, name: df.select(*(F.col(c).alias(f"{name}_{c}") for c in ("score", "grade", "scope", "assessment")))
    rows = side(old, "baseline").crossJoin(side(new, "current")).crossJoin(counts)  # a row each
    changed: Column = (F.col("baseline_scope") != F.col("current_scope")) & F.col("baseline_scope").isin("production", "tests-only") & F.col("current_scope").isin("production", "tests-only")
    worse = ~changed & ((F.col("current_grade") > F.col("baseline_grade")) | (F.col("baseline_score") - F.col("current_score") >= DROP - SLACK))
    rows = rows.withColumns({"scope_changed": changed, "score_delta": F.col("current_score") - F.col("baseline_score"), "project_regressed": worse})
    rows = rows.withColumn("assessment", F.when((F.col("baseline_assessment") == "scored") & (F.col("current_assessment") == "scored"), "scored").otherwise("insufficient-data"))
    rows = rows.withColumn("failed", F.col("project_regressed") | (F.col("regressed_files") > 0)).drop("baseline_assessment", "current_assessment")
    return rows.withColumn("gate_failed", F.col("failed") | (F.col("assessment") == "insufficient-data"))


# What a letter asks for as a threshold.
THRESHOLDS = {"A": 90.0, "B": 80.0, "C": 70.0, "D": 60.0}


def parse_threshold(text: str) -> float:
    """The least score of a gate: A to D, or a number from 0 to 100."""
    if (found := THRESHOLDS.get(text.strip().upper())) is not None:
        return found
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 100:
        raise ValueError(f"a threshold is one of A, B, C, D or a number from 0 to 100, not {text!r}")
    return value


def gate_reason(assessment: str, score: float, threshold: float | None = None, regression: dict | None = None) -> str | None:
    """Why a gate fails, or None. With a threshold, missing data comes first and then the score; then a regression.

    regression: the row of compare()['project'], given if a regression is to fail.
    """
    if threshold is not None and assessment == "insufficient-data":
        return f"score {score:.1f} is an estimate: too little was measured for a threshold"
    if threshold is not None and score < threshold:
        return f"score {score:.1f} is below {threshold:g}"
    if regression is not None and regression["gate_failed"]:
        if regression["assessment"] == "insufficient-data":
            return "too little was measured on both sides for a comparison"
        return "health is worse than in the baseline"
    return None


def scan_reason(n_files: int, n_errors: int) -> str | None:
    """Why a gate fails before anything is scored: unreadable files or no files."""
    if n_errors:
        return f"{n_errors} files could not be read"
    return None if n_files else "no files were analysed"


