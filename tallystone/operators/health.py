"""Health scores and grades of files, directories, languages and projects under both scoring models.

Version 1 scores pooled metrics of all files. Version 2 scores production code file by file, leaves out dimensions that
were not measured, and combines files by the square root of their code with a tenth of the score from the worst files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions import paths, scores
from tallystone.functions.scores import Model
from tallystone.operators.aggregate import first_by_path

# Languages without program code, in lower case.
NON_CODE = ["html", "css", "scss", "sass", "less", "json", "yaml", "toml", "xml", "ini", "csv", "markdown", "restructuredtext", "asciidoc", "latex"]
TAIL, FAILING, ENOUGH, CODE_UNIT = 0.10, 60.0, 0.60, 50
_BINS = 10  # of the score's points, for the weighted tail


class Reports(Mapping):
    """DataFrames by name, each planned when it is asked for, once."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def file_metrics(legacy: bool) -> dict[str, Column]:
    """The metric of each dimension for one file."""
    c = lambda name: F.col(f"complexity.{name}") if not legacy else F.coalesce(f"complexity.legacy_{name}", f"complexity.{name}")
    non_blank = F.greatest(F.col("lines.total") - F.col("lines.blank"), F.lit(0))
    return {
        "complexity": scores.ratio(c("cyclomatic"), c("functions")), "func_size": c("avg_func_lines"), "comment_ratio": scores.ratio(F.col("lines.comment"), F.col("lines.code")),
        "file_size": F.col("lines.total"), "nesting_depth": c("max_depth"), "duplication": scores.ratio(F.col("duplicate_lines"), non_blank),
    }


def pooled_metrics(files: DataFrame, keys: list[str], legacy: bool = True) -> DataFrame:
    """The metrics of groups of files taken together. Depths are counted by value first, for the 90th percentile."""
    c = lambda name: F.col(f"complexity.{name}") if not legacy else F.coalesce(f"complexity.legacy_{name}", f"complexity.{name}")
    sums = {
        "files": F.count("*"), "functions": F.sum(c("functions")), "cyclomatic": F.sum(c("cyclomatic")), "function_lines": F.sum(F.when(c("functions") > 0, c("avg_func_lines") * c("functions")).otherwise(0.0)),
        "code": F.sum("lines.code"), "comment": F.sum("lines.comment"), "total": F.sum("lines.total"), "blank": F.sum("lines.blank"), "duplicate": F.sum("duplicate_lines"),
    }
    by_depth = files.groupBy(*keys, c("max_depth").alias("depth")).agg(*(v.alias(k) for k, v in sums.items()))
    pooled = by_depth.groupBy(*keys).agg(*(F.sum(k).alias(k) for k in sums), F.collect_list(F.struct(F.col("depth").alias("value"), F.col("files").alias("n"))).alias("depths"))
    return pooled.where("files > 0").select(
        *keys, F.col("files").alias("file_count"), F.col("code").alias("code_lines"), scores.ratio(F.col("cyclomatic"), F.col("functions")).alias("complexity"), scores.ratio(F.col("function_lines"), F.col("functions")).alias("func_size"),
        scores.ratio(F.col("comment"), F.col("code")).alias("comment_ratio"), (F.col("total") / F.col("files")).alias("file_size"), scores.p90(F.col("depths")).alias("nesting_depth"),
        scores.ratio(F.col("duplicate"), F.greatest(F.col("total") - F.col("blank"), F.lit(0))).alias("duplication"),
    )


def _staged(files: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, dict[str, str]]:
    """files with a column for each metric, and the names of these columns."""
    names = {d: f"_metric_{d}" for d in metrics}
    return files.withColumns({names[d]: m for d, m in metrics.items()}), names


def _dimension_scores(metrics: dict[str, str], model: Model) -> Column:
    total = sum(model.weights.values())
    each = [F.struct(F.lit(d).alias("dimension"), model.score(d, metrics[d]).alias("score"), F.lit(w / total).alias("weight")) for d, w in model.weights.items()]
    return F.transform(F.array(*each), lambda x: x.withField("grade", scores.grade(x["score"])))


def _total(dimensions: Column) -> Column:
    weighted = F.aggregate(dimensions, F.lit(0.0), lambda acc, d: acc + d["score"] * d["weight"])
    weight = F.aggregate(dimensions, F.lit(0.0), lambda acc, d: acc + d["weight"])
    return F.when(weight > 0, scores.clamp(weighted / weight, 0, 100)).otherwise(0.0)


def measured(dimension: str) -> Column:
    """Whether a file's analysis says anything about a dimension."""
    if dimension in ("complexity", "nesting_depth"):
        return F.col("complexity.control_flow_measured")
    if dimension == "func_size":
        return F.col("complexity.functions_measured") & (F.col("complexity.functions") > 0)
    return F.lit(True)


def coverage(model: Model) -> Column:
    """The share of the model's weight that a file has measurements for."""
    return _add([F.when(measured(d), F.lit(w)).otherwise(0.0) for d, w in model.weights.items()]) / sum(model.weights.values())


def center_weight() -> Column:
    return F.sqrt(F.greatest(F.col("lines.code"), F.lit(1)).cast("double"))


def score_files_v1(files: DataFrame, model: Model) -> DataFrame:
    """files with dimensions, score, grade, top_issue (first of the lowest), coverage and weight."""
    rows, names = _staged(files, file_metrics(True))
    out = rows.withColumn("dimensions", _dimension_scores(names, model)).drop(*names.values()).withColumn("score", _total(F.col("dimensions")))
    lowest = F.array_min(F.transform("dimensions", lambda d, i: F.struct(d["score"], i, d["dimension"].alias("dimension"))))
    return out.select("*", scores.grade(F.col("score")).alias("grade"), lowest["dimension"].alias("top_issue"), coverage(model).alias("coverage"), center_weight().alias("weight"))


def score_files_v2(files: DataFrame, model: Model) -> DataFrame:
    """As score_files_v1, on measured dimensions; top_issue is the dimension that would gain most if it were perfect."""
    metrics = file_metrics(False)
    branches = F.greatest(F.col("complexity.cyclomatic") - F.col("complexity.functions"), F.lit(0))
    units = F.greatest(F.col("complexity.functions"), F.ceil(F.col("lines.code") / CODE_UNIT), F.lit(1))
    metrics["complexity"] = 1.0 + branches / units
    rows, names = _staged(files, metrics)
    each = [F.when(measured(d), F.struct(F.lit(d).alias("dimension"), scores.clamp(model.score(d, names[d]), 0, 100).alias("score"), F.lit(w).alias("weight"))) for d, w in model.weights.items()]
    out = rows.withColumn("dimensions", F.filter(F.array(*each), lambda d: d.isNotNull())).drop(*names.values())
    out = out.withColumn("score", _total(F.col("dimensions")))
    all_weight = F.aggregate("dimensions", F.lit(0.0), lambda acc, d: acc + d["weight"])
    gain = F.array_max(F.transform("dimensions", lambda d, i: F.struct(((100.0 - d["score"]) * d["weight"]).alias("gain"), i, d["dimension"].alias("dimension"))))
    out = out.select("*", scores.grade(F.col("score")).alias("grade"), F.coalesce(gain["dimension"], F.lit("file_size")).alias("top_issue"), coverage(model).alias("coverage"), center_weight().alias("weight"))
    return out.withColumn("dimensions", F.transform("dimensions", lambda d: F.struct(d["dimension"].alias("dimension"), d["score"].alias("score"), (d["weight"] / all_weight).alias("weight"), scores.grade(d["score"]).alias("grade"))))


def tail(scored: DataFrame, keys: list[str]) -> DataFrame:
    """tail_score of groups of scored files: the mean score of the worst tenth of the weight, the last file in part.

    Weights are summed by score class; only files of the class in which the tenth ends are ordered, by their exact score, and
    files of one score count as one. No group is sorted as a whole.
    """
    rows = scored.select(*keys, "score", "weight", F.floor(F.col("score") * _BINS).alias("bin"))
    bins = rows.groupBy(*keys, "bin").agg(F.sum("weight").alias("w"), F.sum(F.col("score") * F.col("weight")).alias("sw"))
    group, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("limit", F.sum("w").over(group) * TAIL).withColumn("before", F.coalesce(F.sum("w").over(so_far), F.lit(0.0)))
    whole = bins.where("before + w <= limit").select(*keys, F.col("sw").alias("part"), F.col("limit"))
    cut = bins.where("before < limit and before + w > limit").select(*keys, "bin", "before", "limit")
    same = lambda a, b, on: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in on])
    ends = rows.alias("r").join(cut.alias("c"), same(rows, cut, [*keys, "bin"])).select(*(F.col(f"r.{k}") for k in keys), "r.score", "r.weight", "c.before", "c.limit")
    ends = ends.groupBy(*keys, "score").agg(F.sum("weight").alias("w"), F.first("before").alias("before"), F.first("limit").alias("limit"))
    inside = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.least(F.col("w"), F.col("limit") - F.col("before") - F.coalesce(F.sum("w").over(inside), F.lit(0.0))), F.lit(0.0))
    parts = whole.unionByName(ends.select(*keys, (F.col("score") * taken).alias("part"), "limit"))
    return parts.groupBy(*keys).agg((F.sum("part") / F.max("limit")).alias("tail_score"))


def _assess(version: int) -> list[Column]:
    return [
        scores.confidence_level(F.col("coverage")).alias("confidence"),
        (F.when(F.col("coverage") < ENOUGH, "insufficient-data").otherwise("scored") if version == 2 else F.lit("scored")).alias("assessment"),
    ]


def group_health(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Score, grade, counts, confidence and tail risk of groups of files scored by version 2."""
    out = _group_sums(scored, keys)
    score = (1 - TAIL) * F.col("center") + TAIL * F.col("tail_score")
    return out.withColumn("score", score).select(*keys, "score", scores.grade(score).alias("grade"), "file_count", "code_lines", "coverage", *_assess(2), *_RISK)


_RISK = ["tail_score", "failing_files", "failing_ratio", "worst_score"]


def _group_sums(scored: DataFrame, keys: list[str]) -> DataFrame:
    one = keys or ["_all"]
    rows = scored if keys else scored.withColumn("_all", F.lit(0))
    w, s = F.col("weight"), F.col("score")
    sums = rows.groupBy(*one).agg(
        F.count("*").alias("file_count"), F.sum("lines.code").alias("code_lines"), (F.sum(s * w) / F.sum(w)).alias("center"), scores.clamp(F.sum(F.col("coverage") * w) / F.sum(w), 0, 1).alias("coverage"),
        F.count_if(s < FAILING).alias("failing_files"), (F.count_if(s < FAILING) / F.count("*")).alias("failing_ratio"), F.min(s).alias("worst_score"),
    )
    return sums.join(tail(rows, one), one).select("*")


def group_dimensions(scored: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """keys, dimension, score, weight and grade: weighted means over the files that have a dimension, weights summing to 1."""
    rows = scored.select(*keys, "weight", F.explode("dimensions").alias("d"))
    w = F.col("weight")
    means = rows.groupBy(*keys, F.col("d.dimension").alias("dimension")).agg((F.sum(F.col("d.score") * w) / F.sum(w)).alias("score"), (F.sum(F.col("d.weight") * w) / F.sum(w)).alias("share"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    return means.withColumn("weight", F.col("share") / F.sum("share").over(whole)).select(*keys, "dimension", "score", "weight", scores.grade(F.col("score")).alias("grade"))


def pooled_health(files: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Score, grade, counts and dimensions of groups of files under version 1."""
    pooled = pooled_metrics(files, keys, legacy=True)
    out = pooled.withColumn("dimensions", _dimension_scores({d: d for d in model.weights}, model)).withColumn("score", _total(F.col("dimensions")))
    return out.select(*keys, "score", scores.grade(F.col("score")).alias("grade"), "file_count", "code_lines", "dimensions")


def worst(rows: DataFrame, path: str, top: int | None) -> DataFrame:
    out = rows.orderBy("score", paths.components(F.col(path)))
    return out if top is None else out.limit(top)


def with_regions(files: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Rows of file_stats that version 2 scores, with region 'production' or 'tests': program code, split at inline tests if
    regions are given.

    regions: path, region ('production' or 'tests'), lines, size, duplicate_lines, complexity.
    """
    columns = ["lines", "size", "duplicate_lines", "complexity"]
    code = files.where(~F.lower("language").isin(NON_CODE)).select("path", "language", *columns)
    is_test = paths.is_test_path(F.col("path"))
    own = F.when(is_test, "tests").otherwise("production")
    if regions is None:
        return code.withColumn("region", own)
    parts = regions.select(F.col("path").alias("_path"), F.col("region").alias("_region"), F.struct(*columns).alias("_part"))
    rows = code.withColumn("_test", is_test).join(parts, ~F.col("_test") & (F.col("path") == F.col("_path")), "left")
    rows = rows.where(F.col("_region").isNull() | (F.col("_part.lines.code") > 0))
    return rows.select("path", "language", *(F.coalesce(f"_part.{c}", c).alias(c) for c in columns), F.coalesce("_region", own).alias("region"))


def common_parent(files: DataFrame) -> DataFrame:
    """One row with depth, the number of components that the parents of all files share."""
    up = F.slice(paths.components(F.col("path")), F.lit(1), F.greatest(F.size(paths.components(F.col("path"))) - 1, F.lit(0)))
    ends = files.agg(F.min(up).alias("lo"), F.max(up).alias("hi"))  # whatever the first and the last share, all share
    same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
    return ends.select(F.when(F.array_position(same, False) == 0, F.size(same)).otherwise(F.array_position(same, False) - 1).cast("int").alias("depth"))


def directories_v2(scored: DataFrame) -> DataFrame:
    """Health of every directory from the common parent of all files downwards; a file counts in each above it."""
    parts = paths.components(F.col("path"))
    deep = F.greatest(F.size(parts) - 1, F.lit(0))
    level = F.sequence(F.least(F.col("_root"), deep), deep)
    up = F.transform(level, lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    rows = scored.crossJoin(F.broadcast(common_parent(scored).withColumnRenamed("depth", "_root")))  # one row
    return group_health(rows.withColumn("directory", F.explode(up)), ["directory"])


def _or_empty(project: DataFrame, version: int, model: Model) -> DataFrame:
    """The project's row, or the row of a report without files."""
    none = {"score": 0.0, "grade": "F", "file_count": 0, "code_lines": 0, "coverage": 0.0, "confidence": "low", "assessment": "insufficient-data" if version == 2 else "scored", "tail_score": 0.0, "failing_files": 0, "failing_ratio": 0.0, "worst_score": 0.0, "model": model.name, "scope": "empty"}
    one = project.sparkSession.range(1).select()
    found = F.col("_found").isNotNull()
    kinds = {c: project.schema[c].dataType for c in project.columns}
    return one.join(project.withColumn("_found", F.lit(1)), F.lit(True), "left").select(*(F.when(found, F.col(c)).otherwise(F.lit(none[c]).cast(kinds[c])).alias(c) for c in project.columns))


def health_v1(files: DataFrame, duplication: bool = True, top: int | None = None) -> Reports:
    """project, files, directories, languages, dimensions and tests under version 1; each path counts once.

    Nothing runs here; who reads several reports persists the files.
    """
    model = Model(1, duplication)
    files = first_by_path(files)
    extra = lambda keys: _group_sums(score_files_v1(files, model), keys).select(*keys, "coverage", *_assess(1), *_RISK)

    def project() -> DataFrame:
        pooled = pooled_health(files, [], model).drop("dimensions").crossJoin(extra([]))  # a row each
        return _or_empty(pooled.withColumns({"model": F.lit(model.name), "scope": F.lit("legacy-all")}), 1, model)

    return Reports({
        "project": project,
        "files": lambda: worst(score_files_v1(files, model), "path", top),
        "directories": lambda: worst(pooled_health(files.withColumn("directory", paths.parent(F.col("path"))), ["directory"], model).drop("dimensions"), "directory", top),
        "languages": lambda: pooled_health(files, ["language"], model).drop("dimensions").join(extra(["language"]), "language").orderBy(F.desc("code_lines"), "language"),
        "dimensions": lambda: pooled_health(files, [], model).select(F.inline("dimensions")).select("dimension", "score", "weight", "grade"),
        "tests": lambda: pooled_health(files.where(paths.is_test_path(F.col("path"))), [], model).drop("dimensions"),
    })


def health_v2(files: DataFrame, regions: DataFrame | None = None, duplication: bool = True, top: int | None = None) -> Reports:
    """project, files, directories, languages, dimensions and tests under version 2; each path counts once.

    Where there is no production code the tests are what is scored, and the scope says so. Nothing runs here; who reads
    several reports persists the files.
    """
    model = Model(2, duplication)
    rows = with_regions(first_by_path(files), regions)
    every = score_files_v2(rows, model)
    # what is scored: production code if there is any; one row, for which the counts of duplicate lines are not needed
    chosen = rows.agg(F.min("region").alias("_chosen"))
    scored = every.join(F.broadcast(chosen), F.col("region") == F.col("_chosen"))

    def project() -> DataFrame:
        found = group_health(scored, []).crossJoin(F.broadcast(chosen))  # a row each
        scope = F.when(F.col("_chosen") == "production", "production").otherwise("tests-only")
        return _or_empty(found.withColumns({"model": F.lit(model.name), "scope": scope}).drop("_chosen"), 2, model)

    return Reports({
        "project": project,
        "files": lambda: worst(scored.drop("region", "_chosen"), "path", top),
        "directories": lambda: worst(directories_v2(scored), "directory", top),
        "languages": lambda: group_health(scored, ["language"]).orderBy(F.desc("code_lines"), "language"),
        "dimensions": lambda: group_dimensions(scored, [], model),
        "tests": lambda: group_health(every.where("region = 'tests'"), []),
    })


def health(files: DataFrame, version: int = 2, regions: DataFrame | None = None, duplication: bool = True, top: int | None = None) -> Reports:
    return health_v2(files, regions, duplication, top) if version == 2 else health_v1(files, duplication, top)
