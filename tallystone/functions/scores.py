"""Scores: curves, grades, confidence, hotspot risk, deltas and size classes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scoring models. Per dimension: weight and breakpoints (metric, score). The order is that of reports and ties.
DIMENSIONS = ["complexity", "func_size", "comment_ratio", "file_size", "nesting_depth", "duplication"]
V1 = {
    "complexity": (0.25, [(0, 100), (3, 100), (6, 80), (10, 60), (15, 40), (25, 20)]),
    "func_size": (0.20, [(0, 100), (15, 100), (30, 80), (50, 60), (80, 40), (150, 20)]),
    "comment_ratio": (0.10, [(0, 40), (0.03, 70), (0.05, 100), (0.30, 100), (0.50, 70), (0.80, 40)]),
    "file_size": (0.20, [(0, 100), (200, 100), (400, 80), (600, 60), (1000, 40), (2000, 20)]),
    "nesting_depth": (0.15, [(0, 100), (3, 100), (4, 80), (6, 60), (8, 40), (12, 20)]),
    "duplication": (0.10, [(0, 100), (0.30, 100), (0.40, 80), (0.50, 60), (0.60, 40), (0.75, 20)]),
}
V2 = {
    "complexity": (0.30, [(0, 100), (3, 100), (6, 80), (10, 60), (15, 35), (25, 10), (40, 1)]),
    "func_size": (0.20, [(0, 100), (15, 100), (30, 80), (50, 60), (80, 35), (150, 10), (300, 1)]),
    "comment_ratio": (0.05, [(0, 60), (0.03, 80), (0.05, 100), (0.30, 100), (0.50, 80), (0.80, 60)]),
    "file_size": (0.20, [(0, 100), (200, 100), (400, 80), (600, 60), (1000, 35), (2000, 10), (4000, 1)]),
    "nesting_depth": (0.05, [(0, 100), (2, 100), (3, 85), (4, 65), (6, 35), (8, 10), (12, 1)]),
    "duplication": (0.20, [(0, 100), (0.25, 100), (0.35, 80), (0.45, 60), (0.60, 30), (0.75, 10), (0.90, 1)]),
}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
# Bytes to a token by kind of language, names in lower case.
TOKEN_BYTES = [
    (4.0, ["markdown", "text", "restructuredtext", "asciidoc", "org"]),
    (3.3, ["rust", "go", "c", "c++", "c header", "c++ header", "zig"]),
    (3.4, ["javascript", "typescript", "jsx", "tsx"]),
    (3.0, ["json", "yaml", "toml", "ini", "xml"]),
    (3.1, ["html", "css", "scss", "sass", "less", "svg"]),
]
DEFAULT_TOKEN_BYTES = 3.5
# Upper ends of the size classes in bytes.
SIZE_CLASSES = [("tiny", 1 << 10), ("small", 10 << 10), ("medium", 100 << 10), ("large", 1 << 20), ("huge", None)]
CONTEXT_WINDOWS = {"fits_200k": 200_000, "fits_1m": 1_000_000}


class Model:
    """A scoring model: weights and curves of its dimensions. Other models subclass it and return Columns."""

    def __init__(self, version: int = 2, duplication: bool = True):
        table = V2 if version == 2 else V1
        self.version = version
        self.name = "default" + ("-v2" if version == 2 else "") + ("" if duplication else "-no-dup")
        self.weights = {d: table[d][0] for d in DIMENSIONS if duplication or d != "duplication"}
        self.curves = {d: table[d][1] for d in self.weights}

    def score(self, dimension: str, metric: Column | str) -> Column:
        return curve(metric, self.curves[dimension])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def curve(x: Column | str, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear between the points, flat outside; 1 for values that are no number, 50 without points.

    x: a column or its name. The SQL text is one call to the JVM instead of several a point.
    """
    if not points:
        return F.lit(50.0)
    if not isinstance(x, str):
        x = x.cast("double")
        out = F.when(~finite(x), 1.0).when(x <= float(points[0][0]), float(points[0][1]))
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            out = out.when(x <= float(x1), float(y0) + (x - float(x0)) / float(x1 - x0) * float(y1 - y0))
        return out.otherwise(float(points[-1][1]))
    v = f"CAST({x} AS DOUBLE)"
    parts = [f"WHEN {v} IS NULL OR isnan({v}) OR abs({v}) = double('infinity') THEN 1D", f"WHEN {v} <= {float(points[0][0])}D THEN {float(points[0][1])}D"]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        parts.append(f"WHEN {v} <= {float(x1)}D THEN {float(y0)}D + ({v} - {float(x0)}D) / {float(x1 - x0)!r}D * {float(y1 - y0)}D")
    return F.expr(f"CASE {' '.join(parts)} ELSE {float(points[-1][1])}D END")


def grade(score: Column) -> Column:
    s = score + 1e-9
    out = F.when(~finite(score), "F")
    for least, letter in GRADES:
        out = out.when(s >= float(least), letter)
    return out.otherwise("F")


def confidence_level(coverage: Column) -> Column:
    return F.when(coverage >= 0.80, "high").when(coverage >= 0.60, "medium").otherwise("low")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    """top / bottom, or otherwise where bottom is not above 0."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(otherwise)


def hotspot_score(commits: Column, cyclomatic: Column) -> Column:
    rise = lambda x, half: 1 - F.pow(F.lit(2.0), -x.cast("double") / half)
    return F.sqrt(rise(commits, 10.0) * rise(cyclomatic, 15.0))


def risk(score: Column) -> Column:
    return F.when(score >= 0.70, "HIGH").when(score >= 0.40, "MED").otherwise("LOW")


def delta(before: Column, after: Column) -> Column:
    """struct(before, after, delta (not below 0), signed, percent)."""
    percent = F.when(before != 0, (after - before).cast("double") / before.cast("double") * 100).when(after > 0, 100.0).otherwise(0.0)
    return F.struct(before.alias("before"), after.alias("after"), F.greatest(after - before, F.lit(0)).alias("delta"), (after - before).alias("signed"), percent.alias("percent"))


def size_class(size: Column) -> Column:
    out = F.when(size < SIZE_CLASSES[0][1], SIZE_CLASSES[0][0])
    for name, end in SIZE_CLASSES[1:-1]:
        out = out.when(size < end, name)
    return out.otherwise(SIZE_CLASSES[-1][0])


def estimated_tokens(language: Column, size: Column) -> Column:
    name, per = F.lower(language), F.lit(None)
    for each, names in reversed(TOKEN_BYTES):
        per = F.when(name.isin(names), each).otherwise(per)
    return F.round(size.cast("double") / F.coalesce(per, F.lit(DEFAULT_TOKEN_BYTES))).cast("long")


def p90(histogram: Column) -> Column:
    """Of a group's values the one at index ceil((n - 1) * 0.9) of their order. histogram: array of (value, n)."""
    n = F.aggregate(histogram, F.lit(0).cast("long"), lambda acc, h: acc + h["n"])
    index = F.ceil((n - 1).cast("double") * 0.9)
    step = lambda acc, h: F.struct((acc["seen"] + h["n"]).alias("seen"), F.when(acc["value"].isNotNull(), acc["value"]).when(acc["seen"] + h["n"] > index, h["value"]).alias("value"))
    none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value"))
    return F.coalesce(F.aggregate(F.sort_array(histogram), none, step)["value"], F.lit(0))


def dryness(unique: Column, non_blank: Column) -> Column:
    return ratio(unique * 100, non_blank, 100.0)


def test_ratio(test_code: Column, code: Column) -> Column:
    """Test code per other code; null without test code."""
    return F.when(test_code > 0, ratio(test_code, code - test_code))
