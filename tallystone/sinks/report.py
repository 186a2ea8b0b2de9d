"""A report: its kind and its small tables, collected to the driver when the report is made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = ("analysis", "health", "hotspot", "coupling", "diff", "trend", "estimate", "comparison", "combined")
# Names of the dimensions for people.
DIMENSION_NAMES = {"complexity": "Complexity", "func_size": "Func Size", "comment_ratio": "Comment %", "file_size": "File Size", "nesting_depth": "Nesting", "duplication": "Duplication"}


@dataclass
class Report:
    """tables: rows by name, as in the operators' results. values: single facts such as since, model or baseline."""

    kind: str
    tables: dict[str, list[dict]] = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    parts: list[Report] = field(default_factory=list)

    def rows(self, name: str) -> list[dict]:
        return self.tables.get(name, [])

    def one(self, name: str) -> dict:
        return self.rows(name)[0] if self.rows(name) else {}

    def part(self, kind: str) -> Report | None:
        return self if self.kind == kind else next((p for p in self.parts if p.kind == kind), None)


def collected(kind: str, frames: dict[str, DataFrame | None], **values) -> Report:
    """A report of DataFrames that are as small as reports are: totals, and rows by language, or the first few of a list."""
    return Report(kind, {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in frames.items() if df is not None}, values)


def combined(*parts: Report) -> Report:
    return Report("combined", parts=list(parts))
