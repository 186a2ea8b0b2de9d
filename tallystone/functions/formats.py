"""Texts for people: sizes, numbers, tokens, money, ages, and quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_text(size: Column) -> Column:
    s = size.cast("double")
    return (
        F.when(size < 1 << 10, F.format_string("%d B", size))
        .when(size < 1 << 20, F.format_string("%.2f KB", s / (1 << 10)))
        .when(size < 1 << 30, F.format_string("%.2f MB", s / (1 << 20)))
        .otherwise(F.format_string("%.2f GB", s / (1 << 30)))
    )


def age_text(days: Column) -> Column:
    return F.when(days >= 365, F.format_string("%.1fy", days / 365.0)).when(days >= 60, F.format_string("%dmo", F.floor(days / 30))).otherwise(F.format_string("%dd", days))


def py_bytes(size: float) -> str:
    for unit, scale in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)):
        if size >= scale:
            return f"{size / scale:.2f} {unit}"
    return f"{size} B"


def py_number(n: int) -> str:
    return f"{n:,}"


def py_tokens(n: int) -> str:
    if n >= 1_000_000:
        return f"≈{n / 1_000_000:.1f}M"
    return f"≈{n / 1_000:.1f}K" if n >= 1_000 else f"≈{n}"


def py_money(x: float) -> str:
    if x >= 1_000_000:
        return f"{x / 1_000_000:.2f}M"
    return f"{x:.0f}" if x >= 1_000 else f"{x:.2f}"


def csv_field(x) -> str:
    s = "" if x is None else str(x)
    return '"' + s.replace('"', '""') + '"' if any(c in s for c in ',"\n\r') else s


def metric_label(x: str) -> str:
    return x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
