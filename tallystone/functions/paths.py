"""Path columns: normal forms, components, ancestors and test paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and names that mark test code.
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs", "testdata"]
TEST_STEM_ENDS = ["_test", ".test", ".spec"]
CLASS_SUFFIX_EXTENSIONS = ["java", "kt", "cs"]


def lexical(path: Column) -> Column:
    """The path without '.' components; '..' and links stay. Identity of files in a scan."""
    parts = F.split(path, "/")
    kept = F.filter(parts, lambda p, i: (p != ".") & ((p != "") | (i == 0)))
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def relative(path: Column) -> Column:
    """The path without one leading './'. Identity in reports and joins."""
    return F.regexp_replace(path, r"^\./+", "")


def components(path: Column) -> Column:
    """The components of a path; ordering by this array orders 'a/b' before 'a-b'."""
    return F.filter(F.split(relative(path), "/"), lambda p, i: (p != "") | (i == 0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, '' if there is none. A leading dot begins no extension."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$|^.+(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    """The directory of a relative path, '.' at the root."""
    p = relative(path)
    up = F.regexp_extract(p, r"(?s)^(.*[^/])/+[^/]*$", 1)
    return F.when(F.startswith(p, F.lit("/")) & (up == ""), "/").when(up == "", ".").otherwise(up)


def ancestors(path: Column, max_depth: int | None = None) -> Column:
    """All directories above a relative file, the topmost first; ['.'] for a file at the root."""
    parts = components(path)
    n = F.size(parts) - 1
    depth = n if max_depth is None else F.least(n, F.lit(max_depth))
    return F.when(n < 1, F.array(F.lit("."))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def suffixes(path: Column) -> Column:
    """The path and every tail of it that starts at a component."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.array(path), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def is_test_path(path: Column) -> Column:
    """Whether a path is test code, by its directories or the name of its file."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    stem = F.regexp_extract(name, r"(?s)^(.+)\.([^.]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"(?s)^(.+)\.([^.]*)$", 2))
    named = (
        F.greatest(*(F.endswith(stem, F.lit(e)) for e in TEST_STEM_ENDS))
        | ((ext == "py") & F.startswith(stem, F.lit("test_")))
        | ((ext == "rb") & F.endswith(stem, F.lit("_spec")))
        | (ext.isin(CLASS_SUFFIX_EXTENSIONS) & (F.endswith(stem, F.lit("Test")) | F.endswith(stem, F.lit("Tests"))))
    )
    return F.arrays_overlap(dirs, F.array(*map(F.lit, TEST_DIRS))) | (name == "conftest.py") | ((stem != "") & named)


def moved(path: Column, folders: dict[str, str]) -> Column:
    """The path with the folder it starts with (or is) replaced, the longest that fits; other paths stay. '' as a new
    folder leaves the rest alone."""
    plain, out = relative(path), None
    for old in sorted(folders, key=len, reverse=True):
        new, own = folders[old].rstrip("/"), old.rstrip("/").removeprefix("./")
        rest = plain if own in ("", ".") else F.substring(plain, F.lit(len(own) + 2), F.length(plain))
        fits = ~F.startswith(plain, F.lit("/")) if own in ("", ".") else F.startswith(plain, F.lit(own + "/")) | (plain == own)
        there = rest if not new else F.when(rest == "", new).otherwise(F.concat(F.lit(new + "/"), rest))
        out = F.when(fits, there) if out is None else out.when(fits, there)
    return plain if out is None else out.otherwise(plain)
