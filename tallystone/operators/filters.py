"""Which files are analysed: patterns, tool and build directories, version-control data, attributes, depth.

Each filter is a column over the path of a file; the same rules decide on the driver which directories are not walked.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import paths

# Directories of version control, of tools, and of builds and dependencies.
VCS_DIRS = [".git", ".svn", ".hg", ".bzr", "_darcs"]
TOOL_DIRS = (
    ".git .svn .hg .bzr __pycache__ .pytest_cache .mypy_cache .ruff_cache .coverage .tox .nox .eggs *.egg-info .cache .parcel-cache .next .nuxt .output .vercel .netlify .turbo coverage .nyc_output "
    ".gradle .idea .vscode .vs *.xcodeproj *.xcworkspace DerivedData Pods"
).split()
BUILD_DIRS = "node_modules vendor target build dist out bin obj bower_components jspm_packages .bundle venv .venv virtualenv".split()


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression that must match a whole path. '*' and '?' match slashes too; '**/' may be nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(glob_regex(x) for x in pattern[i + 1 : end].split(",")) + ")")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _split(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


@dataclass
class PathRules:
    """What to keep. includes and excludes are globs, the others regular expressions; depth 0 or None has no limit."""

    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    include_files: list[str] = field(default_factory=list)
    exclude_files: list[str] = field(default_factory=list)
    exclude_dirs: list[str] = field(default_factory=list)
    smart: bool = True
    everything: bool = False
    depth: int | None = None

    @classmethod
    def parse(cls, includes=None, excludes=None, include_files=None, exclude_files=None, exclude_dirs=None, **rest):
        return cls(_split(includes), _split(excludes), _split(include_files), _split(exclude_files), _split(exclude_dirs), **rest)

    def excluded_dirs(self) -> list[str]:
        return VCS_DIRS if self.everything else TOOL_DIRS + BUILD_DIRS if self.smart else []

    # on the driver ------------------------------------------------------------------------------------------------

    @staticmethod
    def _tails(path: str) -> list[str]:
        parts = [p for p in path.split("/") if p not in ("", ".")]
        return [path, *("/".join(parts[i:]) for i in range(len(parts)))]

    def _globs(self, patterns: list[str], path: str) -> bool:
        return any(re.fullmatch(glob_regex(g), t, re.S) for g in patterns for t in self._tails(path))

    def _regexes(self, patterns: list[str], path: str) -> bool:
        return any(re.search(r, t) for r in patterns for t in self._tails(path))

    def keeps_dir(self, path: str) -> bool:
        """Whether a directory is walked."""
        name = path.rsplit("/", 1)[-1]
        if any(re.fullmatch(glob_regex(d), name) for d in self.excluded_dirs()):
            return False
        if self._globs(self.includes, path) or self.includes or self.include_files:
            return True
        return not (self._globs(self.excludes, path) or self._regexes(self.exclude_dirs, path))

    def keeps_file(self, path: str) -> bool:
        if self._globs(self.includes, path) or self._regexes(self.include_files, path):
            return True
        if self.includes or self.include_files:
            return False
        return not (self._globs(self.excludes, path) or self._regexes(self.exclude_files, path))

    # as columns ---------------------------------------------------------------------------------------------------

    def keeps(self, path: Column) -> Column:
        """Whether a file is kept, the directories above it included."""
        tails = paths.suffixes(path)
        parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
        dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(dirs), F.lit(1))), lambda i: F.array_join(F.slice(dirs, 1, i), "/"))
        no = F.lit(False)
        some = lambda tests: reduce(lambda a, b: a | b, tests, no)
        match = lambda over, regex: F.exists(over, lambda t: t.rlike(regex))
        globs = lambda patterns, over: some([match(over, "(?s)^" + glob_regex(g) + "$") for g in patterns])
        regexes = lambda patterns, over: some([match(over, r) for r in patterns])
        keep = F.lit(True)
        if skipped := self.excluded_dirs():
            named = F.array(*(F.lit(d) for d in skipped if "*" not in d))
            keep = keep & ~(F.arrays_overlap(dirs, named) | globs([d for d in skipped if "*" in d], dirs))
        included = globs(self.includes, tails) | regexes(self.include_files, tails)
        if self.includes or self.include_files:
            keep = keep & included
        else:
            up = F.flatten(F.transform(above, paths.suffixes))
            has_dirs = F.size(dirs) > 0
            keep = keep & ~(globs(self.excludes, tails) | (has_dirs & globs(self.excludes, up)) | (has_dirs & regexes(self.exclude_dirs, up)) | regexes(self.exclude_files, tails))
        if self.depth:
            keep = keep & (F.size(parts) <= self.depth)
        return keep


def keep_languages(files: DataFrame, names: list[str]) -> DataFrame:
    return files.where(F.lower("language").isin([n.lower() for n in names])) if names else files


def keep_lines(files: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Files with a number of lines in bounds."""
    out = files if least is None else files.where(F.col("lines.total") >= least)
    return out if most is None else out.where(F.col("lines.total") <= most)


def without_submodules(files: DataFrame, submodules: list[str]) -> DataFrame:
    """Files outside the directories of submodules."""
    p = paths.relative(F.col("path"))
    inside = reduce(lambda a, b: a | b, [F.startswith(p, F.lit(s.strip("/") + "/")) for s in submodules], F.lit(False))
    return files.where(~inside)
