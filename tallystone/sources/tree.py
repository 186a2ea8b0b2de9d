"""Trees of source files as DataFrames (path, content).

walk() lists a tree on the driver and does not enter ignored or filtered directories; scan_tree() reads what it lists.
scan_distributed() lets Spark list a store of any size and filters by path columns.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.functions import paths
from tallystone.operators.filters import PathRules, glob_regex

#: Names of files that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_FILES = 200_000
IGNORE_FILES, OWN_DIR = (".gitignore", ".tallystoneignore"), ".tallystone"


def _ignore_regex(pattern: str) -> str:
    """An ignore pattern without its marks; here '*' and '?' stop at slashes."""
    out = []
    for part in re.split(r"(\*\*/|/\*\*$|\*\*)", pattern):
        if part == "**/":
            out.append("(?:.*/)?")
        elif part == "/**":
            out.append("/.*")
        elif part == "**":
            out.append(".*")
        else:
            out.append(glob_regex(part).replace(".*", "[^/]*").replace("(?s:.)", "[^/]"))
    return "".join(out)


@dataclass
class IgnoreRules:
    """The rules of one ignore file, for paths relative to its directory."""

    rules: list[tuple[re.Pattern, bool, bool]] = field(default_factory=list)  # pattern, negated, directories only

    @classmethod
    def parse(cls, text: str) -> IgnoreRules:
        out = cls()
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            regex = _ignore_regex(line.removeprefix("/"))
            out.rules.append((re.compile(regex if anchored else "(?:.*/)?" + regex), negated, only_dirs))
        return out

    def decision(self, path: str, is_dir: bool) -> bool | None:
        """True to ignore, False to keep, None if no rule says; the last rule that fits counts."""
        for regex, negated, only_dirs in reversed(self.rules):
            if (is_dir or not only_dirs) and regex.fullmatch(path):
                return not negated
        return None


@dataclass
class Listing:
    files: list[str] = field(default_factory=list)
    counters: Counter = field(default_factory=Counter)


def _outer_rules(root: str) -> list[tuple[str, IgnoreRules]]:
    """Rules from outside a tree: the user's own ignore file for git, and those of the folders above it in its repository, each with
    the part of the tree's path below its folder."""
    found = []
    named = subprocess.run(["git", "config", "--path", "--get", "core.excludesFile"], capture_output=True, text=True).stdout.strip() if shutil.which("git") else ""
    home = Path(named) if named else Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config", "git", "ignore")
    if home.is_file():
        found.append(("", IgnoreRules.parse(home.read_text(errors="replace"))))
    here = Path(root).resolve()
    above = []
    for folder in here.parents:
        if (here / ".git").exists() and not above:
            break  # the tree is a repository itself
        above.append(folder)
        if (folder / ".git").exists():
            for up in reversed(above):
                below = here.relative_to(up).as_posix()
                found += [(below, IgnoreRules.parse(p.read_text(errors="replace"))) for name in IGNORE_FILES if (p := up / name).is_file()]
                if up == folder and (p := up / ".git/info/exclude").is_file():
                    found.append((below, IgnoreRules.parse(p.read_text(errors="replace"))))
            break
    return found


def walk(root: str, rules: PathRules | None = None, ignore: bool = True, ignore_files=IGNORE_FILES, follow_links: bool = False) -> Listing:
    """The files below root that the rules keep, in path order; counts what was filtered and could not be read."""
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    rules, out = rules or PathRules(), Listing()
    if os.path.isfile(root):
        out.files.append(root)
        return out
    outer = _outer_rules(root) if ignore else []

    def enter(folder: str, rel: str, active: list[tuple[str, IgnoreRules]], depth: int) -> None:
        if ignore:
            own = [IgnoreRules.parse(p.read_text(errors="replace")) for name in ignore_files if (p := Path(folder, name)).is_file()]
            if not rel and (extra := Path(folder, ".git/info/exclude")).is_file():
                own.append(IgnoreRules.parse(extra.read_text(errors="replace")))
            active = [*active, *((rel, x) for x in own)]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            out.counters["error"] += 1
            return
        for entry in entries:
            path = f"{rel}/{entry.name}" if rel else entry.name
            is_dir = entry.is_dir(follow_symlinks=follow_links)
            inside = lambda base: path[len(base) + 1 :] if base else path  # noqa: B023, E731
            said = next((d for base, r in reversed(active) if (d := r.decision(inside(base), is_dir)) is not None), None)
            if said is None:
                said = next((d for above, r in reversed(outer) if (d := r.decision(f"{above}/{path}" if above else path, is_dir)) is not None), False)
            if said:
                continue
            if is_dir:
                if entry.name == OWN_DIR or not rules.keeps_dir(path):
                    continue
                if not rules.depth or depth < rules.depth:
                    enter(entry.path, path, active, depth + 1)
            elif entry.is_file(follow_symlinks=follow_links):
                if rules.keeps_file(path):
                    out.files.append(os.path.join(root, path) if root != "." else "./" + path)
                else:
                    out.counters["filtered"] += 1

    enter(root, "", [], 1)
    return out


def read_paths(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, content) of local files; the paths are as given."""
    if not files:
        return spark.createDataFrame([], "path string, content binary")
    given = {os.path.abspath(f): f for f in files}
    rows = spark.read.format("binaryFile").load(list(given))
    names = spark.createDataFrame(list(given.items()), "_full string, _given string")
    names = F.broadcast(names) if len(given) <= MAX_BROADCAST_FILES else names
    rows = rows.withColumn("_full", F.regexp_replace("path", "^file:/*", "/"))
    return rows.join(names, "_full").select(F.col("_given").alias("path"), "content")


def scan_tree(spark: SparkSession, roots: list[str], rules: PathRules | None = None, **options) -> tuple[DataFrame, Counter]:
    """(path, content) of the files below some roots, each path once, and the counters of the walk."""
    seen, counters = {}, Counter()
    for root in roots:
        found = walk(root, rules, **options)
        counters.update(found.counters)
        for f in found.files:
            seen.setdefault(os.path.normpath(f) if ".." not in f else f, f)
    return read_paths(spark, list(seen)), counters


def scan_distributed(spark: SparkSession, root: str, rules: PathRules | None = None) -> DataFrame:
    """(path, content) of a tree in any store that Spark reads; paths are relative to root and filtered before content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    path = F.substring(F.col("path"), F.locate(base, F.col("path")) + len(base), F.length("path"))
    rows = rows.withColumn("path", path)
    return rows.where((rules or PathRules()).keeps(F.col("path"))).select(paths.lexical(F.col("path")).alias("path"), "content")
