"""The configuration file: TOML with known keys and checked values. Flags of a command go before it, defaults behind it."""

from __future__ import annotations

import tomllib
from pathlib import Path

FILE_NAME = ".tallystone.toml"
# Keys and the kinds of their values.
KEYS = {
    "excludes": str, "includes": str, "exclude_files": str, "include_files": str, "exclude_dirs": str, "lang": str, "count_as": str, "languages_file": str, "no_dup_scan": bool, "health_model": str, "min_lines": int, "max_lines": int,
    "output": str, "output_file": str, "threads": int, "depth": int, "sort": str, "top": int, "git_info": bool, "no_gitignore": bool, "no_smart_exclude": bool, "parallel": bool, "summary": bool, "by_file": bool, "verbose": bool, "quiet": bool,
}
CHOICES = {"health_model": ("v1", "v2"), "sort": ("lines", "files", "code", "size"), "output": ("console", "json", "csv", "markdown", "html", "openmetrics", "badge", "sarif")}


def load_config(path: str | Path) -> dict:
    """The values of a file; a relative languages_file is taken from the file's folder."""
    path = Path(path)
    try:
        found = tomllib.loads(path.read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ValueError(f"{path}: {e}") from e
    for key, value in found.items():
        if key not in KEYS:
            raise ValueError(f"{path}: unknown key {key!r}")
        if not isinstance(value, KEYS[key]) or (KEYS[key] is int and (isinstance(value, bool) or value < 0)):
            raise ValueError(f"{path}: {key} must be a {KEYS[key].__name__}{' from 0' * (KEYS[key] is int)}")
        if key in CHOICES and value not in CHOICES[key]:
            raise ValueError(f"{path}: {key} is one of {', '.join(CHOICES[key])}")
    if "languages_file" in found and not Path(found["languages_file"]).is_absolute():
        found["languages_file"] = str(path.parent / found["languages_file"])
    return found


def find_config(folder: str = ".") -> Path | None:
    found = Path(folder, FILE_NAME)
    return found if found.is_file() else None


def merged(defaults: dict, config: dict, flags: dict) -> dict:
    return {**defaults, **config, **{k: v for k, v in flags.items() if v is not None}}


def count_as(text: str | None) -> list[tuple[str, str]]:
    """(extension, language) of 'jsp:html,tpl:php'."""
    out = []
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        ext, colon, lang = part.partition(":")
        if not (ext and colon and lang):
            raise ValueError(f"{part!r} is not extension:language")
        out.append((ext.strip(), lang.strip()))
    return out
