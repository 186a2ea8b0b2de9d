"""Attribute files: which language a path counts as, and what is vendored or generated. The last rule that fits counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tallystone.operators.filters import glob_regex


@dataclass
class Attributes:
    languages: list[tuple[str, str]] = field(default_factory=list)  # (pattern, language)
    vendored: list[tuple[str, bool]] = field(default_factory=list)
    generated: list[tuple[str, bool]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Attributes:
        out = cls()
        for line in text.splitlines():
            words = line.split()
            if not words or words[0].startswith("#"):
                continue
            pattern = words[0].removeprefix("/")
            regex = glob_regex(pattern if "/" in pattern else "**/" + pattern)
            for word in words[1:]:
                off, name = word.startswith("-"), word.removeprefix("-")
                name, given, value = name.partition("=")
                if name == "linguist-language" and given and not off:
                    out.languages.append((regex, value))
                for kind, rules in (("linguist-vendored", out.vendored), ("linguist-generated", out.generated)):
                    if name == kind:
                        rules.append((regex, not off and value != "false"))
        return out

    @staticmethod
    def _last(rules, path: str):
        return next((value for regex, value in reversed(rules) if re.fullmatch(regex, path, re.S)), None)

    def language(self, path: str) -> str | None:
        return self._last(self.languages, path)

    def excluded(self, path: str) -> bool:
        return bool(self._last(self.vendored, path) or self._last(self.generated, path))
