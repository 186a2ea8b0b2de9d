"""Stretches of comments, strings and code in a text, the class of each line, and the text with all but code blanked.

A search jumps from one opening to the next; what lies between is code if it is more than white space.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

from tallystone.kernel.languages import BLOCK, COMMENT, DOC, STRING, Language, Token

SPACE = " \t\n\r\f"
_NOT_FEED = re.compile(r"[^\n]")


@lru_cache(maxsize=4096)
def _stops(*marks: str) -> re.Pattern:
    return re.compile("|".join(map(re.escape, (m for m in marks if m))))


def _comment_end(text: str, at: int, token: Token) -> int:
    """Where a block comment that opens at `at` ends."""
    i, depth = at + len(token.open), 0
    if token.column_0:
        found = text.find("\n" + token.close, i)
        return len(text) if found < 0 else found + 1 + len(token.close)
    if not token.nested:
        found = text.find(token.close, i)
        return len(text) if found < 0 else found + len(token.close)
    for m in _nest(token).finditer(text, i):
        if m.group(1) is None:
            depth += 1
        elif depth:
            depth -= 1
        else:
            return m.end()
    return len(text)


@lru_cache(maxsize=256)
def _nest(token: Token) -> re.Pattern:
    return re.compile(f"({re.escape(token.close)})|{re.escape(token.open)}")  # an ending goes before an opening


def _string_end(text: str, at: int, token: Token, over_feeds: bool) -> int:
    """Where a string ends: behind its end, at a line feed it may not hold, or with the text.

    over_feeds: an escaped line feed belongs to the string even if the string may not hold line feeds.
    """
    i = at + len(token.open)
    stops = _stops(token.escape, token.close, "" if token.multiline else "\n")
    while m := stops.search(text, i):
        if m.group() == "\n":
            return m.start()
        if token.escape and m.group()[0] == token.escape:
            i = m.start() + (1 if not over_feeds and text[m.start() + 1 : m.start() + 2] == "\n" else 2)
        else:
            return m.end()
    return len(text)


def stretches(text: str, lang: Language, masking: bool = False):
    """(kind, start, end) of everything in order: None for code and white space, or the kind of a token.

    Line classes and masking differ on purpose: for classes, a doc string before any code of its line knows no escapes
    and is a comment, behind code it is a string; an escaped line feed ends a line. For masking, all doc strings are strings.
    """
    i, gap, code_at = 0, 0, -1
    while lang.opener is not None and (m := lang.opener.search(text, i)):
        start, token = m.start(), lang.tokens[m.group()]
        if token.column_0 and start and text[start - 1] != "\n":
            i = start + 1
            continue
        code_at = max(code_at, gap + len(text[gap:start].rstrip(SPACE)) - 1 if text[gap:start].strip(SPACE) else -1)
        if start > gap:
            yield None, gap, start
        kind = token.kind
        if kind == COMMENT:
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        elif kind == BLOCK:
            end = _comment_end(text, start, token)
        elif kind == DOC and not masking and code_at <= text.rfind("\n", 0, start):
            end = text.find(token.close, start + len(token.open))
            end = len(text) if end < 0 else end + len(token.close)
        else:
            kind, end = STRING, _string_end(text, start, token, masking)
            code_at = end - 1
        yield kind, start, end
        i = gap = end
    if gap < len(text):
        yield None, gap, len(text)


def feeds(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def line_stats(text: str, lang: Language) -> tuple[int, int, int, int]:
    """(total, code, comment, blank) lines. A line with any code or string is code; else with any comment, a comment."""
    if not text:
        return 0, 0, 0, 0
    breaks = feeds(text)
    total = len(breaks) + (text[-1] != "\n")
    code, comment = bytearray(total), bytearray(total)
    for kind, start, end in stretches(text, lang):
        line = bisect_right(breaks, start - 1)
        if kind is None:
            for k, part in enumerate(text[start:end].split("\n")):
                if part.strip(SPACE):
                    code[line + k] = 1
            continue
        # a stretch that runs into the end of the text holds every line to its end
        last = total - 1 if end == len(text) else bisect_right(breaks, end - 2) if end > start + 1 else line
        last = min(max(last, line), total - 1)
        (code if kind == STRING else comment)[line : last + 1] = b"\1" * (last + 1 - line)
    n_code = sum(code)
    n_comment = sum(b and not a for a, b in zip(code, comment, strict=True))
    return total, n_code, n_comment, total - n_code - n_comment


def masked(text: str, lang: Language) -> str:
    """The text with spaces for comments and strings; its length and line feeds stay."""
    return "".join(text[a:b] if kind is None else _NOT_FEED.sub(" ", text[a:b]) for kind, a, b in stretches(text, lang, masking=True))
