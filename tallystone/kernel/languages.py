"""The registry of languages: how comments, strings, functions and decisions look in each.

Custom languages come from TOML files of the same fields; extensions can be mapped to other languages.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

COMMENT, BLOCK, STRING, DOC = "comment", "block", "string", "doc"


@dataclass(frozen=True)
class Token:
    """What opens a stretch of a text: a comment to the end of the line, a block comment, a string or a doc string."""

    kind: str
    open: str
    close: str = ""
    nested: bool = False
    column_0: bool = False
    multiline: bool = False
    escape: str = ""


@dataclass
class Language:
    id: str
    name: str
    extensions: list[str] = field(default_factory=list)
    filenames: list[str] = field(default_factory=list)
    line_comments: list[str] = field(default_factory=list)
    block_comments: list[tuple[str, str]] = field(default_factory=list)
    nested_comments: bool = False
    string_delimiters: list[tuple[str, str, str, bool]] = field(default_factory=list)  # open, close, escape, multiline
    function_pattern: str | None = None
    legacy_function_pattern: str | None = None
    inline_test_patterns: list[str] = field(default_factory=list)
    complexity_keywords: list[str] = field(default_factory=list)

    @cached_property
    def tokens(self) -> dict[str, Token]:
        """Tokens by what opens them; of two with the same opening the later kind counts."""
        found = [Token(COMMENT, c) for c in self.line_comments]
        found += [Token(BLOCK, a, b, nested=self.nested_comments, column_0=a.startswith("=")) for a, b in self.block_comments]
        strings = self.string_delimiters or [(q, q, "\\", False) for q in "\"'"]
        found += [Token(STRING, a, b, escape=e, multiline=m) for a, b, e, m in strings]
        if self.name == "Python":
            found += [Token(DOC, 3 * q, 3 * q, escape="\\", multiline=True) for q in "\"'"]
        return {t.open: t for t in found if t.open}

    @cached_property
    def opener(self) -> re.Pattern | None:
        longest = sorted(self.tokens, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, longest))) if longest else None

    @cached_property
    def function_re(self) -> re.Pattern | None:
        return re.compile(self.function_pattern) if self.function_pattern else None

    @cached_property
    def legacy_function_re(self) -> re.Pattern | None:
        return re.compile(self.legacy_function_pattern) if self.legacy_function_pattern else self.function_re

    @cached_property
    def inline_test_res(self) -> list[re.Pattern]:
        return [re.compile(p) for p in self.inline_test_patterns]

    @cached_property
    def keywords_re(self) -> re.Pattern | None:
        """All decision words in one pattern, the longest first, with word ends where a word begins or ends with a letter."""
        word = lambda c: r"\b" if c.isalnum() or c == "_" else ""
        each = [word(k[0]) + re.escape(k) + word(k[-1]) for k in sorted({k for k in self.complexity_keywords if k}, key=lambda k: (-len(k), k))]
        return re.compile("|".join(each)) if each else None

    @property
    def measurable(self) -> bool:
        return bool(self.function_pattern or any(self.complexity_keywords))

    @property
    def brace_control(self) -> bool:
        return self.name in BRACE_CONTROL

    @property
    def brace_bodies(self) -> bool:
        return self.name in BRACE_CONTROL or self.name in BRACE_BODIES_ONLY


# Languages whose blocks are braces, and shells whose functions are but whose decisions are not.
BRACE_CONTROL = {
    "Rust", "C", "C++", "Zig", "Go", "Java", "Kotlin", "Groovy", "C#", "PHP", "PowerShell", "JavaScript", "TypeScript", "Swift", "Objective-C", "Dart", "R", "Solidity",
}
BRACE_BODIES_ONLY = {"Bash", "Zsh", "Fish"}
# Words that open a nested decision.
CONTROL_FLOW = set(
    "if elif elseif elsif else unless for foreach while until loop match switch select case when catch except rescue with try repeat cond receive guard do perform evaluate".split()
)
# Interpreters of scripts by what their first line names; others name their language.
INTERPRETERS = {"sh": "bash", "dash": "bash", "ksh": "bash", "node": "javascript", "nodejs": "javascript", "deno": "javascript", "bun": "javascript", "Rscript": "r"}
#: Extensions that several languages claim and one holds.
PINNED = {".m": "objectivec"}

_JS_NAME = r"[A-Za-z_$][\w$]*"
_JS_FUNCTION = (
    r"(?m)^\s*(?:(?:export|default|public|private|protected|static|async|abstract|readonly|override|get|set)\s+)*"
    r"(?:function\s+\w+|constructor\s*\(|" + _JS_NAME + r"\s*(?:<[^>{}\n]+>)?\s*\([^;{}\n]*\)\s*(?::[^={}\n]+)?\s*\{"
    r"|(?:(?:const|let|var)\s+)?" + _JS_NAME + r"\s*[=:]\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*=>|" + _JS_NAME + r"\s*=>))"
    r"|\b(?:map|filter|reduce|forEach|find|some|every|flatMap|then|catch)\s*\(\s*(?:async\s+)?(?:\([^)]*\)|" + _JS_NAME + r")\s*=>"
)
_JS_LEGACY = r"(?m)^\s*(async\s+)?function\s+\w+|\w+\s*[=:]\s*(async\s+)?function|\w+\s*[=:]\s*(async\s+)?\([^)]*\)\s*=>"
_SHELL_FUNCTION = r"(?m)^\s*(function\s+)?\w+\s*\(\s*\)"
_FUNCTION_WORD = r"(?m)^\s*function\s+\w+"
_DEF_WORD = r"(?m)^\s*def\s+\w+"
_LET_WORD = r"(?m)^\s*let\s+(rec\s+)?\w+"
_RUST_VISIBLE = r"(?:pub(?:\([^)]*\))?[ \t]+)?"
_RUST_ATTRIBUTES = r"[ \t]*(?:\r?\n[ \t]*#\s*\[[^\]\r\n]+\][ \t]*)*(?:\r?\n)?[ \t]*"
# How a function begins in each language.
FUNCTIONS = {
    "rust": r"(?m)^\s*(pub(?:\([^)]*\))?\s+)?(async\s+)?fn\s+\w+",
    "c": r"(?m)^\s*\w+\s+\w+\s*\([^)]*\)\s*\{",
    "cpp": r"(?m)^\s*(template\s*<[^>]*>\s*)?(\w+\s+)+\w+\s*\([^)]*\)\s*(const)?\s*\{",
    "zig": r"(?m)^\s*(pub\s+)?fn\s+\w+",
    "go": r"(?m)^\s*func\s+",
    "java": r"(?m)^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(",
    "kotlin": r"(?m)^\s*(fun|suspend\s+fun)\s+\w+",
    "scala": _DEF_WORD,
    "groovy": _DEF_WORD,
    "csharp": r"(?m)^\s*(public|private|protected|internal)?\s*(static|async)?\s*\w+\s+\w+\s*\(",
    "fsharp": _LET_WORD,
    "vb": r"(?m)^\s*(Public|Private|Protected)?\s*(Shared)?\s*(Sub|Function)\s+\w+",
    "python": r"(?m)^\s*(async\s+)?def\s+\w+",
    "ruby": _DEF_WORD,
    "perl": r"(?m)^\s*sub\s+\w+",
    "php": r"(?m)^\s*(public|private|protected)?\s*(static)?\s*function\s+\w+",
    "lua": r"(?m)^\s*(local\s+)?function\s+\w+",
    "bash": _SHELL_FUNCTION,
    "zsh": _SHELL_FUNCTION,
    "fish": _FUNCTION_WORD,
    "powershell": _FUNCTION_WORD,
    "javascript": _JS_FUNCTION,
    "typescript": _JS_FUNCTION,
    "plsql": r"(?m)^\s*(FUNCTION|PROCEDURE)\s+\w+",
    "haskell": r"(?m)^\w+\s*::",
    "elixir": r"(?m)^\s*def(p)?\s+\w+",
    "erlang": r"(?m)^\w+\s*\(",
    "clojure": r"\(defn?-?\s+\w+",
    "ocaml": _LET_WORD,
    "swift": r"(?m)^\s*(func|init)\s+\w+",
    "objectivec": r"(?m)^\s*[-+]\s*\([^)]+\)\s*\w+",
    "dart": r"(?m)^\s*(\w+\s+)?\w+\s*\([^)]*\)\s*(async)?\s*\{",
    "r": r"(?m)^\s*\w+\s*<-\s*function",
    "julia": _FUNCTION_WORD,
    "matlab": r"(?m)^\s*function\s+",
    "fortran": r"(?m)^\s*(SUBROUTINE|FUNCTION)\s+\w+",
    "cobol": r"(?m)^\s*\w+\s+SECTION\.",
    "vhdl": r"(?m)^\s*(function|procedure)\s+\w+",
    "solidity": _FUNCTION_WORD,
}
LEGACY_FUNCTIONS = {"javascript": _JS_LEGACY, "typescript": _JS_LEGACY}
# How a block of inline tests begins; each ends with the brace that opens it.
INLINE_TESTS = {
    "rust": [
        r"(?ms)^[ \t]*#\s*\[\s*cfg\s*\(\s*test\s*\)\s*\]" + _RUST_ATTRIBUTES + _RUST_VISIBLE + r"mod[ \t]+\w+[ \t]*\{",
        r"(?ms)^[ \t]*#\s*\[[ \t]*test[ \t]*\]" + _RUST_ATTRIBUTES + _RUST_VISIBLE + r"(?:async[ \t]+)?fn[ \t]+\w+[^;{]*\{",
    ],
    "zig": [r"(?m)^[ \t]*test\b[^\r\n{]*\{"],
}


def _language(id: str, name: str, extensions: str, files: str = "", line: str = "", block=(), nested: bool = False, strings: str = "", words: str = "") -> Language:
    """strings: delimiters, each with e (a backslash escapes) and m (may hold line feeds)."""
    quotes = [(s[0], s[0], "\\" if "e" in s[1:] else "", "m" in s[1:]) for s in strings.split()]
    return Language(id, name, extensions.split(), files.split(), line.split(), list(block), nested, quotes, FUNCTIONS.get(id), LEGACY_FUNCTIONS.get(id), INLINE_TESTS.get(id, []), words.split())


# Names, extensions, file names, comments, strings and decision words of the languages.
BUILT_IN = [
    _language("rust", "Rust", ".rs", line='//', block=[('/*', '*/')], nested=True, strings='"em', words='if else for while loop match ? && ||'),
    _language("c", "C", ".c .h", line='//', block=[('/*', '*/')], strings='"e \'e', words='if else for while switch case ? && ||'),
    _language("cpp", "C++", ".cpp .cc .cxx .hpp .hh .hxx .c++ .h++", line='//', block=[('/*', '*/')], strings='"e \'e', words='if else for while switch case catch ? && ||'),
    _language("zig", "Zig", ".zig", line='//', words='if else for while switch orelse catch'),
    _language("go", "Go", ".go", line='//', block=[('/*', '*/')], strings='"e `m', words='if else for switch select case && ||'),
    _language("java", "Java", ".java", line='//', block=[('/*', '*/')], strings='"e \'e', words='if else for while switch case catch ? && ||'),
    _language("kotlin", "Kotlin", ".kt .kts", line='//', block=[('/*', '*/')], words='if else for while when catch ?: && ||'),
    _language("scala", "Scala", ".scala .sc", line='//', block=[('/*', '*/')], words='if else for while match case catch && ||'),
    _language("groovy", "Groovy", ".groovy .gvy .gy .gsh", line='//', block=[('/*', '*/')], words='if else for while switch case catch ?: && ||'),
    _language("csharp", "C#", ".cs", line='//', block=[('/*', '*/')], strings='"e \'e', words='if else for foreach while switch case catch ? ?? && ||'),
    _language("fsharp", "F#", ".fs .fsx .fsi", line='//', block=[('(*', '*)')], words='if then else for while match with try && ||'),
    _language("vb", "Visual Basic", ".vb", line="'", words='If Else ElseIf For While Select Case Catch And Or'),
    _language("python", "Python", ".py .pyw .pyi .pyx .pxd", files='SConstruct SConscript', line='#', block=[('"""', '"""'), ("'''", "'''")], strings='"e \'e', words='if elif else for while except with and or not'),
    _language("ruby", "Ruby", ".rb .rake .gemspec", files='Rakefile Gemfile Guardfile', line='#', block=[('=begin', '=end')], strings='"e \'e', words='if elsif else unless for while until case when rescue && ||'),
    _language("perl", "Perl", ".pl .pm .pod .t", line='#', block=[('=pod', '=cut')], words='if elsif else unless for foreach while until && ||'),
    _language("php", "PHP", ".php .phtml .php3 .php4 .php5 .php7 .phps", line='// #', block=[('/*', '*/')], words='if elseif else for foreach while switch case catch ? && || and or'),
    _language("lua", "Lua", ".lua", line='--', block=[('--[[', ']]')], words='if elseif else for while repeat and or'),
    _language("bash", "Bash", ".sh .bash", files='.bashrc .bash_profile .bash_login .bash_logout', line='#', strings='"e \'', words='if elif else for while until case && ||'),
    _language("zsh", "Zsh", ".zsh", files='.zshrc .zprofile .zlogin .zlogout', line='#', strings='"e \'', words='if elif else for while until case && ||'),
    _language("fish", "Fish", ".fish", line='#', words='if else for while switch case and or'),
    _language("powershell", "PowerShell", ".ps1 .psm1 .psd1", line='#', block=[('<#', '#>')], words='if elseif else for foreach while switch catch -and -or'),
    _language("javascript", "JavaScript", ".js .mjs .cjs .jsx", line='//', block=[('/*', '*/')], strings='"e \'e `em', words='if else for while switch case catch ? ?? && ||'),
    _language("typescript", "TypeScript", ".ts .tsx .mts .cts", line='//', block=[('/*', '*/')], strings='"e \'e `em', words='if else for while switch case catch ? ?? && ||'),
    _language("html", "HTML", ".html .htm .xhtml", block=[('<!--', '-->')]),
    _language("css", "CSS", ".css", block=[('/*', '*/')]),
    _language("scss", "SCSS", ".scss", line='//', block=[('/*', '*/')]),
    _language("sass", "Sass", ".sass", line='//'),
    _language("less", "Less", ".less", line='//', block=[('/*', '*/')]),
    _language("vue", "Vue", ".vue", line='//', block=[('/*', '*/'), ('<!--', '-->')]),
    _language("svelte", "Svelte", ".svelte", line='//', block=[('/*', '*/'), ('<!--', '-->')]),
    _language("json", "JSON", ".json .jsonc .json5"),
    _language("yaml", "YAML", ".yml .yaml", line='#', strings='"e \''),
    _language("toml", "TOML", ".toml", line='#'),
    _language("xml", "XML", ".xml .xsl .xslt .xsd .wsdl", block=[('<!--', '-->')]),
    _language("ini", "INI", ".ini .cfg .conf", line='; #'),
    _language("csv", "CSV", ".csv .tsv"),
    _language("sql", "SQL", ".sql", line='--', block=[('/*', '*/')], strings="'", words='CASE WHEN IF ELSE AND OR'),
    _language("plsql", "PL/SQL", ".pls .pks .pkb", line='--', block=[('/*', '*/')], words='IF ELSIF ELSE FOR WHILE LOOP CASE WHEN AND OR'),
    _language("haskell", "Haskell", ".hs .lhs", line='--', block=[('{-', '-}')], nested=True, words='if then else case of guard'),
    _language("elixir", "Elixir", ".ex .exs", line='#', block=[('@doc """', '"""'), ('@moduledoc """', '"""')], words='if else cond case with for and or'),
    _language("erlang", "Erlang", ".erl .hrl", line='%', words='if case of receive try catch andalso orelse'),
    _language("clojure", "Clojure", ".clj .cljs .cljc .edn", line=';', words='if when cond case for loop and or'),
    _language("ocaml", "OCaml", ".ml .mli", block=[('(*', '*)')], nested=True, words='if then else match with for while && ||'),
    _language("swift", "Swift", ".swift", line='//', block=[('/*', '*/')], nested=True, words='if else for while switch case guard catch ? ?? && ||'),
    _language("objectivec", "Objective-C", ".m .mm", line='//', block=[('/*', '*/')], words='if else for while switch case @catch ? && ||'),
    _language("dart", "Dart", ".dart", line='//', block=[('/*', '*/')], words='if else for while switch case catch ? ?? && ||'),
    _language("makefile", "Makefile", ".mk .mak", files='Makefile makefile GNUmakefile Makefile.am Makefile.in', line='#'),
    _language("cmake", "CMake", ".cmake", files='CMakeLists.txt', line='#', block=[('#[[', ']]')]),
    _language("dockerfile", "Dockerfile", ".dockerfile", files='Dockerfile Containerfile', line='#'),
    _language("terraform", "Terraform", ".tf .tfvars", line='# //', block=[('/*', '*/')]),
    _language("nix", "Nix", ".nix", line='#', block=[('/*', '*/')]),
    _language("markdown", "Markdown", ".md .markdown .mdown .mkdn"),
    _language("restructuredtext", "reStructuredText", ".rst .rest", line='..'),
    _language("asciidoc", "AsciiDoc", ".adoc .asciidoc .asc", line='//', block=[('////', '////')]),
    _language("latex", "LaTeX", ".tex .sty .cls", line='%'),
    _language("r", "R", ".r .R .rdata .rds .rda", line='#', words='if else for while repeat switch && ||'),
    _language("julia", "Julia", ".jl", line='#', block=[('#=', '=#')], nested=True, words='if elseif else for while try catch && ||'),
    _language("matlab", "MATLAB", ".m .mat", line='%', block=[('%{', '%}')], words='if elseif else for while switch case try catch && ||'),
    _language("fortran", "Fortran", ".f .for .f90 .f95 .f03 .f08", line='! C c *', words='IF ELSE ELSEIF DO WHILE SELECT CASE .AND. .OR.'),
    _language("cobol", "COBOL", ".cob .cbl .cpy", line='*', words='IF ELSE PERFORM EVALUATE WHEN AND OR'),
    _language("assembly", "Assembly", ".asm .s .S", line='; # //'),
    _language("vhdl", "VHDL", ".vhd .vhdl", line='--', words='if elsif else for while case when and or'),
    _language("verilog", "Verilog", ".v .vh .sv .svh", line='//', block=[('/*', '*/')], words='if else for while case && ||'),
    _language("protobuf", "Protocol Buffers", ".proto", line='//', block=[('/*', '*/')]),
    _language("graphql", "GraphQL", ".graphql .gql", line='#'),
    _language("solidity", "Solidity", ".sol", line='//', block=[('/*', '*/')], words='if else for while do require assert && ||'),
]


class Registry:
    """Languages by id, file name and extension."""

    def __init__(self, languages: list[Language] | None = None):
        self.languages: dict[str, Language] = {}
        self.by_extension: dict[str, str] = {}
        self.by_filename: dict[str, str] = {}
        for lang in sorted(BUILT_IN if languages is None else languages, key=lambda x: x.id):
            self.add(lang)
        for ext, owner in PINNED.items():
            if owner in self.languages and ext in self.languages[owner].extensions:
                self.by_extension[ext] = owner

    def add(self, lang: Language) -> None:
        """Registers a language; one of the same id gives up all its names."""
        for names in (self.by_extension, self.by_filename):
            for k in [k for k, v in names.items() if v == lang.id]:
                del names[k]
        self.languages[lang.id] = lang
        self.by_extension.update((_extension(e), lang.id) for e in lang.extensions)
        self.by_filename.update((f.lower(), lang.id) for f in lang.filenames)

    def map_extension(self, extension: str, language: str) -> None:
        """Counts an extension as a language, given by id or display name."""
        found = next((x.id for x in self.languages.values() if language.lower() in (x.id.lower(), x.name.lower())), None)
        if found is None:
            raise ValueError(f"unknown language {language!r}")
        self.by_extension[_extension(extension)] = found

    def load(self, path: str | Path) -> None:
        """Adds the languages of a TOML file; all of them are checked before the first is added."""
        with open(path, "rb") as f:
            tables = tomllib.load(f)
        for lang in sorted((_from_toml(k, v) for k, v in tables.items()), key=lambda x: x.id):
            self.add(lang)

    def named(self, name: str) -> Language | None:
        return next((x for x in self.languages.values() if x.name.lower() == name.lower() or x.id == name), None)

    def detect(self, path: str, content: bytes | str = b"") -> Language | None:
        """By file name, then by the last extension, then, for names without any, by the first line."""
        name = path.rsplit("/", 1)[-1]
        if found := self.by_filename.get(name.lower()):
            return self.languages[found]
        stem, dot, ext = name.rpartition(".")
        if dot and stem:
            return self.languages.get(self.by_extension.get("." + ext.lower(), ""))
        found = interpreter(content)
        return self.languages.get(INTERPRETERS.get(found, found)) if found else None

    def listing(self) -> list[tuple[str, list[str]]]:
        return sorted((x.name, x.extensions) for x in self.languages.values())


def _extension(ext: str) -> str:
    return "." + ext.lower().lstrip(".")


def interpreter(content: bytes | str) -> str | None:
    """What the first line of a script names, without its version."""
    head = content if isinstance(content, str) else content[:256].decode("utf-8", "replace")
    if not head.startswith("#!"):
        return None
    words = head[2:].split("\n", 1)[0].split()
    if words and words[0].rsplit("/", 1)[-1] == "env":
        words = [w for w in words[1:] if not w.startswith("-")]
    return words[0].rsplit("/", 1)[-1].rstrip("0123456789.") if words else None


_FIELDS = {
    "name", "extensions", "filenames", "line_comments", "block_comments", "nested_comments", "string_delimiters", "function_pattern", "legacy_function_pattern", "inline_test_patterns", "complexity_keywords",
}


def _from_toml(id: str, table: dict) -> Language:
    if unknown := set(table) - _FIELDS:
        raise ValueError(f"language {id}: unknown fields {sorted(unknown)}")
    strings = [(s["start"], s["end"], (s.get("escape") or "")[:1], bool(s.get("multiline", False))) for s in table.get("string_delimiters", [])]
    plain = {k: table[k] for k in ("filenames", "line_comments", "nested_comments", "function_pattern", "legacy_function_pattern", "inline_test_patterns", "complexity_keywords") if k in table}
    lang = Language(id, table.get("name", id), [_extension(e) for e in table.get("extensions", [])], block_comments=[tuple(b) for b in table.get("block_comments", [])], string_delimiters=strings, **plain)
    for pattern in (lang.function_pattern, lang.legacy_function_pattern, *lang.inline_test_patterns):
        try:
            re.compile(pattern or "")
        except re.error as e:
            raise ValueError(f"language {id}: {pattern!r} is no regular expression: {e}") from e
    return lang
