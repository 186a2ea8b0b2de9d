import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallystone.kernel import complexity as C
from tallystone.kernel import scan
from tallystone.kernel.languages import Language, Registry

REGISTRY = Registry()
lang = REGISTRY.named


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("Rust", "", (0, 0, 0, 0)),
        ("Rust", "\n", (1, 0, 0, 1)),
        ("Rust", "fn a() {}", (1, 1, 0, 0)),
        ("Rust", "fn a() {\n\n  b();\n\n}\n", (5, 3, 0, 2)),
        ("Rust", "// note\nfn a() {}\n", (2, 1, 1, 0)),
        ("Rust", "/*\n * note\n\n */\nfn a() {}\n", (5, 1, 4, 0)),
        ("Rust", "let x = 1; // note\n", (1, 1, 0, 0)),
        ("Rust", 'let s = "// no /* note";\n', (1, 1, 0, 0)),
        ("Rust", 'let s = "q \\" q";\n// c\n', (2, 1, 1, 0)),
        ("Rust", 'let s = "one\n\ntwo";\n', (3, 3, 0, 0)),
        ("Rust", "/* c */ let x = 1;\n", (1, 1, 0, 0)),
        ("Rust", "/* c */   \n/* a */ // b\n", (2, 0, 2, 0)),
        ("Rust", 'let s = "a\\\nb";\n', (2, 2, 0, 0)),
        ("Rust", "/* a /* b */\nstill */\nlet x = 1;\n", (3, 1, 2, 0)),
        ("Rust", "fn f<'a>() -> &'a str {\n}\n// c\n", (3, 2, 1, 0)),
        ("Rust", "let x = /* a\nb */ 1;\n", (2, 2, 0, 0)),
        ("C", "/* a /* b */ int x;\n", (1, 1, 0, 0)),
        ("Python", "# c\nx = 1\n", (2, 1, 1, 0)),
        ("Python", 'def f():\n    """\n    doc\n\n    """\n    pass\n', (6, 2, 4, 0)),
        ("Python", '"""doc""" x = 1\n', (1, 1, 0, 0)),
        ("Python", 'x = """a\n\nb"""\n', (3, 3, 0, 0)),
        ("Python", '"""a \\""" b\n', (1, 1, 0, 0)),  # a doc string knows no escapes
        ("Go", "s := `a\\`\n// c\n", (2, 1, 1, 0)),
        ("Ruby", "=begin\nnot the =end\n=end\nx = 1\n", (4, 1, 3, 0)),
        ("Ruby", "  =begin\nx=begin_day\n", (2, 2, 0, 0)),
        ("YAML", "a: Tiger's\n# c\nb: 1\n", (3, 2, 1, 0)),
        ("Lua", "--[[ a\nb ]]\n-- c\nx = 1\n", (4, 1, 3, 0)),
        ("HTML", "<p>\n<!-- a\n\nb --> <b>\n", (4, 2, 2, 0)),
        ("JSON", '{\n "a": 1\n}\n', (3, 3, 0, 0)),
    ],
)
def test_line_classes(name, text, want):
    assert scan.line_stats(text, lang(name)) == want


def test_quotes_end_with_the_line_by_default():
    x = Language("x", "X", line_comments=["//"])
    assert scan.line_stats("s = 'open\n// c\n\ncode()\n", x) == (4, 2, 1, 1)


TEXT = st.text(alphabet="ab \t\n\"'`/*#=-\\{}();fn", max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from(["Rust", "Python", "C", "Ruby", "Go", "Haskell", "Markdown", "Lua", "JavaScript"]))
def test_scans_agree_with_the_text(text, name):
    own = lang(name)
    total, code, comment, blank = scan.line_stats(text, own)
    assert code + comment + blank == total == text.count("\n") + (bool(text) and text[-1] != "\n")
    hidden = scan.masked(text, own)
    assert len(hidden) == len(text) and [i for i, c in enumerate(hidden) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert all(h in (c, " ") for h, c in zip(hidden, text, strict=True))
    for mask in (False, True):
        parts = list(scan.stretches(text, own, mask))
        assert "".join(text[a:b] for _, a, b in parts) == text
    c = C.analyze(text, own)
    assert c.cyclomatic >= c.functions and c.cognitive >= c.cyclomatic - c.functions
    if split := C.split_tests(text, own):
        assert sum(scan.line_stats(p, own)[0] for p in split) == total


def test_functions_and_decisions():
    c = C.analyze("fn run() {\n    if a {\n        for i in b {\n            if i { x() }\n        }\n    } else {\n        while c {}\n    }\n}\n", lang("Rust"))
    assert (c.functions, c.cyclomatic, c.max_depth) == (1, 6, 3)
    c = C.analyze("fn f() { if a && b || c { g()?; } }\n", lang("Rust"))
    assert c.cyclomatic == 5
    c = C.analyze('fn real() {\n let t = "if for fn fake() {";\n // while fn no() {\n /* if /* && */ fn no() { */\n}\n', lang("Rust"))
    assert (c.functions, c.cyclomatic, c.cognitive, c.max_depth) == (1, 1, 0, 0)


def test_nesting_in_braces():
    flat, nested = "fn f() { if a() { b(); } if c() { d(); } }\n", "fn f() { if a() { if c() { d(); } } }\n"
    a, b = C.analyze(flat, lang("Rust")), C.analyze(nested, lang("Rust"))
    assert a.cyclomatic == b.cyclomatic and a.cognitive == 2 and b.cognitive == 3
    assert C.analyze("fn f() { if o() { if l() && r() { w(); } } }\n", lang("Rust")).cognitive == 5
    assert C.analyze("fn f() {\n if v.any(|x| { x > 0 }) {\n  for x in v { g(x); }\n }\n}\n", lang("Rust")).max_depth == 2
    calls = C.analyze("fn f() {\n let v = [g(h(), [1, 2])];\n}\n", lang("Rust"))
    assert calls.max_depth == 0 < calls.legacy_max_depth
    assert C.analyze("void f() { if (a) b(); if (c) { d(); } }\n", lang("C")).max_depth == 1


def test_nesting_by_indentation():
    c = C.analyze("def run():\n    if a:\n        for b in c:\n            while d:\n                e()\n", lang("Python"))
    assert (c.functions, c.max_depth, c.cognitive) == (1, 3, 6)
    c = C.analyze("def a():\n\tif x and y:\n\t\tpass\n\ndef b():\n    if x: pass\n", lang("Python"))
    assert (c.max_depth, c.cognitive) == (1, 3)


def test_spans():
    s = C.function_spans("fn first() {\n    b();\n}\n\npub fn second() {\n    m();\n}\n", lang("Rust"))
    assert [(x.name, x.start_line, x.end_line) for x in s] == [("first", 1, 3), ("second", 5, 7)]
    s = C.function_spans("fn a();\nfn b() {\n    w();\n}\n", lang("Rust"))
    assert [x.end_line for x in s] == [1, 4]
    s = C.function_spans("def a():\n    pass\n\n\ndef b():\n    return {1: 2}\n", lang("Python"))
    assert [(x.name, x.start_line, x.end_line) for x in s] == [("a", 1, 4), ("b", 5, 6)]
    assert C.analyze("// doc\nuse x;\n\nfn only() {}\n", lang("Rust")).avg_func_lines == 1.0


def test_script_functions_of_both_kinds():
    text = "\nfunction declared(v) { return v; }\nclass S {\n  constructor(v) { this.v = v; }\n  async load<T>(v: T): Promise<T> { return v; }\n  method(v) { return v; }\n  field = (v) => { return v; };\n}\nconst e = v => v * 2;\nconst l = [1, 2].map((v) => v + 1);\nif (l.length) { use(l); }\n"
    for name in ("JavaScript", "TypeScript"):
        c = C.analyze(text, lang(name))
        assert (c.functions, c.legacy_functions, c.legacy_cyclomatic, c.legacy_max_depth, c.legacy_avg_func_lines) == (7, 2, 3, 2, 1.0)


def test_languages_without_code_are_not_measured():
    c = C.analyze('# T\n```\n{"a":{"b":1}}\n```\nif else\n', lang("Markdown"))
    assert not c.functions_measured and (c.max_depth, c.cyclomatic, c.cognitive, c.legacy_max_depth) == (0, 0, 0, 0)


def test_inline_tests():
    text = "fn a() {}\n#[cfg(test)]\nmod tests {\n  #[test]\n  fn t() { x(); }\n}\nfn b() {}\n"
    production, tests = C.split_tests(text, lang("Rust"))
    assert production == "fn a() {}\nfn b() {}\n" and tests.startswith("#[cfg(test)]") and tests.endswith("}\n")
    assert C.split_tests("// #[cfg(test)] mod tests {\nfn a() {}\n", lang("Rust")) is None
    assert C.split_tests('test "x" {\n}\nfn a() void {}\n', lang("Zig"))[0] == "fn a() void {}\n"


def test_detection():
    r = REGISTRY
    names = {"a/b.RS": "Rust", "x.m": "Objective-C", "Makefile": "Makefile", "y.R": "R", ".bashrc": "Bash", "a.tar.py": "Python"}
    assert {p: r.detect(p).name for p in names} == names
    assert r.detect("x.unknown", b"#!/bin/sh\n") is None and r.detect("README") is None
    assert [r.detect("run", h).name for h in (b"#!/bin/sh\n", b"#!/usr/bin/env -S python3.12 -u\n", b"#!/usr/bin/node\n", b"#!/usr/bin/Rscript")] == ["Bash", "Python", "JavaScript", "R"]
    assert len(r.languages) == 66


def test_own_languages(tmp_path):
    f = tmp_path / "own.toml"
    f.write_text('[zed]\nname = "Zed"\nextensions = ["zed"]\nline_comments = [";;"]\nfunction_pattern = "(?m)^def \\\\w+"\ncomplexity_keywords = ["when"]\nstring_delimiters = [{ start = "|", end = "|", multiline = true }]\n')
    r = Registry()
    r.load(f)
    assert scan.line_stats("def a\n;; c\nx |\n\n|\n", r.detect("q.zed")) == (5, 4, 1, 0)
    assert C.analyze("def a\nwhen x\n", r.named("Zed")).cyclomatic == 2
    r.map_extension(".tpl", "HTML")
    assert r.detect("a.tpl").name == "HTML"
    with pytest.raises(ValueError):
        r.map_extension("x", "No Such")
    f.write_text('[bad]\nname = "B"\nfunction_pattern = "("\n')
    with pytest.raises(ValueError):
        Registry().load(f)


def test_cyclomatic_alone_is_that_of_all_metrics():
    for name, text in (("Rust", "fn f() { if a && b { g()?; } }\nfn h();\n"), ("JavaScript", "function f(a) {\n  if (a) { b(`if`); }\n}\n"), ("Python", "def f(x):\n    return x and 1\n"), ("Markdown", "if else")):
        assert C.cyclomatic(text, lang(name)) == C.analyze(text, lang(name)).cyclomatic
