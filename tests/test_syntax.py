"""Nodes of source code: cases by hand, broken code, Python's own parser as the model, and time on hostile texts."""

import ast
import random
import time

import pytest

from corpusloom.operators import syntax

CASES = {
    "Python": ('# top\nimport os, a.b as c  # tail\nfrom x.y import (p,\n  q)\nclass A(B):\n    """doc\n    def no(): pass\n    """\n    def f(self,\n          a=(1,\n2)):\n        s = "def g(): # no"\n        def inner(x):\n            return x\n\n        return inner\n    # in class\n    async def h(self): pass\ny = 1\n',
        "comment:# top:0:1 package:os:0:1 package:a:0:1 comment:# tail:0:1 package:x:0:1 class:A:0:9 function:f:A:7 function:inner:f:2 comment:# in class:A:1 function:h:A:1", 13),
    "java": ("package a.b;\nimport java.util.List; \n/* block\n   int no() { } */\n@Ann(x=1) public class A<T> extends B {\n  String s = \"} {\"; char c = '{';\n  @Override\n  public int f(int a) throws E { if (a > 0) { return 1; } for (int i = 0; i < 3; i++) { } return 0; } // t\n  A() { super(); }\n  interface I { int g(); }\n}\n",
        "package:java.util.List:0:1 comment:/* block\n   int no() { } */:0:2 class:A:0:7 function:f:A:1 comment:// t:A:1 function:A:A:1 class:I:A:1", 9),
    "JavaScript": ('import a from "pkg/x"; const q = require(\'y\');\nfunction f(a = {}, b) { return `}${a}`; }\nconst g = async (x) => { return x; };\nconst o = { m(a) { return 1 }, n: function() {} };\nclass K extends L { constructor() { super(); } }\nfoo(function cb(e) { if (e) { } });\n',
        "package:pkg/x:0:1 package:y:0:1 function:f:0:1 function:g:0:1 function:m:0:1 function::0:1 class:K:0:1 function:constructor:K:1 function:cb:0:1", 6),
    "c": ('#include <stdio.h>\n#include "my.h"\nstruct s { int a; };\nstatic struct s *mk(int a) { return 0; }\nint main(int argc, char **argv) {\n  while (1) { do { x(); } while (0); }\n}\n', "package:stdio.h:0:1 package:my.h:0:1 class:s:0:1 function:mk:0:1 function:main:0:3", 7),
    "go": ('package main\nimport (\n  "fmt"\n  x "a/b"\n)\ntype T struct { a int }\nfunc (t *T) M(a int) (int, error) { return 1, nil }\nfunc main() { s := `{"a": }` }\n', "package:fmt:0:1 package:a/b:0:1 class:T:0:1 function:M:0:1 function:main:0:1", 8),
    "ruby": ("require 'a/b'\n=begin\ndef no\n=end\nmodule M\n  class A < B\n    def f(x)\n      while x do\n        y\n      end\n      z.each do |q|\n        q\n      end\n      if x then y end\n    end\n    def self.g = 1\n    def h?; 1; end\n  end\nend\n",
        "package:a/b:0:1 comment:=begin\ndef no\n=end:0:3 class:M:0:15 class:A:M:13 function:f:A:9 function:self.g:A:1 function:h?:A:1", 16),
    "rust": ("use std::io as x;\npub fn a<'a>(s: &'a str) -> R { let c = '{'; match c { _ => {} } }\nimpl T { fn b() {} }\n", "package:std::io:0:1 function:a:0:1 class:T:0:1 function:b:T:1", 3),
    "kotlin": ('import a.b.*\nimport c.d as e\nfun <T> List<T>.x(a: Int): Int { return """}""".length }\nobject O { fun y() { } }\n', "package:a.b:0:1 package:c.d:0:1 function:x:0:1 class:O:0:1 function:y:O:1", 4),
    "c#": ('using System.IO;\nusing A = B.C;\nnamespace N {\n  class K { int P { get { return 1; } } void M(string s = @"}""{") { } }\n}\n', "package:System.IO:0:1 package:B.C:0:1 class:N:0:3 class:K:N:1 function:M:K:1", 5),
}


@pytest.mark.parametrize("language", CASES)
def test_nodes(language):
    text, want, code = CASES[language]
    rows = syntax.parse(text, language)
    name = {r[0]: r[3] if r[0] else "0" for r in rows}
    assert rows[0][2:4] == ("uast_root", "") and rows[0][6] == code
    assert " ".join(f"{r[2][5:]}:{r[3]}:{name[r[1]]}:{r[6]}" for r in rows[1:]) == want
    at = {r[0]: r for r in rows}
    assert all(at[r[1]][4] <= r[4] <= r[5] <= at[r[1]][5] for r in rows[1:])


def test_broken_code():
    told = lambda text, language: [(r[2][5:], r[3]) for r in syntax.parse(text, language)[1:]]
    assert told("def broken(a, (b:\n    return '\ndef last():\n  pass", "py") == [("function", "broken"), ("function", "last")]
    assert told("class A { void open() { foo(bar(\n", "java") == [("class", "A"), ("function", "open")]
    assert told("} } ) function after() {} \"open\nfunction more() {", "js") == [("function", "after"), ("function", "more")]
    assert told("/* never closed { class A {", "java") == [("comment", "/* never closed { class A {")]
    assert told('s = """open\ndef f(): pass', "python") == [] and told("end\nend\ndef f\n x", "ruby") == [("function", "f")] and told("x", "cobol") == [] and told("", "go") == []


def test_python_equals_its_own_parser():
    rng = random.Random(4)

    def block(depth):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["x", "def", "class", "async", "if", "blank", "call", "text"])
            if depth < 4 and kind in ("def", "class", "async", "if"):
                head = {"def": "def f(a=(1, 2)):", "class": "class C:", "async": "async def g():", "if": "if x:"}[kind]
                lines += [head, *["    " + s if s else s for s in block(depth + 1)]]
            else:
                lines += {"blank": ["", "x = 1  # def no():"], "call": ["y = f(1,", "  [2,", "3])"], "text": ["z = '''", "def no():", "    pass'''"]}.get(kind, ["x = 1"])
        return lines

    for _ in range(120):
        text = "\n".join(block(0)) + "\n"
        want = sorted((n.lineno, n.end_lineno, n.name) for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)))
        got = sorted((text.count("\n", 0, r[4]) + 1, text.count("\n", 0, r[5]) + 1, r[3]) for r in syntax.parse(text, "python") if r[2] in ("uast_function", "uast_class"))
        assert got == want, text


def test_time_is_linear():
    hostile = [("java", "{"), ("java", "}"), ("java", "("), ("python", "("), ("python", '"'), ("c", "f("), ("javascript", "a=>"), ("python", "def f():\n"), ("ruby", "def a\n"), ("javascript", "import "), ("javascript", "x"), ("rust", "use a\n"), ("go", "import (\n"), ("ruby", "while x\nx do |y|\n"), ("java", "class "), ("kotlin", "fun <"), ("javascript", "(a)"), ("c#", '@"')]
    for language, part in hostile:
        began = time.perf_counter()
        syntax.parse(part * 50_000 + "{", language)
        assert time.perf_counter() - began < 10, (language, part)


def test_tables_of_nodes_and_metrics(spark):
    rows = [(1, CASES["Python"][0], "Python", "x"), (2, "", "java", "x"), (3, None, "java", "x"), (4, "x", None, "x"), (5, "prose", "text", "x"), (6, "// only\n", "C", "x"), (7, CASES["Python"][0], "python", "x"), (None, "f(){}", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, language string, kind string")
    found = syntax.nodes(df)
    told = {r["id"]: tuple(r)[1:] for r in syntax.metrics(found).collect()}
    assert told == {1: (4.3, 13, 3.3, "os,a,x"), 7: (4.3, 13, 3.3, "os,a,x"), 2: (-1.0, 0, 0.0, ""), 6: (-1.0, 0, 0.0, ""), None: (0.0, 1, 1.0, "")}
    assert syntax.nodes(df.limit(0)).count() == 0
    known = spark.createDataFrame([("os", "Python", "system")], "library string, language string, concept string")
    got = syntax.concepts(found, df.selectExpr("doc_id AS id", "language"), known).where("id = 1").collect()
    assert {(r["library"], r["concept"]) for r in got} == {("os", "system"), ("a", None), ("x", None)}
