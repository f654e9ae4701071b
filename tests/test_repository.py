"""Imports resolved to files, and the order of files by their dependencies, against cases by hand and brute force."""

import random
import time

import pytest

from corpusloom.operators import repository

PY = {
    "pkg/__init__.py": "", "pkg/a.py": "from . import b\nfrom .sub import c as d, missing\nimport os, pkg.sub.c\n", "pkg/b.py": "from ..pkg.a import x\n", "pkg/sub/__init__.py": "from .c import (\n    one,  # the first\n    two,\n)\n",
    "pkg/sub/c.py": "from pkg import b\n    import tool\n", "tool.py": "import pkg.a as z; import src_only\n", "src/src_only.py": "from helper import y\n", "src/helper.py": "", "deep/x/y/main.py": "import near\nfrom ....... import far\n", "deep/x/y/near.py": None,
}
JS = {
    "web/app.ts": "import { a } from './lib'\nimport x from \"../shared/util.js\";\nimport '@scope/web/style'\nimport react from 'react'\n", "web/lib/index.ts": "export * from './part'\n", "web/lib/part.tsx": "const p = require('../app')\n",
    "shared/util.ts": "import {\n b,\n c } from '.'\n", "shared/index.ts": "const late = import('./util')\n", "web/style.js": "import a from 'shared/util'\n", "web/old.js": "var a = require('./style')\nvar b = require('./lib')\n",
}
JVM = {
    "src/main/java/a/b/One.java": "package a.b;\nimport a.c.Two;\nimport static a.c.Two.helper;\nimport java.util.List;\n", "src/main/java/a/c/Two.java": "package a.c;\nimport a.b.One.Inner;\nimport a.b.*;\n",
    "src/test/java/a/c/Two.java": "package a.c;\n", "src/main/kotlin/k/Top.kt": "package k\nimport a.c.Two\n", "Lone.java": "import k.Top;\n", "src/main/java/a/b/Three.java": "package a.b;\n",
}
REST = {
    "c/main.c": '#include "util.h"\n#include <deep/x.h>\n  # include <stdio.h>\n', "c/util.h": '#include "../include/deep/x.h"\n', "include/deep/x.h": "", "c/util.c": '#import "util.h"\n',
    "lib/r.rb": "require 'other'\nrequire_relative '../app/m'\n", "lib/other.rb": "", "app/m.rb": "require('r')\nrequire_relative 'm.rb'\n", "app/in/q.rb": 'require_relative "../m"\nrequire "../other"\n',
    "go.mod": "module example.org/tool // x\n\ngo 1.21\n", "main.go": 'package main\n\nimport (\n\t"fmt"\n\tx "example.org/tool/sub" // s\n)\nvar s = "example.org/tool/not"\n', "sub/one.go": 'package sub\nimport "example.org/tool"\n', "sub/two.go": "package sub\n", "not/n.go": "package not\n",
}
WANT = {
    "py": [("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/sub/c.py"), ("pkg/a.py", "pkg/sub/__init__.py"), ("pkg/b.py", "pkg/a.py"), ("pkg/sub/__init__.py", "pkg/sub/c.py"), ("pkg/sub/c.py", "pkg/b.py"), ("pkg/sub/c.py", "tool.py"), ("tool.py", "pkg/a.py"), ("tool.py", "src/src_only.py"),
        ("src/src_only.py", "src/helper.py"), ("deep/x/y/main.py", "deep/x/y/near.py")],
    "js": [("web/app.ts", "web/lib/index.ts"), ("web/app.ts", "shared/util.ts"), ("web/lib/index.ts", "web/lib/part.tsx"), ("web/lib/part.tsx", "web/app.ts"), ("shared/util.ts", "shared/index.ts"), ("shared/index.ts", "shared/util.ts"), ("web/style.js", "shared/util.ts"), ("web/old.js", "web/style.js"),
        ("web/old.js", "web/lib/index.ts"), ("web/app.ts", "web/style.js")],
    "jvm": [("src/main/java/a/b/One.java", "src/main/java/a/c/Two.java"), ("src/main/java/a/c/Two.java", "src/main/java/a/b/One.java"), ("src/main/java/a/c/Two.java", "src/main/java/a/b/"), ("src/main/kotlin/k/Top.kt", "src/main/java/a/c/Two.java"), ("Lone.java", "src/main/kotlin/k/Top.kt"),
        ("src/main/java/a/b/", "src/main/java/a/b/One.java"), ("src/main/java/a/b/", "src/main/java/a/b/Three.java")],
    "rest": [("c/main.c", "c/util.h"), ("c/main.c", "include/deep/x.h"), ("c/util.h", "include/deep/x.h"), ("c/util.c", "c/util.h"), ("lib/r.rb", "lib/other.rb"), ("lib/r.rb", "app/m.rb"), ("app/m.rb", "lib/r.rb"), ("app/in/q.rb", "app/m.rb"), ("main.go", "sub/"), ("sub/", "sub/one.go"),
        ("sub/", "sub/two.go"), ("sub/one.go", ""), ("", "main.go")],
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(name, p, t, 1) for name, repo in (("py", PY), ("js", JS), ("jvm", JVM), ("rest", REST)) for p, t in repo.items()]
    return spark.createDataFrame([*rows, (None, "x.py", "import y", 1), ("py", None, "import y", 1), ("py", "pkg/a.py", PY["pkg/a.py"], 1)], "r string, p string, body string, path int")


def test_imports_are_resolved(files):
    got = {}
    for r in repository.dependency_edges(files, "r", "p", "body").collect():
        got.setdefault(r["r"], []).append((r["source"], r["target"]))
    for name, want in WANT.items():
        assert sorted(got[name]) == sorted(want), name


def test_paths_are_normalised(spark):
    from pyspark.sql import functions as F

    cases = {"a/b/../c": "a/c", "./a//b/.": "a/b", "a/../../b": None, "": "", "..": None, "a/..": "", "x/./../y/z": "y/z"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", repository.normal_path(F.col("p")).alias("n"))
    assert {r["p"]: r["n"] for r in df.collect()} == cases


def plain_order(nodes, edges):
    """{node: (layer, component)} by closures and recursion."""
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            reach[a] |= reach[b]
    unit = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    needs = {u: {unit[b] for a, b in edges if unit[a] == u and unit[b] != u} for u in set(unit.values())}
    known = {}

    def layer(u):
        if u not in known:
            known[u] = max((layer(v) + 1 for v in needs[u]), default=0)
        return known[u]

    return {n: (layer(unit[n]), unit[n]) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_order_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, links = [], []
    for repo, n in (("a", 14), ("b", 9), ("c", 1)):
        names = [f"f{i:02d}" for i in range(n)]
        rows += [(repo, p, rng.randrange(3)) for p in names]
        links += [(repo, *rng.sample(names, 2)) for _ in range(int(n * rng.choice([0.8, 1.3])) if n > 1 else 0)]
    links = [e for e in links if e[1] != e[2]]
    files = spark.createDataFrame(rows, "repo string, path string, w long")
    edges = spark.createDataFrame([*links, ("a", "f00", "gone"), ("z", "q", "r")], "repo string, source string, target string")
    got = {(r["repo"], r["path"]): (r["layer"], r["place"]) for r in repository.dependency_order(files, edges, "repo", "path", "w").collect()}
    for repo in "abc":
        own = {p: w for r, p, w in rows if r == repo}
        told = plain_order(list(own), [(a, b) for r, a, b in links if r == repo])
        order = sorted(own, key=lambda p: (*told[p], -own[p], p))
        assert [(p, got[repo, p]) for p in order] == [(p, (told[p][0], i + 1)) for i, p in enumerate(order)]
    assert len(got) == len(rows)


def test_order_without_edges_or_files(spark):
    files = spark.createDataFrame([("r", "a", 1), ("r", "a", 1), ("r", None, 1)], "repo string, path string, w long")
    none = spark.createDataFrame([], "repo string, source string, target string")
    assert [tuple(r) for r in repository.dependency_order(files, none, "repo", "path").collect()] == [("r", "a", 0, 1)]
    assert repository.dependency_order(files.limit(0), none, "repo", "path").count() == 0


def test_semantic_order(files):
    got = {}
    for r in repository.semantic_order(files, "r", "p", "body").orderBy("place").collect():
        got.setdefault(r["r"], []).append((r["p"], r["part"], r["place"]))
    assert [p for _, _, p in got["rest"]] == list(range(1, len(REST) + 1)) and {p for p, *_ in got["py"]} == set(PY)
    at = {n: {p: i for p, _, i in rows} for n, rows in got.items()}
    assert at["py"]["src/helper.py"] < at["py"]["src/src_only.py"] < at["py"]["tool.py"] and at["rest"]["include/deep/x.h"] < at["rest"]["c/util.h"] < at["rest"]["c/main.c"]
    assert got["rest"][-2:] == [("go.mod", 2, len(REST) - 1), ("not/n.go", 2, len(REST))]


def test_methods_are_counted(spark):
    from pyspark.sql import functions as F

    rows = [("a.py", "def f():\n  async def g(): pass\n", 2), ("a.go", "func x() {}\nfunc (t T) y() {}\n", 2), ("A.java", "class A { int f(int x) { if (x) { return g(x); } } }", 1), ("a.js", "function f() {}\nconst g = () => 1", 2), ("a.md", "def f():", 0)]
    df = spark.createDataFrame(rows, "p string, t string, n long")
    assert df.where(repository.methods(F.col("p"), F.col("t")) != F.col("n")).count() == 0


def test_very_long_texts(spark):
    """Long names, lists and lines need neither a stack nor more than linear time."""
    texts = [("a.java", "import " + "a." * 200_000 + "b;"), ("a.py", "from " + "." * 100_000 + " import " + "a, " * 100_000 + "b"), ("a.js", "import " * 20_000 + " " * 100_000 + "'x'"), ("a.go", "import (" + '"a"\n' * 50_000), ("a.rb", "require 'x'\n" * 20_000), ("a.c", '#include "' + "x/" * 100_000)]
    df = spark.createDataFrame([("r", p, t) for p, t in texts], "repo string, path string, text string").repartition(2)
    began = time.perf_counter()
    assert repository.dependency_edges(df, "repo", "path").count() == 0
    assert time.perf_counter() - began < 120
