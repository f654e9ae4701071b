"""Repositories as graphs: imports resolved to files of the same repository, and files in the order of their dependencies.

An import statement becomes addresses that the imported file may have, in the order in which its language looks them up. Files
tell the addresses they have: their path, and by what they declare their qualified name (Java, Kotlin, Groovy) or their package
(these and Go). Both meet in one join on repository and address, and the first address that is met holds. A package, as a whole
imported, is a node of its own, spelled as its folder with a closing slash; edges lead from it to its files, so that a package of
many files with many importers has edges for their sum, not their product.

Everything is joins and aggregates on (repository, address) or on numbers of nodes; a repository may be of any size. Steps of the
graph's search are written to the shared folder, one small table a step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..sources.shared import stored
from .filters import sequential_id

#: File endings, without the dot, and the family of languages whose rules their imports follow.
FAMILY = {
    "py": "python", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "java": "jvm", "kt": "jvm", "groovy": "jvm",
    "c": "c", "h": "c", "cpp": "c", "cc": "c", "hpp": "c", "m": "c", "rb": "ruby", "go": "go",
}
#: Characters; file systems have no longer paths.
LONGEST_PATH = 4096
#: Endings that are tried on a module's name, by family.
ENDINGS = {"js": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "ts": ("ts", "tsx", "d.ts", "js", "jsx")}
#: Statements: the pattern, and the group that names what is imported; Python's second group lists names of the module.
_FROM = r"(?m)(?:^|;)[ \t]*from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n#;]+)"
_IMPORT = r"(?m)(?:^|;)[ \t]*import[ \t]+([^\n#;]+)"
_SCRIPT = r"""(?:\bimport\s++(?:type\s++)?(?:[\w$]++\s*+,?\s*+)?(?:\{[^{}'"]*+\}\s*+|\*\s*+as\s++[\w$]++\s*+)?(?:from\s*+)?|\bexport\s++(?:type\s++)?(?:\*(?:\s*+as\s++[\w$]++)?|\{[^{}'"]*+\})\s*+from\s*+|\b(?:require|import)\s*+\(\s*+)['"]([^'"\n]+)['"]"""
#: Classes of characters are repeated, not groups: a name of any length needs no stack.
_JVM = r"(?m)^[ \t]*import[ \t]+((?:static[ \t]+)?\w[\w.]*\*?)"
_C = r'(?m)^[ \t]*#[ \t]*(?:include|import)[ \t]*(["<][^">\n]+)[">]'
_RUBY = r"""(?m)^[ \t]*(require(?:_relative)?[ \t(]+['"][^'"\n]+)['"]"""
_GO = r"""(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*(?://.*)?$"""
_PACKAGE = r"(?m)^[ \t]*package[ \t]+([\w.]+)"
#: Heads of functions and methods, by family.
METHODS = {
    "python": r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]", "js": r"\bfunction\b|=>", "ts": r"\bfunction\b|=>", "ruby": r"(?m)^[ \t]*def[ \t]", "go": r"(?m)^func\b",
    "jvm": r"\bfun\s+\w|\b(?!if|for|while|switch|catch|return|new)\w+\s*\([^(){};]*\)\s*(?:throws[\w\s,.]+)?\{", "c": r"\b(?!if|for|while|switch|return)\w+\s*\([^(){};]*\)\s*(?:const\s*)?\{",
}


def folder(path: Column) -> Column:
    """The path's folder with a closing slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def family(path: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair]), ending(path))


def normal_path(path: Column) -> Column:
    """Without `.` and empty parts, `..` taken with the part before it; null if it leaves the top, or is longer than a path can be."""
    up = lambda s, p: F.when(s.isNull() | ((p == "..") & (F.size(s) == 0)), F.lit(None).cast("array<string>")).when(p == "..", F.slice(s, F.lit(1), F.size(s) - 1)).when((p == ".") | (p == ""), s).otherwise(F.concat(s, F.array(p)))
    return F.when(F.length(path) <= LONGEST_PATH, F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up), "/"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings(*items: Column) -> Column:
    return F.array(*items) if items else F.array().cast("array<string>")


def _ancestors(at: Column) -> Column:
    """All folders above and at a folder (closing slashes), the top first."""
    parts = F.filter(F.split(at, "/"), lambda p: p != "")
    return _let(parts, lambda ps: F.transform(F.sequence(F.lit(0), F.size(ps)), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(ps, F.lit(1), n), "/"), F.lit("/")))))


def _deepest(folders: DataFrame, marks: DataFrame, having: bool, into: str) -> DataFrame:
    """repo, at, `into`: of each folder the deepest one above or at it that is among marks (having), or isn't; null if there is none."""
    above = folders.select("repo", "at", F.explode(_ancestors(F.col("at"))).alias("above"))
    marked = above.join(marks.select("repo", F.col("at").alias("above"), F.lit(True).alias("marked")), ["repo", "above"], "left")
    fits = F.col("marked").isNotNull() if having else F.col("marked").isNull() | (F.col("above") == "")
    return marked.groupBy("repo", "at").agg(F.max_by(F.when(fits, F.col("above")), F.when(fits, F.length("above"))).alias(into))


#: Stands for the importer's package root, the deepest folder above it without __init__.py, until that is joined.
_ROOT = "^/"


def _python(text: Column, at: Column) -> Column:
    """Candidates of each name that a `from` or `import` statement brings. Roots: the importer's package root, the top, src, the
    importer's folder; names first as modules, then as things within the module."""
    listed = lambda names: F.filter(F.transform(F.split(F.regexp_replace(names, r"(?m)#.*$|[()\\]", " "), ","), lambda n: F.regexp_extract(n, r"^\s*([\w.*]+)", 1)), lambda n: n != "")
    both = lambda path: (F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))
    roots = F.array(F.lit(_ROOT), F.lit(""), F.lit("src/"), at)
    froms = F.arrays_zip(F.regexp_extract_all(text, F.lit(_FROM), F.lit(1)).alias("module"), F.regexp_extract_all(text, F.lit(_FROM), F.lit(2)).alias("names"))

    def of(base: Column, module: Column, name: Column) -> Column:
        inner = F.concat(base, module, F.when(module == "", "").otherwise("/"), name)
        return _strings(*both(inner), *[F.when(module != "", c) for c in both(F.concat(base, module))], F.when(module == "", F.concat(base, F.lit("__init__.py"))))

    def said(s: Column) -> Column:
        dots = F.length(F.regexp_extract(s["module"], r"^\.*", 0))
        path = F.regexp_replace(F.regexp_replace(s["module"], r"^[.\s]*", ""), r"\.", "/")
        near = F.when(dots <= F.size(F.split(at, "/")), F.concat(at, F.repeat(F.lit("../"), dots - 1)))  # not above the top
        named = lambda v: F.transform(listed(s["names"]), lambda n: F.when(v["dots"] > 0, of(v["near"], v["path"], n)).otherwise(F.flatten(F.transform(roots, lambda r: of(r, v["path"], n)))))
        return _let(F.struct(dots.alias("dots"), path.alias("path"), near.alias("near")), named)  # computed once a statement

    plain = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_IMPORT), F.lit(1)), listed))
    module = lambda n: F.flatten(F.transform(roots, lambda r: _let(F.concat(r, F.regexp_replace(n, r"\.", "/")), lambda p: _strings(*both(p)))))
    return F.concat(F.flatten(F.transform(froms, said)), F.transform(plain, module))


def _script(text: Column, at: Column, kind: str) -> Column:
    """Relative names from the importer's folder; others from the top, for scoped ones also without the scope. A name may be the
    file's, lack an ending, or be a folder with an index file; `.js` may stand for a TypeScript file."""
    ends = ENDINGS[kind]

    def tried(base: Column) -> Column:
        bare = F.regexp_replace(base, r"\.[mc]?jsx?$", "")
        return _strings(base, *[F.concat(base, F.lit(f".{e}")) for e in ends], *[F.concat(base, F.lit(f"/index.{e}")) for e in ends], *[F.when(bare != base, F.concat(bare, F.lit(e))) for e in (".ts", ".tsx")])

    def said(name: Column) -> Column:
        near = tried(F.concat(at, name))
        scoped = F.when(name.startswith("@") & name.contains("/"), F.regexp_replace(name, r"^[^/]*/", "")).otherwise(name)
        return F.when(name.rlike(r"^\.\.?(?:/|$)"), near).otherwise(F.concat(tried(F.regexp_replace(name, "^/", "")), tried(scoped)))

    return F.transform(F.regexp_extract_all(text, F.lit(_SCRIPT), F.lit(1)), said)


def _jvm(text: Column) -> Column:
    """Qualified names; of static imports and nested classes the enclosing class; `.*` the package, else the class."""

    def said(s: Column) -> Column:
        name = F.regexp_replace(s, r"^static\s+", "")
        outer = F.regexp_replace(name, r"\.[^.]*$", "")
        return F.when(name.endswith(".*"), _strings(F.concat(F.lit("pk:"), outer), F.concat(F.lit("fq:"), outer))).otherwise(_strings(F.concat(F.lit("fq:"), name), F.concat(F.lit("fq:"), outer)))

    return F.transform(F.regexp_extract_all(text, F.lit(_JVM), F.lit(1)), said)


def _c(text: Column, at: Column) -> Column:
    """Quoted: the includer's folder, the top, include, src; in angles the same without the includer's folder."""

    def said(s: Column) -> Column:
        name = F.substring(s, F.lit(2), F.length(s))
        return _strings(F.when(s.startswith('"'), F.concat(at, name)), name, F.concat(F.lit("include/"), name), F.concat(F.lit("src/"), name))

    return F.transform(F.regexp_extract_all(text, F.lit(_C), F.lit(1)), said)


def _ruby(text: Column, at: Column) -> Column:
    """The requirer's folder, one folder less far up, then lib and the top."""

    def said(s: Column) -> Column:
        name = F.regexp_replace(F.regexp_replace(s, r"""^require(?:_relative)?[ \t(]+['"]""", ""), r"\.rb$", "")
        return _strings(*[F.concat(p, name, F.lit(".rb")) for p in (at, F.lit("lib/"), F.lit(""))], F.when(name.contains("../"), F.concat(at, F.regexp_replace(name, r"^(.*?)\.\./", "$1"), F.lit(".rb"))))

    return F.transform(F.regexp_extract_all(text, F.lit(_RUBY), F.lit(1)), said)


def _go(text: Column) -> Column:
    block = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^import\s*\([^)]*\)|^import[^\n]*$"), F.lit(0)), "\n")
    return F.transform(F.regexp_extract_all(F.regexp_replace(block, r"import\s*\(", "\n"), F.lit(_GO), F.lit(1)), lambda s: _strings(F.concat(F.lit("go:"), s)))


def _sources(files: DataFrame, group: str, path: str, text: str) -> DataFrame:
    """repo, path, at (folder), family, text; rows without repository or path can't be imported and are left out."""
    p = col(path)
    out = files.select(col(group).alias("repo"), p.alias("path"), F.coalesce(col(text), F.lit("")).alias("text")).where("repo IS NOT NULL AND path IS NOT NULL")
    return out.select("repo", "path", folder(F.col("path")).alias("at"), family(F.col("path")).alias("family"), "text")


def addresses(files: DataFrame) -> DataFrame:
    """repo, address, target of all that can be imported: files by path and by qualified name, packages by name."""
    mods = files.where(F.col("path").rlike(r"(?:^|/)go\.mod$")).select("repo", "at", F.regexp_extract("text", r"(?m)^module[ \t]+(\S+)", 1).alias("module"))
    go = files.where("family = 'go'").select("repo", "at").distinct()
    rooted = _deepest(go, mods, True, "above").join(mods.withColumnRenamed("at", "above"), ["repo", "above"])
    inside = F.regexp_replace(F.substring(F.col("at"), F.length("above") + 1, F.length("at")), "/$", "")
    packages = rooted.select("repo", F.concat_ws("/", F.concat(F.lit("go:"), "module"), F.when(inside != "", inside)).alias("address"), F.col("at").alias("target"))
    declared = F.regexp_extract("text", _PACKAGE, 1)
    jvm = files.where("family = 'jvm'").select("repo", "path", "at", declared.alias("package"))
    named = jvm.select("repo", F.concat(F.lit("fq:"), F.concat_ws(".", F.when(F.col("package") != "", F.col("package")), stem(F.col("path")))).alias("address"), F.col("path").alias("target"))
    whole = jvm.where("package <> ''").select("repo", F.concat(F.lit("pk:"), "package").alias("address"), F.col("at").alias("target")).distinct()
    return files.select("repo", F.col("path").alias("address"), F.col("path").alias("target")).union(named).union(whole).union(packages)


def candidates(files: DataFrame) -> DataFrame:
    """repo, source, statement, choice, address: what each import may mean, the first choice first."""
    text, at = F.col("text"), F.col("at")
    means = {"python": _python(text, at), "js": _script(text, at, "js"), "ts": _script(text, at, "ts"), "jvm": _jvm(text), "c": _c(text, at), "ruby": _ruby(text, at), "go": _go(text)}
    said = F.lit(None).cast("array<array<string>>")
    for name, meaning in means.items():
        said = F.when(F.col("family") == name, meaning).otherwise(said)
    # one pass over the texts; outer, since filters of empty arrays would read the texts twice
    each = files.where("family IS NOT NULL").select("repo", "at", F.col("path").alias("source"), said.alias("said")).select("repo", "at", "source", F.posexplode_outer("said").alias("statement", "tried"))
    each = each.select("repo", "at", "source", "statement", F.posexplode_outer("tried").alias("choice", "address")).where("address IS NOT NULL")
    roots = _deepest(files.where("family = 'python'").select("repo", "at").distinct(), files.where(F.col("path").rlike(r"(?:^|/)__init__\.py$")).select("repo", "at").distinct(), False, "root")
    rooted = F.when(F.col("address").startswith(_ROOT), F.concat(F.coalesce("root", F.lit("")), F.substring(F.col("address"), F.lit(3), F.length("address")))).otherwise(F.col("address"))
    each = each.join(roots, ["repo", "at"], "left").select("repo", "source", "statement", "choice", rooted.alias("address"))
    plain = F.col("address").rlike("^(?:go|pk|fq):")
    return each.withColumn("address", F.when(plain, F.col("address")).otherwise(normal_path(F.col("address")))).where("address <> ''")


def dependency_edges(files: DataFrame, group: str, path: str, text: str = "text") -> DataFrame:
    """group, source, target: files, and the file or package of the same repository that each imports; and packages (folders with
    a closing slash) that are imported with their files. Languages are told by the files' endings.

    Imports that nothing in the repository answers to give no edge, nor do files that import themselves; of files of one
    qualified name the first by path is meant; repeated files count once; null and empty texts import nothing."""
    own = _sources(files, group, path, text)
    # distinct before the join: an address that all files import is looked up once a repository and language's choice
    known = addresses(own).groupBy("repo", "address").agg(F.min("target").alias("target"))
    met = candidates(own).join(known, ["repo", "address"])
    first = met.groupBy("repo", "source", "statement").agg(F.min_by("target", F.struct("choice", "target")).alias("target"))
    edges = first.where("source <> target").select("repo", "source", "target").distinct()
    whole = edges.where(F.col("target").endswith("/") | (F.col("target") == "")).select("repo", F.col("target").alias("at")).distinct()
    members = own.where("family IN ('go', 'jvm')").select("repo", "at", "path").join(whole, ["repo", "at"]).select("repo", F.col("at").alias("source"), F.col("path").alias("target")).distinct()
    return edges.union(members).select(F.col("repo").alias(group), "source", "target")


def methods(path: Column, text: Column) -> Column:
    """How many functions and methods a file has, by their heads."""
    pattern = F.element_at(F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair]), family(path))
    return F.coalesce(F.regexp_count(text, pattern), F.lit(0)).cast("long")


def _spread(start: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """node, `value`: the least value among the nodes from which a node is reached, its own included; edges are (a, b), start has
    (node, value). Each step sends on only values that have fallen in the last one."""
    held, moved = start, start
    while True:
        sent = edges.join(moved.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min(value).alias("new"))
        met = stored(held.join(sent, "node", "left"), "graph")
        moved = met.where(F.col("new") < F.col(value)).select("node", F.col("new").alias(value))
        if moved.isEmpty():
            return held
        held = met.select("node", F.least(value, F.coalesce("new", value)).alias(value))


def _core(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out, taken away again and again until no others are left."""
    n = edges.count()
    while n:
        both = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        edges, before = stored(both, "graph"), n
        n = edges.count()
        if n == before:
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes that are on a cycle; edges are (a, b), distinct, without loops.

    Forward-backward search with colours: each node takes the least colour that reaches it, in a shuffled order of nodes; what
    reaches its colour's own node back is one component. These go, and the rest is searched again."""
    left, found = stored(edges.select("a", "b"), "graph"), None
    while True:
        left = _core(left)
        if left.isEmpty():
            break
        nodes = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
        mark = nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("colour"))
        coloured = stored(_spread(mark, left, "colour"), "graph")
        a, b = (coloured.select(F.col("node").alias(x), F.col("colour").alias(f"c{x}")) for x in "ab")
        inside = stored(left.join(a, "a").join(b, "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")), "graph")
        back = _spread(coloured.select("node", (F.col("node") != F.col("colour.n")).cast("int").alias("far")), inside.select(F.col("b").alias("a"), F.col("a").alias("b")), "far")
        one = stored(back.where("far = 0").join(coloured, "node").select("node", F.col("colour.n").alias("colour")), "graph")
        least = one.groupBy("colour").agg(F.min("node").alias("component"))
        one = one.join(least, "colour").select("node", "component")
        found = one if found is None else found.union(one)
        gone = one.select("node")
        left = stored(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "graph")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")


def layers(edges: DataFrame) -> DataFrame:
    """node, layer of all nodes with needs in a graph without cycles, edges (a, b) from a to what it needs: one more than the
    highest layer among what it needs, which is 0 for nodes that need nothing.

    Each step drops the edges to nodes that have none themselves; a node's layer is the number of steps that it still has edges in."""
    left, found, layer = stored(edges.select("a", "b").distinct(), "graph"), None, 0
    while not left.isEmpty():
        layer += 1
        needy = left.select(F.col("a").alias("node")).distinct()
        one = needy.select("node", F.lit(layer).cast("long").alias("layer"))
        found = one if found is None else found.union(one)
        left = stored(left.join(needy.withColumnRenamed("node", "b"), "b", "left_semi"), "graph")
    if found is None:
        return left.select(F.col("a").alias("node"), F.lit(0).cast("long").alias("layer"))
    return found.groupBy("node").agg(F.max("layer").alias("layer"))


def dependency_order(files: DataFrame, edges: DataFrame, group: str, path: str, weight: str | None = None) -> DataFrame:
    """group, path, layer, place: each file after all that it imports, but for those on a cycle with it, which share its layer.

    Within a layer, cycles stay together, by their first path; on a cycle the file of most weight (say, methods) comes first, as
    the imports of what weighs least are the ones to give up. Places of a group count from 1. Files that no edge touches are in
    layer 0; repeated files count once; edges to files that aren't listed are left out, packages' nodes get no place."""
    own = files.select(col(group).alias("repo"), col(path).alias("path"), (col(weight) if weight else F.lit(0)).cast("long").alias("weight")).where("repo IS NOT NULL AND path IS NOT NULL").groupBy("repo", "path").agg(F.max("weight").alias("weight"))
    links = edges.select(col(group).alias("repo"), "source", "target").where("repo IS NOT NULL").distinct()
    packages = links.where(F.col("source").endswith("/") | (F.col("source") == "")).select("repo", F.col("source").alias("path"), F.lit(None).cast("long").alias("weight")).distinct()
    nodes = stored(sequential_id(own.union(packages), ["repo", "path"], "node"), "graph")
    number = lambda name, into: nodes.select("repo", F.col("path").alias(name), F.col("node").alias(into))
    graph = stored(links.join(number("source", "a"), ["repo", "source"]).join(number("target", "b"), ["repo", "target"]).where("a <> b").select("a", "b"), "graph")
    cycles = stored(components(graph), "graph")
    to = lambda name: cycles.select(F.col("node").alias(name), F.col("component").alias(f"c{name}"))
    folded = graph.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    placed = nodes.join(cycles, "node", "left").withColumn("unit", F.coalesce("component", "node"))
    placed = placed.join(layers(folded).withColumnRenamed("node", "unit"), "unit", "left").withColumn("layer", F.coalesce("layer", F.lit(0)).cast("long"))
    ranked = stored(sequential_id(placed.where("weight IS NOT NULL").select("repo", "path", "layer", "unit", (-F.col("weight")).alias("light")), ["repo", "layer", "unit", "light", "path"], "at"), "graph")
    first = ranked.groupBy("repo").agg(F.min("at").alias("first"))
    return ranked.join(first, "repo").select(F.col("repo").alias(group), F.col("path").alias(path), "layer", (F.col("at") - F.col("first") + 1).alias("place"))


def semantic_order(files: DataFrame, group: str, path: str, text: str = "text", extensions: Sequence[str] = ("md", "rst", "tex", "txt")) -> DataFrame:
    """group, path, part, layer, place: first README-like and listed files that import nothing and aren't imported (part 0, by
    folder and name), then those with dependencies in their order (1), then the rest by path (2). Places count from 1."""
    edges = stored(dependency_edges(files, group, path, text), "graph")
    weighed = files.select(col(group).alias("repo"), col(path).alias("path"), methods(col(path), F.coalesce(col(text), F.lit(""))).alias("weight"))
    order = dependency_order(weighed, edges.withColumnRenamed(group, "repo"), "repo", "path", "weight")
    linked = edges.select(F.col(group).alias("repo"), F.explode(F.array("source", "target")).alias("path"), F.lit(True).alias("linked")).distinct()
    p = F.col("path")
    name = F.lower(F.regexp_extract(p, r"([^/]*)$", 1))
    told = name.contains("readme") | ending(p).isin(list(extensions))
    kind = F.when(F.col("linked"), 1).when(told, 0).otherwise(2)
    rank = F.when(F.col("linked"), F.col("place")).otherwise(F.when(name.contains("readme"), 0).when(told, 1).otherwise(2))
    at = F.when(F.col("linked"), F.lit("")).otherwise(folder(p))
    parts = order.join(linked, ["repo", "path"], "left").select("repo", "path", "layer", kind.cast("long").alias("part"), at.alias("at"), rank.alias("rank"))
    numbered = stored(sequential_id(parts, ["repo", "part", "at", "rank", "path"], "n"), "graph")
    first = numbered.groupBy("repo").agg(F.min("n").alias("first"))
    return numbered.join(first, "repo").select(F.col("repo").alias(group), F.col("path").alias(path), "part", "layer", (F.col("n") - F.col("first") + 1).alias("place"))
