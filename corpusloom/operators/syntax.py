"""Syntax of source code as a table of nodes: a lexer that sets comments and strings apart, and an island grammar that finds
packages, types and functions between them, also in code that is incomplete. Metrics, package lists and concepts are then
aggregates of nodes.

Texts go through in Arrow batches, a pattern's scan and one walk over brackets or indents each, linear in a text's length."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

ROOT, PACKAGE, COMMENT, TYPE, FUNCTION = "uast_root", "uast_package", "uast_comment", "uast_class", "uast_function"
_SLASHES, _STARS, _HASH = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE, _CHAR = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?', r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?", r"'(?:\\[^\n']*|[^\\'\n])'"
_BACK, _RAW = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+(?:`|\Z)", r"`[^`]*+(?:`|\Z)"
_TRIPLE = r'"""(?s:(?:[^\\"]|\\.|"(?!""))*+)(?:"""|\Z)'
_CONTROL = frozenset("if for while switch catch else do try finally synchronized using lock foreach when return new match loop unsafe guard repeat defer with".split())


@dataclass(frozen=True)
class Syntax:
    """How a language spells comments and strings, bounds blocks (braces, indents or end words), and heads types, functions and imports."""

    comments: str
    strings: str
    blocks: str = "braces"
    types: str = r"\b(?:class|struct|interface|enum|union|namespace|trait|impl|record|object|extension|protocol)\s+(\w+)"
    functions: str = ""
    #: Without a word that heads functions: an identifier before the first bracket of a block's head.
    bare: bool = False
    arrows: bool = False
    imports: tuple[str, ...] = ()


_JAVA = r"(?m)^[ \t]*import\s+([^;\n]+)"
_JS = Syntax(f"{_SLASHES}|{_STARS}", f"{_DOUBLE}|{_SINGLE}|{_BACK}", functions=r"\bfunction\b\s*\*?\s*([\w$]*)", bare=True, arrows=True,
    imports=(r"""\bimport\b\s*+(?:(?:(?!\b(?:import|from)\b)[\w*{}\s,$])*+\bfrom\b\s*+)*+(['"][^'"\n]+['"])""", r"""\brequire\s*\(\s*(['"][^'"\n]+['"])"""))
_C = Syntax(f"{_SLASHES}|{_STARS}", f"{_DOUBLE}|{_CHAR}", bare=True, imports=(r'(?m)^[ \t]*#[ \t]*include[ \t]*(["<][^">\n]+)[">]',))
#: Languages by their names, lower case.
LANGUAGES = {
    "python": Syntax(_HASH, rf'(?:\b[rbfuRBFU]{{1,2}})?(?:{_TRIPLE}|{_TRIPLE.replace(chr(34), chr(39))}|{_DOUBLE}|{_SINGLE})', "indent", r"(?m)^([ \t]*)class[ \t]+(\w+)", r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)",
        imports=(r"(?m)(?:^|;)[ \t]*import[ \t]+([^\n;]+)", r"(?m)(?:^|;)[ \t]*from[ \t]+([\w.]+)[ \t]+import\b")),
    "javascript": _JS, "typescript": _JS, "c": _C, "c++": _C,
    "java": Syntax(f"{_SLASHES}|{_STARS}", f"{_TRIPLE}|{_DOUBLE}|{_CHAR}", bare=True, imports=(_JAVA,)),
    "c#": Syntax(f"{_SLASHES}|{_STARS}", f'@"(?:[^"]|"")*+(?:"|\\Z)|{_DOUBLE}|{_CHAR}', bare=True, imports=(r"(?m)^[ \t]*using\s+([\w.= \t]+);",)),
    "go": Syntax(f"{_SLASHES}|{_STARS}", f"{_DOUBLE}|{_RAW}|{_CHAR}", types=r"\btype\s+(\w+)\s+(?:struct|interface)\b", functions=r"\bfunc\b\s*(?:\([^()]*\)\s*)?(\w*)", imports=(r'(?m)^import\s+(?:[\w.]+\s+)?("[^"\n]+")', r"(?m)^import\s*\(((?:(?!^import\b)[^)])*+)\)")),
    "rust": Syntax(f"{_SLASHES}|{_STARS}", f'r(#*)"(?s:.*?)"\\1|{_DOUBLE}|{_CHAR}', functions=r"\bfn\s+(\w+)", imports=(r"(?m)^[ \t]*(?:pub\s+)?use\s+((?:(?!^[ \t]*use\b)[^;])++);",)),
    "kotlin": Syntax(f"{_SLASHES}|{_STARS}", f"{_TRIPLE}|{_DOUBLE}|{_CHAR}", functions=r"\bfun\b\s*(?:<[^<>]*>\s*)?(?:[\w<>?]+\.)*(\w+)", imports=(_JAVA,)),
    "ruby": Syntax(rf"{_HASH}|(?m:^=begin\b)(?s:.*?)(?:(?m:^=end\b)[^\n]*|\Z)", f"{_DOUBLE}|{_SINGLE}", "end", r"^(?:class|module)\s+([\w:]+)", r"^def\s+([\w.?!=]+)", imports=(r"""(?m)^[ \t]*require(?:_relative)?[ \t(]+(['"][^'"\n]+['"])""",)),
}
LANGUAGES |= {"js": _JS, "jsx": _JS, "ts": _JS, "tsx": _JS, "py": LANGUAGES["python"], "cpp": _C, "c_sharp": LANGUAGES["c#"], "golang": LANGUAGES["go"]}


_INSIDE = "\x02"


def _masked(text: str, syntax: Syntax) -> tuple[str, str, list[tuple[int, int]]]:
    """(text with comments blanked and strings filled, text with comments and free-standing texts blanked, spans of comments). Line
    ends stay; strings are filled with quotes, their further lines with _INSIDE."""
    comments, code, bare, at = [], [], [], 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    for m in re.finditer(f"(?P<comment>{syntax.comments})|{syntax.strings}", text):
        before, found = text[at : m.start()], m[0]
        free = syntax.blocks == "indent" and found[-3:] in ('"""', "'''") and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
        if m["comment"] is not None:
            comments.append(m.span())
        head, end, rest = found.partition("\n")
        code += [before, blank(found) if m["comment"] is not None else '"' * len(head) + end + re.sub(r"[^\n]", _INSIDE, rest)]
        bare += [before, blank(found) if free or m["comment"] is not None else found]
        at = m.end()
    return "".join([*code, text[at:]]), "".join([*bare, text[at:]]), comments


def _braces(code: str, syntax: Syntax) -> Iterator[tuple[str, str, int, int]]:
    """(kind, name, start, end) of blocks in braces. A frame: what opened it, its kind and name, where its head began, where the head
    of the next block in it begins. Closing brackets without a partner are skipped; open blocks end with the text."""
    stack, at = [["", "", "", 0, 0]], 0
    for m in re.finditer(r"[{}();]", code):
        c, at = m[0], m.start()
        if c == "(":
            stack.append(["(", "", "", at, at + 1])
        elif c == ")":
            if stack[-1][0] == "(":
                stack.pop()
        elif c == ";":
            if stack[-1][0] != "(":
                stack[-1][4] = at + 1
        elif c == "{":
            begun = stack[-1][4]
            kind, name, named = _head(code[begun:at], syntax)
            begun = max(begun, code.rfind("\n", 0, begun + named) + 1)  # from the line of its name on
            stack.append(["{", kind, name, begun + re.match(r"[\s,]*", code[begun:at]).end(), at + 1])
        elif any(f[0] == "{" for f in stack[-64:]) or any(f[0] == "{" for f in stack):
            while stack[-1][0] == "(":
                stack.pop()
            _, kind, name, start, _ = stack.pop()
            if kind:
                yield kind, name, start, at + 1
            stack[-1][4] = at + 1
        else:
            del stack[1:]  # brackets that nothing closes any more
            stack[-1][4] = at + 1
    for _, kind, name, start, _ in stack:
        if kind:
            yield kind, name, start, len(code.rstrip())


def _head(head: str, syntax: Syntax) -> tuple[str, str, int]:
    """(kind, name, place of what tells them) of a block by the text before it; ("", "", 0) for other blocks. Patterns see it
    with single spaces, so that blanked comments cost nothing."""
    flat = re.sub(r"\s+", " ", head.strip())
    flat = re.sub(r"@\w+(?:\([^()]*\))?", lambda m: "@" * len(m[0].replace(" ", "")), flat)
    first = re.match(r"[ @]*(\w*)", flat)[1]

    def told(kind: str, name: str, at: int) -> tuple[str, str, int]:
        before = len(flat[:at].replace(" ", ""))
        return kind, name, next(islice(re.finditer(r"\S", head), before, None)).start()

    if first in _CONTROL:
        return "", "", 0
    if syntax.functions and (m := re.search(syntax.functions, flat)):
        return told(FUNCTION, next((g for g in m.groups() if g), ""), m.start())
    if syntax.arrows and (m := re.match(r" ?>= ?(?:\)[^()]*+\(|[\w$]++) ?(?:cnysa ?)?(?:[=:] ?([\w$]++))?", flat[::-1])):
        return told(FUNCTION, (m[1] or "")[::-1], len(flat) - m.end())  # read from the end
    called = re.search(r"(?<![~\w$])([~\w$]+) ?(?:<[^<>()]*> ?)?\(", flat) if syntax.bare else None
    named = re.search(syntax.types, flat)
    if named and not (called and re.search(r"\)[^()]*$", flat) and called.start() > named.start() and first in ("struct", "enum", "union", "static", "const")):
        return told(TYPE, named[1], named.start())
    if called and called[1] not in _CONTROL and ")" in flat[called.end() :] and "=" not in flat[: called.start()]:
        return told(FUNCTION, called[1], called.start())
    return "", "", 0


def _indents(code: str, syntax: Syntax) -> Iterator[tuple[str, str, int, int]]:
    """Blocks by indent: up to the last line before one that is indented no more than the head, lines within brackets apart."""
    heads = {m.start(): (kind, m[2]) for kind, pattern in ((TYPE, syntax.types), (FUNCTION, syntax.functions)) for m in re.finditer(pattern, code)}
    open_, depth, at, last = [], 0, 0, 0
    for line in code.split("\n"):
        if line.startswith(_INSIDE):
            last, at = at + len(line.rstrip()), at + len(line) + 1
            continue
        bare = line.strip()
        head = heads.get(at)
        if head:
            depth = 0  # a head can't be within brackets: they were never closed
        if bare and depth == 0:
            indent = len(line.expandtabs()) - len(line.expandtabs().lstrip())
            while open_ and open_[-1][2] >= indent:
                kind, name, _, start = open_.pop()
                yield kind, name, start, last
            if head:
                open_.append((*head, indent, at + len(line) - len(line.lstrip())))
        if bare:
            last = at + len(line.rstrip())
            depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
        at += len(line) + 1
    for kind, name, _, start in reversed(open_):
        yield kind, name, start, last


_OPENS = re.compile(r"(?m)^[ \t]*(?P<word>class|module|def|begin|case|if|unless|while|until|for)\b[^\n;]*|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|(?P<end>^[ \t]*end\b|;[ \t]*end\b)")


def _ends(code: str, syntax: Syntax) -> Iterator[tuple[str, str, int, int]]:
    """Blocks that a word opens and `end` closes. A loop's own `do` opens nothing; definitions on one line are closed there."""
    stack, loop = [], -1
    for m in _OPENS.finditer(code):
        if m["end"]:
            if stack:
                kind, name, start = stack.pop()
                if kind:
                    yield kind, name, start, m.end()
            continue
        said = m[0].strip()
        if m["word"] is None and loop >= 0 and code.find("\n", loop, m.start()) < 0:
            continue
        if re.search(r"\bend\s*$", said):  # opened and closed on one line
            if m["word"] == "def":
                yield FUNCTION, re.match(syntax.functions, said)[1], m.end() - len(m[0].lstrip()), m.end()
            continue
        loop = m.start() if m["word"] in ("while", "until", "for") else -1
        if m["word"] == "def" and re.match(r"def\s+[\w.?!]+(?:\([^)]*\))?\s*=\s", said):
            yield FUNCTION, re.match(syntax.functions, said)[1], m.end() - len(m[0].lstrip()), m.end()
            continue
        kind, found = (TYPE, re.match(syntax.types, said)) if m["word"] in ("class", "module") else (FUNCTION, re.match(syntax.functions, said)) if m["word"] == "def" else ("", None)
        stack.append((kind if found else "", found[1] if found else "", m.start() + len(m[0]) - len(m[0].lstrip())))
    for kind, name, start in reversed(stack):
        if kind:
            yield kind, name, start, len(code.rstrip())


def _imported(language: str, bare: str) -> Iterator[tuple[str, int, int]]:
    """(package, start, end), as the language names it: Python's first part, a path without quotes, a name without its alias."""
    for pattern in LANGUAGES[language].imports:
        for m in re.finditer(pattern, bare):
            said, span = m[1], m.span(1)
            if language in ("python", "py"):
                names = dict.fromkeys(n.strip().split(" ")[0].split(".")[0] for n in said.split(","))
            elif language in ("go", "golang"):
                names = re.findall(r'"([^"\n]+)"', said)
            elif language in ("c#", "c_sharp"):
                names = [said.split("=")[-1].strip()]
            elif language == "kotlin":
                names = [re.split(r"\s+as\s", said)[0].strip().removesuffix(".*")]
            else:
                names = [re.split(r"\s+as\s", said.strip("\"'<> \t;"))[0].strip()]
            yield from ((n, *span) for n in names if n)


_WALKS = {"braces": _braces, "indent": _indents, "end": _ends}


def parse(text: str, language: str) -> list[tuple[int, int | None, str, str, int, int, int]]:
    """(node, parent, kind, name, start, end, loc) in the order of their starts, node 0 is the root; none for other languages.

    Spans count code points. loc of comments are their lines that aren't blank, of others their lines with code on them."""
    syntax = LANGUAGES.get(language.lower())
    if syntax is None:
        return []
    code, bare, comments = _masked(text, syntax)
    lines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10) + 1
    starts = [0, *lines.tolist()]
    filled = lambda s: np.cumsum([0, *(bool(x.strip()) for x in s.split("\n"))])
    coded = filled(bare)
    first = lambda at: bisect_right(starts, at) - 1
    loc = lambda a, b: int(coded[first(max(b - 1, a)) + 1] - coded[first(a)])
    found = [(a, -b, 0, COMMENT, text[a:b], sum(bool(x.strip()) for x in text[a:b].split("\n"))) for a, b in comments]
    found += [(a, -b, 0, kind, name, loc(a, b)) for kind, name, a, b in _WALKS[syntax.blocks](code, syntax)]
    found += [(a, -b, i, PACKAGE, name, 1) for i, (name, a, b) in enumerate(_imported(language.lower(), bare))]
    out, stack = [(0, None, ROOT, "", 0, len(text), int(coded[-1]))], [(0, len(text))]
    for a, b, _, kind, name, n in sorted(found):
        while len(stack) > 1 and stack[-1][1] <= a:
            stack.pop()
        out.append((len(out), stack[-1][0], kind, name, a, -b, n))
        if kind in (TYPE, FUNCTION):
            stack.append((len(out) - 1, -b))
    return out


_KIND = "node int, parent int, kind string, name string, first long, last long, loc long"


def nodes(df: DataFrame, text: str = "text", language: str = "language", id_column: str = "doc_id") -> DataFrame:
    """id, node, parent, kind, name, first, last (exclusive), loc of all nodes of all texts in known languages; a comment's name is
    its text. Null texts and languages give no node, empty texts their root; repeated rows give their nodes each."""
    own = df.select(col(id_column).alias("id"), col(text).cast("string").alias("text"), F.lower(col(language)).alias("language")).where(F.col("language").isin(sorted(LANGUAGES)) & F.col("text").isNotNull())

    def run(batches):
        names = ["id", "node", "parent", "kind", "name", "first", "last", "loc"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            for i, (t, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                rows = parse(t, lang)
                for lo in range(0, len(rows), 1 << 14):
                    part = rows[lo : lo + (1 << 14)]
                    ids = b.column(0).take(pa.array([i] * len(part)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True))], names=names)

    return own.mapInArrow(run, f"id {own.dtypes[0][1]}, {_KIND}")


def metrics(found: DataFrame) -> DataFrame:
    """id, ccr, code_snippet_len, avg_fn_len_in_snippet, package_list of each text from its nodes.

    ccr: lines of code over lines of comments to one place, 0 without comments, -1 without code; mean lines of functions to one
    place, 0 without any; packages in the order of their nodes. Ids must be unique, and null ids count as one text."""
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("loc"))), F.lit(0))
    length, comments, count = total(ROOT), total(COMMENT), F.count_if(F.col("kind") == FUNCTION)
    ccr = F.when(length == 0, -1.0).when(comments == 0, 0.0).otherwise(F.round(length / comments, 1))
    packages = F.array_sort(F.collect_list(F.when(F.col("kind") == PACKAGE, F.struct("node", "name"))))
    mean = F.when(count == 0, 0.0).otherwise(F.round(total(FUNCTION) / count, 1))
    return found.groupBy("id").agg(ccr.alias("ccr"), length.cast("long").alias("code_snippet_len"), mean.alias("avg_fn_len_in_snippet"), F.array_join(F.transform(packages, lambda p: p["name"]), ",").alias("package_list"))


def concepts(found: DataFrame, languages: DataFrame, known: DataFrame) -> DataFrame:
    """id, library, concept for each distinct package of a text; `languages` has id and language, `known` has library, language and
    concept. What isn't known has a null concept."""
    used = found.where(F.col("kind") == PACKAGE).select("id", F.col("name").alias("library")).distinct().join(languages.select("id", F.lower("language").alias("language")), "id")
    return used.join(known.select("library", F.lower("language").alias("language"), "concept"), ["library", "language"], "left").select("id", "library", "concept")


def described(comment: Column) -> Column:
    """A comment's text without its marks."""
    return F.trim(F.regexp_replace(comment, r"^(?://+|/\*+|#+|=begin)|\*+/$|=end$", ""))
