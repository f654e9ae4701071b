"""Secret scans: fixed patterns, and probabilistic automata inferred from credentials by state merging (ALERGIA)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A match must reach the stated length; shorter ones lie in runs that hold no longer one, so the length may be asked for at once.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
#: What the automata judge: long runs of a credential's characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, 'kind:start:end') of the fixed patterns, leftmost and without overlap within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, start: int, kind: int, end: int) -> str:
    return ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def _symbol(c: str) -> str:
    """Characters by class, so that formats, not the very characters, are learned."""
    return "9" if c.isdigit() else "h" if c in "abcdef" else "a" if c.islower() else "A" if c.isupper() else c


@dataclass(frozen=True)
class Grammar:
    """One automaton: arcs[state] = {symbol: (next, log2 probability of the symbol)}; stop[state]: log2 probability of the end;
    plain: log2 probability of a symbol after another in texts that aren't credentials; `cut`: the least score of the format."""

    arcs: tuple
    stop: tuple
    plain: dict
    cut: float

    def bits(self, s: str) -> float:
        """Mean log2 likelihood ratio of a symbol, format to plain text; -inf where no path ends."""
        state, total, before = 0, 0.0, ""
        for c in map(_symbol, s):
            step = self.arcs[state].get(c)
            if step is None:
                return -math.inf
            state, total, before = step[0], total + step[1] - self.plain.get((before, c), _RARE), c
        return (total + self.stop[state] - self.plain.get((before, ""), _RARE)) / (len(s) + 1)


#: log2 probability of a pair of symbols that plain text never had.
_RARE = -12.0


def plain_text(texts: list[str]) -> dict[tuple[str, str], float]:
    """log2 probability of each symbol ("" for the end) after each other one; without texts, even ones."""
    pairs, before = Counter(), Counter()
    for t in texts:
        symbols = ["", *map(_symbol, t), ""]
        pairs.update(zip(symbols, symbols[1:], strict=False))
        before.update(symbols[:-1])
    if not texts:
        known = "9haA+/=_.-"
        return {(a, b): -math.log2(len(known) + 1) for a in ["", *known] for b in [*known, ""]}
    return {p: math.log2((n + 0.5) / (before[p[0]] + 5)) for p, n in pairs.items()}


class _Tree:
    """The samples' prefix tree, of which states are merged in place. seen: samples through a state; ends: those that end
    there; through: by symbol; rest: how many symbols were left, and how often."""

    def __init__(self, samples: list[str], alpha: float):
        self.next, self.ends, self.seen, self.through, self.depth, self.rest = [{}], [0], [0], [{}], [0], [Counter()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in samples:
            q, left = 0, len(s)
            for c in [*map(_symbol, s), None]:
                self.seen[q] += 1
                self.rest[q][left] += 1
                left -= 1
                if c is None:
                    self.ends[q] += 1
                    continue
                self.through[q][c] = self.through[q].get(c, 0) + 1
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    for made, new in ((self.next, {}), (self.ends, 0), (self.seen, 0), (self.through, {}), (self.depth, self.depth[q] + 1), (self.rest, Counter())):
                        made.append(new)
                q = self.next[q][c]

    def apart(self, gap: float, n: int, m: int) -> bool:
        """Hoeffding's bound for two shares of n and m samples."""
        return gap > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def alike(self, a: int, b: int) -> bool:
        """Whether no share of the futures of two states differs; b's part is still a tree, which bounds the walk."""
        n, m, gap, x, y = self.seen[a], self.seen[b], 0.0, 0, 0
        for k in sorted({*self.rest[a], *self.rest[b]}):
            x, y = x + self.rest[a][k], y + self.rest[b][k]
            gap = max(gap, abs(x / n - y / m))
        if self.apart(gap, n, m):
            return False
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.seen[a], self.seen[b]
            if self.apart(abs(self.ends[a] / n - self.ends[b] / m), n, m):
                return False
            for c in {*self.through[a], *self.through[b]}:
                if self.apart(abs(self.through[a].get(c, 0) / n - self.through[b].get(c, 0) / m), n, m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """Add blue's subtree to red."""
        stack = [(red, blue)]
        while stack:
            r, b = stack.pop()
            self.ends[r] += self.ends[b]
            self.seen[r] += self.seen[b]
            self.rest[r].update(self.rest[b])
            for c, n in self.through[b].items():
                self.through[r][c] = self.through[r].get(c, 0) + n
                if c in self.next[r]:
                    stack.append((self.next[r][c], self.next[b][c]))
                else:
                    self.next[r][c] = self.next[b][c]


def infer(samples: list[str], negatives: list[str] = (), alpha: float = 0.05, least: int = 8, evidence: int = 20) -> Grammar | None:
    """Merge the states of the samples' prefix tree whose futures don't differ, breadth first, the most frequent state of a
    depth first. A state is compared with the kept ones of its own depth, then with those of other depths; the latter, which
    make loops, need at least `evidence` samples on both sides, since few samples never differ.

    None when there are fewer than `least` samples. The cut is the 2 % quantile of the samples' scores, but not under 0: the
    format must be likelier than the plain text that `negatives` (other candidates; some may be credentials) show."""
    if len(samples) < least:
        return None
    tree = _Tree(samples, alpha)
    red, done = [0], {0}
    while blue := sorted((tree.depth[t], -tree.seen[t], t, r, c) for r in red for c, t in tree.next[r].items() if t not in done):
        depth, n, q, parent, c = blue[0]
        for r in sorted(red, key=lambda r: (abs(tree.depth[r] - depth), r)):  # noqa: B023
            if (tree.depth[r] == depth or min(tree.seen[r], -n) >= evidence) and tree.alike(r, q):
                tree.next[parent][c] = r
                tree.fold(r, q)
                break
        else:
            red.append(q)
            done.add(q)
    number = {q: i for i, q in enumerate(red)}
    arcs = tuple({c: (number[t], math.log2(tree.through[q][c] / tree.seen[q])) for c, t in tree.next[q].items()} for q in red)
    stop = tuple(math.log2(tree.ends[q] / tree.seen[q]) if tree.ends[q] else -math.inf for q in red)
    g = Grammar(arcs, stop, plain_text(negatives), 0.0)
    own = sorted(g.bits(s) for s in samples)
    return Grammar(arcs, stop, g.plain, max(0.0, own[len(own) // 50]))


def learn(docs: DataFrame, text: str = "text", sample: int = 300, others: int = 2000, longest: int = 512) -> dict[str, Grammar]:
    """A grammar for each kind from at most `sample` distinct credentials of the fixed patterns, those of the lowest hashes,
    against at most `others` candidates outside of them. Formats of over `longest` characters aren't learned.

    These parameters bound what tasks hold and the driver gets. An empty table gives no grammars."""
    most = {**dict.fromkeys(KINDS, sample), "": others}

    def values(batches):
        found: dict[str, dict[str, int]] = {k: {} for k in most}
        for b in batches:
            for t in b.column(0).to_pylist():
                base = base_spans(t) if t else []
                got = [(KINDS[k], credential(t, s, k, e)) for s, k, e in base]
                got += [("", t[s:e]) for s, e in outside(t or "", base)]
                for kind, v in got:
                    if len(v) <= longest:
                        found[kind][v] = xxhash.xxh64_intdigest(v) >> 1
            for kind, own in found.items():
                if len(own) > most[kind]:
                    found[kind] = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[: most[kind]])
        rows = [(k, v, h) for k, own in found.items() for v, h in own.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["kind", "value", "h"])

    found = stored(docs.select(text).mapInArrow(values, "kind string, value string, h long").distinct(), "credentials")
    rows = {k: sorted(r["value"] for r in found.where(F.col("kind") == k).orderBy("h", "value").limit(n).collect()) for k, n in most.items()}
    out = {k: infer(rows[k], rows[""]) for k in KINDS}
    return {k: g for k, g in out.items() if g is not None}


def outside(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Candidates that no base span overlaps, in one pass."""
    out, k = [], 0
    reach = [(s, e) for s, _, e in base]
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(reach) and reach[k][1] <= s:
            k += 1
        if not any(x < e and s < y for x, y in reach[k : bisect_left(reach, (e,), k)]):
            out.append((s, e))
    return out


def scan(docs: DataFrame, grammars: dict[str, Grammar], text: str = "text") -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans, replacing columns of their names.

    Candidates that no fixed pattern touches are added as kind `format` when an automaton's score reaches its cut.
    Places are code points, ends exclusive. Null texts are empty and have no spans; repeated rows get equal results; an
    empty table gives an empty one; texts are scanned whole, however long; other columns pass through."""
    made = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    names = [c for c in docs.columns if c not in made]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text)

    def run(batches):
        for b in batches:
            out = {m: [] for m in made}
            for t in b.column(at).to_pylist():
                base = base_spans(t or "")
                spans = list(base)
                for s, e in outside(t or "", base):
                    if any(g.bits(t[s:e]) >= g.cut for g in grammars.values()):
                        spans.append((s, 3, e))
                told = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                for k, n in enumerate(("n_assign", "n_access", "n_hex")):
                    out[n].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(",".join(told).encode()).hexdigest())
                out["spans"].append(",".join(f"{(*KINDS, 'format')[k]}:{s}:{e}" for s, k, e in sorted(spans)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(out[m], k) for m, k in zip(made, kinds, strict=True))], names=[*names, *made])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType() if m.startswith("n_") else T.StringType()) for m in made)]))
