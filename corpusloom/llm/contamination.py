"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Long items are cut in segments that overlap by a window less one word, so no window is lost; segments are dealt to parts of
bounded size. A task builds the automaton of a part and writes it, as flat arrays, to the shared folder. Documents are streamed
past the parts that fit in memory together; if there are more, the documents pass several times and carry what was hit."""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_dir, stored, text_buffer, unused
from .elias_fano import place

#: A-Z lower-cased; ASCII characters other than letters and digits become spaces; the rest stays.
_NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_NORMAL).split()


class Automaton:
    """Suffix automaton over the words of several items; each begins at the root, so matches stay within one.

    Transitions are two sorted arrays (state * words + word, next state); link[s]: suffix link; size[s]: longest string of the
    state. Windows that end in a state are rows (state, length, item), by state; mark[s]: the nearest state at or above s along
    the links that has such rows, or -1."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 13):
        self.window, self.vocabulary, self.names = window, {}, []
        texts = []
        for name, ws in items:
            if ws:
                texts.append((len(self.names), np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws], np.int64)))
                self.names.append(name)
        after, link, size = [{}], [-1], [0]
        for _, ids in texts:
            last = 0
            for c in ids.tolist():
                last = self._extend(after, link, size, last, c)
        ends = set()
        for name, ids in texts:
            need, s, m = min(window, len(ids)), 0, 0
            for c in ids.tolist():
                s, m = after[s][c], m + 1
                if m >= need:
                    t = s
                    while size[link[t]] >= need:
                        t = link[t]
                    ends.add((t, need, name))
        n = len(self.vocabulary)
        keys = np.fromiter((s * n + c for s, out in enumerate(after) for c in out), np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter((t for out in after for t in out.values()), np.int64)[order]
        self.link, self.size = np.array(link, np.int64), np.array(size, np.int64)
        self.ends = np.array(sorted(ends), np.int64).reshape(-1, 3)
        self.mark = np.full(len(size), -1, np.int64)
        own = set(self.ends[:, 0].tolist())
        for s in np.argsort(self.size, kind="stable").tolist():
            self.mark[s] = s if s in own else self.mark[link[s]] if s else -1
        self.least = min((min(window, len(ids)) for _, ids in texts), default=0)
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(ids[:-1] * n + ids[1:] for _, ids in texts)]))

    @classmethod
    def _extend(cls, after: list, link: list, size: list, last: int, c: int) -> int:
        if c in after[last]:
            q = after[last][c]
            return q if size[q] == size[last] + 1 else cls._clone(after, link, size, last, c, q)
        new = len(size)
        after.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p != -1:
            q = after[p][c]
            link[new] = q if size[q] == size[p] + 1 else cls._clone(after, link, size, p, c, q)
        return new

    @staticmethod
    def _clone(after: list, link: list, size: list, p: int, c: int, q: int) -> int:
        new = len(size)
        after.append(dict(after[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = new
        while p != -1 and after[p].get(c) == q:
            after[p][c] = new
            p = link[p]
        return new

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Where windows may lie: runs of word pairs that items have."""
        if self.least < 2:
            return [(0, len(ids))]
        key = ids[:-1] * len(self.vocabulary) + ids[1:]
        key[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
        at = np.searchsorted(self.pairs, key)
        live = np.flatnonzero((at < len(self.pairs)) & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == key)) if len(self.pairs) else key[:0]
        cut = np.flatnonzero(np.diff(live) > 1) + 1
        return [(int(r[0]), int(r[-1]) + 2) for r in np.split(live, cut) if len(r) and len(r) + 1 >= self.least]

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """(hit mask, items) for a text's word numbers, -1 where no item has the word."""
        hit, found = np.zeros(len(ids), bool), set()
        if not self.least or len(ids) < self.least:
            return hit, found
        n, keys, starts = len(self.vocabulary), self.keys, self.ends[:, 0]
        for lo, hi in self._runs(ids):
            s = length = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo):
                t = -1
                while c >= 0:
                    at = bisect_left(keys, s * n + c)
                    if at < len(keys) and keys[at] == s * n + c:
                        t = int(self.to[at])
                        break
                    if not s:
                        break
                    s = int(self.link[s])
                    length = int(self.size[s])
                if t < 0:
                    s = length = 0
                    continue
                s, length = t, length + 1
                t = int(self.mark[s])
                while t >= 0:
                    for _, need, name in self.ends[bisect_left(starts, t) : bisect_left(starts, t + 1)].tolist():
                        if length >= need:
                            hit[i + 1 - need : i + 1] = True
                            found.add(self.names[name])
                    t = int(self.mark[self.link[t]]) if t else -1
        return hit, found


@dataclass(frozen=True)
class Items:
    """Files of the parts' automata, in groups that are held in memory together."""

    groups: tuple[tuple[str, ...], ...]


def segments(words_: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """An item's words cut in segments of at most `most`, each of which holds the last window - 1 words of the one before."""
    if len(words_) <= max(most, window):
        return [words_]
    step = max(most, window) - window + 1
    return [words_[at : at + step + window - 1] for at in range(0, len(words_) - window + 1, step)]


def automaton(benchmark: DataFrame, window: int = 13, part_bytes: int = 1 << 20, most_bytes: int = 128 << 20, segment: int = 1 << 15) -> Items:
    """Build the automata of all items: parts of about part_bytes of words, groups of files of at most most_bytes (one at least).

    Tasks build them; the driver knows file names and sizes. Null texts and items without words match nothing; repeated items
    count once by their id; a null id is an empty one; an empty table gives no parts."""
    spark = benchmark.sparkSession
    folder = fresh_dir(spark, "automata")

    def cut(batches):
        for b in batches:
            rows = [(i or "", b" ".join(s)) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for s in segments(words((t or "").encode()), window, segment) if s]
            ids, texts = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    items = stored(items.mapInArrow(cut, "item string, words binary").distinct(), "items")
    total = items.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("b")).first()["b"]
    parts = -(-total // part_bytes)
    if not parts:
        return Items(())

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("words").to_pylist(), strict=True))
        blob, name = pickle.dumps(Automaton([(i, w.split(b" ")) for i, w in rows], window)), f"{folder}/{uuid.uuid4().hex}"
        where, path = place(name)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        with where.open_output_stream(path) as f:
            f.write(blob)
        return pa.table({"part": table.column("part")[:1], "file": [name], "size": pa.array([len(blob)], pa.int64())})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("int"))
    built = stored(dealt.groupBy("part").applyInArrow(build, "part int, file string, size long"), "automata-files")
    groups: list[list[str]] = []
    room = 0
    for r in built.orderBy("part").collect():
        if not groups or r["size"] > room:
            groups.append([])
            room = most_bytes
        groups[-1].append(r["file"])
        room -= r["size"]
    return Items(tuple(map(tuple, groups)))


@lru_cache(maxsize=1)
def _loaded(files: tuple[str, ...]) -> list[Automaton]:
    """The automata of a group, kept by a worker between its tasks."""
    out = []
    for name in files:
        where, path = place(name)
        with where.open_input_stream(path) as f:
            out.append(pickle.loads(f.read()))
    return out


def _runs_of(hit: np.ndarray) -> list[list[int]]:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2).tolist()


_HIT = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])


def _scanned(docs: DataFrame, items: Items, text: str, made: list[T.StructField], finish) -> DataFrame:
    """docs with the columns `made`, which replace none; finish(text bytes, words, hit mask, items) gives their values for a row.

    Each group of automata is one pass; between passes, what was hit so far travels in a column of its own."""
    names = docs.columns
    at, carry = names.index(text), unused("hit", names)

    def one_pass(files, first: bool, last: bool):
        def run(batches):
            autos = _loaded(files) if files else []
            for b in batches:
                data, offsets = text_buffer(b.column(at).cast(pa.string()))
                raw, rows = data.tobytes(), []
                before = None if first else b.column(len(names)).to_pylist()
                for k in range(b.num_rows):
                    own = raw[offsets[k] : offsets[k + 1]]
                    ws, hit, found = words(own), None, set()
                    hit = np.zeros(len(ws), bool)
                    for auto in autos:
                        more, names_ = auto.scan(np.array([auto.vocabulary.get(w, -1) for w in ws], np.int64))
                        hit |= more
                        found |= names_
                    if before is not None:
                        for lo, hi in before[k]["spans"]:
                            hit[lo:hi] = True
                        found.update(before[k]["items"])
                    rows.append(finish(own, ws, hit, sorted(found)) if last else {carry: {"spans": _runs_of(hit), "items": sorted(found)}})
                fields = made if last else [T.StructField(carry, _HIT)]
                cols = [pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in fields]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *cols], names=[*names, *(f.name for f in fields)])

        return run

    groups = items.groups or ((),)
    schema = docs.schema.fields
    for k, files in enumerate(groups[:-1]):
        docs = stored(docs.mapInArrow(one_pass(files, k == 0, False), T.StructType([*schema, T.StructField(carry, _HIT)])), "hits")
    return docs.mapInArrow(one_pass(groups[-1], len(groups) == 1, True), T.StructType([*schema, *made]))


RESULT = T.StructType([T.StructField(n, k) for n, k in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("items_sha256", T.StringType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("contaminated", T.BooleanType()))])


def matches(docs: DataFrame, items: Items, text: str = "text", coverage: int = 20, only: tuple[str, ...] | None = None) -> DataFrame:
    """Add RESULT's columns (or those named in `only`), replacing columns of their names; all others pass through.

    A word is hit inside any window of an item; spans are [first, end) word places of hit runs. A document is contaminated
    when coverage * n_hit >= n_words and n_hit > 0. Null and empty texts have no words and are clean; repeated rows get equal
    results; an empty table gives an empty one; texts are read whole."""
    made = [f for f in RESULT.fields if only is None or f.name in only]
    want = {f.name for f in made}

    def finish(raw: bytes, ws: list[bytes], hit: np.ndarray, found: list[str]) -> dict:
        n = int(hit.sum())
        row = {"n_words": len(ws), "n_hit": n, "n_items": len(found), "items": found, "contaminated": n > 0 and coverage * n >= len(ws)}
        if "items_sha256" in want:
            row["items_sha256"] = hashlib.sha256(",".join(found).encode()).hexdigest()
        if "spans" in want:
            row["spans"] = _runs_of(hit)
        return row

    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT.fieldNames()])
    return _scanned(kept, items, text, made, finish)


def cut_spans(docs: DataFrame, items: Items, text: str = "text", least: int = 13, coverage: float = 0.05) -> DataFrame:
    """Rewrite `text` without its hit runs of at least `least` words, or all of its hit runs where they cover at least
    `coverage` of its words; a run goes from its first word's beginning to its last word's end. Other texts, null and empty
    ones included, and all other columns of any name stay as they are."""
    names = docs.columns
    into = unused("cut", names)

    def finish(raw: bytes, ws: list[bytes], hit: np.ndarray, found: list[str]) -> dict:
        if not hit.any():
            return {into: None}
        ms = list(re.finditer(rb"[^ ]+", raw.translate(_NORMAL)))
        every = hit.sum() >= coverage * len(ms)
        for lo, hi in reversed([r for r in _runs_of(hit) if every or r[1] - r[0] >= least]):
            raw = raw[: ms[lo].start()] + raw[ms[hi - 1].end() :]
        return {into: raw.decode()}

    out = _scanned(docs, items, text, [T.StructField(into, T.StringType())], finish)
    return out.select(*[(F.coalesce(into, f"`{c}`").alias(c) if c == text else F.col(f"`{c}`")) for c in names])
