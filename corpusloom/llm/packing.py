"""Pattern packing: token pieces are packed by repeated length patterns fitted to the length histogram by non-negative
least squares, of which the (nearly) full ones are taken; what they leave is packed best-fit, by counts of equal sequences."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_encoders: dict[str, Encoder] = {}


#: White space of this length makes the fast encoder's patterns overflow its stack.
_LONG_SPACE = re.compile(r"\s{10000}")


class Encoder:
    """Ids of a byte-level BPE vocabulary, as the `tokenizers` library gives them for byte_bpe_50k.json.

    They come from tiktoken over the same ranks, five times as fast; tests hold them against `tokenizers`. Texts with the
    special token's string, which only the latter knows, with very long white space, and any that the former fails on go to it."""

    def __init__(self, name: str):
        import base64

        import public_tokenizers as public
        import tiktoken

        self.path, self.slow = public.path(name), None
        with open(public.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids, end to end."""
        if "<|endoftext|>" in text or len(text) > 10_000 and _LONG_SPACE.search(text):
            found = self.whole(text)
        else:
            try:
                found = self.encode(text)
            except BaseException as e:
                if type(e).__name__ != "PanicException" and not isinstance(e, Exception):
                    raise
                found = self.whole(text)
        return np.array(found, "<u4").tobytes()


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def pieces(docs: DataFrame, text: str = "text", size: int = 2048, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32, part, rank (and ids): each document's ids and a closing 0.

    Only documents over `size` are cut, from their end, so the first piece holds the rest. Null and empty texts are the
    one id 0. part and rank number the pieces of a length within a task, from 0."""

    def run(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = enc.ids(t or "") + b"\0\0\0\0"
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k in range(len(cuts) - 1):
                    own = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                    m = cuts[k + 1] - cuts[k]
                    rows.append((doc, k, cuts[k], m, zlib.crc32(own), part, int(seen[m]), own))
                    seen[m] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"]
            take = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:take], kinds, strict=False)], names=names[:take])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)


def patterns(hist: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of present lengths that fill a sequence, or nearly: around each length pairs, threes and fours, and many short pieces."""
    have = [int(x) for x in np.flatnonzero(hist) if x]

    def at_most(x: int) -> int:
        i = bisect_left(have, x + 1)
        return have[i - 1] if i else 0

    def filled(p: list[int], cap: int) -> tuple[int, ...]:
        """p and the longest pieces that fit, none over cap."""
        rest = size - sum(p)
        while b := at_most(min(rest, cap)):
            p, rest = p + [b] * (rest // b), rest % b
        return tuple(sorted(p))

    out = {(size,)} if hist[size] else set()
    for a in have:
        out.add((a,))
        rest = size - a
        b = at_most(rest)
        if b:
            out.add(tuple(sorted((a, b))))
        for share in (0.5, 0.35, 0.2, 0.08):
            b = at_most(int(rest * share))
            c = at_most(rest - b) if b else 0
            if b and c:
                out.add(tuple(sorted((a, b, c))))
                d = at_most(c // 2)
                e = at_most(rest - b - d) if d else 0
                if d and e:
                    out.add(tuple(sorted((a, b, d, e))))
        out.add(filled([a] * (size // a), size))
        for share in (8, 32):  # a long piece and many short ones
            out.add(filled([a], rest // share))
        if 5 * a <= size:  # short ones with shorter ones
            for share in (2, 4):
                out.add(filled([a] * (size // a // share), a - 1))
    # The fullest come first, and of these those with long pieces: they are the hardest to place otherwise.
    return sorted(out, key=lambda p: (size - sum(p), [-x for x in sorted(p, reverse=True)]))


def nnls(columns: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, A having the patterns' counts as columns; by coordinate descent."""
    sparse = []
    for p in columns:
        ks, cs = np.unique(p, return_counts=True)
        sparse.append((ks.tolist(), cs.tolist(), float((cs * cs).sum())))
    left, x = hist.astype(float).tolist(), [0.0] * len(columns)
    for _ in range(sweeps):
        most = 0.0
        for j, (ks, cs, norm) in enumerate(sparse):
            step = sum(c * left[k] for k, c in zip(ks, cs, strict=True)) / norm
            step = max(step, -x[j])
            if step:
                x[j] += step
                for k, c in zip(ks, cs, strict=True):
                    left[k] -= c * step
                most = max(most, abs(step))
        if most < 0.01:
            break
    return np.array(x)


def best_fit(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): the longest piece first, each into the tightest open sequence. Equal sequences are handled by
    their count, so the work and the patterns are bounded by the lengths, not by the pieces."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {size: []}  # free places -> sequences
    for length in range(size, 0, -1):
        left, moved = int(hist[length]), []

        def put(free: int, p: tuple[int, ...], n: int, left: int, length=length, moved=moved) -> tuple[int, int]:
            """(sequences of n that stay as they were, pieces left)"""
            k = free // length
            for pieces, m in ((k, min(n, left // k)), (left % k, 1 if left // k < n else 0)):
                if pieces and m:
                    moved.append((free - pieces * length, p + (length,) * pieces, m))
                    n, left = n - m, left - m * pieces
            return n, left

        for free in sorted(f for f in open_ if f >= length) if left else ():
            for j, (p, n) in enumerate(open_[free]):
                if left:
                    n, left = put(free, p, n, left)
                    open_[free][j] = (p, n)
            open_[free] = [x for x in open_[free] if x[1]]
        if left:
            put(size, (), left, left)
        for free, p, n in moved:
            open_.setdefault(free, []).append((p, n))
    return [x for groups in open_.values() for x in groups if x[1]]


#: Of a pattern's fitted count so much is used. The rest leaves pieces of all lengths, short ones among them, to the residuals:
#: what a fit leaves when it is used up is mostly long pieces, which nothing fills.
USED = 0.8


def plan(hist: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that together place every piece of the histogram (indexed by length) exactly once.

    Patterns that fill a sequence to the last place are used, so that they lose nothing; their counts are fitted along with
    those of all patterns, cut to USED and rounded down. The residuals are packed by best fit. Only where that needs more than
    best fit of everything, as a few dozen pieces may (1 in 100 random sets of up to 150), that is the plan."""
    whole, hist, out = hist, hist.astype(np.int64), []
    columns = patterns(hist, size)
    for p, x in zip(columns, nnls(columns, hist), strict=True):
        if sum(p) == size:
            ks, cs = np.unique(p, return_counts=True)
            n = int(min(np.floor(USED * x + 1e-6) if len(p) > 1 else np.inf, (hist[ks] // cs).min()))
            if n > 0:
                out.append((p, n))
                hist[ks] -= cs * n
    out += best_fit(hist, size)
    return min(out, best_fit(whole.astype(np.int64), size), key=lambda found: sum(n for _, n in found))


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first sequence, offset), by rank: the pieces of a length in their order."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p, n in planned:
        offset = 0
        for length in p:
            out.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, text: str = "text", size: int = 2048, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The driver sees only the histogram, at most `size` numbers, and the plan, whose parts are bounded by it: a pattern's
    repeats are one row however many. Pieces of a length are ranked by counts of (length, task), so no length, however
    common, meets in one task. An empty table gives an empty result; documents without text are packed as the one id 0;
    repeated rows are packed each; other columns are not carried."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, text, size, tokenizer, with_ids), "pieces")
    counts = stored(cut.groupBy("part", "length").count(), "piece-counts")
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        hist[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(slots(plan(hist, size)))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).cast("long").alias("before"))
    # Counts grow with the number of tasks, so they aren't broadcast.
    ranked = cut.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else []))

    def place(batches):
        where = shared.value
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for m in np.unique(length):
                own, t = np.flatnonzero(length == m), where[int(m)]
                k = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                seq[own], off[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
            cols = [*b.columns[:5], pa.array(seq), pa.array(off), *b.columns[6:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
