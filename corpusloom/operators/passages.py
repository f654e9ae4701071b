"""Passages of a given length that occur several times in a corpus, of bytes or of words, without a row for each place.

Of each window's k-grams the one of the least hash is its anchor, by a rule that looks at the window's content alone. So equal windows
have equal anchors at equal distances, and neighbouring windows share theirs: only anchors are shuffled, some one for each `length` / 4
places, with a digest of the stretch that their windows cover. Anchors of equal digests are one class, whose windows are all equal; only
where an anchor's content stands in several classes are the windows of one occurrence of each class compared one by one.

Most anchors' content stands in one place of the corpus, where no window can repeat. So the hashes alone are counted first, and a
bitmap of those that occur again says which anchors are shuffled; others that fall on its bits are only work for nothing."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mix, rolling
from ..functions.text import WS
from ..sources.shared import stored
from .filters import sequential_id

#: Units of an anchor, at most; places of a text that are gone over at once.
GRAM, STRETCH = {"bytes": 32, "words": 16}, 1 << 18
#: Bits of the bitmap, as a power of two: 32 MB, which the driver collects and each worker holds.
BITS = 28
_SPACE = re.compile(WS + "+")
_ANCHOR = "row long, id {}, m long, back int, last int, gram long, c1 long, c2 long"


class Units:
    """A text as numbers of its units, and what a stretch of them is made of."""

    def __init__(self, text: str | None, kind: str, number: dict[str, int]):
        if kind == "bytes":
            self.raw = (text or "").encode()
            self.items = np.frombuffer(self.raw, np.uint8)
        else:
            self.raw = [w for w in _SPACE.split(text or "") if w]
            self.items = np.array([number[w] if w in number else number.setdefault(w, (xxhash.xxh64_intdigest(w) >> 1) + 1) for w in self.raw], np.uint64)

    def __len__(self) -> int:
        return len(self.raw)

    def content(self, first: int, end: int) -> bytes:
        part = self.raw[first:end]
        return part if isinstance(part, bytes) else " ".join(part).encode()


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _anchors(units: Units, kind: str, length: int, stretch: int):
    """(place, first and last window of the anchor, hash of its content) as arrays, for each stretch of windows."""
    k, low = min(GRAM[kind], (length + 1) // 2), np.uint64((1 << (stretch + length).bit_length()) - 1)
    for lo in range(0, len(units) - length + 1, stretch):
        windows = min(stretch, len(units) - length + 1 - lo)
        items = units.items[lo : lo + windows + length - 1].astype(np.uint64) + np.uint64(kind == "bytes")
        at = np.arange(len(items) - k + 1)
        gram = rolling(items)(at, at + k)
        place = (_least((gram & ~low) | at.astype(np.uint64), length - k + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], windows] - 1
        m = place[first]
        yield m + lo, first + lo, last + lo, gram[m].view(np.int64)


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _joined(run, rows: int = 1 << 14):
    """run() with its small batches put together."""

    def joined(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return joined


def _bit(gram: np.ndarray, bits: int) -> np.ndarray:
    """A gram's bit: grams are least hashes, so mostly low ones, and are mixed once more."""
    return mix(gram.view(np.uint64)) >> np.uint64(64 - bits)


def again(rows: DataFrame, kind: str, length: int, stretch: int = STRETCH) -> np.ndarray:
    """A bitmap, in words of 64 bits, of the anchors' grams that occur more than once."""
    bits = BITS

    def run(batches):
        for b in batches:
            number: dict[str, int] = {}
            found = [gram for text in b.column(0).to_pylist() for *_, gram in _anchors(Units(text, kind, number), kind, length, stretch)]
            if found:
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                bit = _bit(gram, bits)
                yield _batch([gram, n, (bit >> np.uint64(6)).astype(np.int32), (bit & np.uint64(63)).astype(np.int32)], [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["gram", "n", "word", "bit"])

    counted = rows.select("text").mapInArrow(run, "gram long, n long, word int, bit int").groupBy("gram", "word", "bit").agg(F.sum("n").alias("n")).where("n > 1")
    words = counted.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()  # at most a row a word
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def anchors(rows: DataFrame, kind: str, length: int, stretch: int = STRETCH, only: np.ndarray | None = None) -> DataFrame:
    """row, id, m (the anchor's place), back and last (the first window is `back` before it, the last one `last` windows after that),
    gram (hash of the anchor), c1, c2 (md5 of all that the windows cover and of where the anchor lies in it); of those alone whose
    gram has a bit in the bitmap `only`, if it is given."""
    wanted, bits = (None, 0) if only is None else (rows.sparkSession.sparkContext.broadcast(only), len(only).bit_length() + 5)

    def run(batches):
        for b in batches:
            number: dict[str, int] = {}
            for row, i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                units = Units(text, kind, number)
                for m, first, last, gram in _anchors(units, kind, length, stretch):
                    if wanted is not None:
                        bit = _bit(gram, bits)
                        kept = np.flatnonzero(wanted.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
                        m, first, last, gram = m[kept], first[kept], last[kept], gram[kept]
                    for at in range(0, len(m), 1 << 14):
                        cut = slice(at, at + (1 << 14))
                        f, e = first[cut], last[cut]
                        said = b"".join(hashlib.md5(b"%d:%d:" % (x - y, z - y) + units.content(y, z + length)).digest() for x, y, z in zip(m[cut].tolist(), f.tolist(), e.tolist(), strict=True))
                        digests = np.frombuffer(said, np.int64).reshape(-1, 2)
                        n = len(f)
                        kinds = [pa.int64(), b.schema.field(1).type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                        yield _batch([np.full(n, row), [i] * n, m[cut], m[cut] - f, e - f, gram[cut], digests[:, 0], digests[:, 1]], kinds, ["row", "id", "m", "back", "last", "gram", "c1", "c2"])

    return rows.select("row", "id", "text").mapInArrow(_joined(run), _ANCHOR.format(dict(rows.dtypes)["id"]))


def _windows(rows: DataFrame, classes: DataFrame, kind: str, length: int) -> DataFrame:
    """class, n, d, w: the windows of the first occurrence of each class, d places from its anchor, and 64 bits of their md5."""
    wanted = classes.groupBy("row").agg(F.collect_list(F.struct("m", "back", "last", "class", "n")).alias("wanted"))

    def run(batches):
        for b in batches:
            number: dict[str, int] = {}
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                units = Units(text, kind, number)
                for a in wanted:
                    ds = np.arange(-a["back"], a["last"] - a["back"] + 1)
                    said = b"".join(hashlib.md5(units.content(p, p + length)).digest()[:8] for p in (a["m"] + ds).tolist())
                    n = len(ds)
                    yield _batch([np.full(n, a["class"]), np.full(n, a["n"]), ds, np.frombuffer(said, np.int64)], [pa.int64(), pa.int64(), pa.int32(), pa.int64()], ["class", "n", "d", "w"])

    return rows.select("row", "text").join(wanted, "row").select("text", "wanted").mapInArrow(_joined(run), "class long, n long, d int, w long")


def repeats(rows: DataFrame, kind: str, length: int, more_than: int = 1, keep_first: bool = True, stretch: int = STRETCH) -> DataFrame:
    """row, id, first, last (exclusive): windows of `length` units that occur over `more_than` times, neighbouring ones as one range;
    with keep_first the first occurrence of each, by id, row and place, is left out. rows: row (distinct), id, text."""
    found = stored(anchors(rows, kind, length, stretch, again(rows, kind, length, stretch) if more_than > 0 else None), "anchors")
    key = ["c1", "c2"]
    # a class's windows are alike, and so are the distances to its anchor: the first occurrence is that of each of its windows
    classes = found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("id", "row", "m")).alias("f"), *[F.first(c).alias(c) for c in ("gram", "back", "last")])
    classes = stored(classes.select(*key, "n", "f.id", "f.row", "f.m", "gram", "back", "last"), "classes")
    company = classes.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    # equal windows lie alike around their anchors, so the order of first occurrences is that of their windows, too
    shared = stored(sequential_id(classes.join(company, "gram", "left_semi"), ["id", "row", "m", "back"], "class"), "classes")
    alone = classes.where(F.col("n") > more_than).join(company, "gram", "left_anti")
    by_class = alone.select(*key, (-F.col("back")).alias("lo"), (F.col("last") - F.col("back")).alias("hi"), F.col("row").alias("frow"), F.col("m").alias("fm"))
    alike = Window.partitionBy("w", "d")  # a row for each class that has the window, which may go to disk; so windows move once
    windows = _windows(rows, shared, kind, length).withColumns({"total": F.sum("n").over(alike), "first": F.min("class").over(alike)})
    hit = windows.where(F.col("total") > more_than).select("class", "d", (F.col("first") == F.col("class")).alias("leads"))
    over = Window.partitionBy("class", "leads").orderBy("d")  # at most `length` rows of a class
    runs = hit.withColumn("run", F.col("d") - F.row_number().over(over)).groupBy("class", "leads", "run").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    by_window = runs.join(shared, "class").select(*key, "lo", "hi", F.when(F.col("leads"), F.col("row")).alias("frow"), F.when(F.col("leads"), F.col("m")).alias("fm"))
    ranges = stored(by_class.unionByName(by_window), "ranges")
    met = found.select("row", "id", "m", *key).join(ranges, key)
    if keep_first:
        met = met.where(F.col("frow").isNull() | (F.col("row") != F.col("frow")) | (F.col("m") != F.col("fm")))
    return met.select("row", "id", (F.col("m") + F.col("lo")).alias("first"), (F.col("m") + F.col("hi") + length).alias("last"))


def merged(ranges: DataFrame, by: str) -> DataFrame:
    """by, first, last: ranges of each row or id that overlap or touch, merged."""
    over = Window.partitionBy(by).orderBy("first", "last")
    before = F.max("last").over(over.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.select(by, "first", "last").withColumn("opens", F.coalesce((F.col("first") > before).cast("int"), F.lit(0)))
    runs = opened.withColumn("run", F.sum("opens").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(by, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
