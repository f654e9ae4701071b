"""Repeated bytes, and suffix arrays by prefix doubling: places of a corpus are named by the order of what follows them, first by 16
bytes, then by pairs of names twice as long each time. Names are numbers of distinct pairs in a range-partitioned order, joins are on
(row, place), so no task sorts or sees more than its share, and names are exact: no hashes of windows.

Repeats of a given length need no order: they come from passages.repeats(), which compares windows by their md5."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..sources.shared import stored
from . import passages
from .filters import sequential_id

#: Bytes of the first names, and places of a text that are looked for anchors at once.
FIRST, BLOCK = 16, 1 << 18
_TOP = np.uint64(1 << 63)


def _rows(df: DataFrame, text: str, id_column: str) -> DataFrame:
    """row, id, text: rows numbered once, so that repeated and null ids are told apart; null texts are empty."""
    own = df.select(col(id_column).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    return stored(own.withColumn("row", F.monotonically_increasing_id()), "suffixes")


def _places(rows: DataFrame, length: int, all_of_them: bool) -> DataFrame:
    """row, pos, a, b: the next `length` (at most 16) bytes at each place as two longs in the order of bytes; without all_of_them only
    places that many bytes before the end, else bytes after the end are 0."""
    mask = [np.uint64((0xFFFFFFFFFFFFFFFF << 8 * (8 - min(8, max(0, length - 8 * i)))) & 0xFFFFFFFFFFFFFFFF) for i in range(2)]

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(memoryview(text.as_buffer()), np.uint8)
                n = len(raw) if all_of_them else len(raw) - length + 1
                for lo in range(0, n, 1 << 16):
                    size = min(1 << 16, n - lo)
                    own = np.zeros(size + FIRST, np.uint8)
                    part = raw[lo : lo + size + FIRST]
                    own[: len(part)] = part
                    eight = np.zeros(size + 8, np.uint64)
                    for k in range(8):
                        eight |= own[k : k + size + 8].astype(np.uint64) << np.uint64(8 * (7 - k))
                    a, b = (((eight[s : s + size] & m) ^ _TOP).view(np.int64) for s, m in ((0, mask[0]), (8, mask[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, i)), pa.array(np.arange(lo, lo + size)), pa.array(a), pa.array(b)], names=["row", "pos", "a", "b"])

    return rows.select("row", F.encode("text", "utf-8").alias("raw")).mapInArrow(run, "row long, pos long, a long, b long")


def _named(pairs: DataFrame, more_than: int) -> tuple[DataFrame, DataFrame]:
    """((row, pos, name) of places whose pair occurs over `more_than` times, (name, n) of these pairs); names are in the pairs' order."""
    often = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    names = stored(sequential_id(often, ["a", "b"], "name"), "suffixes")
    return stored(pairs.join(names.select("a", "b", "name"), ["a", "b"]).select("row", "pos", "name"), "suffixes"), names.select("name", "n")


def _paired(named: DataFrame, step: int, outer: bool = False) -> DataFrame:
    """row, pos, a, b: the names of a place and of the one `step` further on (with outer -1 behind the end)."""
    later = named.select("row", (F.col("pos") - step).alias("pos"), F.col("name").alias("b"))
    return named.withColumnRenamed("name", "a").join(later, ["row", "pos"], "left" if outer else "inner").select("row", "pos", "a", F.coalesce("b", F.lit(-1)).alias("b"))


def repeated_bytes(df: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 100, more_than: int = 1, keep_first: bool = True) -> DataFrame:
    """id, first, last (exclusive, in bytes of UTF-8): all ranges made of byte strings of `length` that occur over `more_than` times in
    the corpus, overlapping ones merged; with keep_first the first occurrence of each string, by id and place, isn't counted.

    Occurrences may overlap each other. Null and short texts have none; rows that repeat an id give their ranges each."""
    rows = _rows(df, text, id_column)
    return _with_ids(_ranges(rows, length, more_than, keep_first), rows)


def _with_ids(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    return ranges.join(rows.select("row", "id"), "row").select("id", "first", "last")


def _ranges(rows: DataFrame, length: int, more_than: int, keep_first: bool) -> DataFrame:
    if length < 1:
        raise ValueError("length must be at least 1")
    return passages.merged(passages.repeats(rows, "bytes", length, more_than, keep_first, BLOCK), "row")


def remove_repeated_bytes(df: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = 100, more_than: int = 1, keep_first: bool = True) -> DataFrame:
    """id and text without the repeated ranges; ranges that cut a character leave all of it. Texts without any stay, null becomes empty."""
    rows = _rows(df, text, id_column)
    cuts = _ranges(rows, length, more_than, keep_first).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))

    def run(batches):
        for batch in batches:
            out = []
            for t, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, at, parts = t.encode(), 0, []
                lead = lambda p, raw=raw: p < len(raw) and raw[p] & 0xC0 == 0x80
                for r in sorted(ranges or [], key=lambda r: r["first"]):
                    a, b = r["first"], r["last"]
                    while lead(a):
                        a += 1
                    while lead(b):
                        b -= 1
                    if a < b:
                        parts.append(raw[at:a])
                        at = b
                out.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = dict(rows.dtypes)["id"]
    return rows.join(cuts, "row", "left").select("id", "text", "cuts").mapInArrow(run, f"id {kind}, text string")


def suffix_array(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """place, id, pos, lcp: all suffixes of all texts in the order of their bytes, from place 0 on, and how many bytes each has in
    common with the one before it (0 for the first). A text's end is less than any byte; suffixes that are equal are in the order
    of their rows' ids, then of the rows. Names are doubled until all are different or no text is longer."""
    rows = _rows(df, text, id_column)
    sizes = rows.select("row", "id", F.octet_length("text").cast("long").alias("size"))
    longest = sizes.agg(F.max("size")).first()[0] or 0
    ended = _places(rows, FIRST, True).join(sizes.select("row", "size"), "row")
    # bytes after the end look like zeros: the number of real ones tells them apart, as less
    real = F.least(F.col("size") - F.col("pos"), F.lit(FIRST))
    first = ended.select("row", "pos", F.col("a"), F.struct("b", real.alias("real")).alias("b"))
    levels, size = [(FIRST, _named(first, 0))], FIRST
    while size < longest and not levels[-1][1][1].where("n > 1").isEmpty():
        levels.append((size * 2, _named(_paired(levels[-1][1][0], size, True), 0)))
        size *= 2
    top = levels[-1][1][0].join(sizes, "row")
    ordered = stored(sequential_id(top, ["name", "id", "row", "pos"], "place"), "suffixes")
    before = ordered.select((F.col("place") + 1).alias("place"), F.col("row").alias("r"), F.col("pos").alias("p"), F.col("size").alias("s"))
    pairs = ordered.join(before, "place", "left").select("place", "id", "row", "pos", "size", "r", "p", "s", F.lit(0).cast("long").alias("lcp"))
    for length, (named, _) in reversed(levels):
        a, b = named.select("row", F.col("pos").alias("x"), F.col("name").alias("na")), named.select(F.col("row").alias("r"), F.col("pos").alias("y"), F.col("name").alias("nb"))
        met = pairs.withColumns({"x": F.col("pos") + F.col("lcp"), "y": F.col("p") + F.col("lcp")}).join(a, ["row", "x"], "left").join(b, ["r", "y"], "left")
        pairs = stored(met.withColumn("lcp", F.col("lcp") + F.when(F.col("na") == F.col("nb"), length).otherwise(0)).select(pairs.columns), "suffixes")
    pairs = _by_bytes(pairs, rows)
    return pairs.select("place", "id", "pos", F.coalesce("lcp", F.lit(0)).cast("long").alias("lcp"))


def _by_bytes(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds to lcp what the next FIRST bytes after it have in common: names tell that these differ, not where."""
    raw = _places(rows, FIRST, True)
    one = raw.select("row", F.col("pos").alias("x"), F.col("a").alias("a1"), F.col("b").alias("b1"))
    two = raw.select(F.col("row").alias("r"), F.col("pos").alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    both = pairs.withColumns({"x": F.col("pos") + F.col("lcp"), "y": F.col("p") + F.col("lcp")}).join(one, ["row", "x"], "left").join(two, ["r", "y"], "left")
    alike = lambda p, q: F.when(p == q, 8).otherwise(F.floor((16 - F.length(F.hex(p.bitwiseXOR(q)))) / 2))
    same = F.when(F.col("a1") == F.col("a2"), 8 + alike(F.col("b1"), F.col("b2"))).otherwise(alike(F.col("a1"), F.col("a2")))
    return both.withColumn("lcp", F.least(F.col("lcp") + F.coalesce(same, F.lit(0)), F.col("size") - F.col("pos"), F.col("s") - F.col("p"))).select(pairs.columns)
