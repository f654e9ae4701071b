"""Row filters, column selection, annotation by simple predicates, identifiers and slicing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col
from ..sources.shared import stored


def filter_rows(df: DataFrame, criteria: Sequence[str], how: str = "AND", drop: Sequence[str] = ()) -> DataFrame:
    """Keep rows that all ("AND") or any ("OR") of the SQL predicates hold for; without predicates all stay. Then drop columns."""
    if how not in ("AND", "OR"):
        raise ValueError("how is AND or OR")
    if criteria:
        df = df.where(reduce((lambda a, b: a & b) if how == "AND" else (lambda a, b: a | b), [F.expr(f"({c})") for c in criteria]))
    return df.drop(*drop)


def filter_stats(df: DataFrame, criteria: Sequence[str], how: str = "AND") -> DataFrame:
    """One row per criterion with the rows it drops, plus totals; one pass over the data."""
    tests = [F.coalesce(F.expr(f"({c})"), F.lit(False)) for c in criteria]
    kept = reduce((lambda a, b: a & b) if how == "AND" else (lambda a, b: a | b), tests) if tests else F.lit(True)
    one = df.agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), *[F.count_if(~t).alias(f"d{i}") for i, t in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"d{i}").alias("dropped")) for i, c in enumerate(criteria)], F.struct(F.lit("total rows").alias("criterion"), F.col("n").alias("dropped")), F.struct(F.lit("rows kept").alias("criterion"), F.col("kept").alias("dropped")))
    return one.select(F.explode(rows).alias("r")).select("r.criterion", F.col("r.dropped").alias("rows"))


def keep_tokens(tokens: DataFrame, survivors: DataFrame, on: str) -> DataFrame:
    """Token rows whose document survived a filter."""
    return tokens.join(survivors.select(on).distinct(), on, "left_semi")


def id_counts(rows: DataFrame, on: str) -> DataFrame:
    """id and count: how many rows each id has."""
    return rows.groupBy(on).agg(F.count("*").alias("count"))


def ml_filter(df: DataFrame, thresholds: dict[str, dict[str, float]], language: str = "lang", ignore_missing: bool = False) -> DataFrame:
    """Per-language thresholds: `x_min` asks x >= v, `x_max` x <= v, any other name x >= v. Language "other" is none of those named.

    Columns that a table of thresholds names but the frame lacks raise, unless ignored; if all lack, they always raise."""
    def name_of(key: str) -> str:
        return key[:-4] if key.endswith(("_min", "_max", "_not")) else key

    wanted = {name_of(k) for t in thresholds.values() for k in t}
    missing = wanted - set(df.columns)
    if missing and (missing == wanted or not ignore_missing):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    named = [x for x in thresholds if x != "other"]
    tests = []
    for lang, limits in thresholds.items():
        test = ~col(language).isin(named) if lang == "other" else col(language) == lang
        for key, limit in limits.items():
            if name_of(key) not in missing:
                c = col(name_of(key))
                test = test & (c <= limit if key.endswith("_max") else c >= limit)
        tests.append(test)
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df


def language_select(df: DataFrame, allowed: Sequence[str], language: str = "lang", into: str = "allowed") -> DataFrame:
    """Mark rows whose programming (or other) language is in the list; case counts."""
    return df.withColumn(into, F.coalesce(col(language).isin(list(allowed)), F.lit(False)))


def _license_ok(c: Column, names: Sequence[str], is_list: bool, allow_none: bool) -> Column:
    low = [n.lower() for n in names]
    if is_list:
        return F.when(c.isNull() | (F.size(c) == 0), F.lit(allow_none)).otherwise(F.forall(c, lambda x: F.coalesce(F.lower(x).isin(low), F.lit(allow_none))))
    return F.when(c.isNull(), F.lit(allow_none)).otherwise(F.lower(c).isin(low))


def license_select(df: DataFrame, names: Sequence[str], license_column: str = "license", deny: bool = False, allow_no_license: bool = False, into: str = "license_status") -> DataFrame:
    """Allow or deny licences (strings, or lists of which each must be allowed). Denying negates allowing with allow_no_license
    inverted, so a list fails only if all its licences are denied. The licence column is renamed to `license`."""
    is_list = dict(df.dtypes)[license_column].startswith("array")
    c = col(license_column)
    ok = ~_license_ok(c, names, is_list, not allow_no_license) if deny else _license_ok(c, names, is_list, allow_no_license)
    return df.withColumn(into, ok).withColumnRenamed(license_column, "license")


#: Ids of one segment of a Bloom filter: 1.2 MB at one per cent of false positives.
SEGMENT = 1_000_000


def bloom_member(df: DataFrame, known: DataFrame, on: str, into: str = "bloom", expected: int = 1_000_000, fpp: float = 0.01, exact: bool = True) -> DataFrame:
    """1 where the id is in `known`, else 0: exactly, by a join, or approximately, by a Bloom filter.

    The filter is made for `expected` ids at least, and for as many as `known` has if these are more, so that `fpp` holds. It is
    broadcast up to SEGMENT ids; a larger one is cut into segments by the ids' hashes, which ids join."""
    if exact:
        flag = known.select(F.col(on).alias("__id")).distinct().withColumn("__in", F.lit(1))
        return df.join(flag, F.col(on) == F.col("__id"), "left").withColumn(into, F.coalesce("__in", F.lit(0)).cast("int")).drop("__id", "__in")
    import math

    expected = max(expected, known.select(on).distinct().count())
    segments = -(-expected // SEGMENT)
    share = -(-expected // segments)
    if segments > 1:  # hashing deals ids out unevenly
        share += 6 * math.isqrt(share)
    bits = max(64, int(-share * math.log(fpp) / math.log(2) ** 2))
    k = max(1, round(bits / share * math.log(2)))
    places = lambda c: F.array(*[F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits)) for i in range(k)])
    segment = F.pmod(F.xxhash64(col(on), F.lit(-1)), F.lit(segments)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    marked = known.select(segment.alias("s"), F.explode(places(col(on))).alias("p")).groupBy("s", F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(one).alias("b"))
    size = bits // 64 + 1
    cells = df.sparkSession.range(segments * size).select(F.floor(F.col("id") / size).cast("int").alias("s"), (F.col("id") % size).alias("w"))
    every = cells.join(marked, ["s", "w"], "left").select("s", "w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    words = every.groupBy(F.col("s").alias("__s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("__m"))  # bits / 64 numbers
    test = F.forall(places(col(on)), lambda p: F.call_function("shiftrightunsigned", F.get("__m", F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    joined = df.crossJoin(F.broadcast(words)) if segments == 1 else df.join(words, segment == F.col("__s"))
    return joined.withColumn(into, test.cast("int")).drop("__m", "__s")


def collapse(df: DataFrame, columns: Sequence[str], into: str, separator: str = " ", retain_all: bool = True) -> DataFrame:
    """Join the columns' strings; null and empty count as ''."""
    out = df.withColumn(into, F.concat_ws(separator, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]))
    return out if retain_all else out.drop(*columns)


def noop(df: DataFrame) -> DataFrame:
    return df


def _numbered(df: DataFrame, order_by: Sequence[str], into: str, start: int = 0) -> DataFrame:
    """Contiguous numbers over an order without sending all rows to one task: rows are range-partitioned and sorted, and the
    partitions' counts give each its first number. The numbered rows are written once, so that both passes see the same ones."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    placed = stored(placed, "numbered")
    counts = placed.groupBy("__part").count()
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row per partition
    first = counts.select(F.col("__part"), F.coalesce(before, F.lit(0)).alias("__first"))
    return placed.join(F.broadcast(first), "__part").withColumn(into, (F.col("__first") + F.col("__at") + start).cast("long")).drop("__part", "__at", "__first")


def sequential_id(df: DataFrame, order_by: Sequence[str], into: str = "id", start: int = 0) -> DataFrame:
    """0, 1, 2, ... (from `start`) in a declared order."""
    return _numbered(df, order_by, into, start)


def doc_id(df: DataFrame, text: str = "text", hash_into: str | None = "doc_hash", int_into: str | None = None, order_by: Sequence[str] = ("doc_id",), start: int = 0) -> DataFrame:
    """sha256 of the text, and/or contiguous numbers in a declared order."""
    if hash_into:
        df = df.withColumn(hash_into, F.sha2(col(text), 256))
    return _numbered(df, order_by, int_into, start) if int_into else df


def doc_id_distributed(df: DataFrame, into: str = "doc_int") -> DataFrame:
    """Unique, rising but not contiguous numbers, without a shuffle."""
    return df.withColumn(into, F.monotonically_increasing_id())


def resize_rows(df: DataFrame, max_rows: int, order_by: Sequence[str], into: str = "slice") -> DataFrame:
    """Number of the slice of max_rows rows that each row falls in. For files of a size, write with maxRecordsPerFile."""
    return _numbered(df, order_by, into).withColumn(into, F.floor(F.col(into) / max_rows).cast("long"))


def resize_bytes(df: DataFrame, max_bytes: int, size: Column, order_by: Sequence[str], into: str = "slice", disk_factor: int = 2) -> DataFrame:
    """Slices by bytes: the row that crosses disk_factor * max_bytes begins the next slice, and its own size isn't carried over.

    The rule looks at all rows before, but after a row that begins a slice nothing before it counts. So each range of the
    order tells, for every row that could be its first such one, how many slices follow and what is held at its end: at most a
    slice's rows a range. One task goes over these summaries and gives each range what it begins with; then all ranges are
    numbered at once."""
    limit = max_bytes * disk_factor
    spark, names = df.sparkSession, [c for c in df.columns if c != into]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.drop(into).withColumn("__size", F.coalesce(size.cast("long"), F.lit(0))).repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    placed = stored(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    in_order = placed.repartition("__part").sortWithinPartitions("__part", "__at")

    def summaries(batches):
        part, held = None, []
        for b in batches:
            p, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for lo, hi in _stretches(p):
                if p[lo] != part and held:
                    yield _summary(part, np.concatenate(held), limit)
                    held = []
                part = int(p[lo])
                held.append(n[lo:hi])
        if held:
            yield _summary(part, np.concatenate(held), limit)

    def entries(batches):
        """What each range begins with, from the rows of all summaries in order."""
        part, begun, k, h, done = None, [], 0, 0, True
        for b in batches:
            for p, upto, slices, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    part, done = p, False
                    begun.append((p, k, h))
                if not done and (upto is None or upto > limit - h):
                    done, k, h = True, k + slices, left if upto is not None else h + left
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*begun, strict=True)) or [()] * 3, (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "slices", "held"])

    told = stored(in_order.select("__part", "__size").mapInArrow(summaries, "part int, at long, upto long, slices long, held long"), "summaries")
    one = told.repartitionByRange(1, "part", "at").sortWithinPartitions("part", "at").select("part", "upto", "slices", "held")
    starts = {r["part"]: (r["slices"], r["held"]) for r in one.mapInArrow(entries, "part int, slices long, held long").collect()}  # a row a range

    def number(batches):
        part, k, h = None, 0, 0
        for b in batches:
            out = []
            for p, n in zip(b.column(len(names) + 1).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if p != part:
                    part, (k, h) = p, starts[p]
                h += n
                if h > limit:
                    k, h = k + 1, 0
                out.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.int64())], names=[*names, into])

    kept = in_order.select(*names, "__size", "__part")
    return kept.mapInArrow(number, T.StructType([*kept.schema.fields[: len(names)], T.StructField(into, T.LongType())]))


def _stretches(p: np.ndarray):
    """(first, end) of the stretches of equal numbers."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]]) if len(p) else []
    return zip(edges[:-1], edges[1:], strict=True)


def _summary(part: int, sizes: np.ndarray, limit: int) -> pa.RecordBatch:
    """Rows part, at, upto, slices, held: if at is the first row that begins a slice (whose sum `upto` exceeds what was
    free), so many begin in all and that is held at the end; the last row, without upto: none begins."""
    total, n = np.cumsum(sizes), len(sizes)
    before = total - sizes
    next_ = np.searchsorted(total, before + limit, side="right")  # the row that begins a slice after a fresh start at each row
    many, held = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for j in range(n - 1, -1, -1):
        many[j], held[j] = (1 + many[next_[j] + 1], held[next_[j] + 1]) if next_[j] < n else (0, total[-1] - before[j])
    first = np.arange(min(int(np.searchsorted(total, limit, side="right")) + 1, n))
    at = [*first.tolist(), n]
    columns = [[part] * len(at), at, [*total[first].tolist(), None], [*(1 + many[first + 1]).tolist(), 0], [*held[first + 1].tolist(), int(total[-1])]]
    kinds = [pa.int32()] + [pa.int64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "at", "upto", "slices", "held"])
