"""Helpers shared by the training-data operators: Arrow text buffers, word hashing, shared storage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.shared import let_workers_import

U = np.uint64
#: Bytes \x20 and \x09-\x0D end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Largest stretch hashed at once; longer texts are cut after white space, or hashed alone.
CHUNK = 1 << 19
_RADIX = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; arithmetic wraps."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_RADIX, -1, 1 << 64)
        for name, base in (("up", _RADIX), ("down", inverse)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
        _powers["byte"] = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    return _powers["up"], _powers["down"], _powers["byte"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, offsets: np.ndarray):
    """(first, last) document ranges of about CHUNK bytes, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _hash_stretch(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a stretch; edges: places where a document begins."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, U)
    up, down, byte = _tables(len(raw) + 1)
    word = ~SPACE[raw]
    before = np.ones(len(raw), bool)
    before[1:] = ~word[:-1]
    before[edges] = True
    after = np.ones(len(raw), bool)
    after[:-1] = before[1:]
    after[:-1] |= ~word[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    total = np.zeros(len(raw) + 1, U)
    np.cumsum(byte[LOWER[raw]] * up[: len(raw)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), and for each document the place of its first word.

    Words are what lies between ASCII white space. Stretches are bounded by CHUNK, so one very long text
    costs no more memory than its words' hashes."""
    parts, counts = [], np.zeros(len(offsets), np.int64)
    for first, last in chunks(data, offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        edges = offsets[first:last] - lo
        if hi - lo <= CHUNK:
            starts, h = _hash_stretch(data[lo:hi], edges[edges < hi - lo])
            parts.append(h)
            counts[first + 1 : last + 1] = np.searchsorted(starts, offsets[first + 1 : last + 1] - lo)
            counts[first + 1 : last + 1] -= np.concatenate([[0], counts[first + 1 : last]])
            continue
        n = 0
        while lo < hi:  # one long text
            cut = min(lo + CHUNK, hi)
            if cut < hi:
                back = np.flatnonzero(SPACE[data[lo:cut]])
                if len(back):
                    cut = lo + int(back[-1]) + 1
                else:
                    on = np.flatnonzero(SPACE[data[cut:hi]])
                    cut = cut + int(on[0]) + 1 if len(on) else hi
            _, h = _hash_stretch(data[lo:cut], np.zeros(0, np.int64))
            parts.append(h)
            n, lo = n + len(h), cut
        counts[last] = n
    return (np.concatenate(parts) if parts else np.zeros(0, U)), np.cumsum(counts)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path, with its scheme, so that Spark and Python mean the same place."""
    let_workers_import(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(shared.fresh_dir(spark, name))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


#: A step's shuffle files go when it is written: later steps read the written table, never the shuffle.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors, frees the shuffle files."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, "false")
    path = fresh_dir(spark, name)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of stored frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(name: str, names) -> str:
    """A column name like `name` that isn't among `names`."""
    while name in names:
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a (stored) frame has at most that many rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """From now on Python workers get batches of rows of at most so many bytes, unless the session asks for less: what operators
    make of a batch is a few times as large, and workers that several operators use keep the most that any of them took."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).rstrip("b")
    if size.isdigit() and int(size) > most:
        spark.conf.set(name, str(most))


class Bloom:
    """A blocked Bloom filter over 64-bit hashes: four bits of one 64-bit word a key, about 16 bits a key.

    Its size is bounded by most_words, whatever it holds; a fuller one only lets more through. Words are chosen by a
    hash's high bits, so sorted hashes read them in order."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, U(64 - int(len(words) - 1).bit_length())

    @staticmethod
    def _masks(h: np.ndarray) -> np.ndarray:
        m = mix(h ^ U(0x2545F4914F6CDD1D))
        return (U(1) << (m & U(63))) | (U(1) << (m >> U(6) & U(63))) | (U(1) << (m >> U(12) & U(63))) | (U(1) << (m >> U(18) & U(63)))

    def holds(self, h: np.ndarray) -> np.ndarray:
        """h: unsigned 64-bit hashes."""
        mask = self._masks(h)
        return self.words[(h >> self.shift).astype(np.int64)] & mask == mask

    @classmethod
    def of(cls, keys: DataFrame, rows: int, most_words: int = 1 << 22) -> Bloom:
        """From a frame of one column of longs that holds `rows` rows; tasks set bits, the driver gets the set words."""
        words = min(most_words, max(1 << 10, 1 << int(max(rows, 1) // 4).bit_length()))
        shift = U(64 - int(words - 1).bit_length())

        def mark(batches):
            own = np.zeros(words, U)
            for b in batches:
                h = b.column(0).to_numpy(zero_copy_only=False).view(U)
                np.bitwise_or.at(own, (h >> shift).astype(np.int64), cls._masks(h))
            at = np.flatnonzero(own)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(own[part].view(np.int64))], names=["at", "bits"])

        marked = keys.mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
        filled = np.zeros(words, U)
        filled[marked.column(0).to_numpy()] = marked.column(1).to_numpy().view(U)
        return cls(filled)
