"""Language-model scores from an Elias-Fano n-gram trie.

Level 1 holds every training word (64-bit hashes) with its exact count; a word's number is its place there. Levels 2 and 3
hold the pairs and triples seen at least twice. A level lists the successors of each context (a word, or a pair of level 2),
sorted within the context, context after context; a successor's number is its place in the list, which makes it a context of
the next level. Per shard the level consists of

- pointers: for each context the place of its first successor, a monotone Elias-Fano sequence,
- words: successor + 1 + the value at the end of the context before, so the whole list rises and is one Elias-Fano sequence,
- log10 p in 8 bits a successor, and each context's left-over mass in 16 bits.

A query takes its context's range from the pointers, adds the value before the range to the word, and searches that successor
within the range. All levels grow with the corpus and lie in memory-mapped files of the shared folder; the driver knows only
the files. A pair can only be seen twice if its words are, and a triple if its two pairs are, so each level is counted among
what the one below holds; texts are tokenised and looked up once, and travel on as arrays of numbers.

Probabilities are interpolated with absolute discounting: p(w | context) = (c - d) / C for the stored successors, plus
what that leaves times p(w | shorter context); words alone have (c + 1) / (N + V + 1), of which one share stands for all
unknown words."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, dropped, fresh_dir, mix, stored, text_buffer, unused, word_hashes
from .elias_fano import EliasFano, load, pack, save, unpack

#: Hash of the end of a text, which is also the context of its first word.
END = np.int64(0x3C6EF372FE94F82B)
#: Text bytes scored or counted at once.
STRETCH = 3 << 20
DISCOUNT = 0.75


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def tokens(column: pa.Array):
    """(first document, end places, hashes) for stretches of documents: words and one END each, as 63-bit hashes."""
    data, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRETCH, side="right")) - 1))
        part = offsets[lo : hi + 1]
        h, first = word_hashes(data[part[0] : part[-1]], part - part[0])
        at = first[1:] + np.arange(hi - lo)  # place of each END
        out = np.empty(len(h) + hi - lo, np.int64)
        mask = np.ones(len(out), bool)
        mask[at] = False
        out[mask] = (h >> U(1)).view(np.int64)
        out[at] = END
        yield lo, at, out
        lo = hi


@dataclass
class Known:
    words: np.ndarray


@dataclass
class Model:
    """Files only; each level lies in the shared folder."""

    levels: dict[int, list[str]]  # level -> files of its shards, in order
    firsts: dict[int, np.ndarray]  # level -> number of the first entry of each of these, and of all entries
    n: int
    v: int
    least: int  # count from which words and n-grams serve as contexts and successors

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.n + 1.0 * (self.v + 1)))

    def contexts(self, level: int) -> int:
        return int(self.firsts[level - 1][-1])

    def wide(self, level: int) -> bool:
        """Whether context and word don't fit one long."""
        return self.contexts(level) * self.v >= 1 << 62

    def entries(self, level: int) -> int:
        return int(self.firsts[level][-1]) if level in self.firsts else 0

    @property
    def known(self) -> Known:
        """All words of level 1 by number: for small models."""
        parts = [_opened(f.split("\t")[1])[0] for f in self.levels.get(1, [])]
        return Known(np.concatenate([ef.at(np.arange(ef.n)) for ef in parts]) if parts else np.zeros(0, np.int64))


def _sharded(counts: DataFrame, shard: Column, builder, folder: str, keys: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """Write a file for each shard, whose rows (keys, n) come sorted by their keys; gives the files in the order of shards, and
    the number of the first entry of each, then of all. builder gives a task's function of a shard."""
    dealt = counts.withColumn("shard", shard.cast("int")).repartition("shard").sortWithinPartitions("shard", *keys).select("shard", *keys, "n")

    def run(batches):
        build, shard, held = builder(), None, []

        def close():
            name, cols = f"{folder}/{uuid.uuid4().hex}", [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            save(name, build(*cols))
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "size": pa.array([len(cols[0])], pa.int64())})

        for b in batches:
            s, *cols = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(s)) + 1, [len(s)]]) if len(s) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if s[lo] != shard:
                    if shard is not None:
                        yield close()
                    shard, held = int(s[lo]), []
                held.append([c[lo:hi] for c in cols])
        if shard is not None:
            yield close()

    rows = sorted(stored(dealt.mapInArrow(run, "shard int, file string, size long"), "shards").collect())
    return [f"{r['shard']}\t{r['file']}" for r in rows], np.cumsum([0, *[r["size"] for r in rows]])


def _by_shard(files: list[str]) -> dict[int, str]:
    return {int(k): f for k, f in (x.split("\t") for x in files)}


def _with_counts(ns: np.ndarray) -> dict[str, np.ndarray]:
    values, code = np.unique(ns, return_inverse=True)  # few distinct counts: a codebook, exact
    width = max(1, int(len(values) - 1).bit_length())
    return {"counts": values, "width": np.array([width]), "places": pack(code, width)}


def _vocabulary():
    return lambda keys, ns: {**EliasFano.build(keys), **_with_counts(ns)}


def _under(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}_{k}": v for k, v in parts.items()}


def _successors(level: int, model: Model, shards: dict[int, int]):
    """Builder of a shard of level 2 or 3 from rows context, word, n."""

    def build(context: np.ndarray, word: np.ndarray, ns: np.ndarray) -> dict[str, np.ndarray]:
        reader = Reader(model, shards)
        first = np.flatnonzero(np.diff(context, prepend=context[0] - 1))
        heads, size = context[first], np.diff(first, append=len(context))
        total = reader.counts_at(level - 1, heads).astype(float)
        own = np.maximum(ns - DISCOUNT, 0.0)
        left = np.maximum(1 - np.add.reduceat(own, first) / total, 1e-9)
        u, back = np.unique(word, return_inverse=True)
        lower = model.unigram(reader.counts_at(1, u))[back]
        if level == 3:
            lower = reader.logs(2, np.repeat(reader.words_at(2, heads), size), word, lower)
        p = own / np.repeat(total, size) + np.repeat(left, size) * 10.0**lower
        logs = np.log10(p)
        lo, hi = float(logs.min()), float(logs.max())
        step = max((hi - lo) / 255, 1e-12)
        base = int(heads[0])
        many = int(heads[-1]) - base + 1
        mass, held = np.zeros(many, np.uint16), np.zeros(many, np.int64)
        mass[heads - base] = np.clip(np.round(-np.log10(left) * 6553.5), 0, 65535)
        held[heads - base] = size
        last = np.cumsum(word[first + size - 1] + 1)  # value at the end of each context
        rising = word + 1 + np.repeat(np.concatenate([[0], last[:-1]]), size)
        return {
            **_under("pointers", EliasFano.build(np.concatenate([[0], np.cumsum(held)]), searched=False)), **_under("words", EliasFano.build(rising)),
            "codes": np.round((logs - lo) / step).astype(np.uint8), **(_with_counts(ns) if level == 2 else {}),
            "scale": np.array([lo, step]), "base": np.array([base]), "mass": mass,
        }

    return lambda: build


@lru_cache(maxsize=64)
def _opened(file: str):
    """(vocabulary, arrays) of a shard of level 1; ((pointers, words), arrays) of the others."""
    parts = load(file)
    if "shape" in parts:
        return EliasFano.of(parts), parts
    cut = lambda name: EliasFano.of({k.partition("_")[2]: v for k, v in parts.items() if k.startswith(name)})
    return (cut("pointers_"), cut("words_")), parts


def _successor(words: EliasFano, before: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place of each word among the successors lo to hi, -1 where it isn't one; before: the value before lo."""
    out = np.full(len(word), -1, np.int64)
    some = np.flatnonzero(hi > lo)
    at = words.find(word[some] + 1 + before[some])
    ok = (at >= lo[some]) & (at < hi[some])
    out[some[ok]] = at[ok]
    return out


class Reader:
    """Looks n-grams up in the shards; lives in one task."""

    def __init__(self, model: Model, shards: dict[int, int]):
        self.model, self.files, self.shards = model, {k: _by_shard(v) for k, v in model.levels.items()}, shards
        self.first = {k: dict(zip(f, model.firsts[k].tolist(), strict=False)) for k, f in self.files.items()}

    def vocabulary(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, numbers) of sorted distinct hashes; words that aren't contexts have -1 - their count as number, -1 if unknown."""
        out, number = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for s, own in _groups(_word_shard(h, self.shards[1])):
            if (file := self.files.get(1, {}).get(s)) is not None:
                ef, parts = _opened(file)
                at = ef.find(h[own])
                ok = at >= 0
                out[own[ok]] = parts["counts"][unpack(parts["places"], int(parts["width"][0]), at[ok])]
                number[own[ok]] = self.first[1][s] + at[ok]
        return out, np.where((out >= self.model.least) | (h == END) & (out > 0), number, -1 - out)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct hashes; 0 for unknown ones."""
        return self.vocabulary(h)[0]

    def _entries(self, level: int, numbers: np.ndarray):
        """(places in numbers, opened shard, places in it) for each shard of these entries."""
        if not len(numbers):
            return
        firsts = self.model.firsts[level]
        for k, own in _groups(np.searchsorted(firsts, numbers, side="right") - 1):
            yield own, _opened(self.model.levels[level][k].split("\t")[1]), numbers[own] - firsts[k]

    def counts_at(self, level: int, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for own, (_, parts), at in self._entries(level, numbers):
            out[own] = parts["counts"][unpack(parts["places"], int(parts["width"][0]), at)]
        return out

    def words_at(self, level: int, numbers: np.ndarray) -> np.ndarray:
        """The last word of each of these entries."""
        out = np.zeros(len(numbers), np.int64)
        for own, ((pointers, words), _), at in self._entries(level, numbers):
            starts = pointers.at(np.arange(pointers.n))
            start = starts[np.searchsorted(starts, at, side="right") - 1]
            out[own] = words.at(at) - 1 - np.where(start > 0, words.at(np.maximum(start - 1, 0)), 0)
        return out

    def logs_at(self, level: int, numbers: np.ndarray) -> np.ndarray:
        """log10 p of these entries."""
        out = np.zeros(len(numbers))
        for own, (_, parts), at in self._entries(level, numbers):
            lo, step = parts["scale"]
            out[own] = lo + step * parts["codes"][at]
        return out

    def find(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, log10 of the context's left-over mass): -1 and 0 where the level has neither; negative numbers are in no level."""
        entry, mass = np.full(len(context), -1, np.int64), np.zeros(len(context))
        live = np.flatnonzero(context >= 0) if level in self.files else ()
        if len(live):
            for s, part in _groups(_context_shard(context[live], self.model.contexts(level), self.shards[level])):
                if (file := self.files[level].get(s)) is None:
                    continue
                (pointers, words), parts = _opened(file)
                own = live[part]
                place = context[own] - int(parts["base"][0])
                inside = (place >= 0) & (place < len(parts["mass"]))
                own, place = own[inside], place[inside]
                mass[own] = parts["mass"][place] / -6553.5
                can = np.flatnonzero(word[own] >= 0)
                u, back = np.unique(place[can], return_inverse=True)
                lo, hi = pointers.at(u), pointers.at(u + 1)
                before = np.where(lo > 0, words.at(np.maximum(lo - 1, 0)), 0)
                at = _successor(words, before[back], lo[back], hi[back], word[own[can]])
                entry[own[can]] = np.where(at >= 0, self.first[level][s] + at, -1)
        return entry, mass

    def logs(self, level: int, context: np.ndarray, word: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 p(word | context), given that of the shorter context; contexts or words of -1 fall back to it."""
        entry, mass = self.find(level, context, word)
        out = lower + mass
        hit = np.flatnonzero(entry >= 0)
        out[hit] = self.logs_at(level, entry[hit])
        return out


def _groups(shard: np.ndarray):
    """(shard, places) of each shard, in one sort."""
    if len(shard) and (shard == shard[0]).all():
        yield int(shard[0]), np.arange(len(shard))
        return
    shard = shard.astype(np.int16) if len(shard) and shard.max() < 1 << 15 else shard  # sorted by radix
    order = np.argsort(shard, kind="stable")
    u, first = np.unique(shard[order], return_index=True)
    yield from zip(u.tolist(), np.split(order, first[1:]), strict=False)


def _word_shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> 32) * n >> 31).astype(np.int64)


def _context_shard(context: np.ndarray, contexts: int, n: int) -> np.ndarray:
    return context * n // max(1, contexts)


def _kind(most: int):
    """The narrowest signed type for numbers below `most`."""
    return np.dtype("<i4") if most < 1 << 31 else np.dtype("<i8")


def _arrays(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each row's end) of a column of packed arrays."""
    data, offsets = text_buffer(column)
    return data.view(kind), offsets // kind.itemsize


def _packed(numbers: np.ndarray, ends: np.ndarray, kind: np.dtype) -> pa.Array:
    at = np.concatenate([[0], ends]).astype(np.int64) * kind.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(numbers, kind))]).cast(pa.binary())


def _stretches(rows: np.ndarray, most: int = 1 << 18):
    """(first, last) rows of about `most` tokens, one row at least; rows: where each ends, from 0 on."""
    lo, n = 0, len(rows) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(rows, rows[lo] + most, side="right")) - 1))
        yield lo, hi
        lo = hi


#: What a text's tokens give besides their numbers.
BASE = ("n_tokens", "n_known", "train_tokens", "base_score")


def numbered(docs: DataFrame, model: Model, shards: dict[int, int], text: str, carry: list[str]) -> DataFrame:
    """carry, BASE and `numbers`, packed: each token's number in level 1 (see Reader.vocabulary)."""
    at, kind = len(carry), _kind(model.v)

    def run(batches):
        reader = Reader(model, shards)
        for b in batches:
            out, numbers, ends_of, so_far = {m: [] for m in BASE}, [], [], 0
            for _, ends, h in tokens(b.column(at)):
                u, back = np.unique(h, return_inverse=True)
                counts, number = reader.vocabulary(u) if model.n else (np.zeros(len(u), np.int64), np.full(len(u), -1))
                single = model.unigram(counts)[back]
                starts = np.concatenate([[0], ends[:-1] + 1])
                out["n_tokens"].append(ends - starts + 1)
                out["n_known"].append(np.add.reduceat((counts > 0)[back].astype(np.int64), starts))
                out["train_tokens"].append(np.full(len(ends), model.n))
                out["base_score"].append(np.add.reduceat(single, starts))
                numbers.append(number.astype(kind)[back])
                ends_of.append(ends + 1 + so_far)
                so_far += len(h)
            if b.num_rows:
                cols = [pa.array(np.concatenate(out[m]), pa.int64() if m != "base_score" else pa.float64()) for m in BASE]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *cols, _packed(np.concatenate(numbers), np.concatenate(ends_of), kind)], names=[*carry, *BASE, "numbers"])

    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(unused("text", carry)))
    fields = [*source.schema.fields[:at], *(T.StructField(m, T.DoubleType() if m == "base_score" else T.LongType()) for m in BASE), T.StructField("numbers", T.BinaryType())]
    return source.mapInArrow(run, T.StructType(fields))


def paired(docs: DataFrame, model: Model, shards: dict[int, int]) -> DataFrame:
    """Add `pairs`, packed: for each token the number in level 2 of it and the one before (END, for the first), or -1."""
    names = docs.columns
    at, kind, out = names.index("numbers"), _kind(model.v), _kind(max(model.entries(2), 1))

    def run(batches):
        reader = Reader(model, shards)
        end = _end(reader)
        for b in batches:
            own, rows = _arrays(b.column(at), kind)
            pairs = np.full(len(own), -1, out)
            for lo, hi in _stretches(rows):
                a, z = rows[lo], rows[hi]
                part = own[a:z].astype(np.int64)
                before = np.empty_like(part)
                before[1:] = part[:-1]
                before[rows[lo:hi] - a] = end
                pairs[a:z] = reader.find(2, before, part)[0]
            yield pa.RecordBatch.from_arrays([*b.columns, _packed(pairs, rows[1:], out)], names=[*names, "pairs"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pairs", T.BinaryType())]))


def _end(reader: Reader) -> int:
    """END's number; -1 where no text was learned."""
    return int(reader.vocabulary(np.array([END]))[1][0]) if reader.model.n else -1


#: Keys that a bucket holds on the average, before those of different tasks are added up.
BUCKET = 2_000_000
_PACKED = "bucket int, keys binary, more binary, counts binary"


def _dealt(keys: list[np.ndarray], counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Distinct keys (one or two arrays) and their counts as one row a bucket, by the keys' hashes."""
    h = mix(keys[0].view(U))
    if len(keys) > 1:
        h = mix(h ^ keys[1].view(U))
    bucket = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    ends = np.append(first[1:], len(order))[: len(first)]
    counts = counts[order].astype(np.uint8 if counts.max(initial=0) < 256 else np.int64)
    cols = [_packed(k[order], ends, np.dtype("<i8")) for k in keys] + [pa.nulls(len(first), pa.binary())] * (2 - len(keys))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][first], pa.int32()), *cols, _packed(counts, ends, counts.dtype)], names=["bucket", "keys", "more", "counts"])


def _added_up(packed: DataFrame, names: list[str], least: int) -> DataFrame:
    """names, n of _dealt()'s rows: the counts of equal keys are added up, bucket by bucket; those under `least` go."""
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")

    def total(held):
        keys = [np.concatenate([np.frombuffer(r[k], np.int64) for r in held]) for k in range(1, len(names) + 1)]
        counts = np.concatenate([np.frombuffer(r[3], np.uint8 if len(r[3]) * 8 == len(r[1]) else np.int64).astype(np.int64) for r in held])
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        n = np.add.reduceat(counts[order], first)
        keep = np.flatnonzero(n >= least)
        for lo in range(0, len(keep), 1 << 16):
            part = keep[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first[part]]) for k in keys), pa.array(n[part])], names=[*names, "n"])

    def run(batches):
        held = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[0][0] != row[0]:
                    yield from total(held)
                    held = []
                held.append(row)
        if held:
            yield from total(held)

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


def _buckets(spark, tokens_: int) -> int:
    return max(1, -(-tokens_ // BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _counted(docs: DataFrame, level: int, model: Model, shards: dict[int, int]) -> DataFrame:
    """context, word, n of the pairs or triples of numbered (and paired) texts, counted within stretches, then over all."""
    wide, v, kind, pair = model.wide(level), model.v, _kind(model.v), _kind(max(model.entries(2), 1))
    buckets = _buckets(docs.sparkSession, model.n)

    def run(batches):
        end = _end(Reader(model, shards))
        for b in batches:
            own, rows = _arrays(b.column(0), kind)
            two = _arrays(b.column(1), pair)[0] if level == 3 else own
            for lo, hi in _stretches(rows, 1 << 20):
                a, z, starts = rows[lo], rows[hi], rows[lo:hi] - rows[lo]
                word, above = own[a:z].astype(np.int64), two[a:z].astype(np.int64)
                context = np.empty_like(word)
                context[1:] = above[:-1]
                context[starts] = end if level == 2 else -1
                ok = (context >= 0) & (word >= 0) & (above >= 0)
                context, word = context[ok], word[ok]
                if wide:
                    order = np.lexsort([word, context])
                    context, word = context[order], word[order]
                    first = np.flatnonzero((np.diff(context, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
                    yield _dealt([context[first], word[first]], np.diff(first, append=len(word)), buckets)
                else:
                    keys, counts = np.unique(context * v + word, return_counts=True)
                    yield _dealt([keys], counts, buckets)

    names = ["context", "word"] if wide else ["key"]
    counts = _added_up(docs.select("numbers", *(["pairs"] if level == 3 else [])).mapInArrow(run, _PACKED), names, model.least)
    return counts if wide else counts.select(F.expr(f"key div {v}").alias("context"), F.expr(f"key % {v}").alias("word"), "n")


def _build(docs: DataFrame, text: str, learn_from: Column | None, carry: list[str], shard_rows: int, least: int) -> tuple[Model, dict[int, int], DataFrame]:
    """(model, shards, the numbered and paired docs, stored). Only rows with learn_from are learned from; all are numbered."""
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("__text"), (F.lit(True) if learn_from is None else learn_from).alias("__learn"))
    folder = fresh_dir(spark, "trie")

    size = docs.where("__learn").agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0)).alias("n")).first()["n"]
    buckets = _buckets(spark, size // 4)  # about four characters a word at least

    def words(batches):
        for b in batches:
            for _, _, h in tokens(b.column(0)):
                keys, n = np.unique(h, return_counts=True)
                yield _dealt([keys], n, buckets)

    counts = stored(_added_up(docs.where("__learn").select("__text").mapInArrow(words, _PACKED), ["key"], 1), "words")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n, v = int(total["n"]), int(total["v"])
    shards = {1: max(1, -(-v // shard_rows))}
    model = Model({}, {}, n, v, least)
    if n:
        model.levels[1], model.firsts[1] = _sharded(counts, F.shiftright(F.shiftright("key", 32) * shards[1], 31), _vocabulary, f"{folder}/1", ("key",))
    dropped(counts)
    own = stored(numbered(docs, Model(dict(model.levels), dict(model.firsts), n, v, least), dict(shards), "__text", [*carry, "__learn"]), "numbers")
    for level in (2, 3) if n else ():
        below, cut = Model(dict(model.levels), dict(model.firsts), n, v, least), dict(shards)
        if level == 3:
            plain, own = own, stored(paired(own, below, cut), "pairs")
            dropped(plain)
        found = stored(_counted(own.where("__learn"), level, below, cut), "grams")
        size = found.count()
        if not size:
            break
        shards[level] = -(-size // shard_rows)
        shard = F.floor(F.col("context").cast("decimal(38,0)") * shards[level] / below.contexts(level)) if below.contexts(level) * shards[level] >= 1 << 62 else F.expr(f"context * {shards[level]} div {below.contexts(level)}")
        model.levels[level], model.firsts[level] = _sharded(found, shard, _successors(level, below, cut), f"{folder}/{level}", ("context", "word"))
        dropped(found)
    if "pairs" not in own.columns:
        plain, own = own, stored(paired(own, model, shards), "pairs")
        dropped(plain)
    return model, shards, own


def train(docs: DataFrame, text: str = "text", shard_rows: int = 500_000, least: int = 2) -> tuple[Model, dict[int, int]]:
    """Build the trie from all texts. Gives the model and the number of shards of each level.

    Words, pairs and triples seen `least` times at least are kept, whatever the size of the corpus. The driver collects totals
    and file names. Null and empty texts are the one token END; a repeated row counts each time; an empty table gives a
    model of no texts."""
    model, shards, own = _build(docs, text, None, [], shard_rows, least)
    dropped(own)
    return model, shards


def train_and_score(docs: DataFrame, learn_from: Column, text: str = "text", shard_rows: int = 500_000, least: int = 2) -> DataFrame:
    """train() on the rows that learn_from marks, score() of all rows: texts are tokenised twice instead of four times. The text isn't kept."""
    carry = [c for c in docs.columns if c not in (*BASE, "score", text)]
    model, shards, own = _build(docs, text, learn_from, carry, shard_rows, least)
    return _scored(own, model, shards).drop("__learn")


def score(docs: DataFrame, trained: tuple[Model, dict[int, int]], text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score (log10 probability), replacing columns of their names.

    Null and empty texts are the one token END; repeated rows get equal scores; a model of no texts gives every token
    the probability 1; other columns pass through."""
    names = [c for c in docs.columns if c not in (*BASE, "score")]
    model, shards = trained
    return _scored(paired(numbered(docs, model, shards, text, names), model, shards), model, shards)


def _scored(docs: DataFrame, model: Model, shards: dict[int, int]) -> DataFrame:
    """Replace numbers and pairs by score."""
    names = [c for c in docs.columns if c not in ("numbers", "pairs")]
    at, kind, pair = len(names), _kind(model.v), _kind(max(model.entries(2), 1))

    def run(batches):
        reader = Reader(model, shards)
        end = _end(reader)
        for b in batches:
            own, rows = _arrays(b.column(at), kind)
            two, scores = _arrays(b.column(at + 1), pair)[0], []
            for lo, hi in _stretches(rows):
                a, z, starts = rows[lo], rows[hi], rows[lo:hi] - rows[lo]
                word, pairs = own[a:z].astype(np.int64), two[a:z].astype(np.int64)
                hit = pairs >= 0
                miss = np.flatnonzero(~hit)
                few = word[miss]
                counts = np.where(few < 0, -1 - few, 0)
                counts[few >= 0] = reader.counts_at(1, few[few >= 0]) if model.n else 0
                best = np.empty(len(word))
                best[miss] = model.unigram(counts)
                if model.n:
                    before, above = np.empty_like(word), np.empty_like(word)
                    before[1:], above[1:] = word[:-1], pairs[:-1]
                    before[starts], above[starts] = end, -1
                    best[miss] += reader.find(2, before[miss], np.full(len(miss), -1))[1]
                    best[hit] = reader.logs_at(2, pairs[hit])
                    # A triple is stored only if its last two words are.
                    best = reader.logs(3, above, np.where(hit, word, -1), best)
                scores.append(np.add.reduceat(best, starts))
            out = pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], out], names=[*names, "score"])

    source = docs.select(*[F.col(f"`{c}`") for c in names], "numbers", "pairs")
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:at], T.StructField("score", T.DoubleType())]))
