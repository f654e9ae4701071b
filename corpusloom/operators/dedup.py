"""Exact and fuzzy de-duplication.

Fuzzy: word shingles -> MinHash -> bands -> buckets -> greedy pivots by the smallest id -> clean. Documents of equal
signatures are one class from the start, which changes nothing (an equal signature has similarity 1, so a pivot that
removes one removes all) but keeps groups of copies out of the buckets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_heads
from ..functions.text import col, normal_key, shingles
from ..sources.shared import stored

PERMUTATIONS, BANDS, ROWS, THRESHOLD = 112, 14, 8, 0.7
#: Bands and rows of the search: a document as near as THRESHOLD is met with probability 0.9995 (14 bands of 8 meet 0.56).
SEARCH_BANDS, SEARCH_ROWS = 28, 4
#: 32-bit hashes of shingles by name.
HASHES = {"xxh32": xxhash.xxh32_intdigest, "md5": lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:4], "big")}


def exact_key(text: str | Column = "text") -> Column:
    return F.sha2(normal_key(text), 256)


def exact_dedup(df: DataFrame, text: str = "text", order_by: str = "doc_id", removed: bool = False) -> DataFrame:
    """Keep the first row of each key in the declared order. With `removed`, add the ids of the others to the one kept.

    The first is found by an aggregate with map-side combining, so a key that holds a third of all rows is no hot spot; the
    ids of `removed` are kept as sorted arrays, which are as large as the group."""
    keyed = df.withColumn("__key", exact_key(text))
    first = keyed.groupBy("__key").agg(F.min(order_by).alias("__first"), *([F.array_sort(F.collect_list(order_by)).alias("__all")] if removed else []))
    kept = keyed.join(first.withColumnRenamed("__key", "__k"), (F.col("__key") == F.col("__k")) & (F.col(order_by) == F.col("__first")))
    if removed:
        kept = kept.withColumn("removed", F.slice(F.col("__all"), F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0))))
    return kept.drop("__key", "__k", "__first", "__all")


def exact_dedup_rate(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents in and out, and the share removed in per cent."""
    sizes = df.groupBy(exact_key(text).alias("k")).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("docs_in"), F.count("*").alias("docs_out")).withColumn("removed_percent", 100 * (1 - F.col("docs_out") / F.col("docs_in")))


def new_documents(df: DataFrame, known_keys: DataFrame, text: str = "text", order_by: str = "doc_id") -> DataFrame:
    """Exact de-duplication against keys of earlier batches (a column `key`), then within the batch."""
    fresh = df.withColumn("__key", exact_key(text)).join(known_keys.select(F.col("key").alias("__key")), "__key", "left_anti")
    return exact_dedup(fresh.drop("__key"), text, order_by)


def permutations(k: int = PERMUTATIONS, seed: int = 42) -> np.ndarray:
    """k odd 64-bit multipliers."""
    return np.random.RandomState(seed).randint(1, np.iinfo(np.int64).max, size=k, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(hashes: np.ndarray, multipliers: np.ndarray, stretch: int = 8192) -> np.ndarray:
    """min over hashes h of (h * a mod 2^64) >> 32, for each multiplier a, in bounded blocks."""
    out = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint64)
    for at in range(0, len(hashes), stretch):
        block = hashes[at : at + stretch, None] * multipliers[None, :]
        out = np.minimum(out, (block >> np.uint64(32)).min(0))
    return out


#: Shingles that are hashed at once, besides those of one text.
GRAMS = 1 << 16


def _digests(texts: list[tuple[int, bytes, np.ndarray, np.ndarray]], hashing: str) -> np.ndarray:
    """Hashes of the shingles of (row, bytes, first places, ends), end to end."""
    if hashing != "md5":
        digest = HASHES[hashing]
        return np.fromiter((digest(raw[x:y]) for _, raw, first, end in texts for x, y in zip(first.tolist(), end.tolist(), strict=True)), np.uint64)
    at = np.cumsum([0, *(len(raw) for _, raw, _, _ in texts)])
    first, end = (np.concatenate([x[c] + o for x, o in zip(texts, at, strict=False)]) for c in (2, 3))
    return md5_heads(b"".join(raw for _, raw, _, _ in texts), first, end)


def signatures(df: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = PERMUTATIONS, shingle: int = 5, seed: int = 42, hashing: str = "xxh32", characters: bool = False) -> DataFrame:
    """id, minhashes (array of longs below 2^32), document_length. Shingles are of words, or of characters of the text with
    single spaces. Texts without words all have the signature of zeros."""

    def grams(t: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text's words joined by spaces, and where its shingles begin and end in that."""
        raw = " ".join((t or "").split()).encode()
        own = np.frombuffer(raw, np.uint8)
        if characters:
            first = np.flatnonzero((own & 0xC0) != 0x80)
            last = np.r_[first[1:], len(own)]
        else:
            spaces = np.flatnonzero(own == 32)
            first, last = np.r_[0, spaces + 1], np.r_[spaces, len(own)]
        n = max(1, len(first) - shingle + 1) if len(own) else 0
        return raw, first[:n], last[min(shingle, len(first)) - 1 :][:n] if n else first[:0]

    def run(batches):
        a = permutations(k, seed)
        for b in batches:
            texts = b.column(1).to_pylist()
            flat, lengths, held, size = np.zeros((len(texts), k), np.int64), [len(t or "") for t in texts], [], 0
            for row, t in enumerate(texts):
                held.append((row, *grams(t)))
                size += len(held[-1][2])
                if size < GRAMS and row + 1 < len(texts):
                    continue
                some = [x for x in held if len(x[2])]  # texts without words keep their zeros
                if some:
                    h = _digests(some, hashing)
                    at = np.cumsum([0, *(len(x[2]) for x in some)])[:-1]
                    for j in range(k):  # the least product has the least high half
                        flat[[x[0] for x in some], j] = np.minimum.reduceat(h * a[j], at) >> np.uint64(32)
                held, size = [], 0
            at = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(flat.ravel())), pa.array(lengths, pa.int64())], names=["id", "minhashes", "document_length"])

    return df.select(col(id_column).cast("long").alias("id"), col(text).cast("string")).mapInArrow(run, "id long, minhashes array<long>, document_length long")


def limb_multipliers(k: int, seed: int = 42) -> list[tuple[int, int]]:
    """The multipliers as (high, low) 32-bit halves, for arithmetic without 64-bit overflow."""
    return [(int(a) >> 32, int(a) & 0xFFFFFFFF) for a in permutations(k, seed)]


def sql_minhash(h: str, hi: int, lo: int) -> str:
    """SQL text, alike in Spark and DuckDB, for (h * a mod 2^64) >> 32 with a = hi * 2^32 + lo and h below 2^32."""
    return f"(((((({h})>>16)*{lo} + (((({h}) & 65535)*{lo})>>16))>>16) + ((((({h})>>16)*{hi}) & 65535)*65536 + (({h}) & 65535)*{hi})) & 4294967295)"


def signatures_sql(df: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = 16, shingle: int = 5, seed: int = 42) -> DataFrame:
    """The same estimator by built-in functions alone, over the first 32 bits of md5: an explode and k minima with map-side combining."""
    h = F.conv(F.substring(F.md5(F.col("s").cast("binary")), 1, 8), 16, 10).cast("long")
    grams = df.select(col(id_column).alias("id"), F.explode(shingles(text, shingle)).alias("s")).select("id", h.alias("h"))
    mins = [F.min(F.expr(sql_minhash("h", hi, lo))).cast("long").alias(f"m{i}") for i, (hi, lo) in enumerate(limb_multipliers(k, seed))]
    return grams.groupBy("id").agg(*mins).select("id", F.array(*[f"m{i}" for i in range(k)]).alias("minhashes"))


def band_hashes(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document and band: band, band_hash (60 bits of md5 over the band's hashes) and what `sigs` has."""
    text = lambda b: F.array_join(F.slice("minhashes", b * rows + 1, rows).cast("array<string>"), ",")
    hashes = F.array(*[F.conv(F.substring(F.md5(text(b).cast("binary")), 1, 15), 16, 10).cast("long") for b in range(bands)])
    return sigs.select("*", F.posexplode(hashes).alias("band", "band_hash"))


def segments(banded: DataFrame, n: int) -> DataFrame:
    """Adds the number of the segment, of n equal ranges of band hashes, that a row falls in: buckets are whole in their segment."""
    return banded.withColumn("segment", F.floor(F.col("band_hash").cast("decimal(38,0)") * n / F.lit(1 << 60)).cast("int"))


def buckets(banded: DataFrame) -> DataFrame:
    """band, band_hash, docs, first_doc of the buckets that hold at least two documents."""
    return banded.groupBy("band", "band_hash").agg(F.count("*").alias("docs"), F.min("id").alias("first_doc")).where("docs > 1")


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def classes(sigs: DataFrame) -> DataFrame:
    """One document (the smallest id) for each distinct signature, and the signature."""
    return sigs.groupBy("minhashes").agg(F.min("id").alias("id"), F.min("document_length").alias("document_length"))


#: Documents of a bucket that one task goes through; more are taken in blocks of so many.
BLOCK = 20_000


def greedy_pivots(banded: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """first_doc, removed, similarity: in each bucket, by id, a document goes to the first pivot it is similar to, else is one.

    Buckets of up to `block` documents are streamed in sorted partitions. Larger ones are cut into blocks by id, which follow
    each other: a block's documents are compared with the pivots of each earlier block in a task of its own, and what is near
    none of them is streamed as a small bucket is. So a task never holds more than two blocks, whatever a bucket's size."""
    block = block or BLOCK
    own, key = banded.select("band", "band_hash", "id", "minhashes"), ["band", "band_hash"]
    large = stored(own.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*key, "n"), "large-buckets")
    if large.isEmpty():
        return _streamed_pivots(own, threshold)
    out = _streamed_pivots(own.join(large.select(*key), key, "left_anti"), threshold)
    from .filters import sequential_id

    numbered = stored(sequential_id(own.join(large.select(*key), key, "left_semi"), [*key, "id"], "at"), "large-buckets")
    first = numbered.groupBy(*key).agg(F.min("at").alias("first"))
    rows = stored(numbered.join(first, key).select(*key, "id", "minhashes", F.floor((F.col("at") - F.col("first")) / block).cast("int").alias("block")), "large-buckets")
    pivots: DataFrame | None = None
    for k in range(rows.agg(F.max("block")).first()[0] + 1):
        part = rows.where(F.col("block") == k)
        if pivots is not None:
            found = stored(_nearest_pivots(part, pivots, k, threshold), "pivots")
            out = out.union(found.select("first_doc", "removed", "similarity"))
            part = part.join(found.select(*key, F.col("removed").alias("id")), [*key, "id"], "left_anti")
        part = stored(part, "pivots")
        near = stored(_streamed_pivots(part.drop("block"), threshold, with_key=True), "pivots")
        out = out.union(near.select("first_doc", "removed", "similarity"))
        fresh = part.join(near.select(*key, F.col("removed").alias("id")), [*key, "id"], "left_anti")
        pivots = stored(fresh if pivots is None else pivots.union(fresh), "pivots")
    return out


def _nearest_pivots(part: DataFrame, pivots: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """band, band_hash, removed, first_doc, similarity: of the documents that are similar to pivots of earlier blocks the first one."""
    key = ["band", "band_hash", "block"]
    asked = part.select("band", "band_hash", "id", "minhashes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(_, docs, held):
        docs, held = docs.sort_values("id"), held.sort_values("id")
        rows = []
        if len(docs) and len(held):
            ids, matrix = held["id"].to_numpy(), np.stack(held["minhashes"].to_list())
            for doc, m in zip(docs["id"], docs["minhashes"], strict=True):
                j = (matrix == np.asarray(m)).mean(1)
                hit = np.flatnonzero(j >= threshold)
                if len(hit):
                    rows.append((docs["band"].iloc[0], docs["band_hash"].iloc[0], doc, ids[hit[0]], float(j[hit[0]])))
        return pd.DataFrame(rows, columns=["band", "band_hash", "removed", "first_doc", "similarity"])

    met = asked.groupBy(*key).cogroup(pivots.select(*key, "id", "minhashes").groupBy(*key)).applyInPandas(run, "band int, band_hash long, removed long, first_doc long, similarity double")
    return met.groupBy("band", "band_hash", "removed").agg(F.min(F.struct("first_doc", "similarity")).alias("m")).select("band", "band_hash", "removed", "m.first_doc", "m.similarity")


def _streamed_pivots(banded: DataFrame, threshold: float, with_key: bool = False) -> DataFrame:
    """Buckets in sorted partitions, of which only the pivots are held."""
    parts = banded.select("band", "band_hash", "id", "minhashes").repartition("band", "band_hash").sortWithinPartitions("band", "band_hash", "id")

    def run(batches):
        bucket, ids, pivots = None, [], None
        for b in batches:
            out = ([], [], [], [], [])
            sigs = b.column(3)
            flat = sigs.flatten().to_numpy(zero_copy_only=False)
            if not b.num_rows:
                continue
            matrix = flat.reshape(b.num_rows, -1)
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if key != bucket:
                    bucket, ids, pivots = key, [], np.zeros((4, matrix.shape[1]), np.int64)
                doc = b.column(2)[i].as_py()
                if ids:
                    j = (pivots[: len(ids)] == matrix[i]).mean(1)
                    hit = np.flatnonzero(j >= threshold)
                    if len(hit):
                        out[0].append(ids[hit[0]])
                        out[1].append(doc)
                        out[2].append(float(j[hit[0]]))
                        out[3].append(key[0])
                        out[4].append(key[1])
                        continue
                if len(ids) == len(pivots):
                    pivots = np.concatenate([pivots, np.zeros_like(pivots)])
                pivots[len(ids)] = matrix[i]
                ids.append(doc)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["first_doc", "removed", "similarity", "band", "band_hash"])

    found = parts.mapInArrow(run, "first_doc long, removed long, similarity double, band int, band_hash long")
    return found if with_key else found.drop("band", "band_hash")


def fuzzy_pairs(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct (first_doc, removed, similarity): greedy pivots of all buckets, and copies of equal signatures at similarity 1."""
    one = stored(classes(sigs), "classes")
    near = greedy_pivots(crowded(one, bands, rows), threshold)
    same = sigs.join(one.select(F.col("minhashes").alias("m"), F.col("id").alias("first_doc")), F.col("minhashes") == F.col("m")).where("id <> first_doc")
    return near.union(same.select("first_doc", F.col("id").alias("removed"), F.lit(1.0).alias("similarity"))).distinct()


def duplicate_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("removed").alias("id")).distinct()


def fuzzy_removed(sigs: DataFrame, **options) -> DataFrame:
    """Ids to remove: a document goes with all that have its signature."""
    one = stored(classes(sigs), "classes")
    near = duplicate_ids(greedy_pivots(crowded(one, options.get("bands", BANDS), options.get("rows", ROWS)), options.get("threshold", THRESHOLD)))
    gone = one.join(near, "id", "left_semi").select("minhashes")
    whole = sigs.join(gone, "minhashes", "left_semi").select("id")
    copies = sigs.join(one.select(F.col("minhashes").alias("m"), F.col("id").alias("first")), F.col("minhashes") == F.col("m")).where("id <> first").select("id")
    return whole.union(copies).distinct()


def clean(df: DataFrame, duplicates: DataFrame, id_column: str = "doc_id", mode: str = "filter", into: str = "duplicate") -> DataFrame:
    """mode filter: without the duplicates; keep: only them; annotate: `into` is 'd' for them, else ''."""
    ids = duplicates.select(F.col("id").alias("__dup")).distinct()
    on = col(id_column) == F.col("__dup")
    if mode == "filter":
        return df.join(ids, on, "left_anti")
    if mode == "keep":
        return df.join(ids, on, "left_semi")
    return df.join(ids, on, "left").withColumn(into, F.when(F.col("__dup").isNotNull(), "d").otherwise("")).drop("__dup")


def bitmap_signature(sigs: DataFrame, bits: int = 4096, seed: int = 9173) -> DataFrame:
    """Each MinHash sets one of `bits` bits (its place is hashed with it); packed into bytes."""

    def run(batches):
        for b in batches:
            k = len(b.column(1)[0]) if b.num_rows else 1
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k).astype(np.uint64)
            h = (m ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            at = ((h ^ (h >> np.uint64(33))) % np.uint64(bits)).astype(np.int64)
            out = np.zeros((b.num_rows, bits), np.uint8)
            np.put_along_axis(out, at, 1, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.packbits(out, axis=1)], pa.binary())], names=["id", "bitmap"])

    return sigs.select("id", "minhashes").mapInArrow(run, "id long, bitmap binary")


def packed_signature(sigs: DataFrame) -> DataFrame:
    """MinHashes as big-endian 32-bit numbers, end to end."""
    return sigs.select("id", F.unhex(F.array_join(F.transform("minhashes", lambda m: F.lpad(F.hex(m), 8, "0")), "")).alias("packed"))


#: Classes of a bucket of the search that one task compares with each other; more are taken in blocks of so many.
BUCKET = 5_000


def signature_key() -> Column:
    """128 bits that stand for a signature."""
    return F.concat_ws(":", F.xxhash64("minhashes"), F.xxhash64(F.lit(1), "minhashes"))


def band_keys(bands: int, rows: int) -> Column:
    """A 64-bit hash for each band, where nothing but its equality matters (band_hashes() has one that SQL can follow)."""
    return F.array(*[F.xxhash64(F.slice("minhashes", b * rows + 1, rows)) for b in range(bands)])


def crowded(one: DataFrame, bands: int, rows: int) -> DataFrame:
    """band, band_hash, id, minhashes of the rows that share a bucket with another's. Buckets are counted without signatures,
    which are as long as all other columns by far and of which most meet none."""
    keyed = one.select(signature_key().alias("key"), "id", "minhashes")
    banded = keyed.select("key", F.posexplode(band_keys(bands, rows)).alias("band", "band_hash"))
    shared = banded.groupBy("band", "band_hash").agg(F.count("*").alias("n")).where("n > 1").select("band", "band_hash")
    return stored(banded.join(shared, ["band", "band_hash"], "left_semi").join(keyed, "key").drop("key"), "crowded")


def near_duplicates(queries: DataFrame, index: DataFrame, k: int = 4, bands: int = SEARCH_BANDS, rows: int = SEARCH_ROWS, max_distance: float = 0.3, block: int | None = None) -> DataFrame:
    """query_id, neighbor_id, distance, rank: the k nearest by signature among those that share a band, within max_distance.

    Signatures are searched once however many documents share them: queries and index meet as classes. Buckets are counted without
    signatures, and only rows that share one get theirs. A bucket gives each class its k + 1 nearest by distance and least id (a
    document of any further class has k nearer ones besides the query), so what is shuffled grows with the rows and not with the
    pairs. Of a bucket of more than `block` classes a task compares two blocks."""
    asked, held = (d.select("id", "minhashes", signature_key().alias("key")) for d in (queries, index))
    none = F.lit(None).cast("long")
    if queries is index:
        sides = index.select("minhashes", F.col("id").alias("q"), F.col("id").alias("i"))
    else:
        sides = queries.select("minhashes", F.col("id").alias("q"), none.alias("i")).union(index.select("minhashes", none, "id"))
    one = sides.groupBy("minhashes").agg(F.min("q").alias("q"), F.count("q").alias("qs"), F.min("i").alias("least"), F.count("i").alias("n"))
    several = (F.col("qs") > 1) | (F.col("n") > 1) | (F.col("q") != F.col("least"))
    one = stored(one.select(signature_key().alias("key"), "minhashes", (F.col("qs") > 0).alias("asked"), "least", several.alias("several")), "classes")
    banded = one.select("key", "asked", "least", F.posexplode(band_keys(bands, rows)).alias("band", "band_hash"))
    sizes = banded.groupBy("band", "band_hash").agg(F.count("*").alias("n"), F.max("asked").alias("any"), F.count("least").alias("held"))
    shared = sizes.where("n > 1 AND any AND held > 0").select("band", "band_hash", F.ceil(F.col("n") / (block or BUCKET)).cast("int").alias("blocks"))
    met = banded.select("key", "band", "band_hash").join(shared, ["band", "band_hash"]).join(one.drop("several"), "key")
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = _near_in_buckets(met.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")), k + 1, max_distance)
    same = one.where("asked AND least IS NOT NULL AND several").select(F.col("key").alias("qk"), F.col("key").alias("ik"), F.lit(0.0).alias("distance"))
    pairs = stored(near.distinct().union(same), "pairs")
    order = F.row_number().over(Window.partitionBy("ik").orderBy("neighbor_id"))  # limited before the shuffle
    members = held.select(F.col("key").alias("ik"), F.col("id").alias("neighbor_id")).join(pairs.select("ik").distinct(), "ik", "left_semi")
    members = members.withColumn("place", order).where(F.col("place") <= k + 1).drop("place")
    best = pairs.join(members, "ik").withColumn("place", F.row_number().over(Window.partitionBy("qk").orderBy("distance", "neighbor_id"))).where(F.col("place") <= k + 1)
    near = asked.select(F.col("id").alias("query_id"), F.col("key").alias("qk")).join(best, "qk").where("query_id <> neighbor_id").select("query_id", "neighbor_id", "distance")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k)


def _near_in_buckets(met: DataFrame, k: int, max_distance: float) -> DataFrame:
    """qk, ik, distance: for each asked class of a bucket, or of two blocks of one, the k nearest other classes that are held."""
    group = ["band", "band_hash", "first", "second"]
    parts = met.select(*group, "own", "key", "asked", F.col("least").isNotNull(), F.coalesce("least", F.lit(0)), "minhashes")
    parts = parts.repartition(*group).sortWithinPartitions(*group)

    def found(own, keys, asked, held, least, matrix, whole):
        places = np.flatnonzero(held)
        for q in np.flatnonzero(asked):
            others = places[places != q] if whole else places[own[places] != own[q]]
            distance = 1 - (matrix[others] == matrix[q]).sum(1) / matrix.shape[1]
            hit = np.flatnonzero(distance <= max_distance + 1e-9)
            for j in hit[np.lexsort((least[others[hit]], distance[hit]))[:k]]:
                yield keys[q], keys[others[j]], float(distance[j])

    def flushed(bucket, pieces):
        columns = [np.concatenate(x) for x in zip(*pieces, strict=True)]
        pairs = list(found(*columns, bucket[2] == bucket[3])) if len(columns[0]) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["qk", "ik", "distance"])

    def run(batches):
        bucket, pieces = None, []
        for b in batches:
            if not b.num_rows:
                continue
            places = np.stack([c.to_numpy() for c in b.columns[:4]], 1)
            matrix = b.column(9).flatten().to_numpy().astype(np.uint32).reshape(b.num_rows, -1)
            columns = [*(c.to_numpy(zero_copy_only=False) for c in b.columns[4:9]), matrix]
            edges = np.r_[0, np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1, b.num_rows].tolist()
            out = []
            for at, to in zip(edges, edges[1:], strict=False):
                here = tuple(places[at].tolist())
                if here != bucket and pieces:
                    out.append(flushed(bucket, pieces))
                    pieces = []
                bucket = here
                pieces.append([c[at:to] for c in columns])
            yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else ()
        if pieces:
            yield flushed(bucket, pieces)

    return parts.mapInArrow(run, "qk string, ik string, distance double")


def nearest(queries: DataFrame, index: DataFrame, k: int = 4, max_distance: float = 0.3, permutations: int = PERMUTATIONS) -> DataFrame:
    """near_duplicates() that misses none: signatures within max_distance differ in so few places that, of one band more than
    these, one must be equal. So all pairs are judged without meeting each other."""
    bands = int(max_distance * permutations + 1e-6) + 1
    if bands > permutations:
        raise ValueError("max_distance must be below 1")
    return near_duplicates(queries, index, k, bands, permutations // bands, max_distance)


def met_pairs(queries: DataFrame, index: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """a, b, jaccard: the documents of the index that share a band with a query's, and how alike the signatures are. Classes of equal
    signatures meet, by band without their signatures; the result alone has a row for each pair of members."""
    key = F.md5(F.array_join(F.col("minhashes").cast("array<string>"), ",").cast("binary"))
    asked, held = (d.select("id", "minhashes", key.alias("key")) for d in (queries, index))
    qc, ic = (d.groupBy("key").agg(F.first("minhashes").alias("minhashes")) for d in (asked, held))
    q, i = (band_hashes(d, bands, rows).select("band", "band_hash", F.col("key").alias(n)) for d, n in ((qc, "qk"), (ic, "ik")))
    pairs = q.join(i, ["band", "band_hash"]).select("qk", "ik").distinct()
    pairs = pairs.join(qc.select(F.col("key").alias("qk"), F.col("minhashes").alias("qm")), "qk").join(ic.select(F.col("key").alias("ik"), F.col("minhashes").alias("im")), "ik")
    pairs = pairs.select("qk", "ik", signature_jaccard(F.col("qm"), F.col("im")).alias("jaccard"))
    return pairs.join(asked.select(F.col("key").alias("qk"), F.col("id").alias("a")), "qk").join(held.select(F.col("key").alias("ik"), F.col("id").alias("b")), "ik").select("a", "b", "jaccard")


def optimal_bands(threshold: float = THRESHOLD, k: int = PERMUTATIONS, false_positive: float = 0.5, false_negative: float = 0.5) -> tuple[int, int]:
    """(bands, rows) of at most k hashes with the least weighted area of errors around the threshold."""

    def area(f, lo, hi, n=200):
        step = (hi - lo) / n
        return sum(f(lo + (i + 0.5) * step) for i in range(n)) * step

    best = (math.inf, 1, 1)
    for b in range(1, k + 1):
        for r in range(1, k // b + 1):
            hit = lambda s, b=b, r=r: 1 - (1 - s**r) ** b
            best = min(best, (false_positive * area(hit, 0, threshold) + false_negative * area(lambda s, hit=hit: 1 - hit(s), threshold, 1), b, r))
    return best[1], best[2]


def _pseudo_random(id_column: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), col(id_column)).cast("binary"))


def split_queries(df: DataFrame, n: int, id_column: str = "doc_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(n queries, corpus without them) by a seeded pseudo-random order."""
    queries = df.orderBy(_pseudo_random(id_column, seed), id_column).limit(n)
    return queries, df.join(queries.select(id_column), id_column, "left_anti")


def shuffled(df: DataFrame, id_column: str = "doc_id", seed: int = 42) -> DataFrame:
    """Rows in a seeded pseudo-random order."""
    return df.orderBy(_pseudo_random(id_column, seed), id_column)


def upsert(store: DataFrame, fresh: DataFrame, on: str = "id", order_by: str | None = None) -> DataFrame:
    """The store's rows, and for ids that `fresh` has too, its rows; of several the last one by order_by, else by all columns."""
    order = F.struct(*([order_by] if order_by else []), *fresh.columns)
    last = fresh.groupBy(F.col(on).alias("__on")).agg(F.max_by(F.struct(*fresh.columns), order).alias("__row")).select("__row.*")
    return store.join(fresh.select(on).distinct(), on, "left_anti").unionByName(last)


def kept_ids(sigs: DataFrame, **options) -> DataFrame:
    """The ids that fuzzy de-duplication keeps: a manifest to filter other tables of the same documents with."""
    return sigs.select("id").join(fuzzy_removed(sigs, **options), "id", "left_anti")


def manifest_of(spark, k: int = PERMUTATIONS, bits: int = 4096, seed: int = 42) -> DataFrame:
    """What signatures depend on; signatures of different manifests must not be compared."""
    return spark.createDataFrame([(k, bits, seed, [int(x) - (1 << 64) if int(x) >= 1 << 63 else int(x) for x in permutations(k, seed)])], "k int, bits int, seed long, multipliers array<long>")


def check_manifest(a: DataFrame, b: DataFrame) -> None:
    if a.first() != b.first():
        raise ValueError("signatures of different manifests can't be compared")
