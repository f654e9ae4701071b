"""N-gram Jaccard join over prefix trees.

Documents become sets of hashed word n-grams, sorted by one global order: rare n-grams first, by hash, then the common ones
(a Bloom filter of bounded size tells them; any filter gives the same links). Three steps narrow down who may link:

1. Two sets that link share at least m n-grams among the first n - ceil(threshold * n) + m of each. With m = 1 + n // SHARE (and
   two n-grams more for sets whose m differ), a document that has fewer than m of them in company links with none.
2. What is left is cut in hash parts, more of them than two sets that link can differ by: some part must be equal in both. Sizes
   are cut in classes so wide that a link never crosses more than one border, and each two neighbouring classes have their
   own number of parts. All documents of a part are joined to the least one, which gives clusters; every link lies within one.
   Sharing passages doesn't make parts equal, so clusters hold near copies and little else.
3. A task stores the sets of a cluster in a trie in the global order and walks it with one vector of overlaps with all of the
   task's sets: sets that begin alike share the overlaps of what they share, and a subtree is left when no other set can reach
   the wanted overlap with what remains. Only links that join something leave the task.

Large clusters are dealt by size class and hash to blocks of bounded bytes, which are walked first. Most of a large cluster
is then one component; only the documents outside of it go on to the other blocks of their own and the neighbouring size
classes, since two documents of the same component need no further link. So near copies are never compared block by block.

Equal sets are one class from the start (its least id stands for it). Whatever is grouped by an n-gram or part is counted, or
its least id taken, before the shuffle, or dealt by a salt, so that one that all documents hold needs no task of its own. No pair
of candidates is ever a row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, U, dropped, mix, small_enough, stored, text_buffer, word_hashes
from .components import components

#: Bytes kept of each n-gram hash when sets travel to be verified. Short hashes can only add matches, so no link is lost;
#: links that a few matches fewer (`margin`) would undo are verified again with all 8 bytes.
KEPT = 4
#: See step 1.
SHARE = 32
#: Ids that may be broadcast, 8 bytes each; more are joined by shuffling.
MOST_IDS = 2_000_000


def margin(a, b, kept: int):
    """More chance matches between two sets of these sizes than ever occur: mean of a Poisson law plus ten deviations and three."""
    mean = np.asarray(a, float) * b / 2.0 ** (8 * kept)
    return 3 + mean + 10 * np.sqrt(mean)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of one text; of fewer words, one hash of them all; of none, none."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k), U)
    for i in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def _sets(column: pa.Array, n: int):
    data, offsets = text_buffer(column)
    h, first = word_hashes(data, offsets)
    for k in range(len(first) - 1):
        yield grams(h[first[k] : first[k + 1]], n)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = int(np.bitwise_xor.reduce(mix(s + U(0x51ED270B)), initial=U(0)))
    with np.errstate(over="ignore"):
        b = int(np.add.reduce(mix(s ^ U(0xA24BAED4963EE407)), dtype=U))
    return a - (1 << 63), b - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def share_of(percent: int) -> int:
    return SHARE if percent >= 10 else 1 << 40


def ordered(s: np.ndarray, common: Bloom) -> np.ndarray:
    """A set (sorted by hash) in the global order."""
    late = common.holds(s)
    return np.concatenate([s[~late], s[late]]) if late.any() else s


#: n-grams that a task counts before it sends them on.
MOST_HELD = 2_000_000


def _counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several batches added up."""
    if len(held) == 1:
        return held[0]
    u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)


def common_grams(docs: DataFrame, n: int, percent: int, text: str, common: int, most_words: int, heavy: int, most_heavy: int) -> tuple[Bloom, np.ndarray]:
    """The filter of n-grams that over `common` prefixes (by hash alone) hold, and a sorted list of the most frequent ones.

    If the filter can't hold all, only those with higher counts enter. The list has those in over `heavy` prefixes, the
    most_heavy most frequent at most, so no n-gram outside of it has more than one in most_heavy of all rows."""

    told = lambda own: pa.RecordBatch.from_arrays([pa.array(own[0].view(np.int64)), pa.array(own[1].astype(np.int64))], names=["gram", "n"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[tuple] = set()  # copies within a task count once, however its rows come in batches
        for b in batches:
            parts, seen = [], seen if len(seen) < MOST_HELD else set()
            for s in _sets(b.column(0), n):
                if len(s) and (key := signature(s)) not in seen:
                    seen.add(key)
                    parts.append(s[: prefix_length(len(s), percent)])
            if parts:
                held.append(np.unique(np.concatenate(parts), return_counts=True))
            if sum(len(u) for u, _ in held) > MOST_HELD:
                held = [_counted(held)]
                if len(held[0][0]) > MOST_HELD // 2:
                    yield told(held.pop())
        if held:
            yield told(_counted(held))

    counted = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > common)
    counted = stored(counted, "common-grams")
    bins = counted.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("bin")).agg(F.min("n").alias("least"), F.count("*").alias("rows")).collect()
    rows, least = 0, None  # from the most frequent on, while the filter has room
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if rows and rows + r["rows"] > most_words * 8:
            break
        rows, least = rows + r["rows"], r["least"]
    order = Bloom.of(counted.where(F.col("n") >= F.lit(least)).select("gram"), rows, most_words)
    top = counted.where(F.col("n") > heavy).orderBy(F.desc("n"), "gram").limit(most_heavy).select("gram").toArrow()
    dropped(counted)
    return order, np.sort(top.column(0).to_numpy().view(U))


def profile(docs: DataFrame, shared, n: int, percent: int, id_column: str, text: str, salts: int = 64) -> DataFrame:
    """id, n_shingles, the set's signature (sig_a, sig_b), and prefix: n-gram hashes, each with a salt (0 but for heavy ones)."""

    def run(batches):
        order, heavy = shared.value
        for b in batches:
            rows, prefix, salt = [], [], []
            for s in _sets(b.column(1), n):
                sig = signature(s)
                rows.append((len(s), *sig))
                own = ordered(s, order)[: prefix_length(len(s), percent) + len(s) // share_of(percent) + 2]
                prefix.append(own)
                at = np.minimum(np.searchsorted(heavy, own), max(len(heavy) - 1, 0))
                salt.append((heavy[at] == own).astype(np.int32) * (1 + sig[0] % salts) if len(heavy) else np.zeros(len(own), np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            at = pa.array(np.cumsum([0, *map(len, prefix)]).astype(np.int32))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*prefix, np.zeros(0, U)]).view(np.int64)), pa.array(np.concatenate([*salt, np.zeros(0, np.int32)]).astype(np.int32))], names=["gram", "salt"])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.ListArray.from_arrays(at, flat)], names=["id", "n_shingles", "sig_a", "sig_b", "prefix"])

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string"))
    return source.mapInArrow(run, "id long, n_shingles long, sig_a long, sig_b long, prefix array<struct<gram:long,salt:int>>")


class Trie:
    """Sets in the global order; a node holds a run of n-grams, its children by their first one, and the sets that end there."""

    __slots__ = ("run", "children", "ends", "longest")

    def __init__(self, run):
        self.run, self.children, self.ends, self.longest = run, {}, [], 0

    def add(self, s: np.ndarray, name: int) -> None:
        node, at = self, 0
        node.longest = max(node.longest, len(s))
        while at < len(s):
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = Trie(s[at:])
                leaf.ends.append((name, len(s)))
                leaf.longest = len(s)
                node.children[int(s[at])] = leaf
                return
            rest = s[at : at + len(child.run)]
            same = rest == child.run[: len(rest)]
            k = len(rest) if same.all() else int(np.argmin(same))
            if k < len(child.run):  # split the run
                upper = Trie(child.run[:k])
                upper.longest = child.longest
                child.run = child.run[k:]
                upper.children[int(child.run[0])] = child
                node.children[int(s[at])] = upper
                child = upper
            child.longest = max(child.longest, len(s))
            node, at = child, at + k
        node.ends.append((name, len(s)))


def trie_of(sets: list[np.ndarray]) -> Trie:
    trie = Trie(np.zeros(0, U))
    for i, s in enumerate(sets):
        trie.add(s, i)
    return trie


def links_of(sets: list[np.ndarray], percent: int, stretch: int = 96, kept: int = 8):
    """For each non-empty set (place, places of the sets it links with, whether `margin` matches fewer would still do)."""
    size = np.array([len(s) for s in sets], np.int64)
    kind = sets[0].dtype if sets else U
    flat = np.concatenate([*sets, np.zeros(0, kind)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    del order

    def with_run(overlap: np.ndarray, run: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(flat, run, side="left"), np.searchsorted(flat, run, side="right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return overlap + np.bincount(owner[at], minlength=len(sets))

    def alive(overlap: np.ndarray, depth: int, longest: int) -> int:
        """How many sets could link with one of at most `longest` below, itself included."""
        best = np.minimum(longest, depth + size - overlap)  # its size, were all that remains to match
        return int(np.count_nonzero((100 + percent) * (overlap + best - depth) >= percent * (size + best)))

    stack = [(trie_of(sets), 0, np.zeros(len(sets), np.int64))]
    while stack:
        node, depth, overlap = stack.pop()
        for at in range(0, len(node.run), stretch):
            part = node.run[at : at + stretch]
            overlap, depth = with_run(overlap, part), depth + len(part)
            if alive(overlap, depth, node.longest) < 2:
                break
        else:
            if node.ends:
                n = node.ends[0][1]
                near = np.flatnonzero((100 + percent) * overlap >= percent * (n + size)) if n else np.zeros(0, np.int64)
                for i, _ in node.ends:
                    own = near[near != i]
                    if len(own):
                        yield i, own, (100 + percent) * (overlap[own] - margin(n, size[own], kept)) >= percent * (n + size[own])
            stack.extend((c, depth, overlap) for c in node.children.values())


def sets_of(docs: DataFrame, wanted: DataFrame, shared, n: int, id_column: str, text: str, kept: int) -> DataFrame:
    """id and grams (`kept` bytes of each hash, in the global order) of the texts whose ids are in `wanted` (stored, distinct).

    A Bloom filter of bounded size passes over the ids first, so that only wanted texts (and a few more) are hashed and moved."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted.select(F.xxhash64("id")), wanted.count()))

    def run(batches):
        (order, _), seen = shared.value, bloom.value
        for b in batches:
            own = b.filter(pa.array(seen.holds(b.column(2).to_numpy(zero_copy_only=False).view(U))))
            out = [ordered(s, order).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :kept].tobytes() for s in _sets(own.column(1), n)]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(out, pa.large_binary()).cast(pa.binary())], names=["id", "grams"])

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string")).where("id is not null")
    return source.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id long, grams binary")


def _width(percent: int) -> float:
    return -math.log(min(percent, 99.999) / 100) * (1 + 1e-9)


def class_of(size: int, percent: int) -> int:
    return math.floor(math.log(size) / _width(percent)) if size else 0


def size_limit(base: int, percent: int) -> float:
    """What all sizes of a class are below."""
    return math.exp((base + 1) * _width(percent)) * (1 + 1e-9)


def size_class(size: Column, percent: int) -> Column:
    """Classes of sizes: if percent * larger <= 100 * smaller, the two are at most one class apart."""
    return F.floor(F.log(size.cast("double")) / _width(percent)).cast("int")


def walk(sets: DataFrame, percent: int, kept: int) -> DataFrame:
    """small, large, safe from rows unit, id, grams (a task holds one unit's sets at a time): links that join what no link
    before joined; of those that aren't safe, a forest that connects what the safe ones leave apart."""
    dealt = sets.select("unit", "id", "grams").repartition("unit").sortWithinPartitions("unit", "id")

    def joined(label: np.ndarray, i: int, near: np.ndarray) -> list[int]:
        """Of `near`, one place for each label other than i's, all of which become i's."""
        labels, first = np.unique(label[near], return_index=True)
        fresh = labels != label[i]
        if not fresh.any():
            return []
        label[np.isin(label, labels)] = label[i]
        return near[first[fresh]].tolist()

    def run(batches):
        key, ids, raw = None, [], []

        def found():
            out, label, unsure = [], np.arange(len(ids)), []
            if len(ids) > 1:
                wide = [np.frombuffer(g, f">u{kept}").astype(f"u{kept}") for g in raw]
                forest = np.arange(len(ids))
                for i, near, safe in links_of(wide, percent, kept=kept):
                    out += [(ids[i], ids[j], True) for j in joined(label, i, near[safe])]
                    unsure += [(i, j) for j in joined(forest, i, near[~safe])]
                # A part of the unsure graph that crosses safe parts goes whole: any of its pairs may be a link.
                across = {forest[i] for i, j in unsure if label[i] != label[j]}
                out += [(ids[i], ids[j], False) for i, j in unsure if forest[i] in across]
            rows = [(min(a, b), max(a, b), safe) for a, b, safe in out if a != b]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["small", "large", "safe"])

        for b in batches:
            for c, i, g in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != key:
                    if len(ids) > 1:
                        yield found()
                    key, ids, raw = c, [], []
                ids.append(i)
                raw.append(g)
        yield found()

    return dealt.mapInArrow(run, "small long, large long, safe boolean")


def parts(s: np.ndarray, percent: int, base: int, limit: float, order: Bloom) -> np.ndarray:
    """Keys of the parts of a set in the join of size classes `base` and base + 1, whose smaller set is below `limit`.

    Two sets that link differ by at most `apart`, so of apart + 1 + spare parts, spare + 1 are equal. A set with no more than
    `spare` parts of fewer than two n-grams thus needs the others only; where both have more, they meet at an n-gram of
    their prefixes."""
    apart = int((100 - percent) / percent * limit + 1e-6)
    if not apart:
        return s[:0]  # only equal sets link
    spare = apart // 5
    k = apart + 1 + spare
    where = ((mix(s ^ U(0x94D049BB133111EB)) >> U(32)) * U(k) >> U(32)).astype(np.int64)
    rank = np.argsort(where, kind="stable")
    where = where[rank]
    first = np.flatnonzero(np.diff(where, prepend=-1))
    n = np.diff(first, append=len(s))
    content = np.add.reduceat(mix(s[rank]), first)
    full = n > 1
    keys = mix(content[full] + mix(where[first[full]].astype(U) + U(base + 1 << 32)))
    if k - np.count_nonzero(full) > spare:
        keys = np.concatenate([keys, mix(ordered(s, order)[: prefix_length(len(s), percent)] ^ mix(np.array([base + 1 << 40], U)))])
    return keys


def clusters(docs: DataFrame, wanted: DataFrame, shared, n: int, percent: int, id_column: str, text: str) -> DataFrame:
    """id, cluster (stored) of the ids of `wanted` (stored) that share a part with another."""
    bloom = docs.sparkSession.sparkContext.broadcast(Bloom.of(wanted.select(F.xxhash64("id")), wanted.count()))

    def run(batches):
        (order, _), seen = shared.value, bloom.value
        for b in batches:
            own = b.filter(pa.array(seen.holds(b.column(2).to_numpy(zero_copy_only=False).view(U))))
            keys = []
            for s in _sets(own.column(1), n):
                c = class_of(len(s), percent)
                keys.append(np.concatenate([parts(s, percent, k, size_limit(k, percent), order) for k in (c - 1, c)]) if len(s) else s)
            ids = np.repeat(own.column(0).to_numpy(zero_copy_only=False), [len(k) for k in keys])
            flat = np.concatenate([*keys, np.zeros(0, U)]).view(np.int64)
            for lo in range(0, len(flat), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(flat[lo : lo + (1 << 16)]), pa.array(ids[lo : lo + (1 << 16)])], names=["key", "id"])

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string")).where("id is not null")
    keys = source.withColumn("h", F.xxhash64("id")).mapInArrow(run, "key long, id long")
    hint = F.broadcast if small_enough(wanted, MOST_IDS) else lambda d: d
    keys = stored(keys.join(hint(wanted.select("id").distinct()), "id", "left_semi"), "parts")
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("key", "least")
    edges = keys.join(least, "key").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    out = stored(components(edges).select("id", F.col("component").alias("cluster")), "clusters")
    dropped(keys)
    return out


def _blocks(named: DataFrame, block: int, most_grams: int) -> DataFrame:
    """cluster, class, blocks for the clusters that one task can't hold, from rows cluster, class, size."""
    by_class = named.groupBy("cluster", "class").agg(F.count("*").alias("n"), F.sum("size").alias("grams"))
    large = by_class.groupBy("cluster").agg(F.sum("n").alias("all"), F.sum("grams").alias("all_grams")).where((F.col("all") > block) | (F.col("all_grams") > most_grams))
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("grams") / most_grams)).cast("int")
    return by_class.join(large.select("cluster"), "cluster", "left_semi").select("cluster", "class", blocks.alias("blocks"))


def _links(docs: DataFrame, named: DataFrame, shared, n: int, percent: int, id_column: str, text: str, block: int, most_grams: int, kept: int) -> DataFrame:
    """small, large, safe: enough links within the clusters of `named` (stored; id, cluster, class, size) to tell the components."""
    one = lambda *parts: F.xxhash64(*parts)
    large = stored(_blocks(named, block, most_grams), "blocks")
    dealt = named.join(large, ["cluster", "class"], "left").withColumn("own", F.pmod(F.hash("id"), F.coalesce("blocks", F.lit(1))))
    dealt = dealt.withColumn("unit", F.when(F.col("blocks").isNull(), one("cluster")).otherwise(one("cluster", "class", "own", F.lit(0))))
    sets = sets_of(docs, named, shared, n, id_column, text, kept)
    found = stored(walk(sets.join(dealt.select("id", "unit").distinct(), "id"), percent, kept), "found")
    if large.isEmpty():
        return found
    # What the blocks of a large cluster joined: all outside of its largest part visit the blocks of classes near their own.
    within = named.join(large.select("cluster").distinct(), "cluster", "left_semi").join(large, ["cluster", "class"]).withColumn("own", F.pmod(F.hash("id"), F.col("blocks")))
    so_far = components(found.where("safe"), "small", "large")
    within = stored(within.join(so_far, "id", "left").withColumn("component", F.coalesce("component", "id")), "blocked")
    parts = within.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("cluster").agg(F.max(F.struct("n", (-F.col("component")).alias("least"))).alias("top")).select("cluster", (-F.col("top.least")).alias("component"))
    outside = within.join(main, ["cluster", "component"], "left_anti").select("cluster", "id", "size", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    outside = stored(outside.join(large, ["cluster", "class"]), "visitors")
    if outside.isEmpty():
        return found
    visits = outside.groupBy("cluster", "class").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / most_grams)).cast("int").alias("groups"))
    groups = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    guest = outside.join(visits, ["cluster", "class"]).withColumn("group", F.pmod(F.hash("id", F.lit(7)), F.col("groups"))).select("id", "cluster", "class", "group", groups("blocks").alias("own"))
    home = within.join(visits, ["cluster", "class"]).select("id", "cluster", "class", "own", groups("groups").alias("group"))
    units = guest.select("id", "cluster", "class", "own", "group").union(home.select("id", "cluster", "class", "own", "group")).select("id", one("cluster", "class", "own", F.col("group") + 1).alias("unit")).distinct()
    again = sets_of(docs, stored(within.select("id").distinct(), "blocked-ids"), shared, n, id_column, text, kept)
    return found.union(stored(walk(again.join(units, "id"), percent, kept), "visits"))


def join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, common: int = 4, block: int = 1000, most_grams: int = 1 << 20, heavy: int = 256, most_heavy: int = 1 << 16, most_words: int = 1 << 22) -> DataFrame:
    """One row per document: id_column, n_shingles, component_id.

    component_id is the least id reachable by links (100 * intersection >= percent * union). Texts without words have no n-grams and
    link with nothing; null ids are dropped from links and keep themselves (null); rows that repeat an id are one document, which
    has the links of all its texts; an empty table gives an empty result.

    A task holds the sets of at most `block` documents and about most_grams n-grams (twice as many where blocks are visited), or of
    two documents if these are longer. common, heavy, most_heavy, most_words: see common_grams()."""
    spark = docs.sparkSession
    docs = docs.select(id_column, text)
    order = spark.sparkContext.broadcast(common_grams(docs, n, percent, text, common, most_words, heavy, most_heavy))
    own = stored(profile(docs, order, n, percent, id_column, text), "profiles")
    live = own.where("n_shingles > 0 and id is not null")
    copies = stored(live.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "classes")
    # Rows other than the first of their class; a class's least id may be repeated, too.
    several = copies.where("rows > 1").select("sig_a", "sig_b", "rep")
    hint = F.broadcast if small_enough(several, MOST_IDS) else lambda d: d
    marked = live.join(hint(several), ["sig_a", "sig_b"], "left")
    single = marked.where("rep is null").select("id", "n_shingles", "prefix")
    first = marked.where("rep = id").dropDuplicates(["sig_a", "sig_b", "id"]).select("id", "n_shingles", "prefix")
    groups = single.union(first).select("id", "n_shingles", F.inline("prefix"))
    enough = stored(_shared(groups, percent).groupBy("id").agg(F.count("*").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("id"), "in-company")
    cluster = clusters(docs, enough, order, n, percent, id_column, text)
    sizes = live.select("id", F.col("n_shingles").alias("size")).distinct().withColumn("class", size_class(F.col("size"), percent))
    named = stored(cluster.join(sizes, "id"), "named")
    dropped(enough, cluster)
    options = (order, n, percent, id_column, text, block, most_grams)
    found = _links(docs, named, *options, KEPT)
    sure, close = found.where("safe").select("small", "large"), found.where(~F.col("safe")).select("small", "large")
    if not close.isEmpty():
        again = components(close, "small", "large").select("id", F.col("component").alias("cluster"))
        sure = sure.union(_links(docs, stored(again.join(sizes, "id"), "close"), *options, 8).select("small", "large"))
    whole = own.drop("prefix").join(copies.drop("rows"), ["sig_a", "sig_b"], "left")
    again = stored(own.where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    repeated = not again.isEmpty()
    if repeated:
        sure = sure.union(whole.where("rep is not null").join(again, "id", "left_semi").select(F.least("id", "rep"), F.greatest("id", "rep")))
    so_far = components(sure, "small", "large")
    whole = whole.join(so_far.select(F.col("id").alias("rep"), "component"), "rep", "left")
    label = F.coalesce("component", "rep", "id")
    if repeated:  # a repeated id's rows without words have the label of its others
        whole = whole.join(so_far.select("id", F.col("component").alias("by_id")), "id", "left")
        label = F.coalesce("component", "by_id", "rep", "id")
    return whole.select(F.col("id").alias(id_column), "n_shingles", label.alias("component_id"))


def _shared(groups: DataFrame, percent: int) -> DataFrame:
    """id, least for each n-gram that another document has, too; least: how many of them a document needs.

    Single rows fall out of each task's sorted rows. The documents of heavy n-grams, which all have company, are dealt by their
    salt, too."""
    dealt = groups.select("gram", "salt", "id", (1 + F.floor(F.col("n_shingles") / share_of(percent))).cast("int").alias("least"))
    dealt = dealt.repartition("gram", "salt").sortWithinPartitions("gram")

    def run(batches):
        last, spare = None, None  # the gram before, and its row while it stands alone
        for b in batches:
            if not b.num_rows:
                continue
            g, heavy = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False) > 0
            same = g[1:] == g[:-1]
            keep = heavy.copy()
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and g[0] == last:
                keep[0] = True
                if spare is not None:
                    yield spare
            alone = not keep[-1]
            b = b.select(["id", "least"])
            spare, last = (b.slice(len(g) - 1, 1) if alone else None), g[-1]
            yield b.filter(pa.array(keep))

    return dealt.mapInArrow(run, "id long, least int")
