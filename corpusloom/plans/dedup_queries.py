"""Exact, fuzzy and online de-duplication, repetition, and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import shingles
from ..operators import dedup, phrases, repetition, suffixes, vectors
from ..sources import tables
from ..sources.shared import fresh_dir, stored
from ..streaming import online
from .registry import query
from .sql import KEY, words

_FIRST = f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) = 1"


@query(_FIRST)
def exact_dedup(t):
    return dedup.exact_dedup(t("documents")).select("doc_id", "lang", "source")


@query(f"WITH k AS (SELECT doc_id, {KEY} AS k FROM documents), g AS (SELECT min(doc_id) AS doc_id, list(doc_id ORDER BY doc_id) AS l FROM k GROUP BY k) SELECT doc_id, array_to_string(l[2:], ',') AS removed FROM g")
def exact_dedup_removed(t):
    return dedup.exact_dedup(t("documents").select("doc_id", "text"), removed=True).select("doc_id", F.array_join("removed", ",").alias("removed"))


@query(f"SELECT count(*) AS docs_in, count(DISTINCT {KEY}) AS docs_out, round(100 * (1 - count(DISTINCT {KEY}) / count(*)), 6) AS removed_percent FROM documents")
def exact_dedup_rate(t):
    return dedup.exact_dedup_rate(t("documents"))


@query(_FIRST)
def exact_dedup_incremental(t):
    docs = t("documents")
    path = fresh_dir(docs.sparkSession, "exact-store")
    online.add_in_batches(docs, online.ExactStore(path), 4)
    return docs.sparkSession.read.parquet(f"{path}/kept").select("doc_id", "lang", "source")


_SHINGLES = f"(SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT doc_id, {words()} AS w FROM documents))"


@query(f"SELECT doc_id, count(*) AS n, min(s) AS first FROM {_SHINGLES} GROUP BY doc_id")
def word_shingles(t):
    """Shingles are counted where their text lies: only numbers and least shingles are shuffled, for ids that repeat."""
    each = t("documents").where("text IS NOT NULL").select("doc_id", shingles("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.array_min("s").alias("first"))
    return each.groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


_K = dedup.PERMUTATIONS
_MINS = ", ".join(f"min({dedup.sql_minhash('h', hi, lo)})::BIGINT AS m{i}" for i, (hi, lo) in enumerate(dedup.limb_multipliers(_K)))
_SIGS = f"(SELECT id, [{', '.join(f'm{i}' for i in range(_K))}] AS m, n FROM (SELECT doc_id AS id, any_value(n) AS n, {_MINS} FROM (SELECT doc_id, n, ('0x' || substr(md5(s), 1, 8))::BIGINT AS h FROM (SELECT s.*, length(text)::BIGINT AS n FROM {_SHINGLES} s JOIN documents USING (doc_id))) GROUP BY doc_id))"


def _bands(table: str, bands: int, rows: int) -> str:
    return f"(SELECT *, ('0x' || substr(md5(array_to_string(m[b * {rows} + 1:b * {rows} + {rows}], ',')), 1, 15))::BIGINT AS band_hash FROM (SELECT *, b::INTEGER AS band FROM {table}, range({bands}) r(b)))"


_BANDS = _bands(_SIGS, dedup.BANDS, dedup.ROWS)
_SAME = f"len(list_filter(range(1, {_K + 1}), lambda i: {{}}[i] = {{}}[i])) / {_K}.0"
_NUMBERS = "array_to_string({}, ',')"
#: Greedy pivots: in each bucket, by id, a document goes to the first pivot it is similar to, else it becomes one.
_GREEDY = f"""WITH RECURSIVE sg AS MATERIALIZED (SELECT * FROM {_SIGS}), one AS MATERIALIZED (SELECT m, min(id) AS id FROM sg GROUP BY m),
bk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY band, band_hash ORDER BY id) AS i, count(*) OVER (PARTITION BY band, band_hash) AS k FROM {_bands('one', dedup.BANDS, dedup.ROWS)}),
go AS (SELECT band, band_hash, i, [struct_pack(id := id, m := m)] AS piv, NULL::BIGINT AS first_doc, NULL::BIGINT AS removed, NULL::DOUBLE AS similarity FROM bk WHERE i = 1 AND k > 1
UNION ALL SELECT band, band_hash, i, CASE WHEN hit IS NULL THEN list_append(piv, struct_pack(id := id, m := m)) ELSE piv END, hit.id, CASE WHEN hit IS NOT NULL THEN id END, CASE WHEN hit IS NOT NULL THEN {_SAME.format('hit.m', 'm')} END
FROM (SELECT go.band, go.band_hash, bk.i, piv, bk.id, bk.m, list_filter(piv, lambda p: {_SAME.format('p.m', 'bk.m')} >= {dedup.THRESHOLD})[1] AS hit FROM go JOIN bk ON go.band = bk.band AND go.band_hash = bk.band_hash AND bk.i = go.i + 1)),
near AS MATERIALIZED (SELECT DISTINCT first_doc, removed, similarity FROM go WHERE removed IS NOT NULL),
same AS (SELECT one.id AS first_doc, sg.id AS removed, 1.0::DOUBLE AS similarity FROM sg JOIN one USING (m) WHERE sg.id <> one.id),
gone AS (SELECT sg.id FROM sg JOIN one USING (m) WHERE one.id IN (SELECT removed FROM near) UNION SELECT removed FROM same) """


def _signed(t, **options):
    return stored(dedup.signatures(t("documents"), hashing="md5", **options), "signatures")


def _shown(sigs):
    return sigs.withColumn("minhashes", F.array_join(F.col("minhashes").cast("array<string>"), ","))


@query(f"SELECT id, {_NUMBERS.format('m')} AS minhashes, n AS document_length FROM {_SIGS}")
def fuzzy_signatures(t):
    return _shown(dedup.signatures(t("documents"), hashing="md5"))


@query(f"SELECT id, {_NUMBERS.format('m[:16]')} AS minhashes FROM {_SIGS}")
def minhash_signature(t):
    """The same numbers by built-in functions alone."""
    return _shown(dedup.signatures_sql(t("documents"), k=16))


_CHARS = r"trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_FOUR = ", ".join(f"min({dedup.sql_minhash('h', hi, lo)})::BIGINT" for hi, lo in dedup.limb_multipliers(4))


@query(f"SELECT id, array_to_string([{_FOUR}], ',') AS minhashes FROM (SELECT doc_id AS id, ('0x' || substr(md5(c[i:i + 8]), 1, 8))::BIGINT AS h FROM (SELECT doc_id, c, unnest(range(1, greatest(length(c) - 8, 1) + 1)) AS i FROM (SELECT doc_id, {_CHARS} AS c FROM documents))) GROUP BY id")
def character_signatures(t):
    return _shown(dedup.signatures(t("documents"), k=4, shingle=9, characters=True, hashing="md5")).drop("document_length")


@query(f"SELECT id, band, band_hash, {_NUMBERS.format('m')} AS minhashes FROM {_BANDS}")
def band_hash(t):
    return _shown(dedup.band_hashes(_signed(t))).drop("document_length")


@query(f"SELECT band, band_hash, count(*) AS docs, min(id) AS first_doc FROM {_BANDS} GROUP BY band, band_hash HAVING count(*) > 1")
def lsh_buckets(t):
    return dedup.buckets(dedup.band_hashes(_signed(t)))


@query(f"WITH b AS MATERIALIZED (SELECT * FROM {_BANDS}) SELECT DISTINCT x.id AS a, y.id AS b, round({_SAME.format('x.m', 'y.m')}, 6)::DOUBLE AS jaccard FROM b x JOIN b y ON x.band = y.band AND x.band_hash = y.band_hash AND x.id < y.id AND x.id % 100 = 0")
def lsh_pairs_jaccard(t):
    """Signature Jaccard of the documents divisible by 100 with later ones of their buckets."""
    sigs = _signed(t)
    return dedup.met_pairs(sigs.where("id % 100 = 0"), sigs).where("a < b")


@query(_GREEDY + "SELECT first_doc, removed, round(similarity, 6)::DOUBLE AS similarity FROM near UNION SELECT * FROM same")
def fuzzy_greedy(t):
    return dedup.fuzzy_pairs(_signed(t))


@query(_GREEDY + "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT id FROM gone)")
def fuzzy_filter(t):
    return dedup.clean(t("documents"), dedup.fuzzy_removed(_signed(t))).drop("text")


@query(_GREEDY + "SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id IN (SELECT id FROM gone) THEN 'd' ELSE '' END AS duplicate FROM documents")
def fuzzy_annotate(t):
    return dedup.clean(t("documents"), dedup.fuzzy_removed(_signed(t)), mode="annotate").drop("text")


@query(_GREEDY + "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT id FROM gone)")
def fuzzy_keep_dups(t):
    return dedup.clean(t("documents"), dedup.fuzzy_removed(_signed(t)), mode="keep").drop("text")


@query(_GREEDY + "SELECT id FROM sg WHERE id NOT IN (SELECT id FROM gone)")
def kept_ids(t):
    return dedup.kept_ids(_signed(t))


_WRAP = "18446744073709551616::UHUGEINT"
_H1 = f"((xor(x::UBIGINT, 9173::UBIGINT)::UHUGEINT * 18397679294719823053::UHUGEINT) % {_WRAP})::UBIGINT"
_H2 = f"((xor(h, h >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % {_WRAP})::UBIGINT"


@query(f"SELECT id, string_agg(p::VARCHAR, ',' ORDER BY p) AS bits FROM (SELECT DISTINCT id, (xor(g, g >> 33) % 4096)::INTEGER AS p FROM (SELECT id, {_H2} AS g FROM (SELECT id, {_H1} AS h FROM (SELECT id, unnest(m) AS x FROM {_SIGS})))) GROUP BY id")
def bitmap_signature(t):
    """The set bits of each signature's bitmap, the highest bit of a byte first."""
    hexa = dedup.bitmap_signature(_signed(t)).select("id", F.hex("bitmap").alias("h"))
    digits = F.transform(F.sequence(F.lit(1), F.length("h")), lambda i: F.conv(F.substring("h", i, F.lit(1)), 16, 10).cast("int"))
    bits = F.flatten(F.transform(digits, lambda d, i: F.filter(F.array(*[F.when(d.bitwiseAND(F.lit(8 >> k)) > 0, 4 * i + k) for k in range(4)]), lambda x: x.isNotNull())))
    return hexa.select("id", F.array_join(bits.cast("array<string>"), ",").alias("bits"))


@query(f"SELECT id, array_to_string(list_transform(m, lambda x: printf('%08X', x)), '') AS packed FROM {_SIGS}")
def packed_signature(t):
    return dedup.packed_signature(_signed(t)).select("id", F.hex("packed").alias("packed"))


def _nearest(k: int, where: str) -> str:
    """The k nearest by signature of those that share a band of the search."""
    return f"""WITH b AS MATERIALIZED (SELECT id, m, band, band_hash FROM {_bands(_SIGS, dedup.SEARCH_BANDS, dedup.SEARCH_ROWS)}), p AS (SELECT DISTINCT x.id AS query_id, y.id AS neighbor_id, 1 - {_SAME.format('x.m', 'y.m')} AS d
FROM b x JOIN b y ON x.band = y.band AND x.band_hash = y.band_hash AND x.id <> y.id WHERE {where})
SELECT query_id, neighbor_id, round(d, 6)::DOUBLE AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id)::INTEGER AS rank FROM p WHERE d <= 0.300000001 QUALIFY rank <= {k}"""


@query(_nearest(4, "x.id % 100 = 0"))
def near_dup_topk(t):
    """The nearest of all documents to each one whose id is divisible by 100."""
    sigs = _signed(t)
    return dedup.near_duplicates(sigs.where("id % 100 = 0"), sigs)


@query(f"""WITH sg AS MATERIALIZED (SELECT * FROM {_SIGS}), tr AS (SELECT x.id AS q, 1 - {_SAME.format('x.m', 'y.m')} AS d FROM sg x JOIN sg y ON x.id % 100 = 0 AND x.id <> y.id WHERE d <= 0.300000001)
SELECT count(DISTINCT q) AS queries, true AS enough FROM tr""")
def near_dup_recall(t):
    """Whether the search finds at least 0.9 of the true nearest documents by signature, over all documents."""
    sigs = _signed(t)
    asked = sigs.where("id % 100 = 0")
    truth, found = (f(asked, sigs).withColumnsRenamed({"query_id": "query", "neighbor_id": "neighbor"}) for f in (dedup.nearest, dedup.near_duplicates))
    return repetition.recall_at(truth, found, 4).select("queries", F.coalesce(F.col("recall") >= 0.9, F.lit(True)).alias("enough"))


_BATCH = "(doc_id - (SELECT min(doc_id) FROM documents)) // ((SELECT (max(doc_id) - min(doc_id) + 4) // 4 FROM documents))"


@query(f"SELECT {_BATCH} AS batch, count(*) AS documents, true AS accounted, true AS apart FROM documents GROUP BY ALL")
def online_dedup(t):
    """Four batches: whether each document was either kept or dropped, and whether no kept one is near an earlier kept one that
    the search, asked again, would find."""
    docs = t("documents")
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "fuzzy-store")
    store = online.FuzzyStore(path)
    online.add_in_batches(docs, store, 4)
    kept, dropped = store.signatures(spark), spark.read.parquet(f"{path}/dropped")
    span = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    batch = F.floor((F.col("doc_id") - span["lo"]) / ((span["hi"] - span["lo"] + 4) // 4)).cast("long")
    state = kept.select(F.col("id").alias("doc_id"), F.lit(1).alias("kept")).union(dropped.select(F.col("dropped_query_id").alias("doc_id"), F.lit(0)))
    near = dedup.near_duplicates(kept, kept).groupBy(F.col("query_id").alias("doc_id")).agg(F.count("*").alias("near"))
    rows = docs.select("doc_id", batch.alias("batch")).join(state, "doc_id", "left").join(near, "doc_id", "left")
    return rows.groupBy("batch").agg(F.count_distinct("doc_id").alias("documents"), (F.count("kept") == F.count_distinct("doc_id")).alias("accounted"), (F.count("near") == 0).alias("apart"))


@query("SELECT doc_id, true AS known FROM documents WHERE doc_id % 100 = 0")
def probe_known_documents(t):
    """Documents probed against a store that holds them all: each is found again. The store isn't changed."""
    docs = t("documents")
    spark, path = docs.sparkSession, fresh_dir(docs.sparkSession, "probed-store")
    store = online.FuzzyStore(path)
    store.add(docs, 0)
    return store.probe(docs.where("doc_id % 100 = 0")).select("doc_id", "known")


@query(f"SELECT band, (band_hash * 3 // 1152921504606846976)::BIGINT AS segment, count(*) AS rows, count(DISTINCT band_hash) AS buckets, min(id) AS least FROM (SELECT id, band, band_hash::HUGEINT AS band_hash FROM {_BANDS}) GROUP BY ALL")
def segmented_bands(t):
    """Bands written as a table partitioned by band and segment, and read back segment by segment: no bucket is in two."""
    rows = dedup.segments(dedup.band_hashes(_signed(t)).select("band", "band_hash", "id"), 3)
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "segments")
    tables.write(rows, path, partition_by=["segment", "band"])
    back = tables.merged([spark.read.option("basePath", path).parquet(f"{path}/segment={i}") for i in range(3)])
    return back.groupBy(F.col("band").cast("int").alias("band"), F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("rows"), F.count_distinct("band_hash").alias("buckets"), F.min("id").alias("least"))


@query(f"SELECT doc_id, lang FROM documents WHERE {KEY} NOT IN (SELECT {KEY} FROM documents WHERE doc_id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY doc_id) = 1")
def new_documents(t):
    old = t("documents").where("doc_id % 10 = 0").select(dedup.exact_key("text").alias("key")).distinct()
    return dedup.new_documents(t("documents"), old).select("doc_id", "lang")


_PAIRS = f"(SELECT f AS first_doc, doc_id AS removed FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY}) AS f FROM documents) WHERE f <> doc_id)"
_TRUTH = f"""(SELECT query, neighbor, row_number() OVER (PARTITION BY query ORDER BY neighbor) AS rank FROM (
SELECT first_doc AS query, removed AS neighbor FROM {_PAIRS} UNION SELECT removed, first_doc FROM {_PAIRS}
UNION SELECT a.removed, b.removed FROM {_PAIRS} a JOIN {_PAIRS} b ON a.first_doc = b.first_doc AND a.removed <> b.removed))"""


def _truth(t):
    first = F.min("doc_id").alias("first_doc")
    keyed = t("documents").select("doc_id", dedup.exact_key("text").alias("k"))
    pairs = keyed.join(keyed.groupBy("k").agg(first), "k").where("doc_id <> first_doc").select("first_doc", F.col("doc_id").alias("removed"), F.lit(1.0).alias("similarity"))
    return repetition.ground_truth(pairs)


@query(f"SELECT query, neighbor, 0.0::DOUBLE AS distance, rank::BIGINT AS rank FROM {_TRUTH} WHERE rank <= 100")
def ground_truth(t):
    return _truth(t).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH tr AS (SELECT * FROM {_TRUTH} WHERE rank <= 4), f AS (SELECT * FROM tr WHERE (query + neighbor) % 2 = 0), p AS (SELECT query, count(*) AS n,
count(*) FILTER (WHERE (query, neighbor) IN (SELECT (query, neighbor) FROM f)) AS hits FROM tr GROUP BY query)
SELECT count(*) AS queries, round(avg((hits > 0)::INTEGER), 6) AS hit_rate, round(avg(hits::DOUBLE / least(n, 4)), 6) AS recall FROM p""")
def recall_at_k(t):
    truth = _truth(t)
    return repetition.recall_at(truth, truth.where("(query + neighbor) % 2 = 0"), 4)


@query(f"""WITH tr AS (SELECT * FROM {_TRUTH} WHERE rank <= 4), a AS (SELECT query, list(neighbor) AS l FROM tr GROUP BY query), b AS (SELECT query, list(neighbor) AS l FROM tr WHERE neighbor % 3 <> 0 GROUP BY query),
x AS (SELECT coalesce(a.l, []) AS la, coalesce(b.l, []) AS lb FROM a FULL JOIN b USING (query)), y AS (SELECT len(list_intersect(la, lb)) AS i, len(list_distinct(list_concat(la, lb))) AS u FROM x)
SELECT 'all' AS a, 'some' AS b, round(avg(i / 4.0), 6)::DOUBLE AS overlap, round(avg(i / u), 6)::DOUBLE AS jaccard FROM y""")
def divergence(t):
    truth = _truth(t).where("rank <= 4")
    return repetition.divergence({"all": truth, "some": truth.where("neighbor % 3 <> 0")}, 4)


def _grams(table: str, ident: str, n: int, text: str = "text") -> str:
    return f"(SELECT {ident} AS id, i - 1 AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT {ident}, {words(text)} AS w FROM {table}), unnest(range(1, len(w) - {n - 2})) r(i))"


_RUNS = "SELECT id, min(pos)::BIGINT AS first, (max(pos) + {n})::BIGINT AS last FROM (SELECT id, pos, sum(new) OVER (PARTITION BY id ORDER BY pos) AS run FROM (SELECT id, pos, (pos > coalesce(lag(pos) OVER (PARTITION BY id ORDER BY pos), {low}) + {n})::INTEGER AS new FROM hit)) GROUP BY id, run"


@query(f"WITH g AS (SELECT *, count(*) OVER (PARTITION BY gram) AS n, row_number() OVER (PARTITION BY gram ORDER BY id, pos) AS r FROM {_grams('documents', 'doc_id', 50)}), hit AS (SELECT id, pos FROM g WHERE n > 1 AND r > 1) " + _RUNS.format(n=50, low=-51))
def repetition_ranges(t):
    return repetition.repeated_ranges(t("documents")).select("id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


_DUP50 = f"g AS (SELECT *, count(*) OVER (PARTITION BY gram) AS n, row_number() OVER (PARTITION BY gram ORDER BY id, pos) AS r FROM {_grams('documents', 'doc_id', 50)}), hit AS (SELECT DISTINCT id, unnest(range(pos, pos + 50)) AS q FROM g WHERE n > 1 AND r > 1)"


@query(f"WITH {_DUP50}, h AS (SELECT id, list(q) AS q FROM hit GROUP BY id) SELECT doc_id, CASE WHEN q IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(q, i - 1)), lambda i: w[i]), ' ') END AS text FROM (SELECT doc_id, text, {words()} AS w FROM documents) LEFT JOIN h ON id = doc_id")
def repetition_removal(t):
    return repetition.remove_repetition(t("documents").select("doc_id", "text"))


_BYTES = """h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, q, md5_number(x[2 * q + 1:2 * q + 200]) AS g FROM h, unnest(range(0, length(x) // 2 - 99)) t(q)),
c AS (SELECT g, min(struct_pack(d := doc_id, q := q)) AS f FROM p GROUP BY g HAVING count(*) > 1), hit AS (SELECT doc_id, q FROM p JOIN c USING (g) WHERE struct_pack(d := doc_id, q := q) <> f),
s AS (SELECT doc_id, q, CASE WHEN q > lag(q) OVER w + 100 THEN 1 ELSE 0 END AS new FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY q)), r AS (SELECT doc_id, q, sum(new) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM s)"""


@query(f"WITH {_BYTES} SELECT doc_id AS id, min(q)::BIGINT AS first, (max(q) + 100)::BIGINT AS last FROM r GROUP BY doc_id, run")
def byte_repetition(t):
    """Ranges of at least 100 bytes that occur elsewhere, but for first occurrences."""
    return suffixes.repeated_bytes(t("documents"), length=100)


@query("""WITH h AS (SELECT item_id, hex(encode(text)) AS x FROM benchmark WHERE text IS NOT NULL), s AS (SELECT item_id AS id, p AS pos, x[2 * p + 1:] AS v FROM h, unnest(range(0, length(x) // 2)) t(p)),
o AS (SELECT *, row_number() OVER w - 1 AS place, lag(v) OVER w AS b FROM s WINDOW w AS (ORDER BY v, id, pos))
SELECT place, id, pos, coalesce((SELECT max(k) FROM unnest(range(0, least(length(v), length(b)) // 2 + 1)) t(k) WHERE v[:2 * k] = b[:2 * k]), 0)::BIGINT AS lcp FROM o""")
def suffix_array(t):
    return suffixes.suffix_array(t("benchmark"), id_column="item_id")


@query(f"WITH hit AS (SELECT id, pos FROM {_grams('benchmark', 'item_id', 8)} WHERE gram IN (SELECT gram FROM {_grams('documents', 'doc_id', 8)})) " + _RUNS.format(n=8, low=-9))
def cross_corpus_repetition(t):
    got = repetition.shared_ranges(t("benchmark"), t("documents"), id_a="item_id", n=8)
    return got.select("id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("SELECT p AS phrase, sum((length(text) - length(replace(text, p, ''))) // length(p))::BIGINT AS occurrences, count(*) FILTER (WHERE contains(text, p)) AS documents FROM documents, (SELECT unnest(['the', 'License', 'zzz']) AS p) GROUP BY p")
def count_phrases(t):
    return repetition.count_phrases(t("documents"), ["the", "License", "zzz"])


_LOW = r"lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT DISTINCT id, gram FROM {_grams('benchmark', 'item_id', 5, _LOW)}), d AS (SELECT DISTINCT id, gram FROM {_grams('documents', 'doc_id', 5, _LOW)}), n AS (SELECT id, count(*) AS n FROM q GROUP BY id),
m AS (SELECT q.id AS query_id, d.id AS id, count(*) AS k FROM q JOIN d USING (gram) GROUP BY ALL) SELECT query_id, m.id, round(k / n.n, 6)::DOUBLE AS score,
row_number() OVER (PARTITION BY query_id ORDER BY k / n.n DESC, m.id)::BIGINT AS rank FROM m JOIN n ON n.id = query_id QUALIFY rank <= 3""")
def similarity(t):
    got = repetition.similarity(t("benchmark"), repetition.shingle_index(t("documents")), id_column="item_id")
    return got.withColumn("rank", F.col("rank").cast("long"))


_TERMS = r"list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g')), ' +'), lambda w: w <> '')"


@query(f"""WITH a AS (SELECT item_id AS query_id, {_TERMS} AS w FROM benchmark), ph AS (SELECT DISTINCT query_id, array_to_string(w[i:i + 4], ' ') AS phrase FROM a, unnest(range(1, len(w) - 3)) t(i)), sl AS (SELECT phrase, i - 1 AS i, s[i] AS term FROM (SELECT DISTINCT phrase, string_split(phrase, ' ') AS s FROM ph), unnest(range(1, 6)) t(i)),
d AS (SELECT doc_id AS id, {_TERMS} AS w FROM documents), po AS (SELECT id, q - 1 AS p, w[q] AS term FROM d, unnest(range(1, len(w) + 1)) t(q)), rare AS (SELECT phrase, arg_min(term, (n, term)) AS term FROM sl JOIN (SELECT term, count(*) AS n FROM po GROUP BY term) USING (term) GROUP BY phrase HAVING count(*) = 5),
near AS (SELECT DISTINCT phrase, id, p + e AS p FROM rare JOIN po USING (term), unnest(range(-6, 7)) t(e)), dm AS (SELECT n.phrase, n.id, s.i, n.p FROM near n JOIN po ON po.id = n.id AND po.p = n.p JOIN sl s ON s.phrase = n.phrase AND s.term = po.term),
win AS (SELECT phrase, id, p - i - e AS w, term, count(DISTINCT i) AS slots, count(DISTINCT p) AS places FROM dm JOIN sl USING (phrase, i), unnest(range(0, 3)) t(e) GROUP BY ALL), hit AS (SELECT DISTINCT phrase, id FROM win GROUP BY phrase, id, w HAVING sum(slots) = 5 AND bool_and(places >= slots)),
sc AS (SELECT query_id, id, count(*) / any_value(n)::DOUBLE AS score FROM ph JOIN hit USING (phrase) JOIN (SELECT query_id, count(*) AS n FROM ph GROUP BY query_id) USING (query_id) GROUP BY query_id, id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3""")
def similarity_slop(t):
    """Documents in which most phrases of a benchmark item stand, words up to two places off."""
    items = t("benchmark").withColumnRenamed("item_id", "doc_id")
    return phrases.similarity(items, t("documents"), n=5, slop=2).drop("phrase", "highlight")


def _vectors(t):
    return vectors.unit_vectors(t("embeddings"), "embedding", "vec_id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, neighbor_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id)::INTEGER AS rank FROM s QUALIFY rank <= 4""")
def vector_search_exact(t):
    own = _vectors(t)
    return vectors.exact(own.where("id % 100 = 0"), own, 4)


def _vector_store(t):
    own = stored(_vectors(t), "vectors")
    store = vectors.VectorStore(own.sparkSession, fresh_dir(own.sparkSession, "vector-store")).create(own, 32)
    store.add(own, "all")
    return own, store


@query()
def vector_search(t):
    """The same from three quarters of the inverted lists, which vectors without clusters need; `found`: whether the exact search gives this neighbour, too."""
    own, store = _vector_store(t)
    asked = own.where("id % 100 = 0")
    sure = vectors.exact(asked, own, 4).select("query_id", "neighbor_id", F.lit(True).alias("found"))
    return store.search(asked, 4, 24).join(sure, ["query_id", "neighbor_id"], "left").fillna(False, "found")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT DISTINCT q.vec_id AS query_id FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE round(list_cosine_similarity(q.e, v.e), 9) >= 0.4""")
def known_vectors(t):
    """All vectors that the rest has something near to."""
    return vectors.with_neighbours(_vectors(t), least=0.4)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(t):
    return repetition.latency_percentiles(t("events"), "value", "event_type")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= 20")
def query_split(t):
    return dedup.split_queries(t("documents").select("doc_id", "source"), 20)[0]


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1)::BIGINT AS place FROM documents")
def shuffled_order(t):
    from ..operators import filters

    docs = t("documents").select("doc_id", F.md5(F.concat(F.lit("7:"), "doc_id").cast("binary")).alias("by"))
    return filters.sequential_id(dedup.shuffled(docs, seed=7), ["by", "doc_id"], "place").drop("by")


def _best(threshold: float, k: int) -> str:
    low, high = f"(i + 0.5) * {threshold} / 200", f"{threshold} + (i + 0.5) * {1 - threshold:.2f} / 200"
    area = f"sum(0.5 * (1 - pow(1 - pow({low}, r), b)) * {threshold} / 200 + 0.5 * pow(1 - pow({high}, r), b) * {1 - threshold:.2f} / 200)"
    return f"(SELECT {threshold}::DOUBLE AS threshold, b::INTEGER AS bands, r::INTEGER AS rows FROM range(1, {k + 1}) x(b), range(1, {k + 1}) y(r), range(200) z(i) WHERE b * r <= {k} GROUP BY b, r ORDER BY {area} LIMIT 1)"


@query(f"SELECT * FROM {_best(0.8, 64)} UNION ALL SELECT * FROM {_best(0.7, 112)}")
def optimal_bands(t):
    rows = [(x, *dedup.optimal_bands(x, k)) for x, k in ((0.8, 64), (0.7, 112))]
    return t("region").sparkSession.createDataFrame(rows, "threshold double, bands int, rows int")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, lang, -1 FROM documents WHERE doc_id % 7 = 0")
def upsert(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    return dedup.upsert(docs, docs.where("doc_id % 7 = 0").withColumn("n_chars", F.lit(-1).cast("long")), "doc_id")


@query("SELECT 112 AS k, 4096 AS bits, 42::BIGINT AS seed, 112 AS multipliers, true AS odd")
def sketch_manifest(t):
    """What the signatures of the documents depend on; multipliers are odd, so multiplying loses nothing."""
    got = dedup.manifest_of(t("documents").sparkSession)
    return got.select("k", "bits", "seed", F.size(F.array_distinct("multipliers")).alias("multipliers"), F.forall("multipliers", lambda x: F.pmod(x, F.lit(2)) == 1).alias("odd"))


@query(f"SELECT DISTINCT {KEY} AS key FROM documents")
def exact_dedup_stream(t):
    """The same store fed by a file stream in three batches: of each key one document stays, that of the batch which came first."""
    docs = t("documents").select("doc_id", "text")
    spark = docs.sparkSession
    base = fresh_dir(spark, "stream")
    few = docs.rdd.getNumPartitions() < 3  # of at most 128 MB each, as Spark reads them; more are written as they are
    (docs.repartitionByRange(3, "doc_id") if few else docs).write.parquet(f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    online.run(spark, f"{base}/in", "doc_id long, text string", online.ExactStore(f"{base}/store"), f"{base}/progress", max(1, -(-files // 3)))
    return spark.read.parquet(f"{base}/store/kept").select(dedup.exact_key("text").alias("key"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL", digits=6)
def event_rates(t):
    return online.event_rates(t("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
