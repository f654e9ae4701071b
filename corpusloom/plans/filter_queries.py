"""Filters, annotation by predicates, identifiers, slices, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normal_key, str_to_int
from ..operators import filters, urls
from ..sources import tables
from .registry import query
from .sql import KEY, words


@query("SELECT doc_id, lang, source FROM documents WHERE (lang = 'en') AND (n_chars > 1000)")
def filter_and(t):
    return filters.filter_rows(t("documents"), ["lang = 'en'", "n_chars > 1000"], "AND", ["text", "n_chars"])


@query("SELECT doc_id, lang, n_chars FROM documents WHERE (lang = 'de') OR (n_chars < 500)")
def filter_or(t):
    return filters.filter_rows(t("documents"), ["lang = 'de'", "n_chars < 500"], "OR", ["text", "source"])


@query("SELECT o_orderkey, (o_orderdate::VARCHAR)[:10] AS o_orderdate, o_orderpriority FROM orders WHERE (o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31') AND (o_orderpriority LIKE '%URGENT%')")
def filter_between_like(t):
    got = filters.filter_rows(t("orders"), ["o_orderdate BETWEEN timestamp_ntz'1995-01-01' AND timestamp_ntz'1996-12-31'", "o_orderpriority LIKE '%URGENT%'"])
    return got.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src7')")
def filter_in(t):
    return filters.filter_rows(t("documents"), ["source IN ('src1', 'src3', 'src7')"]).select("doc_id", "source")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def filter_none(t):
    return filters.filter_rows(t("documents"), [])


@query("""SELECT 'lang = ''en''' AS criterion, count(*) FILTER (WHERE NOT lang = 'en') AS rows FROM documents UNION ALL
SELECT 'n_chars > 1000', count(*) FILTER (WHERE NOT n_chars > 1000) FROM documents UNION ALL SELECT 'total rows', count(*) FROM documents UNION ALL
SELECT 'rows kept', count(*) FILTER (WHERE lang = 'en' AND n_chars > 1000) FROM documents""")
def filter_stats(t):
    return filters.filter_stats(t("documents"), ["lang = 'en'", "n_chars > 1000"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def keep_tokens(t):
    survivors = t("orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return filters.keep_tokens(t("lineitem"), survivors, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE (lang = 'en' AND quality >= 1 AND n_chars <= 3000) OR (lang NOT IN ('en') AND n_chars >= 500)")
def ml_filter(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return filters.ml_filter(rows, {"en": {"quality_min": 1, "n_chars_max": 3000}, "other": {"n_chars_min": 500}}).select("doc_id", "lang", "n_chars", "quality")


_LICENSES = "CASE doc_id % 4 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'MIT' END"
_LISTS = "CASE doc_id % 4 WHEN 0 THEN {b}'Apache-2.0', 'MIT'{e} WHEN 1 THEN {b}'GPL-3.0', 'MIT'{e} WHEN 2 THEN {b}'GPL-3.0'{e} END"


@query(f"SELECT doc_id, l AS license, coalesce(lower(l) IN ('apache-2.0', 'mit'), true) AS license_status FROM (SELECT doc_id, {_LICENSES} AS l FROM documents)")
def license_allow(t):
    rows = t("documents").select("doc_id", F.expr(_LICENSES).alias("lic"))
    return filters.license_select(rows, ["Apache-2.0", "MIT"], "lic", allow_no_license=True)


@query(f"SELECT doc_id, l AS license, NOT coalesce(lower(l) IN ('gpl-3.0'), true) AS license_status FROM (SELECT doc_id, {_LICENSES} AS l FROM documents)")
def license_deny(t):
    rows = t("documents").select("doc_id", F.expr(_LICENSES).alias("lic"))
    return filters.license_select(rows, ["GPL-3.0"], "lic", deny=True, allow_no_license=False)


@query(f"SELECT doc_id, array_to_string(l, ',') AS license, CASE WHEN l IS NULL THEN false ELSE len(list_filter(l, lambda x: lower(x) NOT IN ('apache-2.0', 'mit'))) = 0 END AS license_status FROM (SELECT doc_id, {_LISTS.format(b='[', e=']')} AS l FROM documents)")
def license_list(t):
    rows = t("documents").select("doc_id", F.expr(_LISTS.format(b="array(", e=")")).alias("lic"))
    return filters.license_select(rows, ["Apache-2.0", "MIT"], "lic").withColumn("license", F.when(F.col("license").isNotNull(), F.array_join("license", ",")))


@query("SELECT doc_id, lang, lang IN ('en', 'fr') AS allowed FROM documents")
def lang_select(t):
    return filters.language_select(t("documents"), ["en", "fr"]).select("doc_id", "lang", "allowed")


_HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"


@query(f"""WITH h AS (SELECT page_id, lower({_HOST}) AS h FROM pages) SELECT page_id, CASE WHEN h = 'spam-farm.example.org' OR h LIKE '%.spam-farm.example.org' OR h LIKE '%.cheap-pills.example.com'
OR h = 'cheap-pills.example.com' OR h = 'example.net' OR h LIKE '%.example.net' THEN h ELSE '' END AS blocklisted FROM h""")
def blocklist(t):
    pages = t("pages").select("page_id", "url")
    listed = pages.sparkSession.createDataFrame([("spam-farm.example.org",), ("cheap-pills.example.com",), ("example.net",)], "domain string")
    return urls.blocklist(pages, listed).select("page_id", "blocklisted")


@query(f"SELECT page_id, {_HOST} AS fqdn, array_to_string(string_split({_HOST}, '.')[-2:], '.') AS etld1, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(t):
    return t("pages").select("page_id", urls.fqdn("url").alias("fqdn"), urls.etld1("url").alias("etld1"), urls.url_path("url").alias("path"))


@query(f"SELECT page_id, array_to_string(string_split({_HOST}, '.')[-2:], '.') = 'example.com' AS same_domain, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?([/?#][^ ]*)?$') AS valid FROM pages")
def url_allowed(t):
    return t("pages").select("page_id", urls.allowed("url", ["https://www.example.com/x"]).alias("same_domain"), urls.is_valid_url("url").alias("valid"))


@query("SELECT doc_id, (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))::INTEGER AS bloom FROM documents")
def bloom_member(t):
    return filters.bloom_member(t("documents").select("doc_id"), t("labels").where("toxic = 1"), "doc_id")


@query("SELECT count(*) AS documents, 0::BIGINT AS missed, true AS few_wrong FROM documents")
def bloom_member_approximate(t):
    """A Bloom filter misses none and passes few others (at most 3 per cent, of 1 expected)."""
    ids, toxic = t("documents").select("doc_id"), t("labels").where("toxic = 1")
    both = filters.bloom_member(filters.bloom_member(ids, toxic, "doc_id", "told", expected=2000, exact=False), toxic, "doc_id", "member")
    return both.agg(F.count("*").alias("documents"), F.count_if(F.expr("member = 1 and told = 0")).alias("missed"), (F.count_if(F.expr("member = 0 and told = 1")) <= 0.03 * F.count("*")).alias("few_wrong"))


@query("SELECT doc_id, coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(n_chars::VARCHAR, '') AS joined FROM documents")
def collapse(t):
    return filters.collapse(t("documents").select("doc_id", "lang", "source", "n_chars"), ["lang", "source", "n_chars"], "joined", "|", retain_all=False)


@query("SELECT * FROM nation")
def noop(t):
    return filters.noop(t("nation"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 125)::BIGINT AS slice FROM documents")
def resize_rows(t):
    return filters.resize_rows(t("documents").select("doc_id"), 125, ["doc_id"])


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
s AS (SELECT doc_id, n_chars, i, n_chars AS held, 0::BIGINT AS slice FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.n_chars, o.i, CASE WHEN s.held + o.n_chars > 100000 THEN 0 ELSE s.held + o.n_chars END, slice + (s.held + o.n_chars > 100000)::BIGINT FROM s JOIN o ON o.i = s.i + 1) SELECT doc_id, n_chars, slice FROM s""")
def resize_bytes(t):
    return filters.resize_bytes(t("documents").select("doc_id", "n_chars"), 50_000, F.col("n_chars"), ["doc_id"])


@query("SELECT doc_id, sha256(text) AS doc_hash FROM documents")
def doc_id_hash(t):
    return filters.doc_id(t("documents")).select("doc_id", "doc_hash")


@query("SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) + 4)::BIGINT AS doc_int FROM documents")
def doc_id_int(t):
    return filters.doc_id(t("documents").select("doc_id", "source"), hash_into=None, int_into="doc_int", order_by=["source", "doc_id"], start=5).select("doc_id", "doc_int")


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS numbers, true AS rising FROM documents")
def doc_id_distributed(t):
    """Numbers are unique and rise within each task."""
    got = filters.doc_id_distributed(t("documents").select("doc_id")).withColumn("part", F.shiftright("doc_int", 33))
    parts = got.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("doc_int").alias("d"), (F.max("doc_int") - F.min("doc_int") + 1).alias("span"))
    return parts.agg(F.sum("n").alias("rows"), F.sum("d").alias("numbers"), F.every(F.col("span") == F.col("n")).alias("rising"))


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1)::BIGINT AS id FROM conversations")
def sequential_id(t):
    return filters.sequential_id(t("conversations").select("conv_id", "turn"), ["conv_id", "turn"])


@query(f"SELECT doc_id, {KEY.removeprefix('sha256(').removesuffix(')')} AS plain FROM documents")
def normalize_string(t):
    return t("documents").select("doc_id", normal_key("text").alias("plain"))


@query("SELECT count(*) AS docs, count(*)::DOUBLE AS docs_per_table, round(avg(length(text)), 6) AS mean_chars FROM documents")
def corpus_profile(t):
    return tables.profile(t("documents"), 1)


@query("SELECT doc_id, text, NULL::VARCHAR AS role FROM documents UNION ALL SELECT conv_id, text, role FROM conversations")
def merge_tables(t):
    return tables.merged([t("documents").select("doc_id", "text"), t("conversations").select(F.col("conv_id").alias("doc_id"), "text", "role")])


@query(f"SELECT doc_id, len({words()}) AS docq_total_words FROM documents WHERE (lang = 'en')")
def chain(t):
    from ..operators import quality

    return tables.chain(t("documents"), lambda d: filters.filter_rows(d, ["lang = 'en'"]), quality.word_statistics).select("doc_id", "docq_total_words")


@query("SELECT doc_id, lang, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE (lang = 'en' AND quality >= 1) OR (lang = 'de')")
def ml_filter_missing_columns(t):
    """A threshold on a column that the table lacks is left out where that is asked for."""
    rows = t("documents").join(t("labels"), "doc_id")
    return filters.ml_filter(rows, {"en": {"quality_min": 1, "perplexity_max": 3}, "de": {"perplexity_max": 9}}, ignore_missing=True).select("doc_id", "lang", "n_chars", "quality")


@query("SELECT source, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY source")
def token_id_counts(t):
    """The `id, count` file beside token files: rows that each surviving id has."""
    return filters.id_counts(filters.keep_tokens(t("documents"), t("documents").where("lang = 'en'").select("doc_id"), "doc_id"), "source")


def _times(x: str, m: int) -> str:
    return f"(({x})::HUGEINT * {m} % 4294967296)::BIGINT"


def _turned(x: str, r: int) -> str:
    return f"((({x})::HUGEINT * {1 << r} % 4294967296)::BIGINT + (({x}) >> {32 - r}))"


_KEYED = _times(_turned(_times("k", 0xCC9E2D51), 15), 0x1B873593)
_NEXT = f"(({_turned('xor(h, k)', 13)})::HUGEINT * 5 + 3864292196) % 4294967296"
_BYTE = "coalesce(('0x' || nullif(substr(x, {0}, 2), ''))::BIGINT, 0)"


@query(f"""WITH b AS (SELECT doc_id, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT doc_id, lang || doc_id || source AS s FROM documents)),
k AS (SELECT doc_id, n, i, {_KEYED} AS k FROM (SELECT doc_id, n, i, {_BYTE.format('i * 8 + 1')} + 256 * {_BYTE.format('i * 8 + 3')} + 65536 * {_BYTE.format('i * 8 + 5')} + 16777216 * {_BYTE.format('i * 8 + 7')} AS k FROM b, unnest(range(0, n // 4 + 1)) t(i))),
f AS (SELECT doc_id, n, list_reduce(list_concat([42::BIGINT], coalesce(list(k ORDER BY i) FILTER (WHERE i < n // 4), [])), lambda h, k: ({_NEXT})::BIGINT) AS h, any_value(k) FILTER (WHERE i = n // 4) AS tail FROM k GROUP BY doc_id, n),
g AS (SELECT doc_id, xor(xor(h, CASE WHEN n % 4 > 0 THEN tail ELSE 0 END), n) AS h FROM f), g1 AS (SELECT doc_id, {_times('xor(h, h >> 16)', 0x85EBCA6B)} AS h FROM g), g2 AS (SELECT doc_id, {_times('xor(h, h >> 13)', 0xC2B2AE35)} AS h FROM g1)
SELECT doc_id, xor(h, h >> 16) AS murmur FROM g2""")
def murmur_ids(t):
    return t("documents").select("doc_id", str_to_int(F.concat("lang", F.col("doc_id").cast("string"), "source")).alias("murmur"))
