"""Sources, sinks and file-level control: each query writes to the shared folder what it then reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, structure, urls
from ..sources import archives, feed, shared, tables, warc
from ..sources.shared import fresh_dir
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def table_round_trip(t):
    """A zstd table of files of at most 10,000 rows, written and scanned again by extension; other files are left alone."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    path = fresh_dir(rows.sparkSession, "table")
    tables.write(rows, path, max_rows=10_000)
    rows.limit(1).write.mode("append").json(path)
    return tables.read(rows.sparkSession, path, extensions=[".parquet"])


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')")
def sub_datasets(t):
    """Two folders of a data set of one folder a language."""
    rows = t("documents").select("doc_id", "lang", F.col("lang").alias("folder"))
    path = fresh_dir(rows.sparkSession, "sets")
    tables.write(rows, path, partition_by=["folder"])
    return tables.read(rows.sparkSession, path, sub_datasets=["folder=en", "folder=fr"]).select("doc_id", "lang")


@query("SELECT r_regionkey, r_name FROM region")
def in_memory_table(t):
    rows = t("region").select("r_regionkey", "r_name")
    return tables.from_memory(rows.sparkSession, rows.toArrow(), "regions_in_memory")


def _listing(t):
    """A file for each source of the documents, named after it."""
    rows = t("documents").select(F.col("doc_id").cast("string").alias("value"), "source")
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "files")
    rows.repartition("source").write.partitionBy("source").text(path)
    return tables.files(spark, path, [".txt"]).withColumn("name", F.regexp_extract("path", "source=([^/]*)/", 1))


_SOURCES = "(SELECT source AS name, row_number() OVER (ORDER BY source) - 1 AS n FROM (SELECT DISTINCT source FROM documents))"


@query(f"SELECT name FROM {_SOURCES} WHERE n < 3")
def capped_listing(t):
    return tables.capped(_listing(t), 3).select("name")


@query("SELECT 40::BIGINT AS draws, 0::BIGINT AS unknown, true AS spread")
def sampled_listing(t):
    """Draws with replacement are of listed files only, and not all of one."""
    known = t("documents").select(F.col("source").alias("name"), F.lit(1).alias("known")).distinct()
    drawn = tables.sampled(_listing(t), 40).join(known, "name", "left")
    return drawn.agg(F.count("*").alias("draws"), F.count_if(F.col("known").isNull()).alias("unknown"), (F.count_distinct("name") > 1).alias("spread"))


@query(f"SELECT name FROM {_SOURCES} WHERE n % 3 <> 0")
def resumed_listing(t):
    """Without the files whose results are there: those of every third source."""
    files = _listing(t)
    done = tables.batches(files, 1).where("batch % 3 = 0")
    return tables.unprocessed(files, done).select("name")


@query(f"SELECT name, (n // 2)::BIGINT AS batch FROM {_SOURCES}")
def batched_listing(t):
    return tables.batches(_listing(t), 2).select("name", "batch")


@query("SELECT doc_id, lang, length(text)::INTEGER AS n FROM documents")
def fed_documents(t):
    """Documents in files, read as a stream of three files a batch, each batch written where a repeated one would replace it."""
    rows = t("documents").select("doc_id", "lang", "text")
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "feed")
    rows.repartition(8).write.parquet(f"{path}/in")
    feed.run(spark, f"{path}/in", f"{path}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{path}/out/batch={i}"), max_files=3, ending=".parquet")
    return spark.read.parquet(f"{path}/out").select("doc_id", "lang", F.length("text").alias("n"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) * 4 // (SELECT count(*) FROM documents))::BIGINT AS part FROM documents")
def split_table(t):
    """Four parts of consecutive rows, as equal as can be."""
    return tables.split(t("documents").select("doc_id"), 4, ["doc_id"])


@query("SELECT 'noop' AS job, count(*) AS rows_in, count(*) AS rows_out, 'success' AS status FROM nation")
def job_record(t):
    rows = t("nation")
    return tables.job_record(rows.sparkSession, "noop", {"a": 1}, rows, filters.noop(rows), 0.0, 1.0).select("job", "rows_in", "rows_out", "status")


@query("SELECT 2 * count(*) AS rows FROM nation")
def several_inputs(t):
    """One operator over several inputs, each to an output of its own."""
    rows = t("nation")
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "several")
    for i in range(2):
        tables.write(rows, f"{path}/in{i}")
    done = tables.run_over(spark, [f"{path}/in{i}" for i in range(2)], filters.noop, f"{path}/out")
    return spark.read.parquet(*done).agg(F.count("*").alias("rows"))


@query(r"SELECT 'f' || doc_id || '.py' AS title, text AS contents, 'Python' AS programming_language, sha256(text) AS hash FROM documents WHERE regexp_matches(text, '\S')")
def archive_members(t):
    """Every document as a file of ZIP archives, read again as source code."""
    rows = t("documents").select(F.concat(F.lit("f"), "doc_id", F.lit(".py")).alias("title"), F.col("text").alias("contents"))
    path = fresh_dir(rows.sparkSession, "zips")
    archives.write_archives(rows, path)
    return archives.code2parquet(rows.sparkSession, path).select("title", "contents", "programming_language", "hash")


@query("SELECT count(*) AS docs, sum(strlen(text))::BIGINT AS tokens FROM documents WHERE length(text) > 0")
def token_stream(t):
    """Byte tokens to Arrow files and back."""
    tokens = structure.tokenize(t("documents"), structure.bytes_tokenizer)
    spark, path = tokens.sparkSession, fresh_dir(tokens.sparkSession, "tokens")
    archives.write_token_stream(tokens, path)
    return spark.read.format("token_stream").load(path).agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"))


@query("SELECT 'http://x/' || doc_id AS url, 'conversion' AS type, text AS content FROM documents")
def warc_records(t):
    """Every document as a record of gzipped WET files, read again as a stream."""
    rows = t("documents").select(F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.col("text").alias("content"))
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "wet")
    warc.write(rows, path)
    warc.register(spark)
    return spark.read.format("warc").load(path).select("url", "type", "content")


@query("SELECT 'http://x/' || doc_id AS url, lang AS language, text AS content FROM documents WHERE lang = 'de'")
def warc_language(t):
    """Of all documents as records the German ones, read in ranges of 64 kB of the files."""
    rows = t("documents").select(F.concat(F.lit("http://x/"), "doc_id").alias("url"), F.col("text").alias("content"), "lang")
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "wet")
    warc.write(rows, path, language="lang")
    warc.register(spark)
    return spark.read.format("warc").option("language", "de").option("rangeBytes", 1 << 16).load(path).select("url", "language", "content")


@query(r"SELECT DISTINCT lower(regexp_extract(url, '^[^:/]+://([^/?#]*)', 1)) AS domain, true AS listed FROM pages WHERE regexp_extract(url, '^[^:/]+://([^/?#]*)', 1) <> ''")
def blocklist_file(t):
    """The hosts of all pages as a list of domains in a text file with comments, blanks and repeats."""
    hosts = t("pages").select(F.regexp_extract("url", r"^[^:/]+://([^/?#]*)", 1).alias("h")).where("h <> ''")
    spark, path = hosts.sparkSession, fresh_dir(hosts.sparkSession, "blocklist")
    hosts.select(F.explode(F.array(F.lit("# comment"), F.concat(F.upper("h"), F.lit(" ")), F.lit(""), F.col("h"))).alias("value")).write.text(path)
    return urls.load_blocklist(spark, path).select("domain", F.lit(True).alias("listed"))


@query("SELECT doc_id, lang, lang IN ('en', 'fr') AS allowed FROM documents WHERE (n_chars > 1000)")
def configured_chain(t):
    """Operators named in a description, as a job's configuration has them."""
    steps = [{"operator": "filters.filter_rows", "criteria": ["n_chars > 1000"], "drop": ["text"]}, {"operator": "filters.language_select", "allowed": ["en", "fr"]}]
    return tables.configured(steps)(t("documents")).select("doc_id", "lang", "allowed")


@query("SELECT count(*) AS rows, true AS measured FROM lineitem")
def task_resources(t):
    got = tables.resources(t("lineitem").select("l_orderkey"))
    return got.agg(F.sum("rows").cast("long").alias("rows"), F.every((F.col("cpu_seconds") > 0) & (F.col("memory_mb") > 1)).alias("measured"))


@query("SELECT 2 AS before, 1 AS after, count(*) AS rows FROM documents")
def cleaned_folder(t):
    """Of two intermediate results one is cleaned away by its name, the other one stays whole."""
    rows = t("documents").select("doc_id")
    spark = rows.sparkSession
    paths = [fresh_dir(spark, name) for name in ("clean-me", "keep-me")]
    for p in paths:
        rows.write.parquet(p)
    exists = lambda p: shared.place(p)[0].get_file_info(shared.place(p)[1]).type.name != "NotFound"
    before = sum(map(exists, paths))
    shared.cleaned(spark, ("clean-me",), older_than=0)
    return spark.read.parquet(paths[1]).agg(F.lit(before).alias("before"), F.lit(sum(map(exists, paths))).alias("after"), F.count("*").alias("rows"))
