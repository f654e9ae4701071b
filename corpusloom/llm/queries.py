"""The opN_ queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, exact_dedup, fill_in_middle, jaccard, language_model, media, packing, pseudonyms, quality, secrets, site_style, url_templates, whitening
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.read(spark, media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")
    return out.withColumn("purity", F.round("purity", 6))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= model.at).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, secrets.learn(docs)).drop("text")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = language_model.held_out(F.col("doc_id"))
    scored = language_model.train_and_score(docs, ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.matches(docs, contamination.automaton(table(spark, sf_dir, "benchmark")), only=("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    return found.drop("text")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = fill_in_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model)
    error = F.lit(None if model is None else whitening.identity_error(vectors, model)).cast("double")
    shares = F.array(*[F.lit(float(x)) for x in ([] if model is None else model.explained)]).cast("array<double>")
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n = F.lit(0 if model is None else model.n).cast("long")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), n.alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), error.alias("identity_error"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


_ALL = (
    op1_site_style, op2_media, op3_url_templates, op4_jaccard, op5_quality, op6_secrets, op7_pseudonyms, op8_packing, op9_language_model, op10_contamination,
    op11_fill_in_middle, op12_whitening, op13_exact_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}
