"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import contamination, jaccard, packing, pseudonyms, quality
from corpusloom.llm.common import small_batches, small_enough, stored, table

#: Ids that may be broadcast, 8 bytes each; more are joined by shuffling.
MOST_IDS = 2_000_000


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored as texts without words; repeated rows are scored alike and all stay or go; rows with a
    null id are scored, too; without labels of both kinds all stay; an empty table stays empty."""
    small_batches(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, into="__score", keep_from=model.at).drop("__score")


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document of the least id. Copies share at least 80 % of their five-word shingles.

    Texts without words are nobody's copies and stay; so do rows without an id. Of rows that repeat an id the least one stays, by
    the order of all columns. An empty table stays empty."""
    small_batches(spark)
    found = stored(jaccard.join(docs, n=5, percent=80), "near-copies").where(F.col("doc_id").isNotNull())
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    again = found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    hint = (lambda d: F.broadcast(d)) if small_enough(gone, MOST_IDS) else (lambda d: d)
    kept = docs.join(hint(gone), F.col("doc_id") == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return kept
    twice = F.col("doc_id") == F.col("__again")
    least = kept.join(again, twice, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.join(again, twice, "left_anti").unionByName(least.select("row.*"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that benchmark items contaminate; others stay as they are.

    Texts without words are clean; repeated rows all stay or go; items without words match nothing; without items or
    documents nothing goes."""
    small_batches(spark)
    items = contamination.automaton(table(spark, sf_dir, "benchmark"))
    return contamination.matches(docs, items, only=("contaminated",)).where(~F.col("contaminated")).drop("contaminated").select(docs.columns)


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, dates and addresses in the texts by pseudonyms of the same format; n_chars follows.

    Null and empty texts stay so; equal values have equal pseudonyms in all rows, repeated ones included."""
    return pseudonyms.pseudonymise(docs, n_chars="n_chars").select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    Null and empty texts are the one closing id; repeated rows are packed each; an empty table gives no sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("near_copies", distinct_documents), ("contamination", clean_documents), ("pseudonyms", private_documents), ("packing", packed_sequences)]

#: Tokenising and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
