"""Exact de-duplication against a persistent index of digests: a Parquet table bucketed and sorted by digest.

A batch is reduced to one row a digest before it is shuffled; the digests that the index doesn't have are found by a
sort-merge anti-join, whose side of the index is read bucket by bucket without a shuffle, and are appended. Which row of a
group stays is then read from the index, which has all digests of the batch by now. Nothing but built-in expressions runs.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts in a batch the row
of the largest id stays (null ids are least; of rows that repeat an id, one stays); a text that an earlier batch brought goes
whatever its id, and `keep_id` names the row that stayed then. Adding a batch again, under its old name, changes nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_dir
from .common import stored

#: A digest's rows are dealt to so many parts, for counting and for telling rows their group.
SALTS = 128
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null empty. Where all characters are ASCII, lower() does that, and much faster."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))


def digest(text: Column) -> Column:
    """The 32 bytes of the normalised text's SHA-256."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """The index in a folder that driver and executors share. One writer at a time.

    A generation is a folder `g<number>-<buckets>` below `path`; add() appends files to the last complete one, compact()
    writes the next one with one sorted file a bucket. `buckets`: of a new index; by default as many as shuffles have
    partitions, so that a batch's digests are shuffled once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        have = self._generations()
        if have:
            self.generation, self.buckets = max(have)
        else:
            self.generation, self.buckets = 0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = self._register(self.generation, self.buckets)

    def _generations(self) -> list[tuple[int, int]]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(at):
            return []
        found = [(re.fullmatch(r"g(\d+)-(\d+)", s.getPath().getName()), s.getPath()) for s in fs.listStatus(at)]
        done = [(int(m[1]), int(m[2])) for m, p in found if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return done

    def _register(self, generation: int, buckets: int) -> str:
        name = f"digests_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet OPTIONS (path '{self.path}/g{generation}-{buckets}') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )
        return name

    def digests(self) -> DataFrame:
        """digest, keep_id, batch: one row a digest."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str, buckets: int) -> None:
        rows.select("digest", "keep_id", "batch").write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").mode("append").saveAsTable(name)

    def add(self, docs: DataFrame, batch: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """Append the batch's new digests; a row for each row of `docs`: `id_column`, keep_id, group_size (equal texts in this
        batch, itself included), kept, text_sha256. Columns other than text and id aren't read; an empty table adds nothing."""
        own = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), digest(F.col(f"`{text}`")).alias("digest"))
        own = own.withColumn("row", F.monotonically_increasing_id())
        rows = stored(own.withColumn("salt", (F.col("row") % SALTS).cast("int")), "digests")
        parts = rows.groupBy("digest", "salt").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n"))
        groups = parts.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
        groups = stored(groups, "groups")  # used twice; and the optimiser would push the anti-join below both aggregations
        news = groups.select("digest", F.col("top.id").alias("keep_id"), F.lit(batch).alias("batch"))
        self._append(news.hint("merge").join(self.digests().select("digest"), "digest", "left_anti"), self.name, self.buckets)
        known = groups.hint("merge").join(self.digests(), "digest")
        known = known.select("digest", "keep_id", "group_size", F.when(F.col("batch") == batch, F.col("top.row")).alias("best"), F.explode("salts").alias("salt"))
        out = rows.hint("merge").join(known, ["digest", "salt"])
        return out.select(F.col("id").alias(id_column), "keep_id", "group_size", F.coalesce(F.col("row") == F.col("best"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

    def compact(self, buckets: int | None = None) -> None:
        """Write the next generation, one sorted file a bucket; the last one stays until drop_old()."""
        buckets = buckets or self.buckets
        name = self._register(self.generation + 1, buckets)
        self._append(self.digests().repartition(buckets, "digest"), name, buckets)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.generation, self.buckets, self.name = self.generation + 1, buckets, name

    def drop_old(self) -> None:
        """Delete all generations but the last; nothing may read them any more."""
        for generation, buckets in self._generations():
            if generation < self.generation:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/g{generation}-{buckets}")
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def deduplicate(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One batch against a new, empty index in the shared folder; see DigestIndex.add."""
    return DigestIndex(docs.sparkSession, fresh_dir(docs.sparkSession, "digest-index")).add(docs, "all", text, id_column)
