"""De-duplication of arriving batches against what came before, as Structured Streaming micro-batches.

The store is append-only Parquet, a folder for each batch: a batch that was committed is skipped when it is delivered
again, so foreachBatch's at-least-once delivery changes nothing."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from ..sources.shared import stored


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


class ExactStore:
    """Keys of all documents kept so far, under `path`/keys, and the documents under `path`/kept."""

    def __init__(self, path: str, text: str = "text", id_column: str = "doc_id"):
        self.path, self.text, self.id = path.rstrip("/"), text, id_column

    def add(self, batch: DataFrame, batch_id: int) -> None:
        spark, mark = batch.sparkSession, f"{self.path}/keys/batch={batch_id}"
        if _exists(spark, f"{mark}/_SUCCESS"):
            return
        known = _stored(spark, f"{self.path}/keys", "key string, batch long").where(F.col("batch") != batch_id)
        kept = dedup.new_documents(batch, known, self.text, self.id)
        kept.write.mode("overwrite").parquet(f"{self.path}/kept/batch={batch_id}")
        # The keys come last: they commit the batch.
        spark.read.parquet(f"{self.path}/kept/batch={batch_id}").select(dedup.exact_key(self.text).alias("key")).write.mode("overwrite").parquet(mark)


class FuzzyStore:
    """Signatures of all documents kept so far, under `path`/signatures, and an index of their bands, under `path`/bands; for
    each batch also neighbours, drops and metrics.

    The index is partitioned by a part of the band's hash (`parts` folders a batch); a batch reads the parts that its own bands
    fall in, semi-joined by these bands, and then the signatures of the documents that it met, so what is compared grows with
    the matches and not with the store."""

    SIGNATURES = "id long, minhashes array<long>, document_length long, batch long"
    INDEX = "band int, band_hash long, id long, batch long, part int"

    def __init__(self, path: str, text: str = "text", id_column: str = "doc_id", threshold: float = dedup.THRESHOLD, bands: int = dedup.BANDS, rows: int = dedup.ROWS, top: int = 4, seed: int = 42, parts: int = 8):
        self.path, self.text, self.id, self.threshold, self.bands, self.rows, self.top, self.seed, self.parts = path.rstrip("/"), text, id_column, threshold, bands, rows, top, seed, parts

    def signatures(self, spark: SparkSession) -> DataFrame:
        return _stored(spark, f"{self.path}/signatures", self.SIGNATURES)

    def _banded(self, sigs: DataFrame, *more: str) -> DataFrame:
        bands = sigs.select(F.posexplode(dedup.band_keys(dedup.SEARCH_BANDS, dedup.SEARCH_ROWS)).alias("band", "band_hash"), "id", *more)
        return bands.withColumn("part", F.pmod(F.col("band_hash"), F.lit(self.parts)).cast("int"))

    def _search(self, sigs: DataFrame, batch_id: int | None, also: DataFrame | None = None) -> DataFrame:
        """dedup.near_duplicates() of the given signatures among the store's (but for one batch's) and those of `also`."""
        spark = sigs.sparkSession
        index, known = _stored(spark, f"{self.path}/bands", self.INDEX), self.signatures(spark)
        if not _exists(spark, f"{self.path}/bands") and _exists(spark, f"{self.path}/index"):  # of a store whose bands had another hash
            self._banded(known.select("id", "minhashes", "batch"), "batch").write.partitionBy("batch", "part").parquet(f"{self.path}/bands")
            index = _stored(spark, f"{self.path}/bands", self.INDEX)
        if batch_id is not None:
            index, known = index.where(F.col("batch") != batch_id), known.where(F.col("batch") != batch_id)
        held = None if also is None else also.select("id", "minhashes")
        if not known.isEmpty():
            asked = self._banded(sigs).select("part", "band", "band_hash").distinct()
            met = index.join(asked, ["part", "band", "band_hash"], "left_semi").select("id").distinct()
            met = known.join(met, "id", "left_semi").select("id", "minhashes")
            held = met if held is None else held.union(met)
        if held is None:
            return spark.createDataFrame([], "query_id long, neighbor_id long, distance double, rank int")
        return dedup.near_duplicates(sigs, held, self.top, max_distance=1 - self.threshold)

    def _signed(self, batch: DataFrame) -> DataFrame:
        return dedup.signatures(batch, self.text, self.id, self.bands * self.rows, seed=self.seed)

    def probe(self, batch: DataFrame) -> DataFrame:
        """Only ask: the batch's ids with neighbors (nearest first) and known, whether the store has any near copy; an id that
        the store holds itself is known, too. Nothing is inserted."""
        spark, sigs = batch.sparkSession, stored(self._signed(batch), "probed")
        found = self._search(sigs, None).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbor_id"))), lambda x: x["neighbor_id"]).alias("neighbors"))
        held = self.signatures(spark).select("id").distinct().withColumn("held", F.lit(True))
        out = sigs.select("id").join(found, F.col("id") == F.col("query_id"), "left").join(held, "id", "left")
        return out.select(F.col("id").alias(self.id), "neighbors", (F.col("neighbors").isNotNull() | F.col("held").isNotNull()).alias("known"))

    def _inner(self, sigs: DataFrame) -> DataFrame:
        """Ids of near copies among each other: the greedy rule, and what the finer search still finds goes by the least id."""
        inner = stored(dedup.fuzzy_removed(sigs, threshold=self.threshold, bands=self.bands, rows=self.rows), "inner")
        left = sigs.join(inner, "id", "left_anti")
        later = dedup.near_duplicates(left, left, self.top, max_distance=1 - self.threshold).where("neighbor_id < query_id").select(F.col("query_id").alias("id"))
        return stored(inner.union(later).distinct(), "inner")

    def _none_lost(self, sigs: DataFrame, inner: DataFrame, fresh: DataFrame, batch_id: int) -> DataFrame:
        """`fresh` and, of the batch's near copies, those that are near nothing that stays: what they are copies of was itself dropped
        as a copy of something else. They are set apart among each other; the least id of them stays each time, so this ends."""
        near = lambda d, held: dedup.near_duplicates(d, held, self.top, max_distance=1 - self.threshold).select(F.col("query_id").alias("id"))
        asked, fresh = stored(sigs.join(inner, "id", "left_semi"), "inner"), stored(fresh, "fresh")
        met = self._search(asked, batch_id, fresh).select(F.col("query_id").alias("id"))
        lost = stored(asked.join(met, "id", "left_anti"), "lost")
        while not lost.isEmpty():
            again = self._inner(lost)
            more = stored(lost.join(again, "id", "left_anti"), "fresh")
            fresh, lost = fresh.union(more), stored(lost.join(again, "id", "left_semi"), "lost")
            if not lost.isEmpty():
                lost = stored(lost.join(near(lost, more), "id", "left_anti"), "lost")
        return fresh

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Sign, drop near copies within the batch, search the store, drop what is too near, never insert a known id, insert the rest.
        What is dropped is near something that the store keeps."""
        spark, mark, began = batch.sparkSession, f"{self.path}/signatures/batch={batch_id}", time.time()
        if _exists(spark, f"{mark}/_SUCCESS"):
            return
        sigs = stored(self._signed(batch), "batch")
        inner = self._inner(sigs)
        survivors = sigs.join(inner, "id", "left_anti")
        near = stored(self._search(survivors, batch_id), "near")
        found = near.groupBy("query_id").agg(F.array_sort(F.collect_list("neighbor_id")).alias("neighbors"))
        found.write.mode("overwrite").parquet(f"{self.path}/neighbors/batch={batch_id}")
        known = self.signatures(spark).where(F.col("batch") != batch_id).select("id")
        again = survivors.join(known, "id", "left_semi").select("id")
        gone = stored(inner.union(near.select("query_id")).union(again).distinct(), "gone")
        fresh = stored(self._none_lost(sigs, inner.join(known, "id", "left_anti"), sigs.join(gone, "id", "left_anti"), batch_id), "fresh")
        gone = sigs.join(fresh, "id", "left_anti")
        gone.select(F.lit(batch_id).cast("long").alias("batch_start"), F.col("id").alias("dropped_query_id")).write.mode("overwrite").parquet(f"{self.path}/dropped/batch={batch_id}")
        self._banded(fresh).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/bands/batch={batch_id}")
        # The signatures come last: they commit the batch.
        fresh.write.mode("overwrite").parquet(mark)
        inserted, total = fresh.count(), sigs.count()
        row = (batch_id, total, inserted, total - inserted, time.time() - began)
        spark.createDataFrame([row], "batch_id long, documents long, inserted long, removed long, seconds double").write.mode("overwrite").parquet(f"{self.path}/metrics/batch={batch_id}")


def run(spark: SparkSession, source: str, schema: str, store: ExactStore | FuzzyStore, checkpoint: str, files_per_batch: int = 1) -> None:
    """Feed all files that are there, oldest first, batch by batch, and return."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def add_in_batches(df: DataFrame, store: ExactStore | FuzzyStore, batches: int, order_by: str = "doc_id") -> None:
    """The same over a static frame cut by ranges of an id into equal spans."""
    lo, hi = df.agg(F.min(order_by), F.max(order_by)).first()
    if lo is None:
        return
    span = -(-(hi - lo + 1) // batches)
    for i in range(batches):
        store.add(df.where((F.col(order_by) >= lo + i * span) & (F.col(order_by) < lo + (i + 1) * span)), i)


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and time window, for streams (with a watermark) and static frames alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
