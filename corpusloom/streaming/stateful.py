"""Near copies in a stream by keyed state: a bucket of a band holds the documents that fell in it, and a batch reads and writes the
state of its own buckets only. Spark's checkpoint keeps states and offsets together, so restarts and repeated batches change nothing.

Unlike FuzzyStore, which searches what was kept, this tells near copies of all documents seen. States may expire."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Bucket(StatefulProcessor):
    """Members: the first document of each distinct signature. A row in is compared with all members, in the order of ids."""

    def __init__(self, threshold: float, keep_ms: int | None):
        self.threshold, self.keep_ms = threshold, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.members = handle.getListState("members", "id long, minhashes array<long>", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(rows).sort_values("id", kind="stable")
        held = [(int(m[0]), np.asarray(m[1])) for m in self.members.get()]
        ids, matrix = [i for i, _ in held], np.stack([m for _, m in held]) if held else np.zeros((0, len(fresh["minhashes"].iloc[0])), np.int64)
        out, added = [], []
        for i, m in zip(fresh["id"], fresh["minhashes"], strict=True):
            m = np.asarray(m)
            share = (matrix == m).mean(1) if len(ids) else np.zeros(0)
            for k in np.flatnonzero(share >= self.threshold):
                if ids[k] != i:
                    out.append((int(i), ids[k], float(share[k])))
            if not (share == 1).any():
                ids.append(int(i))
                matrix = np.vstack([matrix, m])
                added.append((int(i), m.tolist()))
        if added:
            self.members.appendList(added)
        yield pd.DataFrame(out, columns=["id", "neighbor_id", "similarity"])

    def close(self) -> None:
        pass


def near_earlier(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = dedup.THRESHOLD, bands: int = dedup.SEARCH_BANDS, rows: int = dedup.SEARCH_ROWS, keep_ms: int | None = None) -> DataFrame:
    """A stream of id, neighbor_id, similarity: for each document those before it (of earlier batches, or of its own with a lesser id)
    that share a band and at least `threshold` of the signature; of documents with one signature only the first is a neighbour.
    A pair comes once for each band that it shares. keep_ms: after how long an entry of a state expires (processing time).

    Null ids give none; null and empty texts have the signature of texts without words."""
    docs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    sigs = dedup.signatures(docs, text, id_column, bands * rows).where("id IS NOT NULL")
    banded = dedup.band_hashes(sigs, bands, rows).select("band", "band_hash", "id", "minhashes")
    return banded.groupBy("band", "band_hash").transformWithStateInPandas(statefulProcessor=_Bucket(threshold, keep_ms), outputStructType="id long, neighbor_id long, similarity double", outputMode="append", timeMode="ProcessingTime" if keep_ms else "None")


def run(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 1, **options) -> None:
    """Write the pairs of all files that are there, oldest first, below `out`, and return."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = near_earlier(stream, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
