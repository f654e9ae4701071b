"""Files of a folder as a stream that admits so many files or bytes a batch, and that goes on where its checkpoint says.

The stream carries what is to be read, a row a file; batches of files are then read by Spark's own readers on the executors, so the
driver holds the rows of one batch at most. An offset is the last file admitted, in the order of (time of change, path); a file that
comes later with an earlier time than one already admitted isn't seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .shared import let_workers_import, place


class FileFeed(DataSource):
    """Format `file_feed`. Options: path; ending (of the files' names, empty for all); maxFiles and maxBytes of a batch, 0 for no bound.
    A batch has one file at least."""

    @classmethod
    def name(cls):
        return "file_feed"

    def schema(self):
        return "path string, length long, changed long"

    def simpleStreamReader(self, schema):
        o = self.options
        return _Feed(o["path"], o.get("ending", ""), int(o.get("maxFiles", 0)), int(o.get("maxBytes", 0)))


class _Feed(SimpleDataSourceStreamReader):
    def __init__(self, path: str, ending: str, files: int, size: int):
        self.path, self.ending, self.files, self.size = path, ending, files, size

    def _listed(self, after: dict) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        where, root = place(self.path)
        found = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name.endswith(self.ending) and not i.base_name.startswith(("_", "."))]
        rows = sorted((i.mtime_ns, i.path, i.size) for i in found)
        return [(p, n, t) for t, p, n in rows if (t, p) > (after["changed"], after["path"])]

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def read(self, start):
        batch, size = [], 0
        for path, length, changed in self._listed(start):
            if batch and (0 < self.files <= len(batch) or 0 < self.size < size + length):
                break
            batch.append((path, length, changed))
            size += length
        return iter(batch), {"changed": batch[-1][2], "path": batch[-1][0]} if batch else start

    def readBetweenOffsets(self, start, end):
        return iter([r for r in self._listed(start) if (r[2], r[0]) <= (end["changed"], end["path"])])


def run(spark: SparkSession, path: str, checkpoint: str, handle: Callable[[DataFrame, int], None], format: str = "parquet", schema: str | None = None, max_files: int = 0, max_bytes: int = 0, ending: str = "") -> None:
    """Give handle(rows, batch id) the rows of batch after batch until all files that are there have been read. A batch that was given but
    not committed is given again under its number, with the same files."""
    let_workers_import(spark)
    spark.dataSource.register(FileFeed)

    def one(files: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in files.select("path").collect()]  # of one batch
        if paths:
            reader = spark.read.format(format)
            handle((reader.schema(schema) if schema else reader).load(paths), batch_id)

    stream = spark.readStream.format("file_feed").option("path", path).option("maxFiles", max_files).option("maxBytes", max_bytes).option("ending", ending).load()
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
