"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import re
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder, which only a local master may use."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path, with its scheme, so that Spark and Python mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()


def place(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers, for drivers that found it by sys.path alone."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def cleaned(spark: SparkSession, names: tuple[str, ...], older_than: float = 86_400.0) -> list[str]:
    """Delete the folders of fresh_dir() whose names begin with one of these and that are older than so many seconds; gives them.

    Only a job that knows that nothing reads its intermediate results any more may call this."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    limit = time.time() * 1000 - older_than * 1000
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() <= limit and re.fullmatch(r"(?:" + "|".join(map(re.escape, names)) + r")-[0-9a-f]{32}", s.getPath().getName())]
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on Python workers get batches of rows of at most so many bytes, unless the session asks for less: what operators make
    of a batch is many times as large (a list of numbers 16 times), so with batches by rows alone workers grow with the texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).rstrip("b")
    if size.isdigit() and int(size) > most:
        spark.conf.set(name, str(most))
