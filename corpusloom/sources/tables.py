"""Reading and writing corpora: files as data frames, sub-datasets, resume, samples, merges, statistics and job records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str | Sequence[str], kind: str = "parquet", extensions: Sequence[str] | None = None, sub_datasets: Sequence[str] | None = None, recursive: bool = True, **options) -> DataFrame:
    """Tables of any store that Hadoop's file systems reach (local, s3a://, hdfs://, ...), of given extensions and folders."""
    paths = [path] if isinstance(path, str) else list(path)
    if sub_datasets:
        paths = [f"{p.rstrip('/')}/{d}" for p in paths for d in sub_datasets]
    reader = spark.read.format(kind).options(**options)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    return reader.load(paths)


def write(df: DataFrame, path: str, max_rows: int = 0, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Parquet with zstd; at most max_rows rows a file where set."""
    w = df.write.mode(mode).option("compression", "zstd")
    if max_rows:
        w = w.option("maxRecordsPerFile", max_rows)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def from_memory(spark: SparkSession, table, name: str | None = None) -> DataFrame:
    """A pandas frame or Arrow table, as a data frame and, with a name, a temporary view."""
    df = spark.createDataFrame(table)
    if name:
        df.createOrReplaceTempView(name)
    return df


def files(spark: SparkSession, path: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """path, length, name (without extension) of the files below a path; contents aren't read."""
    df = read(spark, path, "binaryFile", extensions).select("path", "length")
    return df.withColumn("name", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))


def capped(listing: DataFrame, m: int) -> DataFrame:
    """The first m files by path (-1: all)."""
    return listing if m < 0 else listing.orderBy("path").limit(m)


def sampled(listing: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, seeded, with their number; a file may be drawn more than once."""
    spark = listing.sparkSession
    total = listing.count()
    if not total:
        return listing.limit(0).withColumn("draw", F.lit(0).cast("long"))
    from ..operators.filters import sequential_id

    draws = spark.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("at"))
    return sequential_id(listing, ["path"], "at").join(draws, "at").drop("at")


def unprocessed(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Input files whose base name has no output yet."""
    return inputs.join(outputs.select("name").distinct(), "name", "left_anti")


def batches(inputs: DataFrame, size: int) -> DataFrame:
    """Files with the number of their batch of `size` by path (-1: one batch)."""
    from ..operators.filters import resize_rows

    return inputs.withColumn("batch", F.lit(0).cast("long")) if size < 0 else resize_rows(inputs, size, ["path"], "batch")


def merged(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows, by column names; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def split(df: DataFrame, n: int, order_by: Sequence[str], into: str = "part") -> DataFrame:
    """Add the number of the part, of n as equal ones as can be, that each row falls in by its order; write with partition_by."""
    from ..operators.filters import sequential_id

    total = df.count()
    return sequential_id(df, order_by, into).withColumn(into, F.floor(F.col(into) * n / max(total, 1)).cast("long"))


def profile(df: DataFrame, tables: int, sample_rows: int | None = None) -> DataFrame:
    """Documents, mean documents a table, and mean characters of a text, of the first sample_rows read where that is set."""
    if sample_rows is not None:
        mean = df.limit(sample_rows).agg(F.avg(F.length("text"))).first()[0]
        return profile(df, tables).withColumn("mean_chars", F.lit(mean).cast("double"))
    return df.agg(F.count("*").alias("docs"), (F.count("*") / F.lit(tables)).alias("docs_per_table"), F.avg(F.length("text")).alias("mean_chars"))


def job_record(spark: SparkSession, name: str, params: dict, inputs: DataFrame, outputs: DataFrame, started: float, ended: float) -> DataFrame:
    """One row that says what a job did: name, parameters, rows in and out, seconds, status."""
    return spark.createDataFrame([(name, {k: str(v) for k, v in params.items()}, inputs.count(), outputs.count(), ended - started, "success")], "job string, params map<string,string>, rows_in long, rows_out long, seconds double, status string")


def run_over(spark: SparkSession, paths: Sequence[str], operator, out: str) -> list[str]:
    """Apply one operator to several inputs; gives the folders written."""
    done = []
    for i, p in enumerate(paths):
        write(operator(read(spark, p)), target := f"{out.rstrip('/')}/{i}")
        done.append(target)
    return done


def chain(df: DataFrame, *operators) -> DataFrame:
    """Operators one after the other, as one plan."""
    for op in operators:
        df = df.transform(op)
    return df


def configured(steps: Sequence[dict]):
    """An operator from a description: steps of {"operator": "module.function", ...parameters}, of this package's operators."""
    from importlib import import_module

    def step(d: dict):
        module, _, name = d["operator"].rpartition(".")
        if module.startswith("_") or "." in module or name.startswith("_"):
            raise ValueError(f"no operator of this name: {d['operator']}")
        f = getattr(import_module(f"corpusloom.operators.{module}"), name)
        return lambda df: f(df, **{k: v for k, v in d.items() if k != "operator"})

    made = [step(d) for d in steps]
    return lambda df: chain(df, *made)


def resources(df: DataFrame) -> DataFrame:
    """What reading a frame takes: for each task its rows, and CPU seconds and greatest memory (MB) of its Python worker so far."""

    def run(batches):
        import resource

        import pyarrow as pa
        from pyspark import TaskContext

        rows = sum(b.num_rows for b in batches)
        used = resource.getrusage(resource.RUSAGE_SELF)
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "rows": [rows], "cpu_seconds": [used.ru_utime + used.ru_stime], "memory_mb": [used.ru_maxrss / 1024]})

    return df.mapInArrow(run, "task int, rows long, cpu_seconds double, memory_mb double")
