"""Named queries over the standard tables, each with its operator's plan and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import let_workers_import, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(c: Column, digits: int) -> Column:
    """Rounded as the SQL does: the product with a power of ten goes to the nearest whole number. Spark's own rounding of decimals
    goes up where a quotient stands for a tie and the product lies below it (41 / 640)."""
    near = F.round(c * 10.0**digits, 0) / 10.0**digits
    return F.when(F.abs(near) < float("inf"), near).otherwise(c)


def query(sql: str | None = None, digits: int | None = 6):
    """Register a function of tables (t("documents") reads one) under its name; doubles are rounded, as the SQL does."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            small_batches(spark)
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            if digits is None:
                return out
            return out.select(*[rounded(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in out.dtypes])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import code_queries, dedup_queries, filter_queries, quality_queries, source_queries, star_queries, structure_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact de-duplication of the documents, with the word statistics of those that stay."""
    from ..operators import dedup, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality.word_statistics(dedup.exact_dedup(docs)).drop("text")
