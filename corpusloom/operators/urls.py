"""URL predicates and domain block lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col

#: Public suffixes of two labels that are common; callers pass a full list where it matters.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "com.cn")


def fqdn(url: str | Column) -> Column:
    """Lower-cased host without user and port; null without one."""
    return F.nullif(F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def etld1(url: str | Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: the last two labels of the host, or three under a suffix of two."""
    h = fqdn(url)
    two = F.substring_index(h, ".", -2)
    return F.when(two.isin(list(two_label)), F.substring_index(h, ".", -3)).otherwise(two)


def url_path(url: str | Column) -> Column:
    """Path up to ? or #; / where there is none."""
    p = F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def is_valid_url(url: str | Column) -> Column:
    return col(url).rlike(r"^https?://[A-Za-z0-9.-]+(?::\d+)?(?:[/?#]\S*)?$")


def focus_path(url: str | Column) -> Column:
    """Folder of the url's path, with the closing slash."""
    return F.regexp_extract(url_path(url), r"^(.*/)", 1)


def allowed(url: str | Column, seeds: Sequence[str], by: str = "domain") -> Column:
    """Whether the url is in the registered domain, host or folder of one of the seed urls (by: domain, subdomain, path)."""
    find = {"domain": etld1, "subdomain": fqdn, "path": lambda u: F.concat(fqdn(u), focus_path(u))}[by]
    own = F.concat(fqdn(url), url_path(url)) if by == "path" else find(url)
    test = F.lit(False)
    for s in seeds:
        test = test | (own.startswith(find(F.lit(s))) if by == "path" else own == find(F.lit(s)))
    return F.coalesce(test, F.lit(False))


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """`domain` from text files: one a line, # comments and blanks skipped."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("domain"))
    return lines.where((F.col("domain") != "") & ~F.col("domain").startswith("#")).distinct()


def blocklist(df: DataFrame, domains: DataFrame, url: str = "url", into: str = "blocklisted") -> DataFrame:
    """Annotate with the host where it or a parent domain is listed, else ''.

    Each distinct host meets the list by its label suffixes; then the few blocked hosts meet the rows."""
    h = F.coalesce(fqdn(url), F.lower(col(url)))
    hosts = df.select(h.alias("__h")).distinct()
    labels = F.split("__h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    blocked = hosts.select("__h", F.explode(suffixes).alias("domain")).join(domains, "domain", "left_semi").select(F.col("__h").alias("__b")).distinct()
    return df.join(blocked, h == F.col("__b"), "left").withColumn(into, F.coalesce("__b", F.lit(""))).drop("__b")
