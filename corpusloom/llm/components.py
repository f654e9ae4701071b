"""Connected components by alternating large-star and small-star steps; edges only, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in an edge: the smallest id it can reach. Loops and repeated edges are harmless.

    Each step takes minima by node with map-side aggregation and joins them back, so a node with very many neighbours is
    one row on one side and many rows of a splittable join on the other."""

    def own(minima: DataFrame) -> DataFrame:
        """Keyed by a computed column: the join then shuffles it anew instead of in the aggregation's stage, and only so may
        adaptive execution split a node's rows on the other side."""
        return minima.select((F.col("u") + F.lit(0)).alias("w"), "m")

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    for _ in range(rounds):
        # Large star: larger neighbours of u move to u's least neighbour, itself included.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(own(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u itself, move to u's least one.
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own(m), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small, "edges")
        # Settled when every id points to one that points nowhere.
        stars = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty()
        dropped(e)
        e = new
        if stars:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
