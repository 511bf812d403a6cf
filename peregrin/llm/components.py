"""Connected components of links, by alternating large and small stars (no vertex needs its whole neighbourhood in memory)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs to (v, component): the smallest vertex reachable, for every vertex that has a link.

    Each round is two aggregations and joins of the links with their minima (skewed ones are split by adaptive
    execution); the number of rounds grows with the logarithm of the longest path. Each round's links are written, and
    those before it removed.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state.n:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = staged(small, "links")
        discard(edges)
        edges = after
    root = edges.select(F.col("v").alias("v")).distinct().select("v", F.col("v").alias("component"))
    return edges.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(root)
