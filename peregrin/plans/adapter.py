"""Trajectories and a road graph derived from the events table, for queries on the driver's data.

An integer walk: user_id is the trajectory, event time runs 400 times faster, and the number in props moves the point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..operators import grid
from ..operators.clean import track


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, t, lon, lat."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(400e6)).cast("long")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).try_cast("long")
    move = lambda up, down: F.when(F.col("event_type") == up, k).when(F.col("event_type") == down, -k).otherwise(F.lit(0))
    d = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), t.alias("t"), move("click", "view").alias("dx"), move("purchase", "signup").alias("dy"))
    w = track().rowsBetween(Window.unboundedPreceding, 0)
    at = lambda base, c: (base + F.sum(c).over(w)).cast("double") / 1e4
    return d.select("id", "seq", "t", at(125000, "dx").alias("lon"), at(419000, "dy").alias("lat"))


def grid_graph(d: DataFrame, metres: float = 400) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y) and edges (from_node, to_node, length_m): occupied cells, and the moves between them."""
    c = grid.cells(d, metres).select("id", "t", "seq", "loncol", "latcol")
    nodes = numbered(c.select("loncol", "latcol").distinct(), "loncol", "latcol")
    c = c.withColumn("px", F.lag("loncol").over(track())).withColumn("py", F.lag("latcol").over(track())).where("px is not null and (px <> loncol or py <> latcol)")
    here, there = nodes.select("loncol", "latcol", F.col("n").alias("b")), nodes.select(F.col("loncol").alias("px"), F.col("latcol").alias("py"), F.col("n").alias("a"))
    far = F.sqrt(((F.col("loncol") - F.col("px")) ** 2 + (F.col("latcol") - F.col("py")) ** 2).cast("double")) * metres
    e = c.select("loncol", "latcol", "px", "py").distinct().join(here, ["loncol", "latcol"]).join(there, ["px", "py"])
    edges = e.select(F.least("a", "b").alias("from_node"), F.greatest("a", "b").alias("to_node"), far.alias("length_m")).distinct()
    return nodes.select(F.col("n").alias("node_id"), (F.col("loncol") * metres).alias("x"), (F.col("latcol") * metres).alias("y")), edges
