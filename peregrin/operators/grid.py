"""Density on a grid of square cells in degrees, and chart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE
from ..functions.lineage import cut
from ..functions.ranks import quantiles


def cells(d: DataFrame, metres: float = 40) -> DataFrame:
    """loncol, latcol of each fix; the first cell is centred on the least lon and lat. No rows for an empty or flat extent."""
    delta = metres / METRES_PER_DEGREE
    p = d.agg(F.min("lon").alias("slon"), F.min("lat").alias("slat"), F.max("lon").alias("elon"), F.max("lat").alias("elat")).where("slon < elon and slat < elat").select("slon", "slat")
    d = d.crossJoin(F.broadcast(p))  # one row
    at = lambda c: F.floor((F.col(c) - (F.col(f"s{c}") - delta / 2)) / delta)
    return d.withColumn("loncol", at("lon")).withColumn("latcol", at("lat"))


def density(d: DataFrame, metres: float = 40) -> DataFrame:
    return cells(d, metres).groupBy("loncol", "latcol").agg(F.count("*").alias("n"))


def _of_counts(counts: DataFrame, at: float | list[float]) -> DataFrame:
    """q: exact quantiles of n. Rows with equal n are counted first: there are at most about the square root of twice the fixes."""
    return counts.groupBy("n").agg(F.count("*").alias("k")).agg(F.percentile("n", F.array(*map(F.lit, at)) if isinstance(at, list) else at, F.col("k")).alias("q"))


def dense_fixes(d: DataFrame, metres: float = 40, quantile: float = 0.5) -> DataFrame:
    """Fixes in cells at or above the quantile of the cells' counts."""
    c = cells(d, metres).drop("slon", "slat")
    n = c.groupBy("loncol", "latcol").agg(F.count("*").alias("n"))
    limit = _of_counts(n, quantile).withColumnRenamed("q", "limit")
    return c.join(n.crossJoin(F.broadcast(limit)).where("n >= limit"), ["loncol", "latcol"], "left_semi")  # one row


def polygons(d: DataFrame, metres: float = 40) -> DataFrame:
    """The box of each occupied cell."""
    delta = metres / METRES_PER_DEGREE
    g = cells(d, metres).groupBy("loncol", "latcol").agg(F.count("*").alias("n"), F.first("slon").alias("slon"), F.first("slat").alias("slat"))
    x, y = F.col("slon") + F.col("loncol") * delta, F.col("slat") + F.col("latcol") * delta
    return g.select("loncol", "latcol", "n", (x - delta / 2).alias("west"), (y - delta / 2).alias("south"), (x + delta / 2).alias("east"), (y + delta / 2).alias("north"))


def quantile_classes(counts: DataFrame, k: int = 7) -> DataFrame:
    """class 1 to k by the quantiles i/k of n, upper bounds inclusive."""
    q = _of_counts(counts, [i / k for i in range(1, k)])
    c = counts.crossJoin(F.broadcast(q))  # one row
    return c.withColumn("class", F.size(F.filter("q", lambda x: F.col("n") > x)) + 1).drop("q")


def _limits(m: DataFrame, at: list[float]) -> DataFrame:
    """measure and q: the exact quantiles of x, a row a measure."""
    found = quantiles(m, {"x": at}, "measure")
    return m.sparkSession.createDataFrame([(k, q["x"]) for k, q in found.items()], "measure string, q array<double>")


def distribution_summary(m: DataFrame, trim: float = 0.995) -> DataFrame:
    """n, mean, median, largest and the trim limit of each measure."""
    m = cut(m)
    s = m.groupBy("measure").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("largest"))
    return s.join(F.broadcast(_limits(m, [0.5, trim])), "measure").select("measure", "n", "mean", F.col("q")[0].alias("median"), "largest", F.col("q")[1].alias("trim_at"))


def _trimmed(m: DataFrame, trim: float) -> DataFrame:
    """Values up to the trim quantile of their measure, with low and high, the least and largest of them."""
    t = m.join(F.broadcast(_limits(m, [trim])), "measure").where(F.col("x") <= F.col("q")[0]).drop("q")  # a row a measure
    ends = t.groupBy("measure").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return t.join(F.broadcast(ends), "measure")


def histogram(m: DataFrame, bins: int = 50, trim: float = 0.995) -> DataFrame:
    """Counts of the bins between the least and largest of the values up to the trim quantile."""
    b = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / ((F.col("high") - F.col("low")) / bins)))).otherwise(0)
    return _trimmed(cut(m), trim).withColumn("bin", b.cast("int")).groupBy("measure", "bin").agg(F.count("*").alias("n"))


def kernel_density(m: DataFrame, points: int = 200, trim: float = 0.995, cells: int = 4096) -> DataFrame:
    """measure, at, density: the Gaussian estimate with Scott's bandwidth on an even grid over the values up to the trim quantile.

    Values are counted in `cells` cells first, whose width is far below the bandwidth, so what is summed a point doesn't grow with the
    data. A measure of one value or of values without spread has no estimate.
    """
    t = _trimmed(cut(m), trim).where("high > low")
    s = t.groupBy("measure").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd"), F.first("low").alias("low"), F.first("high").alias("high")).where("n > 1 and sd > 0")
    s = s.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    cell = F.least(F.lit(cells - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * cells))
    c = t.groupBy("measure", cell.alias("cell")).agg(F.count("*").alias("k"), F.avg("x").alias("x"))
    g = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("at", F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / (points - 1))
    z = (F.col("at") - F.col("x")) / F.col("h")
    j = F.broadcast(g).join(c, "measure")  # `points` rows a measure
    return j.groupBy("measure", "at").agg((F.sum(F.col("k") * F.exp(-z * z / 2)) / F.first("n") / F.first("h") / 2.5066282746310002).alias("density"))
