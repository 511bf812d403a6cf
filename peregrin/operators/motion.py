"""Steps, trajectory statistics, radius of gyration, and three kinds of mean-squared displacement.

Lags are matched pair-first: each trajectory is joined with itself once, by id and time bucket, and each pair of points is
offered to the few lags it can serve. No lag repeats the join, and a long trajectory is many buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .clean import track, with_previous


def steps(d: DataFrame) -> DataFrame:
    """Of each point but the first: dt (s), dist_m from the point before, speed_kmh (null where dt is not positive)."""
    d = with_previous(d).where(F.col("p_t").isNotNull())
    d = d.withColumn("dt", F.col("t") - F.col("p_t")).withColumn("dist_m", geo.haversine("p_lon", "p_lat", "lon", "lat"))
    return d.withColumn("speed_kmh", F.when(F.col("dt") > 0, F.col("dist_m") / F.col("dt") * 3.6)).drop("p_t", "p_lon", "p_lat")


def summary(d: DataFrame, key: str = "id") -> DataFrame:
    """n, duration_s, distance_m, avg_speed_kmh (0 without duration) of each trajectory."""
    w = Window.partitionBy(key).orderBy("t", "seq")
    d = d.withColumn("p_lon", F.lag("lon").over(w)).withColumn("p_lat", F.lag("lat").over(w))
    s = d.groupBy(key).agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("duration_s"), F.coalesce(F.sum(geo.haversine("p_lon", "p_lat", "lon", "lat")), F.lit(0.0)).alias("distance_m"))
    return s.withColumn("avg_speed_kmh", F.when(F.col("duration_s") > 0, F.col("distance_m") / F.col("duration_s") * 3.6).otherwise(0.0))


def displacement(d: DataFrame) -> DataFrame:
    """First to last point of trajectories of two points and more that last: displacement_m, duration_min."""
    me = F.struct("t", "seq")
    at = F.struct("t", "lon", "lat")
    e = d.groupBy("id").agg(F.min_by(at, me).alias("a"), F.max_by(at, me).alias("b"), F.count("*").alias("n")).where("n > 1 and b.t > a.t")
    return e.select("id", geo.haversine("a.lon", "a.lat", "b.lon", "b.lat").alias("displacement_m"), ((F.col("b.t") - F.col("a.t")) / 60.0).alias("duration_min"))


def measures(d: DataFrame) -> DataFrame:
    """(measure, x): displacement_m, duration_min, flight_m, speed_kmh, for the distribution charts."""
    rows = lambda t, **of: t.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).alias("x")) for k, c in of.items()])).alias("r")).select("r.*")
    ends = rows(displacement(d), displacement_m="displacement_m", duration_min="duration_min")
    out = ends.union(rows(steps(d).where("dt > 0"), flight_m="dist_m", speed_kmh="speed_kmh"))
    return out.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


def radius_of_gyration(d: DataFrame, distance: str = "haversine") -> DataFrame:
    """rg of each id about the mean of its degrees; null for fewer than two valid points."""
    d = d.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    w = Window.partitionBy("id")
    d = d.withColumn("c_lon", F.avg("lon").over(w)).withColumn("c_lat", F.avg("lat").over(w))
    far = geo.haversine("c_lon", "c_lat", "lon", "lat") if distance == "haversine" else geo.geodesic("c_lon", "c_lat", "lon", "lat")
    return d.withColumn("m", far).groupBy("id").agg(F.when(F.count("m") >= 2, F.sqrt(F.avg(F.col("m") * F.col("m")))).alias("rg"))


def _pairs(d: DataFrame, horizon: int, least_points: int) -> DataFrame:
    """(id, bucket, i, j, n, gap, d2) of points i <= j in order, at most `horizon` seconds apart.

    A point goes to the bucket of its time, and offers itself to starts there and in the one before: all pairs of a start are in one
    partition of the join, which serves the grouping by start as well.
    """
    d = d.withColumn("rn", F.row_number().over(track())).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where(F.col("n") >= least_points)
    b = F.floor(F.col("t") / horizon)
    left = d.select("id", b.alias("bucket"), "n", F.col("rn").alias("i"), F.col("t").alias("t_i"), F.col("lon").alias("lon_i"), F.col("lat").alias("lat_i"))
    right = d.select("id", F.explode(F.array(b, b - 1)).alias("bucket"), F.col("rn").alias("j"), F.col("t").alias("t_j"), F.col("lon").alias("lon_j"), F.col("lat").alias("lat_j"))
    p = left.join(right, ["id", "bucket"]).where(f"j >= i and t_j - t_i <= {horizon}")
    p = p.withColumn("m", geo.haversine("lon_i", "lat_i", "lon_j", "lat_j"))
    return p.select("id", "bucket", "i", "j", "n", (F.col("t_j") - F.col("t_i")).alias("gap"), (F.col("m") * F.col("m")).alias("d2"))


def _lags(p: DataFrame, low: Column, high: Column, last: int, step: int) -> DataFrame:
    """A row for every lag (multiple of step, from low to high) that the pair can serve."""
    lo, hi = F.greatest(F.lit(1), F.ceil(low / step)).cast("int"), F.least(F.lit(last // step), F.floor(high / step)).cast("int")
    return p.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("lag", F.explode(F.expr(f"sequence({step}*lo, {step}*hi, {step})"))).drop("lo", "hi")


def _matched(p: DataFrame, order: Column, tie: Column | None = None) -> DataFrame:
    """d2 of each start's first pair in (order, tie), which are one number here: longs and doubles are aggregated in place."""
    rank = order.cast("long") * F.lit(2**40) + (F.col("j") if tie is None else tie)
    return p.groupBy("id", "bucket", "i", "lag").agg(F.min_by("d2", rank).alias("d2"))


def ensemble_matches(d: DataFrame, last: int = 7200, step: int = 60, tolerance: int = 60, least_points: int = 10, allow_self_match: bool = True) -> DataFrame:
    """The match of each point and lag: the nearest in time to the lag among this and later points, the first on a tie."""
    p = _lags(_pairs(d, last + tolerance, least_points), F.col("gap") - tolerance, F.col("gap") + tolerance, last, step)
    return _matched(p if allow_self_match else p.where("j > i"), F.abs(F.col("gap") - F.col("lag")))


def msd_ensemble(d: DataFrame, least_samples: int = 30, least_lags: int = 5, **how: int) -> DataFrame:
    """lag, msd (mean of trajectories' means), samples; none at all if fewer than least_lags lags have least_samples."""
    each = ensemble_matches(d, **how).groupBy("id", "lag").agg(F.avg("d2").alias("m"), F.count("*").alias("k"))
    out = each.groupBy("lag").agg(F.avg("m").alias("msd"), F.sum("k").alias("samples")).where(F.col("samples") >= least_samples)
    return _guard(out, least_lags)


def msd_pooled(d: DataFrame, last: int = 7200, step: int = 60, tolerance: int = 60, least_points: int = 10, least_samples: int = 30, least_lags: int = 5) -> DataFrame:
    """lag, msd over all samples, samples. Of the last point before the target and the first at or after it the nearer counts, the former on a tie; the last point of a trajectory starts nothing."""
    p = _lags(_pairs(d, last + tolerance, least_points).where("i < n"), F.col("gap") - tolerance, F.col("gap") + tolerance, last, step)
    after = F.col("gap") >= F.col("lag")
    m = _matched(p, 2 * F.abs(F.col("gap") - F.col("lag")) + after.cast("int"), F.when(after, F.col("j")).otherwise(2**40 - 1 - F.col("j")))
    out = m.groupBy("lag").agg(F.avg("d2").alias("msd"), F.count("*").alias("samples")).where(F.col("samples") >= least_samples)
    return _guard(out, least_lags)


def _guard(curve: DataFrame, least: int) -> DataFrame:
    """The curve (a row a lag, so one partition holds it), if it has enough lags."""
    return curve.withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(1)))).where(F.col("__n") >= least).drop("__n")


def msd_individual(d: DataFrame, last: int = 3600, step: int = 60, least_points: int = 10, least_lags: int = 5) -> DataFrame:
    """id, lag, msd of each trajectory: the first point at or after the target counts, if within max(30 s, a tenth of the lag); lags below the duration."""
    span = d.groupBy("id").agg((F.max("t") - F.min("t")).alias("duration"))
    p = _lags(_pairs(d, last + last // 10, least_points), F.col("gap") / 1.1 - 30, F.col("gap"), last, step)
    m = _matched(p.where(F.col("gap") - F.col("lag") <= F.greatest(F.lit(30), F.col("lag") / 10)), F.col("gap"))
    curve = m.groupBy("id", "lag").agg(F.avg("d2").alias("msd")).where("msd > 0").join(span, "id").where("lag < duration")
    return curve.withColumn("k", F.count("*").over(Window.partitionBy("id"))).where(F.col("k") >= least_lags).select("id", "lag", "msd")
