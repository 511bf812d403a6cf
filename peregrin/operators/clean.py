"""Cleaning: filters, re-identification by gaps, folds over a trajectory, smoothing.

Fixes are rows id, seq, t (seconds), lon, lat and whatever else; a trajectory is the rows of an id in the order (t, seq).
Windows share that partitioning, so a chain of them shuffles once. Folds that must know the last *kept* point stream over sorted
partitions, batch by batch, and carry that point along; everything else is expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import asin, cos, isnan, sin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ranks import numbered, quantiles

ORDER = ("t", "seq")


def track(key: str = "id") -> Window:
    return Window.partitionBy(key).orderBy(*ORDER)


def previous(c: str) -> Column:
    return F.lag(c).over(track())


def with_previous(d: DataFrame, ahead: bool = False) -> DataFrame:
    """p_t, p_lon, p_lat of the point before; with ahead also n_t, n_lon, n_lat of the next."""
    for c in ("t", "lon", "lat"):
        d = d.withColumn(f"p_{c}", F.lag(c).over(track()))
        if ahead:
            d = d.withColumn(f"n_{c}", F.lead(c).over(track()))
    return d


def drop_nulls_and_range(d: DataFrame) -> DataFrame:
    """Rows with time and a position inside plus or minus 90 and 180 degrees; NaN counts as null."""
    d = d.dropna(subset=["t", "lon", "lat"])
    return d.where(~F.isnan("lon") & ~F.isnan("lat") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def swap_repair(d: DataFrame, strict: bool = True) -> DataFrame:
    """Exchange lon and lat of the whole table if latitudes exceed 90 (strict: and longitudes would be latitudes)."""
    m = d.agg(F.max(F.abs("lat")).alias("m_lat"), F.max(F.abs("lon")).alias("m_lon"))
    cond = (F.col("m_lat") > 90) & (F.col("m_lon") <= 90) if strict else F.col("m_lat") > 90
    d = d.crossJoin(F.broadcast(m))  # one row
    return d.withColumn("x", F.when(cond, F.col("lat")).otherwise(F.col("lon"))).withColumn("lat", F.when(cond, F.col("lon")).otherwise(F.col("lat"))).withColumn("lon", F.col("x")).drop("x", "m_lat", "m_lon")


def auto_bbox(d: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows within the exact quantiles of both axes over the whole table, inclusive."""
    q = quantiles(d, {"lon": [low, high], "lat": [low, high]}).get(None, {})
    for c, (least, most) in q.items():
        d = d.where((F.col(c) >= least) & (F.col(c) <= most))
    return d


#: The box of the cities' fixes.
WEST, EAST, SOUTH, NORTH = 113, 115, 22, 23


def fixed_bbox(d: DataFrame, west: float = WEST, east: float = EAST, south: float = SOUTH, north: float = NORTH) -> DataFrame:
    return d.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def _ordinal(d: DataFrame, breaks: Column, name: str) -> DataFrame:
    w = track().rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("brk", F.when(breaks, 1).otherwise(0)).withColumn(name, F.sum("brk").over(w).cast("int")).drop("brk")


def gap_segments(d: DataFrame, gap_s: int = 1800) -> DataFrame:
    """sub: ordinal of the segment, new where the gap to the point before exceeds gap_s; seg_id: id_sub."""
    return _ordinal(d, F.col("t") - previous("t") > gap_s, "sub").withColumn("seg_id", F.concat_ws("_", "id", "sub"))


def reindex_by_distance(d: DataFrame, metres: float = 5000) -> DataFrame:
    """A new part where the jump from the point before exceeds `metres`."""
    d = with_previous(d)
    return _ordinal(d, geo.haversine("p_lon", "p_lat", "lon", "lat") > metres, "part").drop("p_t", "p_lon", "p_lat")


def drift_clean(d: DataFrame, speed: float = 120, metres: float = 2000, degrees: float = 30) -> DataFrame:
    """Drop points too fast (or too far) to reach from and leave to both neighbours while these fit each other, and spikes of a turn below `degrees`."""
    d = with_previous(d, ahead=True)
    far = {"a": geo.haversine("p_lon", "p_lat", "lon", "lat"), "b": geo.haversine("lon", "lat", "n_lon", "n_lat"), "c": geo.haversine("p_lon", "p_lat", "n_lon", "n_lat")}
    for k, v in far.items():
        d = d.withColumn(f"d_{k}", v)
    rate = lambda k, dt: F.when(dt > 0, F.col(f"d_{k}") / dt * 3.6)
    fast = (rate("a", F.col("t") - F.col("p_t")) > speed) & (rate("b", F.col("n_t") - F.col("t")) > speed) & (rate("c", F.col("n_t") - F.col("p_t")) <= speed)
    away = (F.col("d_a") > metres) & (F.col("d_b") > metres) & (F.col("d_c") <= metres)
    cos = (F.col("d_a") ** 2 + F.col("d_b") ** 2 - F.col("d_c") ** 2) / (2 * F.col("d_a") * F.col("d_b"))
    spike = F.when((F.col("d_a") > 0) & (F.col("d_b") > 0), cos > float(np.cos(np.radians(degrees))))
    return d.where(~(F.coalesce(fast, F.lit(False)) | F.coalesce(away, F.lit(False)) | F.coalesce(spike, F.lit(False)))).drop("p_t", "p_lon", "p_lat", "n_t", "n_lon", "n_lat", "d_a", "d_b", "d_c")


def redundant_clean(d: DataFrame) -> DataFrame:
    """Drop points at the place of both neighbours."""
    d = with_previous(d, ahead=True)
    same = (F.col("p_lon") == F.col("lon")) & (F.col("p_lat") == F.col("lat")) & (F.col("n_lon") == F.col("lon")) & (F.col("n_lat") == F.col("lat"))
    return d.where(~F.coalesce(same, F.lit(False))).drop("p_t", "p_lon", "p_lat", "n_t", "n_lon", "n_lat")


def _hav(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    r = 0.017453292519943295
    f, g = sin((lat2 - lat1) * r / 2), sin((lon2 - lon1) * r / 2)
    return 2 * 6371000.0 * asin(sqrt(min(1.0, f * f + cos(lat1 * r) * cos(lat2 * r) * g * g)))


def _geo(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    return float(geo.vincenty(np.array([lon1]), np.array([lat1]), np.array([lon2]), np.array([lat2]))[0])


def _geo_steps(lon: np.ndarray, lat: np.ndarray) -> list[float]:
    """Metres from each point to the next."""
    return geo.vincenty(lon[:-1], lat[:-1], lon[1:], lat[1:]).tolist()


#: Of a pair of points, and where it pays of all neighbours at a time.
DISTANCES: dict[str, tuple[Callable[[float, float, float, float], float], Callable[[np.ndarray, np.ndarray], list[float]] | None]] = {"haversine": (_hav, None), "geodesic": (_geo, _geo_steps)}


def fold(d: DataFrame, keep: Callable[[float, float], bool], distance: str = "haversine", same_drops: bool = False) -> DataFrame:
    """Keep the first point of each trajectory and every point for which keep(seconds, metres since the last kept one) holds.

    keep gets NaN metres where the distance is not defined. same_drops: a point at the place of the last kept one goes first.
    Partitions are sorted by id and time and read as a stream, so a trajectory may be of any length: only the last kept point is held.
    """
    far, steps = DISTANCES[distance]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, lt, lx, ly = None, 0.0, 0.0, 0.0
        for b in batches:
            ids, t, x, y = (b.column(c).to_pylist() for c in ("id", "t", "lon", "lat"))
            ahead = steps(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))) if steps and b.num_rows else None
            mask, last = [], -2
            for i in range(b.num_rows):
                stays = i == 0 and me is None or ids[i] != me
                if not stays and not (same_drops and x[i] == lx and y[i] == ly):
                    stays = keep(t[i] - lt, ahead[last] if ahead and last == i - 1 else far(lx, ly, x[i], y[i]))
                mask.append(stays)
                if stays:
                    me, lt, lx, ly, last = ids[i], t[i], x[i], y[i], i
            yield b.filter(pa.array(mask, pa.bool_()))

    return d.where("id is not null").repartition("id").sortWithinPartitions("id", *ORDER).mapInArrow(run, d.schema)


def speed_denoise(d: DataFrame, limit_kmh: float = 150, drop_stationary: bool = False, distance: str = "haversine") -> DataFrame:
    """Drop points not later than the last kept one, or not reachable from it within the limit."""
    return fold(d, lambda s, m: s > 0 and m / s * 3.6 <= limit_kmh, distance, drop_stationary)


def min_spacing(d: DataFrame, metres: float = 30, distance: str = "haversine") -> DataFrame:
    """Keep points at least `metres` from the last kept one."""
    return fold(d, lambda s, m: not isnan(m) and m >= metres, distance)


def smooth(d: DataFrame, key: str = "id") -> DataFrame:
    """Centred mean of three (two at the ends) for each axis; trajectories of fewer than three points stay as they are."""
    w = track(key).rowsBetween(-1, 1)
    n = F.count("*").over(Window.partitionBy(key))
    mean = lambda c: F.when(n >= 3, F.avg(c).over(w)).otherwise(F.col(c))
    return d.select(*[c for c in d.columns if c not in ("lon", "lat")], mean("lon").alias("lon"), mean("lat").alias("lat"))


def at_least(d: DataFrame, n: int = 5, key: str = "id") -> DataFrame:
    return d.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where(F.col("__n") >= n).drop("__n")


def at_most_duration(d: DataFrame, hours: float = 3, key: str = "seg_id") -> DataFrame:
    w = Window.partitionBy(key)
    return d.withColumn("__s", F.max("t").over(w) - F.min("t").over(w)).where(F.col("__s") <= hours * 3600).drop("__s")


def dense_renumber(d: DataFrame, key: str = "id") -> DataFrame:
    """new_id from 1 in the order of the ids."""
    ids = numbered(d.select(key).distinct(), key).select(key, (F.col("n") + 1).alias("new_id"))
    return d.join(ids, key)


def clean_segments(d: DataFrame, gap_s: int = 1800, hours: float = 3, limit_kmh: float = 150, drop_stationary: bool = False, distance: str = "haversine") -> DataFrame:
    """The chain: bbox, speed, gaps, at least five points, duration, smoothing. The id becomes id_sub."""
    before = 2 if drop_stationary else 5
    d = at_least(auto_bbox(drop_nulls_and_range(swap_repair(d))), before)
    d = at_least(speed_denoise(d, limit_kmh, drop_stationary, distance), 5)
    d = at_most_duration(at_least(gap_segments(d, gap_s), 5, "seg_id"), hours)
    return smooth(d, "seg_id").withColumn("id", F.col("seg_id")).drop("seg_id", "sub")


def some_ids(d: DataFrame, n: int = 50, seed: int = 42, key: str = "id") -> DataFrame:
    """The rows of n ids, chosen by a seeded hash: the preview of individual curves (fewer ids are all kept)."""
    ids = d.where(F.col(key).isNotNull()).select(key).distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
    return d.join(F.broadcast(ids), key, "left_semi")  # n rows


def process(d: DataFrame, gap_s: int = 1800, metres: float = 5000, tolerance: float = 20, spacing: float = 30, least: int = 5, **drift: float) -> DataFrame:
    """The preprocessing chain: drop nulls and ranges, part trajectories at gaps and jumps, drop drift and points that add nothing, simplify,
    keep trajectories of `least` points, number them from 1 (new_id) in the order of their parts."""
    from .simplify import simplify

    d = drop_nulls_and_range(d).select("id", "seq", "t", "lon", "lat")
    part = lambda d, by: d.withColumn("id", F.concat_ws("_", "id", by)).select("id", "seq", "t", "lon", "lat")
    d = part(reindex_by_distance(part(gap_segments(d, gap_s), "sub"), metres), "part")
    d = simplify(redundant_clean(drift_clean(d, **drift)), tolerance, spacing)
    return dense_renumber(at_least(d, least))
