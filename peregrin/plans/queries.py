"""Every operator applied to the driver's tables. Doubles are rounded, as engines may sum in another order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lineage import cut
from ..operators import clean, cluster, ctqw, diffusion, grid, motion, roads, simplify
from .adapter import grid_graph, points

FIX = ["id", "seq", "t", "lon", "lat"]
GAP, CELL = 300, 400.0


def _r(places: int, **columns: object) -> list:
    return [F.round(c, places).alias(k) for k, c in columns.items()]


def _gaps(d: DataFrame) -> DataFrame:
    return clean.gap_segments(d, GAP)


def _smooth(d: DataFrame) -> DataFrame:
    return clean.smooth(_gaps(d), "seg_id").select("seg_id", "seq", *_r(6, lon="lon", lat="lat"))


def _summary(d: DataFrame, key: str = "id") -> DataFrame:
    return motion.summary(d, key).select(key, "n", "duration_s", *_r(3, distance_m="distance_m", avg_speed_kmh="avg_speed_kmh"))


def _curve(d: DataFrame) -> DataFrame:
    return diffusion.alpha_curve(motion.msd_ensemble(d).select("lag", "msd"))


def _individual(d: DataFrame) -> DataFrame:
    return diffusion.alpha_curve(motion.msd_individual(d), ["id"], 5)


def _individual_summary(d: DataFrame) -> DataFrame:
    fitted = diffusion.power_law(motion.msd_individual(d), ["id"])
    s = motion.summary(d).join(fitted, "id")
    return s.select("id", F.col("n").alias("points_count"), "duration_s", *_r(3, distance_m="distance_m", avg_speed_kmh="avg_speed_kmh", diffusion_coeff="coefficient"), *_r(6, global_alpha="slope", r_squared="r2"))


def _labelled(d: DataFrame) -> DataFrame:
    return cluster.clusters(motion.radius_of_gyration(d))


def _starts(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes, edges = (cut(x) for x in grid_graph(d, CELL))
    inside = roads.largest_component(edges).select("node")
    g = roads.graph(edges)
    g = cut(g.join(inside.withColumnRenamed("node", "u"), "u", "left_semi"))
    return g, roads.start_nodes(nodes.join(inside, F.col("node_id") == F.col("node"), "left_semi"), g)


def _hops(d: DataFrame) -> DataFrame:
    return roads.hops(*_starts(d))


def _walk(d: DataFrame) -> DataFrame:
    g, starts = _starts(d)
    return ctqw.walk_msd(g, starts, ctqw.COARSE.tolist()).select("start", "gamma", "step", *_r(6, msd="msd"))


def _fit(d: DataFrame) -> DataFrame:
    g, starts = _starts(d)
    return ctqw.fit_walk(g, starts, _curve(d))


def _subdivided(d: DataFrame) -> DataFrame:
    nodes, edges = grid_graph(d, CELL)
    a, b = (nodes.select(F.col("node_id").alias(i), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for i, k in (("from_node", 1), ("to_node", 2)))
    end = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    s = edges.join(a, "from_node").join(b, "to_node").select("from_node", "to_node", F.array(end(1), end(2)).alias("points"))
    return roads.subdivide(s, 800.0).select("from_node", "to_node", "k", *_r(4, x1="x1", y1="y1", x2="x2", y2="y2"))


def _noded(d: DataFrame) -> DataFrame:
    """Edges of a network: each trajectory's way through the cells of 1600 m as a polyline, noded and subdivided."""
    c = grid.cells(d, 1600.0).select("id", "t", "seq", (F.col("loncol") * 100.0).alias("x"), (F.col("latcol") * 100.0).alias("y"))
    way = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "x", "y"))).alias("p"))  # of one trajectory
    shapes = way.select(F.array(F.transform("p", lambda q: F.struct(q["x"], q["y"]))).alias("parts"))
    lines = cut(roads.lines_of(shapes))
    return cut(roads.subdivide(roads.node_lines(lines), 150.0))


def _swapped(d: DataFrame) -> DataFrame:
    turned = d.select("id", "seq", "t", (F.col("lat") + 60).alias("lon"), F.col("lon").alias("lat"))
    return clean.swap_repair(turned.select("id", "seq", "t", F.col("lat").alias("lon"), F.col("lon").alias("lat"))).select(*FIX)


def _holes(d: DataFrame) -> DataFrame:
    lon = F.when(F.col("seq") % 7 == 0, None).when(F.col("seq") % 11 == 0, F.lit(500.0)).otherwise(F.col("lon"))
    return clean.drop_nulls_and_range(d.withColumn("lon", lon)).select(*FIX)


def _duration(d: DataFrame) -> DataFrame:
    return clean.at_most_duration(_gaps(d), 0.5).select("seg_id", "seq", "t")


PLANS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "traj_points": lambda d: d,
    "step_speed": lambda d: motion.steps(d).where("dt > 0").select("id", "seq", "dt", *_r(3, dist_m="dist_m", speed_kmh="speed_kmh")),
    "gap_segments": lambda d: _gaps(d).select("id", "seq", "t", "sub", "seg_id"),
    "segment_summary": lambda d: _summary(_gaps(d), "seg_id"),
    "bbox_filter": lambda d: clean.auto_bbox(d).select(*FIX),
    "latlon_swap_fix": _swapped,
    "null_and_range_filter": _holes,
    "id_reindex_disgap": lambda d: clean.reindex_by_distance(d, 500).select("id", "seq", "part"),
    "id_reindex_timegap": lambda d: clean.dense_renumber(_gaps(d), "seg_id").select("seg_id", "seq", "new_id"),
    "drift_clean": lambda d: clean.drift_clean(d).select(*FIX),
    "redundant_clean": lambda d: clean.redundant_clean(d).select(*FIX),
    "speed_denoise_a": lambda d: clean.speed_denoise(d).select(*FIX),
    "speed_denoise_b": lambda d: clean.speed_denoise(d, drop_stationary=True).select(*FIX),
    "duration_filter": _duration,
    "rolling_smooth": _smooth,
    "min_spacing": lambda d: clean.min_spacing(d, 300).select(*FIX),
    "dense_renumber": lambda d: clean.dense_renumber(clean.at_least(d, 5)).select("id", "seq", "new_id"),
    "traj_displacement_duration": lambda d: motion.displacement(d).select("id", *_r(3, displacement_m="displacement_m", duration_min="duration_min")),
    "dist_summary": lambda d: grid.distribution_summary(motion.measures(d)).select("measure", "n", *_r(3, mean="mean", median="median", largest="largest", trim_at="trim_at")),
    "dist_histogram": lambda d: grid.histogram(motion.measures(d)),
    "msd_pooled": lambda d: motion.msd_pooled(d).select("lag", "samples", *_r(3, msd="msd")),
    "msd_ensemble": lambda d: motion.msd_ensemble(d).select("lag", "samples", *_r(3, msd="msd")),
    "msd_individual_summary": _individual_summary,
    "msd_individual_curves": lambda d: _individual(d).select("id", F.col("lag").alias("tau"), *_r(3, msd="msd"), *_r(6, alpha_local="alpha")),
    "alpha_curve": lambda d: _curve(d).select("lag", *_r(3, msd="msd"), *_r(6, alpha="alpha")),
    "rebound_cutoff_flags": lambda d: diffusion.rebound_flags(_curve(d)).select("lag", "hit", "keep", *_r(6, run_min="run_min")),
    "transition_point": lambda d: diffusion.transition(_curve(d)).select("lag", *_r(6, alpha="alpha")),
    "power_law_fit": lambda d: diffusion.power_law(motion.msd_ensemble(d)).select(*_r(6, slope="slope", r2="r2"), *_r(3, coefficient="coefficient")),
    "diffusion_regime": lambda d: _curve(d).groupBy(diffusion.regime(F.col("alpha")).alias("regime")).agg(F.count("*").alias("n")),
    "cutoff_log": lambda d: diffusion.cutoff_log(_curve(d)),
    "rg_summary": lambda d: motion.radius_of_gyration(d).where("rg is not null").select("id", *_r(3, rg="rg")),
    "rg_elbow": lambda d: cluster.elbow(motion.radius_of_gyration(d)).select("k", *_r(6, inertia="inertia")),
    "rg_clusters": lambda d: _labelled(d).select("id", "cluster", *_r(3, rg="rg")),
    "cluster_split_counts": lambda d: d.join(_labelled(d).select("id", "cluster"), "id").groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")),
    "rg_boxplot": lambda d: cluster.box_plot(_labelled(d)).select("cluster", "n", *_r(3, q1="q1", q2="q2", q3="q3", low="low", high="high")),
    "dist_kernel_density": lambda d: grid.kernel_density(motion.measures(d), 50).select("measure", *_r(3, at="at"), *_r(8, density="density")),
    "clean_segments": lambda d: clean.clean_segments(d, GAP).select("id", "seq", "t", *_r(6, lon="lon", lat="lat")),
    "process_chain": lambda d: clean.process(d, GAP, 500).select("id", "seq", "t", "lon", "lat", "new_id"),
    "curve_preview": lambda d: clean.some_ids(_individual(d)).select("id", "lag", *_r(3, msd="msd"), *_r(6, alpha="alpha")),
    "road_network_nodes": lambda d: roads.topology(_noded(d))[0],
    "road_network_edges": lambda d: roads.topology(_noded(d))[1].select("from_node", "to_node", *_r(3, length_m="length_m")),
    "ctqw_result": lambda d: ctqw.result_table(_fit(d)),
    "grid_density": lambda d: grid.density(d, 40),
    "grid_high_density": lambda d: grid.dense_fixes(d, CELL).select("id", "seq", "loncol", "latcol"),
    "grid_quantile_classes": lambda d: grid.quantile_classes(grid.density(d, CELL)),
    "grid_polygons": lambda d: grid.polygons(d, CELL).select("loncol", "latcol", "n", *_r(6, west="west", south="south", east="east", north="north")),
    "dp_simplify": lambda d: simplify.simplify(d).select(*FIX),
    "grid_graph_nodes": lambda d: grid_graph(d, CELL)[0],
    "grid_graph_edges": lambda d: grid_graph(d, CELL)[1].select("from_node", "to_node", *_r(3, length_m="length_m")),
    "edge_subdivide": _subdivided,
    "largest_component": lambda d: roads.largest_component(grid_graph(d, CELL)[1]).select("node", "component"),
    "node_degree_top": lambda d: roads.degrees(roads.graph(grid_graph(d, CELL)[1])).orderBy(F.desc("degree"), "node").limit(15),
    "start_nodes": lambda d: _starts(d)[1],
    "hop_distance": _hops,
    "ctqw_msd": _walk,
    "ctqw_fit": _fit,
    "geodesic_vs_haversine": lambda d: clean.with_previous(d).where("p_t is not null").select("id", "seq", *_r(3, sphere_m=geo.haversine("p_lon", "p_lat", "lon", "lat"), ellipsoid_m=geo.geodesic("p_lon", "p_lat", "lon", "lat"))),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, plan=plan: plan(points(spark, sf_dir)) for name, plan in PLANS.items()}
