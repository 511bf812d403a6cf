"""Hand-made cases of the trajectory operators."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.functions import geo
from peregrin.operators import clean, cluster, ctqw, diffusion, grid, motion, roads, simplify
from peregrin.sources import fixes
from peregrin.sources.shapefile import Shapefile

FIX = "id long, seq long, t long, lon double, lat double"


def track(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], FIX)


def kept(d):
    return sorted(r.seq for r in d.collect())


def test_gap_splits_only_beyond_the_limit(spark):
    d = clean.gap_segments(track(spark, (0, 0.0, 0.0), (1800, 0.0, 0.0), (3601, 0.0, 0.0)), 1800)
    assert [r["sub"] for r in d.orderBy("seq").collect()] == [0, 0, 1]


def test_speed_fold_compares_with_the_last_kept(spark):
    d = track(spark, (0, 12.0, 42.0), (10, 13.0, 42.0), (20, 12.0001, 42.0))
    assert kept(clean.speed_denoise(d)) == [0, 2]


def test_stationary_and_ties(spark):
    d = track(spark, (0, 12.0, 42.0), (60, 12.0, 42.0), (60, 12.001, 42.0), (120, 12.001, 42.0))
    assert kept(clean.speed_denoise(d)) == [0, 1, 3]
    assert kept(clean.speed_denoise(d, drop_stationary=True)) == [0, 2]


def test_undefined_distance_drops_the_point(spark):
    d = track(spark, (0, 12.0, 42.0), (60, 12.0, 95.0), (120, 12.0, 42.0))
    assert kept(clean.speed_denoise(d, distance="geodesic")) == [0, 2]


def test_smoothing_averages_two_at_the_ends(spark):
    d = clean.smooth(track(spark, (0, 1.0, 1.0), (1, 2.0, 2.0), (2, 6.0, 6.0)))
    assert [r.lon for r in d.orderBy("t").collect()] == [1.5, 3.0, 4.0]


def test_point_matches_itself_at_the_first_lag(spark):
    d = track(spark, *[(500 * i, 12.0 + i * 0.01, 42.0) for i in range(10)])
    m = motion.ensemble_matches(d).where("lag = 60").collect()
    assert len(m) == 10 and all(r.d2 == 0 for r in m)


def test_least_points(spark):
    for n, rows in ((9, 0), (10, 10)):
        d = track(spark, *[(60 * i, 12.0, 42.0) for i in range(n)])
        assert motion.ensemble_matches(d).where("lag = 60").count() == rows


def test_cutoff(spark):
    c = spark.createDataFrame([(60 * i, 1.0, a) for i, a in enumerate([1.5, 1.2, 0.9, 1.0, 1.2, 0.8], 1)], "lag int, msd double, alpha double")
    assert diffusion.rebound_flags(c).where("keep").count() == 4
    assert diffusion.cutoff_log(c).first().reason == "Rebound > 0.2 (Min=0.90)"
    assert diffusion.transition(c).first().lag == 180
    short = c.limit(4)
    assert diffusion.rebound_flags(short).where("keep").count() == 4
    assert diffusion.cutoff_log(short).first().reason == "TooShort"


def test_alpha_of_a_power_law_is_its_exponent(spark):
    c = spark.createDataFrame([(60 * i, float(3 * (60 * i) ** 1.5)) for i in range(1, 30)], "lag int, msd double")
    a = [r.alpha for r in diffusion.alpha_curve(c).orderBy("lag").collect()]
    assert np.isfinite(a).all() and abs(np.median(a) - 1.5) < 0.02
    f = diffusion.power_law(c).first()
    assert f.slope == pytest.approx(1.5) and f.coefficient == pytest.approx(3.0) and f.r2 == pytest.approx(1.0)
    assert diffusion.power_law(c.limit(4)).count() == 0


def test_radius_of_gyration(spark):
    one = track(spark, (0, 12.0, 42.0))
    assert motion.radius_of_gyration(one).first().rg is None
    two = track(spark, (0, 12.0, 42.0), (1, 12.002, 42.0))
    far = float(geo.vincenty([12.0], [42.0], [12.002], [42.0])[0])
    assert motion.radius_of_gyration(two, "geodesic").first().rg == pytest.approx(far / 2, rel=1e-6)


def test_flat_extent_has_no_grid(spark):
    assert grid.density(track(spark, (0, 12.0, 42.0), (1, 12.0, 42.5))).count() == 0


def test_line_keeps_its_ends(spark):
    d = track(spark, *[(i, 12.0 + i * 0.001, 42.0) for i in range(5)])
    assert kept(simplify.simplify(d)) == [0, 4]
    bent = track(spark, (0, 12.0, 42.0), (1, 12.01, 42.01), (2, 12.02, 42.0))
    assert kept(simplify.simplify(bent)) == [0, 1, 2]


def test_vincenty_published_example():
    d = geo.vincenty([144 + 25 / 60 + 29.52440 / 3600], [-(37 + 57 / 60 + 3.72030 / 3600)], [143 + 55 / 60 + 35.38390 / 3600], [-(37 + 39 / 60 + 10.15610 / 3600)])
    assert d[0] == pytest.approx(54972.271, abs=0.01)
    assert np.isnan(geo.vincenty([0.0], [95.0], [0.0], [0.0])[0])


def test_utm(spark):
    r = spark.createDataFrame([(12.5, 41.9)], "lon double, lat double").withColumn("zone", geo.utm_zone("lon", "lat"))
    e, n = geo.utm("lon", "lat", "zone")
    r = r.select("zone", e.alias("e"), n.alias("n")).first()
    assert r.zone == 32633 and r.e == pytest.approx(292_621, abs=60) and r.n == pytest.approx(4_641_800, abs=600)


def test_best_cuts_against_all_cuts():
    rng = np.random.default_rng(1)
    x, w = np.sort(rng.random(30)), np.ones(30)
    inertia, _ = cluster.best_cuts(x, w, 3)
    sse = lambda a: ((a - a.mean()) ** 2).sum()
    assert inertia[2] == pytest.approx(min(sse(x[:i]) + sse(x[i:j]) + sse(x[j:]) for i in range(1, 29) for j in range(i + 1, 30)))


def test_noding_cuts_a_cross(spark):
    shapes = spark.createDataFrame([([[(0.0, 0.0), (10.0, 0.0)], [(5.0, -5.0), (5.0, 5.0)]],), ([[(2.0, 0.0), (4.0, 0.0)]],), (None,)], "parts array<array<struct<x:double,y:double>>>")
    e = roads.subdivide(roads.node_lines(roads.lines_of(shapes)), 100.0)
    assert {(r.x1, r.y1, r.x2, r.y2) for r in e.collect()} == {(0, 0, 2, 0), (2, 0, 4, 0), (4, 0, 5, 0), (5, 0, 10, 0), (5, -5, 5, 0), (5, 0, 5, 5)}
    nodes, edges = roads.topology(e)
    assert nodes.count() == 7 and edges.count() == 6 and roads.largest_component(edges).count() == 7
    assert {r.node_id for r in nodes.collect()} == set(range(7))


def test_last_parallel_edge_counts(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 1), (2, 1, 8.0, 2)], "from_node long, to_node long, length_m double, seq int")
    g = roads.graph(e, "seq").first()
    assert (g.u, g.v, g.length_m) == (1, 2, 8.0) and g.weight == pytest.approx(1 / 8)


def test_walk_of_two_nodes(spark):
    g = spark.createDataFrame([(1, 2, 4.0, 0.25)], "u long, v long, length_m double, weight double")
    starts = spark.createDataFrame([(1,)], "node long")
    for r in ctqw.walk_msd(g, starts, [2.0], 20).collect():
        assert r.msd == pytest.approx(np.sin(2.0 * 0.25 * r.step) ** 2, abs=1e-9)


def test_fit_finds_a_known_coupling(spark):
    edges = [(i, i + 1, 100.0, 0.01) for i in range(12)]
    g = spark.createDataFrame(edges, "u long, v long, length_m double, weight double")
    w = ctqw.Walk(edges)
    y = ctqw.simulate(w.values, w.vectors, 6, ctqw.hops_squared(13, w.edges, 6), np.array([35.0]), 40)[0] * 7
    t = 60 * np.arange(1, 41)
    log = np.gradient(np.log(y), np.log(t))
    curve = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(t, y, log, strict=True)], "lag int, msd double, alpha double")
    f = ctqw.fit_walk(g, spark.createDataFrame([(6,)], "node long"), curve)
    assert f.first().gamma == pytest.approx(35.0, abs=0.051) and ctqw.r_squared(f).first().r2 > 0.999
    assert ctqw.fit_walk(g, spark.createDataFrame([(6,)], "node long"), curve.limit(3)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("7;2014-02-01 00:00:00.739166+01;POINT(41.88 12.48)\nx;bad;none\n")
    r = fixes.load(spark, str(tmp_path / "a.txt")).orderBy(F.col("id").desc_nulls_last()).collect()
    assert (r[0].id, r[0].lon, r[0].lat) == (7, 12.48, 41.88) and r[0].time is not None and r[1].lon is None
    (tmp_path / "b.csv").write_bytes("车辆ID,经度,纬度,时间\n3,114.1,22.5,2020-01-01 00:00:00\n".encode("gbk"))
    r = fixes.load(spark, str(tmp_path / "b.csv")).first()
    assert (r.id, r.lon, r.lat) == ("3", 114.1, 22.5)
    (tmp_path / "c.csv").write_text("﻿TimeInterval,MSD_mean,Alpha_t\n60,5.0,1\n120,-1,1\n", encoding="utf-8")
    assert [tuple(x) for x in fixes.read_curve(spark, str(tmp_path / "c.csv")).collect()] == [(60.0, 5.0)]
    with pytest.raises(ValueError):
        fixes.standardise(spark.createDataFrame([(1,)], "z int"))


def test_shapefile(spark, tmp_path):
    body = struct.pack("<i4d2i", 3, 0, 0, 1, 1, 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 0, 0, 1, 1)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    spark.dataSource.register(Shapefile)
    r = spark.read.format("shapefile").load(str(tmp_path)).first()
    assert [[(p.x, p.y) for p in part] for part in r.parts] == [[(0, 0), (1, 1)]]
