"""Published curves, roads with bends, readers and sinks of mixed files, exact ranks, whole chains."""

import csv
import itertools
import threading
from collections import Counter
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.functions import geo
from peregrin.functions.ranks import numbered, quantiles
from peregrin.operators import clean, cluster, ctqw, diffusion, grid, motion, roads
from peregrin.operators.simplify import key_points
from peregrin.plans import queries
from peregrin.plans.adapter import points
from peregrin.sources import fixes
from peregrin.sources.shapefile import Shapefile

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.1"
FIX = "id long, seq long, t long, lon double, lat double"
#: Fixed values of the published curves: transition (lag, alpha), slope and coefficient and R2 of the power law.
PUBLISHED = {1: (780, 0.931475, 1.197902, 2285.7197, 0.954402), 2: (780, 0.897472, 1.369371, 2648.4395, 0.963785), 3: (900, 0.963911, 1.382864, 5449.0016, 0.953032)}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_published_curves(spark, k):
    path = Path(__file__).parent / f"curves/curve{k}.csv"
    with open(path, encoding="utf-8-sig") as f:
        said = [(int(r["TimeInterval"]), float(r["Alpha_t"])) for r in csv.DictReader(f)]
    curve = fixes.read_curve(spark, str(path))
    got = {r.lag: r.alpha for r in diffusion.alpha_curve(curve).collect()}
    assert len(got) == len(said)
    for lag, alpha in said[:-4]:  # the curves were cut after their exponents were computed
        assert got[lag] == pytest.approx(alpha, abs=1e-9)
    whole = spark.createDataFrame([(lag, a) for lag, a in said], "lag int, alpha double").join(curve.select(F.col("lag").cast("int").alias("lag"), "msd"), "lag")
    lag, alpha, slope, coefficient, r2 = PUBLISHED[k]
    t = diffusion.transition(whole).first()
    assert t.lag == lag and t.alpha == pytest.approx(alpha, abs=1e-6) and diffusion.rebound_flags(whole).where("keep").count() == len(said)
    f = diffusion.power_law(curve).first()
    assert (round(f.slope, 6), round(f.coefficient, 4), round(f.r2, 6)) == (slope, coefficient, r2)


def test_utm_of_known_points(spark):
    """The meridian arc to 45 degrees and the equator's edge of a zone, as published to the millimetre."""
    rows = [(9.0, 45.0, 32632, 500000.0, 4982950.400), (6.0, 0.0, 32632, 166021.443, 0.0), (12.0, 0.0, 32632, 833978.557, 0.0), (9.0, -45.0, 32732, 500000.0, 1e7 - 4982950.400)]
    d = spark.createDataFrame([r[:3] for r in rows], "lon double, lat double, zone int")
    e, n = geo.utm("lon", "lat", "zone")
    for r, (_, _, _, east, north) in zip(d.select(e.alias("e"), n.alias("n")).collect(), rows, strict=True):
        assert r.e == pytest.approx(east, abs=0.002) and r.n == pytest.approx(north, abs=0.002)


def test_segment_distance(spark):
    d = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0, 2.0, 0.0), (3.0, 0.0, 0.0, 0.0, 2.0, 0.0), (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)], "a double, b double, c double, d double, e double, f double")
    assert [r[0] for r in d.select(geo.segment_distance(*map(F.col, "abcdef"))).collect()] == [1.0, 1.0, 5.0]


def shapes(spark, *lines):
    return spark.createDataFrame([([[{"x": float(x), "y": float(y)} for x, y in line]],) for line in lines], f"parts array<{roads.POINTS}>")


def ways(d):
    return {tuple((p.x, p.y) for p in r.points) for r in d.select("points").collect()}


def test_noding_keeps_bends(spark):
    bend = [(0, 0), (100, 0), (100, 100), (200, 100)]
    assert ways(roads.node_lines(roads.lines_of(shapes(spark, bend)))) == {tuple((float(x), float(y)) for x, y in bend)}
    crossed = roads.node_lines(roads.lines_of(shapes(spark, bend, [(50, 50), (150, 50)], [(200, 100), (100, 100)])))
    assert ways(crossed) == {((0, 0), (100, 0), (100, 50)), ((100, 50), (100, 100)), ((100, 100), (200, 100)), ((50, 50), (100, 50)), ((100, 50), (150, 50))}
    ring = roads.node_lines(roads.lines_of(shapes(spark, [(0, 0), (10, 0), (10, 10), (0, 0)])))
    assert len(ways(ring)) == 1 and len(next(iter(ways(ring)))) == 4
    eight = roads.node_lines(roads.lines_of(shapes(spark, [(0, 0), (10, 10), (10, 0), (0, 10)])))
    assert ways(eight) == {((0, 0), (5, 5)), ((5, 5), (10, 0), (10, 10), (5, 5)), ((0, 10), (5, 5))} or len(ways(eight)) == 3


def test_long_diagonal_meets_all_it_crosses(spark):
    r = np.random.default_rng(3)
    lines = [[(0, 0), (40_000, 30_000)]] + [[(x, 0.75 * x - 50), (x + 1, 0.75 * x + 50)] for x in r.integers(100, 39_000, 60).tolist()]
    got = ways(roads.node_lines(roads.lines_of(shapes(spark, *lines))))
    assert len(got) == 3 * len({tuple(x[0]) for x in lines[1:]}) + 1


@contextmanager
def within(spark, seconds):
    """Jobs are cancelled, and so fail, after that time."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_copies_of_a_line_do_not_meet_in_pairs(spark):
    lines = [[(0, 0), (100, 0), (100, 100)], [(100, 100), (100, 0), (0, 0)], [(50, -50), (50, 50)]]
    many = shapes(spark, *lines).crossJoin(spark.range(20_000)).select("parts")
    with within(spark, 100):
        got = ways(roads.node_lines(roads.lines_of(many)))
    assert got == ways(roads.node_lines(roads.lines_of(shapes(spark, *lines)))) == {((0, 0), (50, 0)), ((50, 0), (100, 0)), ((100, 0), (100, 100)), ((50, -50), (50, 0)), ((50, 0), (50, 50))}


def lattice_edges(walks):
    """Ends (lesser first) and length of the edges that walks along a lattice of 100 m give, in plain Python."""
    walks = [[p for i, p in enumerate(w) if not i or w[i - 1] != p] for w in walks]
    ends = Counter(p for w in walks for s in itertools.pairwise(w) for p in s)
    pieces = set()
    for w in walks:
        assert all(abs(a - c) + abs(b - d) == 100 for (a, b), (c, d) in itertools.pairwise(w))
        cuts = [0, *(i for i in range(1, len(w) - 1) if ends[w[i]] > 2), len(w) - 1]
        pieces |= {min(x, x[::-1]) for i, j in itertools.pairwise(cuts) if i < j for x in [tuple(w[i : j + 1])]}
    edges = []
    for x in pieces:
        n = -(-(len(x) - 1) * 100 // 150)
        at = [(len(x) - 1) * k / n for k in range(n + 1)]
        spots = [x[-1] if k == n else tuple(a + (b - a) * (v % 1) for a, b in zip(x[int(v)], x[int(v) + 1], strict=True)) for k, v in enumerate(at)]
        edges += [(*sorted(tuple(round(c, 4) for c in p) for p in (a, b)), 100.0 * (len(x) - 1) if n == 1 else float(np.hypot(b[0] - a[0], b[1] - a[1]))) for a, b in itertools.pairwise(spots)]
    return [e for e in edges if e[2] > 0]


@pytest.fixture(scope="module")
def walked(spark):
    c = grid.cells(points(spark, LARGER), 1600.0).select("id", "t", "seq", "loncol", "latcol").collect()
    return lattice_edges([[(100.0 * r.loncol, 100.0 * r.latcol) for r in g] for _, g in itertools.groupby(sorted(c), lambda r: r.id)])


def test_road_network_edges_of_many_walks(spark, walked):
    with within(spark, 100):
        got = queries.queries()["road_network_edges"](spark, LARGER).collect()
    ids = {p: i for i, p in enumerate(sorted({p for e in walked for p in e[:2]}))}
    assert sorted((*sorted((r.from_node, r.to_node)), r.length_m) for r in got) == sorted((ids[a], ids[b], round(m, 3)) for a, b, m in walked)


def test_road_network_nodes_of_many_walks(spark, walked):
    with within(spark, 100):
        got = queries.queries()["road_network_nodes"](spark, LARGER).collect()
    assert sorted((r.node_id, r.x, r.y) for r in got) == [(i, *p) for i, p in enumerate(sorted({p for e in walked for p in e[:2]}))]


def test_points_of_a_long_line(spark):
    d = spark.range(1).select(F.expr("array(transform(sequence(0, 199999), i -> if(i % 5 = 4, null, struct(double(i div 2) as x, double(i % 3) as y)))) as parts"))
    d = d.union(shapes(spark, [(1, 1), (1, 1)], [(1, 1), (1, 2), (1, 2), (1, 1)]))
    want = [(float(i // 2), float(i % 3)) for i in range(200_000) if i % 5 != 4]
    with within(spark, 100):
        got = sorted((tuple(map(tuple, r.points)) for r in roads.lines_of(d).collect()), key=len)
    assert got == [((1, 1), (1, 2), (1, 1)), tuple(p for i, p in enumerate(want) if not i or want[i - 1] != p)]


def test_subdivision_goes_along_the_line(spark):
    lines = roads.lines_of(shapes(spark, [(0, 0), (300, 0), (300, 400)], [(0, 1), (0, 2)]))
    e = {(r.x1, r.y1, r.x2, r.y2): r.length_m for r in roads.subdivide(lines, 300).collect()}
    third = 700 / 3
    assert e.pop((0.0, 1.0, 0.0, 2.0)) == 1.0
    ends = [(0.0, 0.0), (third, 0.0), (300.0, 2 * third - 300), (300.0, 400.0)]
    assert len(e) == 3
    for (a, b), (k, m) in zip(zip(ends, ends[1:], strict=False), sorted(e.items(), key=lambda x: x[0][0] + x[0][1]), strict=True):
        assert k == pytest.approx((*a, *b)) and m == pytest.approx(np.hypot(b[0] - a[0], b[1] - a[1]))


def test_network_round_trip(spark, tmp_path):
    """A curved street and a crossing one, in degrees; written as shapefiles and read back as a graph."""
    street = [(12.50 + i * 0.0005, 41.9 + 0.0003 * np.sin(i)) for i in range(12)]
    nodes, edges, code = roads.network(shapes(spark, street, [(12.5025, 41.89), (12.5025, 41.91)], [(12.5, 41.9), (12.5, 41.9)]))
    assert code == 32633 and nodes.count() == 5 + edges.where("length_m > 0").count() - 4
    spark.dataSource.register(Shapefile)
    nodes.write.format("shapefile").option("crs", "PROJCS[x]").mode("append").save(str(tmp_path / "n"))
    edges.write.format("shapefile").mode("append").save(str(tmp_path / "e"))
    back = [spark.read.format("shapefile").load(str(tmp_path / x)) for x in "ne"]
    assert back[0].select("crs").distinct().collect()[0].crs == "PROJCS[x]" and not list(tmp_path.glob("*/.part*"))
    n, e = roads.network_tables(*back)
    assert sorted(map(tuple, n.collect())) == sorted((r.node_id, r.x, r.y) for r in nodes.collect())
    assert sorted((r.from_node, r.to_node, r.length_m) for r in e.collect()) == sorted((r.from_node, r.to_node, r.length_m) for r in edges.collect())
    assert sorted(map(str, back[1].select("parts").collect())) == sorted(map(str, edges.select(F.array("points").alias("parts")).collect()))


def test_zone_without_lines(spark):
    none = shapes(spark, [(0, 0), (0, 0)])
    assert roads.utm_code(roads.lines_of(none)) is None and roads.network(none)[0].count() == 0
    assert roads.utm_code(roads.lines_of(shapes(spark, [(500, 0), (600, 0)]))) == 3857
    assert roads.utm_code(roads.lines_of(shapes(spark, [(-70.5, -33.1), (-70.4, -33.2)]))) == 32719


def test_components_of_a_long_path(spark):
    e = spark.range(500).select(F.col("id").alias("from_node"), (F.col("id") + 1).alias("to_node")).union(spark.createDataFrame([(10**15, 10**15 + 1)], "a long, b long"))
    assert {tuple(r) for r in roads.component_labels(e).groupBy("component").count().collect()} == {(0, 501), (10**15, 2)}
    g = e.withColumnsRenamed({"from_node": "u", "to_node": "v"}).where("u < 20")
    got = {r.node: r.hops for r in roads.hops(g, spark.createDataFrame([(3,)], "node long")).collect()}
    assert got == {i: abs(i - 3) for i in range(21)}


def test_quantiles_and_numbers(spark, monkeypatch):
    from peregrin.functions import ranks

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=3000), np.repeat(0.25, 900), r.integers(0, 5, 300)])
    k = r.integers(0, 3, len(x))
    d = spark.createDataFrame([(int(b), float(a)) for a, b in zip(x, k, strict=True)] + [(0, None), (7, None)], "k int, x double")
    at = [0.0, 0.001, 0.25, 0.5, 0.995, 1.0]
    for most, accuracy in ((50_000, 10_000), (400, 100)):  # all values at once, and narrowed
        monkeypatch.setattr(ranks, "MOST_VALUES", most)
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        got = quantiles(d, {"x": at}, "k")
        assert set(got) == {0, 1, 2}
        for b in (0, 1, 2):
            assert got[b]["x"] == pytest.approx(np.quantile(x[k == b], at), abs=1e-12)
        assert quantiles(d, {"x": at})[None]["x"] == pytest.approx(np.quantile(x, at), abs=1e-12)
    assert quantiles(d.where("false"), {"x": at}) == {}
    n = numbered(d.where("x is not null"), "k", "x").collect()
    assert sorted(r.n for r in n) == list(range(len(x))) and [(r.k, r.x) for r in sorted(n, key=lambda r: r.n)] == sorted((r.k, r.x) for r in n)


def test_fold_carries_on_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = spark.createDataFrame([(i % 3, i, 10 * i, 12.0 + 0.0007 * ((i * 7919) % 50), 42.0) for i in range(600)], FIX)
    whole = {n: sorted(map(tuple, clean.speed_denoise(d, 20, distance=n).collect())) for n in ("haversine", "geodesic")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        for n, rows in whole.items():
            assert sorted(map(tuple, clean.speed_denoise(d, 20, distance=n).collect())) == rows and 3 < len(rows) < 600
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_lag_plans_share_the_join_s_partitioning(spark):
    plan = queries.queries()["msd_ensemble"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") <= 5 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    head = "车辆ID,经度,纬度,时间"
    (tmp_path / "a.csv").write_bytes(f"{head}\n1,114.1,22.5,2020-01-01 00:00:00\n".encode() + f'{head}\n"1,2",x,22.5,bad\n'.encode())
    (tmp_path / "b.csv").write_bytes((f"{head}\r\n" + "2,114.2,22.5,2020-01-01 00:00:00\r\n" * 9000 + "粤B,114.3,22.6,2020/1/2 3:04\r\n").encode("gbk"))
    (tmp_path / "deep/c.csv").write_text("﻿id,lon,lat,note\n3,1,2,é\n", encoding="utf-8")
    (tmp_path / "deep/d.csv").write_bytes("id,lon,lat,note\n4,1,2,㐀\n".encode("gb18030"))
    (tmp_path / "skip.txt").write_text("id\n9\n")
    got = fixes.discover(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(Path(r.source_file).name, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a.csv": 3, "b.csv": 9001, "c.csv": 1, "d.csv": 1}
    assert [(r.id, r.lon, r.lat) for r in by["a.csv"]] == [("1", 114.1, 22.5), ("车辆ID", None, None), ("1,2", None, 22.5)]
    assert by["a.csv"][0].time is not None and by["a.csv"][2].time is None
    odd = next(r for r in by["b.csv"] if r.id == "粤B")
    assert (odd.lon, odd.lat, str(odd.time)) == (114.3, 22.6, "2020-01-02 03:04:00")
    assert (by["c.csv"][0].note, by["d.csv"][0].note) == ("é", "㐀")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b"'), (2, "c")], "id int, `名` string").coalesce(1)
    fixes.write_csv(d, str(tmp_path / "x"))
    data = next((tmp_path / "x").glob("part*")).read_bytes()
    assert data.startswith("﻿id,名\n".encode()) and sorted(r.id for r in fixes.read_table(spark, str(tmp_path / "x")).collect()) == ["1", "2"]
    fixes.write_csv(d, str(tmp_path / "y"), bom=False)
    assert next((tmp_path / "y").glob("part*")).read_bytes().startswith(b"id,")
    f = spark.createDataFrame([(1, 0, 0, 1.0, 1.0), (2, 0, 0, 2.0, 2.0), (3, 0, 0, 2.0, 2.0)], FIX)
    cluster.split_by_cluster(f, spark.createDataFrame([(1, 1), (2, 3)], "id long, cluster int"), str(tmp_path / "z"))
    assert sorted(p.name for p in (tmp_path / "z").glob("cluster=*")) == ["cluster=1", "cluster=3"]


def test_cluster_labels(spark):
    d = spark.createDataFrame([("x/Cluster12路网.shp",), ("cluster_0.shp",), ("a_cluster7_b",), ("none",)], "f string")
    assert [r[0] for r in d.select(fixes.cluster_label(F.col("f"))).collect()] == ["Cluster12", "Cluster1", None, None]
    assert [r[0] for r in d.select(fixes.cluster_label(F.col("f"), True)).collect()] == ["Cluster12", "Cluster1", "cluster7", None]


def test_kernel_density(spark):
    x = np.random.default_rng(2).normal(10, 3, 500)
    d = spark.createDataFrame([("m", float(v)) for v in x] + [("flat", 1.0), ("flat", 1.0)], "measure string, x double")
    got = {r.at: r.density for r in grid.kernel_density(d, 20, 1.0).collect()}
    h = x.std(ddof=1) * len(x) ** -0.2
    assert len(got) == 20
    for at, density in got.items():
        assert density == pytest.approx(np.exp(-(((at - x) / h) ** 2) / 2).sum() / len(x) / h / np.sqrt(2 * np.pi), rel=1e-3, abs=1e-6)


def test_process_chain(spark):
    walk = [(5, i, 60 * i, 12.0 + 0.001 * i, 42.0 + 0.001 * (i % 2)) for i in range(12)] + [(5, 50 + i, 10_000 + 60 * i, 12.5 + 0.001 * i, 42.0 + 0.001 * (i % 2)) for i in range(12)]
    short = [(4, 100 + i, 60 * i, 12.0, 42.0) for i in range(4)] + [(4, 200, None, 12.0, 42.0), (4, 201, 9, 500.0, 42.0)]
    got = clean.process(spark.createDataFrame(walk + short, FIX), least=5).collect()
    assert {(r.id, r.new_id) for r in got} == {("5_0_0", 1), ("5_1_0", 2)} and min(r.t for r in got) == 0
    assert clean.process(spark.createDataFrame(short, FIX)).count() == 0


def test_first_point_has_no_step(spark):
    d = spark.createDataFrame([(1, i, 60 * i, 12.0 + 0.001 * i, 42.0) for i in range(3)], FIX)
    step = float(geo.RADIUS) * np.radians(0.001) * np.cos(np.radians(42.0))
    assert motion.summary(d).first().distance_m == pytest.approx(2 * step, rel=1e-6)
    assert [r.part for r in clean.reindex_by_distance(d).collect()] == [0, 0, 0]


def test_some_ids(spark):
    d = spark.range(1000).select((F.col("id") % 200).alias("id"))
    a, b = (sorted(r.id for r in clean.some_ids(x).collect()) for x in (d, d.repartition(7)))
    assert a == b and len(set(a)) == 50 and len(a) == 250 and clean.some_ids(d.where("id < 3")).count() == 15


def test_fit_table(spark):
    curve = [(60 * i, 5.0 * i**1.3, 1.0) for i in range(1, 12)]
    f = spark.createDataFrame([(t, m, a, 3.0 * (t / 60) ** 0.8, 10.0, 0.1, 1) for t, m, a in curve], "lag int, real_msd double, real_alpha double, fit_msd double, gamma double, loss double, start long")
    t = ctqw.result_table(f).orderBy("Time").collect()
    assert t[0].asDict().keys() == {"Time", "Real_MSD", "Real_Alpha", "Fit_MSD", "Fit_Alpha"} and len(t) == 11
    assert np.median([r.Fit_Alpha for r in t]) == pytest.approx(0.8, abs=0.02)


def test_inertia_of_all_numbers_of_clusters():
    x = np.sort(np.random.default_rng(1).random(14))
    inertia, starts = cluster.best_cuts(x, np.ones(14), 4)
    assert [len(s) for s in starts] == [1, 2, 3, 4]
    for j, at in zip(inertia, starts, strict=True):
        assert j == pytest.approx(sum(((p - p.mean()) ** 2).sum() for p in np.split(x, at[1:])))


def test_trajectories_of_the_tables_have_ids(spark):
    assert points(spark, SF).where("id is null").count() == 0 and motion.summary(points(spark, SF)).count() > 0


def test_boxes_and_swaps(spark):
    d = spark.createDataFrame([(1, 0, 0, 113.0, 22.0), (1, 1, 1, 115.0, 23.0), (1, 2, 2, 115.1, 22.5), (1, 3, 3, 114.0, None)], FIX)
    assert sorted(r.seq for r in clean.fixed_bbox(d).collect()) == [0, 1]
    both = spark.createDataFrame([(1, 0, 0, 95.0, 114.0)], FIX)  # neither axis can be a latitude
    assert [(r.lon, r.lat) for r in clean.swap_repair(both).collect()] == [(95.0, 114.0)]
    assert [(r.lon, r.lat) for r in clean.swap_repair(both, strict=False).collect()] == [(114.0, 95.0)]
    assert clean.auto_bbox(d.where("false")).count() == 0


def test_mercator_of_known_points(spark):
    x, y = geo.mercator("lon", "lat")
    r = spark.createDataFrame([(180.0, 85.0511287798066), (0.0, 0.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert (r[0].x, r[0].y) == pytest.approx((20037508.342789244, 20037508.342789244), abs=1e-3) and (r[1].x, r[1].y) == pytest.approx((0, 0), abs=1e-8)


def test_simplified_line_stays_within_the_tolerance(spark):
    """Every dropped point lies within the tolerance of the line between its kept neighbours, before spacing."""
    r = np.random.default_rng(6)
    lon, lat = 12 + np.cumsum(r.normal(size=300)) * 2e-4, 42 + np.cumsum(r.normal(size=300)) * 2e-4
    x, y = 6378137.0 * np.radians(lon), 6378137.0 * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    at = key_points(x, y, 40.0)
    assert at[0] == 0 and at[-1] == 299 and len(at) < 300
    for a, b in zip(at, at[1:], strict=False):
        dx, dy = x[b] - x[a], y[b] - y[a]
        for i in range(a + 1, b):
            u = np.clip(((x[i] - x[a]) * dx + (y[i] - y[a]) * dy) / (dx * dx + dy * dy), 0, 1)
            assert np.hypot(x[i] - x[a] - u * dx, y[i] - y[a] - u * dy) <= 40.0
