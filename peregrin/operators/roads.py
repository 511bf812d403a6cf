"""Road topology: projection, noding, subdivision, nodes and edges, the largest component, start nodes.

Lines are rows (line, points: array of (x, y)), in degrees before `project` and in metres after it; segments are rows with two ends.
Segments meet in the cells of a grid that they cross, so noding joins neighbours only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lineage import cut
from ..functions.ranks import numbered

POINTS = "array<struct<x:double,y:double>>"


def lines_of(shapes: DataFrame) -> DataFrame:
    """(line, points) of every part of shapes (parts: array of arrays of points) that has two different points; repeated ones are passed over."""
    p = shapes.where("parts is not null").select(F.explode("parts").alias("points")).where("points is not null")
    p = p.select(F.filter("points", lambda q: q.isNotNull() & q["x"].isNotNull() & q["y"].isNotNull()).alias("points"))
    beside = F.zip_with("points", F.concat(F.array(F.lit(None)), "points"), lambda q, before: F.struct(q.alias("q"), before.alias("before")))  # looking back by place would filter the line again for each point
    p = p.select(F.transform(F.filter(beside, lambda z: z["q"].isNotNull() & ~z["before"].eqNullSafe(z["q"])), lambda z: z["q"]).alias("points")).where("size(points) > 1")
    return p.select(F.monotonically_increasing_id().alias("line"), "points")


def segments(lines: DataFrame) -> DataFrame:
    """(line, pos, x1, y1, x2, y2) of consecutive points; null points and repeats are passed over."""
    p = lines.where(F.col("points").isNotNull()).select("line", F.posexplode("points").alias("pos", "p")).where("p is not null").select("line", "pos", "p.x", "p.y")
    w = Window.partitionBy("line").orderBy("pos")
    p = p.withColumn("x0", F.lag("x").over(w)).withColumn("y0", F.lag("y").over(w)).where("x0 is null or x0 <> x or y0 <> y")
    s = p.select("line", (F.row_number().over(w) - 1).alias("pos"), F.lag("x").over(w).alias("x1"), F.lag("y").over(w).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return s.where("x1 is not null")


def utm_code(lines: DataFrame) -> int | None:
    """The EPSG code of the UTM zone of the lines' common centroid, weighted by length, segments that lines share counting once.

    None without lines; 3857 if the centroid is no place on earth. Points are degrees.
    """
    s = segments(lines)
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    s = s.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct().selectExpr("a.x as x1", "a.y as y1", "b.x as x2", "b.y as y2")
    n = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    c = s.agg(F.sum(n).alias("n"), F.sum(n * (F.col("x1") + F.col("x2")) / 2).alias("x"), F.sum(n * (F.col("y1") + F.col("y2")) / 2).alias("y")).select(F.try_divide("x", "n").alias("x"), F.try_divide("y", "n").alias("y")).first()
    if c.x is None:
        return None
    if not (-180 <= c.x <= 180 and -90 <= c.y <= 90):
        return 3857
    return int((c.x + 180) // 6) + 1 + (32600 if c.y >= 0 else 32700)


def project(lines: DataFrame, code: int | None) -> DataFrame:
    """Degrees to metres of a UTM zone (326zz, 327zz) or of EPSG:3857; unchanged without a code."""
    if code is None:
        return lines
    x, y = geo.mercator_sql("p.x", "p.y") if code == 3857 else geo.utm_sql("p.x", "p.y", str(code))
    return lines.withColumn("points", F.expr(f"transform(points, p -> struct({x} as x, {y} as y))"))


def _in_cells(s: DataFrame, cell: float) -> DataFrame:
    """Segments in the cells that they cross: columns by their x, and in each the rows between the segment's ends there."""
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    c = s.withColumn("cx", F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell))))
    rise = F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    at = lambda x: F.col("y1") + (x - F.col("x1")) * rise
    a, b = F.coalesce(at(F.greatest(lo, F.col("cx") * cell)), F.col("y1")), F.coalesce(at(F.least(hi, (F.col("cx") + 1) * cell)), F.col("y2"))
    margin = 1e-3  # rounding must not lose a cell
    return c.withColumn("cy", F.explode(F.sequence(F.floor((F.least(a, b) - margin) / cell), F.floor((F.greatest(a, b) + margin) / cell))))


ENDS = ["x1", "y1", "x2", "y2"]


def node_lines(lines: DataFrame, cell: float = 200.0) -> DataFrame:
    """(points): lines cut where they meet, each piece once whatever its direction (points rounded to 4 places).

    Lines are cut at their ends and wherever segments touch, cross or begin and end to overlap, but for neighbours of one line in
    their common point. Vertices that nothing touches stay inside a piece. Segments that many lines share, in either direction, meet
    the others once; how often they occur says whether more than one line's bend is at an end.
    """
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    s = segments(lines).select("line", "pos", (a > b).alias("back"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    s = s.select("line", "pos", "back", *[F.col(k).alias(n) for k, n in zip(("a.x", "a.y", "b.x", "b.y"), ENDS, strict=True)])
    own = cut(s.groupBy(*ENDS).agg(F.count("*").alias("n")))
    c = _in_cells(own.drop("n"), cell)
    o = c.select("cx", "cy", *[F.col(k).alias(f"o{k}") for k in ENDS])
    is_at = lambda x, y, u, v: (F.col(x) == F.col(u)) & (F.col(y) == F.col(v))
    j = c.join(o, ["cx", "cy"]).where(~(is_at("x1", "y1", "ox1", "oy1") & is_at("x2", "y2", "ox2", "oy2")))
    dx, dy, ex, ey = (F.col(a) - F.col(b) for a, b in (("x2", "x1"), ("y2", "y1"), ("ox2", "ox1"), ("oy2", "oy1")))
    det = dx * ey - dy * ex
    t = ((F.col("ox1") - F.col("x1")) * ey - (F.col("oy1") - F.col("y1")) * ex) / det
    u = ((F.col("ox1") - F.col("x1")) * dy - (F.col("oy1") - F.col("y1")) * dx) / det
    eps = 1e-9
    cross = F.when((F.abs(det) > eps) & t.between(-eps, 1 + eps) & u.between(-eps, 1 + eps), F.array(t))
    long2 = dx * dx + dy * dy
    on = lambda x, y: F.when(F.abs((F.col(x) - F.col("x1")) * dy - (F.col(y) - F.col("y1")) * dx) <= 1e-6 * F.sqrt(long2), ((F.col(x) - F.col("x1")) * dx + (F.col(y) - F.col("y1")) * dy) / long2)
    line_up = F.when(F.abs(det) <= eps, F.filter(F.array(on("ox1", "oy1"), on("ox2", "oy2")), lambda v: v.isNotNull()))
    snap = lambda v: F.when(v < eps, 0.0).when(v > 1 - eps, 1.0).otherwise(v)
    met = j.withColumn("t", F.explode(F.coalesce(cross, line_up))).where(f"t >= -{eps} and t <= 1 + {eps}").withColumn("t", snap(F.col("t")))
    ends_at = lambda x, y: is_at(x, y, "ox1", "oy1") | is_at(x, y, "ox2", "oy2")
    met = met.where(~F.when(F.col("t") == 0, ends_at("x1", "y1")).when(F.col("t") == 1, ends_at("x2", "y2")).otherwise(False))  # common ends are counted below
    place = [F.when(F.col("t") == 1, F.col(f"{c}2")).otherwise(F.col(f"{c}1") + F.col("t") * d).alias(c) for c, d in (("x", dx), ("y", dy))]
    cuts = met.select(*ENDS, "t", *place, F.lit(1).alias("node"))
    ends = own.select(*ENDS, "n", F.explode(F.array(*[F.struct(F.lit(float(k - 1)).alias("t"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)])).alias("e")).select(*ENDS, "n", "e.*")
    shared = ends.groupBy("x", "y").agg(F.sum("n").alias("k")).where("k > 2")  # a bend has two
    ends = ends.join(shared, ["x", "y"], "left").select(*ENDS, "t", "x", "y", F.col("k").isNotNull().cast("int").alias("node"))
    pts = ends.unionByName(cuts).withColumns({k: F.round(k, 4) for k in ("x", "y")}).groupBy(*ENDS, "x", "y").agg(F.min("t").alias("t"), F.max("node").alias("node"))
    pts = s.join(pts, ENDS).select("line", "pos", F.when(F.col("back"), -F.col("t")).otherwise(F.col("t")).alias("t"), "x", "y", "node")
    w = Window.partitionBy("line").orderBy("pos", "t")
    new = F.coalesce((F.lag("x").over(w) != F.col("x")) | (F.lag("y").over(w) != F.col("y")), F.lit(True))
    pts = pts.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pts = pts.groupBy("line", "run").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.max("node").alias("node"))
    w = Window.partitionBy("line").orderBy("run")
    pts = pts.withColumn("chain", F.sum("node").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).where("nx is not null")
    pieces = pts.groupBy("line", "chain").agg(F.array_sort(F.collect_list(F.struct("run", "x", "y", "nx", "ny"))).alias("p"))
    way = F.concat(F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), F.transform(F.slice("p", -1, 1), lambda q: F.struct(q["nx"].alias("x"), q["ny"].alias("y"))))
    return pieces.select(way.alias("points")).select(F.least("points", F.reverse("points")).alias("points")).distinct()


def max_edge(area_km2: Column) -> Column:
    """Metres an edge may have, by the area of the extent."""
    return F.when(area_km2 < 1, 300.0).when(area_km2 < 10, 800.0).when(area_km2 < 100, 2000.0).otherwise(5000.0)


def longest_of(lines: DataFrame) -> float:
    """Metres an edge may have, by the extent of all lines."""
    ends = lines.select(F.explode("points").alias("p")).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))
    r = ends.select(max_edge((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 1e6).alias("m")).first()
    return r.m


def subdivide(lines: DataFrame, longest: float) -> DataFrame:
    """Edges of lines: lines up to `longest` metres whole, longer ones as chords between equal lengths along them.

    Columns of lines but `points`, and k, x1, y1, x2, y2, length_m, points. Chords without length are left out.
    """
    far = lambda a, b: F.sqrt((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)
    own = [c for c in lines.columns if c != "points"]
    p = lines.withColumn("lens", F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: far(F.get("points", i), F.get("points", i + 1))))
    p = p.withColumn("at", F.aggregate("lens", F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))).withColumn("total", F.element_at("at", -1))
    p = p.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("total") / longest)).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def place(k: Column) -> Column:
        s = F.col("total") * k / F.col("n")
        i = F.least(F.size(F.filter("at", lambda v: v <= s)), F.size("lens")) - 1
        a, b, u = F.get("points", i), F.get("points", i + 1), F.try_divide(s - F.get("at", i), F.get("lens", i))
        inner = F.struct((a["x"] + (b["x"] - a["x"]) * u).alias("x"), (a["y"] + (b["y"] - a["y"]) * u).alias("y"))
        return F.when(k == 0, F.get("points", F.lit(0))).when(k == F.col("n"), F.element_at("points", -1)).otherwise(inner)

    p = p.withColumn("a", place(F.col("k"))).withColumn("b", place(F.col("k") + 1))
    whole = F.col("n") == 1
    e = p.select(*own, "k", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), F.when(whole, F.col("total")).otherwise(far(F.col("a"), F.col("b"))).alias("length_m"), F.when(whole, F.col("points")).otherwise(F.array("a", "b")).alias("points"))
    return e.where("length_m > 0")


def topology(s: DataFrame, places: int = 4) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of edges with ends x1, y1, x2, y2: nodes are distinct rounded ends, numbered from 0 in the order of (x, y).

    Edges keep loops, parallels, and their length_m and points if they have them (else the straight length).
    """
    r = s.withColumns({f"r{c}": F.round(c, places) for c in ("x1", "y1", "x2", "y2")})
    ends = r.select(F.col("rx1").alias("x"), F.col("ry1").alias("y")).union(r.select("rx2", "ry2")).distinct()
    nodes = numbered(ends, "x", "y").withColumnRenamed("n", "node_id")
    a = nodes.select(F.col("x").alias("rx1"), F.col("y").alias("ry1"), F.col("node_id").alias("from_node"))
    b = nodes.select(F.col("x").alias("rx2"), F.col("y").alias("ry2"), F.col("node_id").alias("to_node"))
    edges = r.join(a, ["rx1", "ry1"]).join(b, ["rx2", "ry2"])
    if "length_m" not in s.columns:
        edges = edges.withColumn("length_m", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    return nodes, edges.select("from_node", "to_node", "length_m", *[c for c in ("points",) if c in s.columns])


def network(shapes: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """(nodes, edges, EPSG code) of road shapes (parts, crs): the whole chain.

    Shapes without a crs or with a geographic one are degrees and are projected to the UTM zone of their centroid; others stay
    as they are, and have no code here. No line gives no node.
    """
    crs = shapes.select("crs").where("crs is not null").limit(1).collect() if "crs" in shapes.columns else []
    lines = cut(lines_of(shapes))
    code = utm_code(lines) if not crs or crs[0].crs.lstrip().upper().startswith("GEOG") else None
    lines = cut(project(lines, code))
    longest = longest_of(lines)
    nodes, edges = topology(cut(subdivide(node_lines(lines), longest or 1.0)))
    return nodes, edges, code


def network_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, x, y; edges: from_node, to_node, length_m, seq) of shapes (record, parts, attributes) read back.

    Ends are from_node and to_node, else u and v; lengths length, else length_m, else 1; nodes node_id, else osmid, else the record's number.
    """
    first = lambda *names: F.coalesce(*[F.try_element_at("attributes", F.lit(n)) for n in names])
    p = F.col("parts")[0][0]
    n = nodes.select(F.coalesce(first("node_id", "osmid").try_cast("double").cast("long"), F.col("record").cast("long")).alias("node_id"), p["x"].alias("x"), p["y"].alias("y"))
    whole = lambda *names: first(*names).try_cast("double").cast("long")
    e = edges.select(whole("from_node", "u").alias("from_node"), whole("to_node", "v").alias("to_node"), F.coalesce(first("length", "length_m").try_cast("double"), F.lit(1.0)).alias("length_m"), F.struct("file", "record").alias("seq"))
    return n, e


def graph(edges: DataFrame, seq: str = "length_m") -> DataFrame:
    """Undirected edges u < v with length_m (of parallel ones the last in the order of seq) and weight 1/length (1 without length)."""
    g = edges.groupBy(F.least("from_node", "to_node").alias("u"), F.greatest("from_node", "to_node").alias("v")).agg(F.max_by("length_m", seq).alias("length_m"))
    return g.withColumn("weight", F.when(F.col("length_m") > 0, 1 / F.col("length_m")).otherwise(1.0))


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Minimum labels travel and are then looked up again, so paths halve, until none changes."""
    e = edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    both = cut(e.union(e.select("b", "a")).distinct())
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "node")
    changed = True
    while changed:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        new = label.join(near, "node").select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = new.select(F.col("node").alias("c"), F.col("c").alias("r"))
        label = cut(new.join(jump, "c", "left").select("node", "old", F.coalesce("r", "c").alias("c")))
        changed = not label.where("c <> old").isEmpty()
        label = label.drop("old")
    return label.withColumnRenamed("c", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """The nodes of the component with most nodes, the smallest label on a tie."""
    label = component_labels(edges)
    sizes = label.groupBy("component").agg(F.count("*").alias("k"))
    best = sizes.orderBy(F.desc("k"), "component").limit(1)
    return label.join(F.broadcast(best), "component", "left_semi")  # one row


def degrees(g: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    return g.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def hops(g: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, hops) of every node that a start reaches in the graph u, v: one frontier join a hop, until nothing new is met."""
    both = cut(g.select(F.col("u").alias("a"), F.col("v").alias("b")).union(g.select("v", "u")).distinct())
    seen = front = cut(starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("hops")))
    while not front.isEmpty():
        step = front.join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        front = cut(step.join(seen, ["start", "node"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return seen


def start_nodes(nodes: DataFrame, g: DataFrame, few: int = 200) -> DataFrame:
    """All nodes of small graphs; else the 15 of highest degree, that nearest the mean, and those nearest the centres of 3 x 3 cells."""
    targets = nodes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    cells = [F.struct((F.col("x0") + (F.col("x1") - F.col("x0")) * ((2 * i + 1) / 6)).alias("tx"), (F.col("y0") + (F.col("y1") - F.col("y0")) * ((2 * j + 1) / 6)).alias("ty")) for i in range(3) for j in range(3)]
    t = targets.select("n", F.posexplode(F.array(F.struct(F.col("mx").alias("tx"), F.col("my").alias("ty")), *cells)).alias("target", "p")).select("n", "target", "p.tx", "p.ty")
    near = nodes.crossJoin(F.broadcast(t)).groupBy("target").agg(F.min_by("node_id", F.struct(((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2).alias("d"), F.col("node_id"))).alias("node"))  # ten rows
    top = degrees(g).orderBy(F.desc("degree"), "node").limit(15).select("node")
    chosen = top.union(near.select("node")).distinct()
    small = nodes.crossJoin(F.broadcast(targets.select("n"))).where(F.col("n") < few).select(F.col("node_id").alias("node"))  # one row
    return chosen.union(small).distinct()
