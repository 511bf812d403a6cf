"""The same queries in SQL for DuckDB. Formulas and weights are written out here, apart from the code that they check."""

from __future__ import annotations

METRES_PER_DEGREE = 111320.0
#: Weights of the quadratic fit to 3, 5 and 7 values at its places (divisor, rows up to the middle; later ones mirror them).
SMOOTHING = {
    3: (1, [[1, 0, 0], [0, 1, 0]]),
    5: (35, [[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3]]),
    7: (42, [[32, 15, 3, -4, -6, -3, 5], [15, 12, 9, 6, 3, 0, -3], [3, 9, 12, 12, 9, 3, -6], [-4, 6, 12, 14, 12, 6, -4]]),
}


def H(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle metres on a sphere of 6371 km: twice the radius times the arc sine of the root of the haversine."""
    h = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(12742000e0 * asin(sqrt(CASE WHEN {h} > 1 THEN 1e0 ELSE {h} END)))"


def _weight(w: int, r: int, k: int) -> float:
    divisor, rows = SMOOTHING[w]
    return (rows[r][k] if r < len(rows) else rows[w - 1 - r][w - 1 - k]) / divisor


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


PTS = """pts AS (
  SELECT id, seq, t, CAST(125000 + sum(dx) OVER w AS DOUBLE) / 1e4 AS lon, CAST(419000 + sum(dy) OVER w AS DOUBLE) / 1e4 AS lat FROM (
    SELECT user_id AS id, event_id AS seq, CAST(floor((epoch_us(ts) - 1704067200000000) / 400e6) AS BIGINT) AS t,
      CASE event_type WHEN 'click' THEN k WHEN 'view' THEN -k ELSE 0 END AS dx,
      CASE event_type WHEN 'purchase' THEN k WHEN 'signup' THEN -k ELSE 0 END AS dy
    FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events))
  WINDOW w AS (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING))"""
PREV = "prv AS (SELECT *, lag(t) OVER w AS p_t, lag(lon) OVER w AS p_lon, lag(lat) OVER w AS p_lat, lead(t) OVER w AS n_t, lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat FROM pts WINDOW w AS (PARTITION BY id ORDER BY t, seq))"
STEP = f"stp AS (SELECT *, t - p_t AS dt, {H('p_lon', 'p_lat', 'lon', 'lat')} AS dist_m FROM prv WHERE p_t IS NOT NULL)"
SEG = "seg AS (SELECT *, id || '_' || sub AS seg_id FROM (SELECT *, CAST(sum(CASE WHEN t - p_t > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS sub FROM prv))"
FIX = "id, seq, t, lon, lat"


def _with(final: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join([PTS, *ctes]) + "\n" + final


def _fold_of(source: str, keep: str) -> tuple[str, str]:
    return (
        f"o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS rn FROM {source})",
        f"""f AS (SELECT id, rn, seq, t, lon, lat, true AS kept, t AS kt, lon AS kx, lat AS ky FROM o WHERE rn = 1
  UNION ALL SELECT id, rn, seq, t, lon, lat, k, CASE WHEN k THEN t ELSE kt END, CASE WHEN k THEN lon ELSE kx END, CASE WHEN k THEN lat ELSE ky END
  FROM (SELECT o.id, o.rn, o.seq, o.t, o.lon, o.lat, f.kt, f.kx, f.ky, {keep} AS k FROM f JOIN o ON o.id = f.id AND o.rn = f.rn + 1))""",
    )


def _fold(keep: str) -> str:
    return _with(f"SELECT {FIX} FROM f WHERE kept", *_fold_of("pts", keep), recursive=True)


_FAR = H("f.kx", "f.ky", "o.lon", "o.lat")
_REACH = f"CASE WHEN o.t <= f.kt THEN false ELSE {_FAR} / (o.t - f.kt) * 3.6e0 <= 150 END"
MEASURES = f"""ends AS (SELECT id, arg_min(lon, (t, seq)) AS x0, arg_min(lat, (t, seq)) AS y0, arg_max(lon, (t, seq)) AS x1, arg_max(lat, (t, seq)) AS y1, min(t) AS t0, max(t) AS t1 FROM pts GROUP BY id HAVING count(*) > 1 AND max(t) > min(t)),
dsp AS (SELECT id, {H("x0", "y0", "x1", "y1")} AS displacement_m, (t1 - t0) / 60e0 AS duration_min FROM ends),
mea AS (SELECT 'displacement_m' AS measure, displacement_m AS x FROM dsp UNION ALL SELECT 'duration_min', duration_min FROM dsp
  UNION ALL SELECT 'flight_m', dist_m FROM stp WHERE dt > 0 UNION ALL SELECT 'speed_kmh', dist_m / dt * 3.6e0 FROM stp WHERE dt > 0)"""


def _pairs(horizon: int) -> str:
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS rn, count(*) OVER (PARTITION BY id) AS n FROM pts),
pr AS (SELECT a.id, a.n, a.rn AS i, b.rn AS j, b.t - a.t AS gap, a.lon AS x0, a.lat AS y0, b.lon AS x1, b.lat AS y1 FROM n a JOIN n b ON a.id = b.id AND b.rn >= a.rn AND b.t - a.t <= {horizon} WHERE a.n >= 10)"""


_D2 = f"pow({H('x0', 'y0', 'x1', 'y1')}, 2)"
LAGS = "lg AS (SELECT CAST(60 * g AS INTEGER) AS lag FROM range(1, 121) r(g))"
ENS = f"""{_pairs(7260)}, {LAGS},
mt AS (SELECT id, lag, {_D2} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id, i, lag ORDER BY abs(gap - lag), j) AS k FROM pr JOIN lg ON abs(gap - lag) <= 60) WHERE k = 1),
e0 AS (SELECT lag, avg(m) AS msd, CAST(sum(k) AS BIGINT) AS samples FROM (SELECT id, lag, avg(d2) AS m, count(*) AS k FROM mt GROUP BY id, lag) GROUP BY lag HAVING sum(k) >= 30),
ens AS (SELECT * FROM e0 WHERE (SELECT count(*) FROM e0) >= 5)"""
POOL = f"""{_pairs(7260)}, {LAGS},
cd AS (SELECT *, row_number() OVER (PARTITION BY id, i, lag, gap < lag ORDER BY CASE WHEN gap < lag THEN -gap ELSE gap END, CASE WHEN gap < lag THEN -j ELSE j END) AS k FROM pr JOIN lg ON abs(gap - lag) <= 60 WHERE i < n),
mt AS (SELECT id, lag, {_D2} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id, i, lag ORDER BY abs(gap - lag), CASE WHEN gap < lag THEN 0 ELSE 1 END) AS q FROM cd WHERE k = 1) WHERE q = 1),
e0 AS (SELECT lag, avg(d2) AS msd, count(*) AS samples FROM mt GROUP BY lag HAVING count(*) >= 30)"""
IND = f"""{_pairs(3960)}, {LAGS},
mt AS (SELECT id, lag, gap, {_D2} AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY id, i, lag ORDER BY gap, j) AS k FROM pr JOIN lg ON gap >= lag AND lag <= 3600) WHERE k = 1),
i0 AS (SELECT id, lag, avg(d2) AS msd FROM mt WHERE gap - lag <= greatest(30, lag / 10e0) GROUP BY id, lag HAVING avg(d2) > 0),
spn AS (SELECT id, max(t) - min(t) AS duration FROM pts GROUP BY id),
i1 AS (SELECT id, lag, msd, count(*) OVER (PARTITION BY id) AS k FROM i0 JOIN spn USING (id) WHERE lag < duration),
ind AS (SELECT id, lag, msd FROM i1 WHERE k >= 5)"""


def _alpha(source: str, key: str, window: int, name: str) -> str:
    """Smoothing by rows of a constant matrix, then the gradient; curves shorter than the window use a shorter odd one."""
    parts = [f"({w}, {r}, {k}, {_d(_weight(w, r, k))})" for w in range(3, window + 1, 2) for r in range(w) for k in range(w)]
    p = f"PARTITION BY {key}"
    return f"""hm(w, r, k, h) AS (VALUES {", ".join(parts)}),
a0 AS (SELECT {key} AS key, lag, msd, ln(CAST(lag AS DOUBLE)) AS x, ln(msd) AS y, row_number() OVER ({p} ORDER BY lag) - 1 AS i, count(*) OVER ({p}) AS n FROM {source} WHERE lag > 0 AND msd > 0),
a1 AS (SELECT *, least({window}, CASE WHEN n % 2 = 0 THEN n - 1 ELSE n END) AS w FROM a0),
a2 AS (SELECT *, greatest(0, least(i - w // 2, n - w)) AS base FROM a1),
a3 AS (SELECT a.key, a.i, any_value(a.n) AS n, any_value(a.lag) AS lag, any_value(a.msd) AS msd, any_value(a.x) AS x, sum(h * b.y) AS s FROM a2 a JOIN a2 b ON a.key = b.key AND b.i BETWEEN a.base AND a.base + a.w - 1 JOIN hm ON hm.w = a.w AND hm.r = a.i - a.base AND hm.k = b.i - a.base GROUP BY a.key, a.i),
a4 AS (SELECT *, lag(s) OVER v AS s0, lead(s) OVER v AS s2, x - lag(x) OVER v AS ha, lead(x) OVER v - x AS hb FROM a3 WINDOW v AS (PARTITION BY key ORDER BY i)),
{name} AS (SELECT key, lag, msd, CASE WHEN s0 IS NULL THEN (s2 - s) / hb WHEN s2 IS NULL THEN (s - s0) / ha ELSE (ha * ha * s2 + (hb * hb - ha * ha) * s - hb * hb * s0) / (ha * hb * (ha + hb)) END AS alpha FROM a4)"""


CURVE = f"{ENS},\n{_alpha('ens', '1', 7, 'crv')}"
FLAGS = """f0 AS (SELECT *, min(alpha) OVER (ORDER BY lag ROWS UNBOUNDED PRECEDING) AS run_min, count(*) OVER () AS n FROM crv WHERE alpha IS NOT NULL),
f1 AS (SELECT *, (run_min < 1 AND alpha > run_min + 0.2e0) OR alpha <= 0 AS hit FROM f0),
flg AS (SELECT *, n < 5 OR max(CAST(hit AS INTEGER)) OVER (ORDER BY lag ROWS UNBOUNDED PRECEDING) = 0 AS keep FROM f1)"""
RG = f"""rg0 AS (SELECT *, avg(lon) OVER (PARTITION BY id) AS cx, avg(lat) OVER (PARTITION BY id) AS cy FROM pts WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
rg AS (SELECT id, sqrt(avg(pow({H("cx", "cy", "lon", "lat")}, 2))) AS rg FROM rg0 GROUP BY id HAVING count(*) >= 2)"""
LABEL = f"""{RG},
v AS (SELECT rg, row_number() OVER (ORDER BY rg) AS i, sum(rg) OVER (ORDER BY rg ROWS UNBOUNDED PRECEDING) AS s1, sum(rg * rg) OVER (ORDER BY rg ROWS UNBOUNDED PRECEDING) AS s2, count(*) OVER () AS n FROM rg),
z AS (SELECT * FROM v WHERE i = n),
cut AS (SELECT a.i AS a, b.i AS b FROM v a JOIN v b ON a.i < b.i CROSS JOIN z WHERE b.i < z.i
  ORDER BY a.s2 - a.s1 * a.s1 / a.i + (b.s2 - a.s2) - pow(b.s1 - a.s1, 2) / (b.i - a.i) + (z.s2 - b.s2) - pow(z.s1 - b.s1, 2) / (z.i - b.i) LIMIT 1),
lab AS (SELECT id, rg, CAST(1 + CAST(rg > (SELECT rg FROM v, cut WHERE i = a) AS INTEGER) + CAST(rg > (SELECT rg FROM v, cut WHERE i = b) AS INTEGER) AS INTEGER) AS cluster FROM rg)"""


def _cells(metres: float) -> str:
    d = metres / METRES_PER_DEGREE
    at = lambda c: f"CAST(floor(({c} - ((SELECT min({c}) FROM pts) - {_d(d / 2)})) / {_d(d)}) AS BIGINT)"
    return f"cel AS (SELECT *, {at('lon')} AS loncol, {at('lat')} AS latcol FROM pts),\nden AS (SELECT loncol, latcol, count(*) AS n FROM cel GROUP BY ALL)"


C400, D400 = _cells(400.0), 400.0 / METRES_PER_DEGREE
GRAPH = f"""{C400},
nod AS (SELECT *, row_number() OVER (ORDER BY loncol, latcol) - 1 AS node_id FROM den),
mov AS (SELECT loncol, latcol, lag(loncol) OVER w AS px, lag(latcol) OVER w AS py FROM cel WINDOW w AS (PARTITION BY id ORDER BY t, seq)),
edg AS (SELECT DISTINCT least(a.node_id, b.node_id) AS from_node, greatest(a.node_id, b.node_id) AS to_node, sqrt(CAST(pow(m.loncol - px, 2) + pow(m.latcol - py, 2) AS DOUBLE)) * 400e0 AS length_m
  FROM mov m JOIN nod b ON b.loncol = m.loncol AND b.latcol = m.latcol JOIN nod a ON a.loncol = px AND a.latcol = py WHERE px <> m.loncol OR py <> m.latcol),
both_ AS (SELECT from_node AS a, to_node AS b FROM edg UNION SELECT to_node, from_node FROM edg)"""
COMP = f"""{GRAPH},
rch AS (SELECT a AS node, a AS root FROM both_ UNION SELECT e.b, r.root FROM rch r JOIN both_ e ON e.a = r.node),
lbl AS (SELECT node, min(root) AS component FROM rch GROUP BY node),
big AS (SELECT node, component FROM lbl WHERE component = (SELECT component FROM lbl GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"""
NODES = "SELECT node_id, loncol * 400e0 AS x, latcol * 400e0 AS y FROM nod"
STARTS = f"""{COMP},
xy AS (SELECT * FROM ({NODES}) WHERE node_id IN (SELECT node FROM big)),
ext AS (SELECT avg(x) AS mx, avg(y) AS my, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM xy),
tgt AS (SELECT -1 AS target, mx AS tx, my AS ty FROM ext UNION ALL SELECT 3 * i + j, x0 + (x1 - x0) * ((2 * i + 1) / 6e0), y0 + (y1 - y0) * ((2 * j + 1) / 6e0) FROM ext, range(3) p(i), range(3) q(j)),
deg AS (SELECT a AS node, count(*) AS degree FROM both_ WHERE a IN (SELECT node FROM big) GROUP BY a),
near AS (SELECT node_id, row_number() OVER (PARTITION BY target ORDER BY pow(x - tx, 2) + pow(y - ty, 2), node_id) AS k FROM xy, tgt)"""


def _sides(source: str) -> str:
    """Of each point the lengths of the sides to its neighbours, and of the third side."""
    return f"SELECT *, {H('p_lon', 'p_lat', 'lon', 'lat')} AS a, {H('lon', 'lat', 'n_lon', 'n_lat')} AS b, {H('p_lon', 'p_lat', 'n_lon', 'n_lat')} AS c FROM {source}"


_DRIFT = f"""(coalesce(CASE WHEN t > p_t THEN a / (t - p_t) * 3.6e0 END > 120 AND CASE WHEN n_t > t THEN b / (n_t - t) * 3.6e0 END > 120 AND CASE WHEN n_t > p_t THEN c / (n_t - p_t) * 3.6e0 END <= 120, false)
  OR coalesce(a > 2000 AND b > 2000 AND c <= 2000, false) OR coalesce(CASE WHEN a > 0 AND b > 0 THEN (pow(a, 2) + pow(b, 2) - pow(c, 2)) / (2 * a * b) > {_d(0.8660254037844387)} END, false))"""
_SAME = "coalesce(p_lon = lon AND p_lat = lat AND n_lon = lon AND n_lat = lat, false)"


def _simplified(source: str) -> tuple[str, ...]:
    """Relation smp: stretches are halved at their farthest point while it lies over 20 m off; then 30 m from the last point kept."""
    return (
        f"mrc AS (SELECT *, 6378137e0 * radians(lon) AS x, 6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS y, row_number() OVER (PARTITION BY id ORDER BY t, seq) AS rn, count(*) OVER (PARTITION BY id) AS n FROM {source})",
        """dgp AS (SELECT id, CAST(1 AS BIGINT) AS i, n AS j FROM mrc WHERE rn = 1 AND n > 2
  UNION ALL SELECT id, unnest([i, -top[2]]), unnest([-top[2], j]) FROM (SELECT id, i, j, max(row(sqrt(pow(px - u * dx, 2) + pow(py - u * dy, 2)), -rn)) AS top FROM (
    SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS u FROM (
      SELECT s.id, s.i, s.j, p.rn, q.x - o.x AS dx, q.y - o.y AS dy, p.x - o.x AS px, p.y - o.y AS py FROM dgp s
      JOIN mrc p ON p.id = s.id AND p.rn > s.i AND p.rn < s.j JOIN mrc o ON o.id = s.id AND o.rn = s.i JOIN mrc q ON q.id = s.id AND q.rn = s.j)) GROUP BY id, i, j) WHERE top[1] > 20)""",
        "kpt AS (SELECT DISTINCT id, unnest([i, j]) AS rn FROM dgp)",
        "kps AS (SELECT id, seq, t, lon, lat FROM mrc JOIN kpt USING (id, rn))",
        *_fold_of("kps", f"{_FAR} >= 30"),
        f"smp AS (SELECT {FIX} FROM f WHERE kept UNION ALL SELECT {FIX} FROM mrc WHERE n <= 2)",
    )


def _ellipsoid(rounds: int = 8) -> tuple[str, ...]:
    """Relation ell: the inverse problem on WGS-84 by Vincenty's series, as many rounds of its iteration; steps are short, so few do."""
    f = "(1 / 298.257223563e0)"
    first = f"ve AS (SELECT id, seq, p_lon, p_lat, lon, lat, sin(v1) AS s1, cos(v1) AS c1, sin(v2) AS s2, cos(v2) AS c2, radians(lon - p_lon) AS d FROM (SELECT *, atan((1 - {f}) * tan(radians(p_lat))) AS v1, atan((1 - {f}) * tan(radians(lat))) AS v2 FROM prv WHERE p_t IS NOT NULL))"
    arc = lambda source: f"SELECT *, CASE WHEN ca > 0 THEN cs - 2 * s1 * s2 / ca ELSE 0 END AS cm FROM (SELECT *, 1 - sa * sa AS ca, atan2(ss, cs) AS g FROM (SELECT *, CASE WHEN ss > 0 THEN c1 * c2 * sin(l) / ss ELSE 0 END AS sa FROM (SELECT *, sqrt(pow(c2 * sin(l), 2) + pow(c1 * s2 - s1 * c2 * cos(l), 2)) AS ss, s1 * s2 + c1 * c2 * cos(l) AS cs FROM {source})))"
    own = "id, seq, p_lon, p_lat, lon, lat, s1, c1, s2, c2, d"
    rows = [first, "v0 AS (SELECT *, d AS l FROM ve)"]
    for k in range(rounds):
        rows.append(f"v{k + 1} AS (SELECT {own}, d + (1 - h) * {f} * sa * (g + h * ss * (cm + h * cs * (2 * cm * cm - 1))) AS l FROM (SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS h FROM ({arc(f'v{k}')})))")
    b = f"(6378137e0 * (1 - {f}))"
    rows.append(
        f"""ell AS (SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE {b} * (1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))) * (g - w * ss * (cm + w / 4 * (cs * (2 * cm * cm - 1) - w / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) END AS metres
  FROM (SELECT *, k / 1024 * (256 + k * (-128 + k * (74 - 47 * k))) AS w FROM (SELECT *, ca * (6378137e0 * 6378137e0 - {b} * {b}) / ({b} * {b}) AS k FROM ({arc(f'v{rounds}')}))))"""
    )
    return tuple(rows)


def _neighbours(source: str, name: str) -> str:
    return PREV.replace("prv AS", f"{name} AS").replace("FROM pts", f"FROM {source}")


SQL = {
    "traj_points": _with(f"SELECT {FIX} FROM pts"),
    "step_speed": _with("SELECT id, seq, dt, round(dist_m, 3) AS dist_m, round(dist_m / dt * 3.6e0, 3) AS speed_kmh FROM stp WHERE dt > 0", PREV, STEP),
    "gap_segments": _with("SELECT id, seq, t, sub, seg_id FROM seg", PREV, SEG),
    "segment_summary": _with(f"SELECT seg_id, n, duration_s, round(m, 3) AS distance_m, round(CASE WHEN duration_s > 0 THEN m / duration_s * 3.6e0 ELSE 0 END, 3) AS avg_speed_kmh FROM (SELECT seg_id, count(*) AS n, max(t) - min(t) AS duration_s, coalesce(sum({H('q_lon', 'q_lat', 'lon', 'lat')}), 0) AS m FROM (SELECT *, lag(lon) OVER w AS q_lon, lag(lat) OVER w AS q_lat FROM seg WINDOW w AS (PARTITION BY seg_id ORDER BY t, seq)) GROUP BY seg_id)", PREV, SEG),
    "bbox_filter": _with(f"SELECT {FIX} FROM pts, (SELECT quantile_cont(lon, [0.001, 0.999]) AS qx, quantile_cont(lat, [0.001, 0.999]) AS qy FROM pts) WHERE lon BETWEEN qx[1] AND qx[2] AND lat BETWEEN qy[1] AND qy[2]"),
    "latlon_swap_fix": _with("SELECT id, seq, t, CASE WHEN s THEN y ELSE x END AS lon, CASE WHEN s THEN x ELSE y END AS lat FROM (SELECT id, seq, t, lon AS x, lat + 60 AS y, max(abs(lat + 60)) OVER () > 90 AND max(abs(lon)) OVER () <= 90 AS s FROM pts)"),
    "null_and_range_filter": _with(f"SELECT {FIX} FROM pts WHERE seq % 7 <> 0 AND seq % 11 <> 0"),
    "id_reindex_disgap": _with(f"SELECT id, seq, CAST(sum(CASE WHEN {H('p_lon', 'p_lat', 'lon', 'lat')} > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS INTEGER) AS part FROM prv", PREV),
    "id_reindex_timegap": _with("SELECT seg_id, seq, dense_rank() OVER (ORDER BY seg_id) AS new_id FROM seg", PREV, SEG),
    "drift_clean": _with(f"SELECT {FIX} FROM ({_sides('prv')}) WHERE NOT {_DRIFT}", PREV),
    "redundant_clean": _with(f"SELECT {FIX} FROM prv WHERE NOT {_SAME}", PREV),
    "speed_denoise_a": _fold(_REACH),
    "speed_denoise_b": _fold(f"CASE WHEN o.lon = f.kx AND o.lat = f.ky THEN false ELSE {_REACH} END"),
    "duration_filter": _with("SELECT seg_id, seq, t FROM (SELECT *, max(t) OVER (PARTITION BY seg_id) - min(t) OVER (PARTITION BY seg_id) AS s FROM seg) WHERE s <= 1800", PREV, SEG),
    "rolling_smooth": _with("SELECT seg_id, seq, round(CASE WHEN n >= 3 THEN avg(lon) OVER w ELSE lon END, 6) AS lon, round(CASE WHEN n >= 3 THEN avg(lat) OVER w ELSE lat END, 6) AS lat FROM (SELECT *, count(*) OVER (PARTITION BY seg_id) AS n FROM seg) WINDOW w AS (PARTITION BY seg_id ORDER BY t, seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", PREV, SEG),
    "min_spacing": _fold(f"{_FAR} >= 300"),
    "dense_renumber": _with("SELECT id, seq, dense_rank() OVER (ORDER BY id) AS new_id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM pts) WHERE n >= 5"),
    "traj_displacement_duration": _with("SELECT id, round(displacement_m, 3) AS displacement_m, round(duration_min, 3) AS duration_min FROM dsp", PREV, STEP, MEASURES),
    "dist_summary": _with("SELECT measure, count(*) AS n, round(avg(x), 3) AS mean, round(quantile_cont(x, 0.5), 3) AS median, round(max(x), 3) AS largest, round(quantile_cont(x, 0.995), 3) AS trim_at FROM mea GROUP BY measure", PREV, STEP, MEASURES),
    "dist_histogram": _with("SELECT measure, CAST(CASE WHEN high > low THEN least(49, floor((x - low) / ((high - low) / 50))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM (SELECT *, min(x) OVER (PARTITION BY measure) AS low, max(x) OVER (PARTITION BY measure) AS high FROM (SELECT *, quantile_cont(x, 0.995) OVER (PARTITION BY measure) AS q FROM mea) WHERE x <= q) GROUP BY ALL", PREV, STEP, MEASURES),
    "msd_pooled": _with("SELECT lag, samples, round(msd, 3) AS msd FROM e0 WHERE (SELECT count(*) FROM e0) >= 5", POOL),
    "msd_ensemble": _with("SELECT lag, samples, round(msd, 3) AS msd FROM ens", ENS),
    "msd_individual_summary": _with(
        f"""SELECT id, points_count, duration_s, round(m, 3) AS distance_m, round(CASE WHEN duration_s > 0 THEN m / duration_s * 3.6e0 ELSE 0 END, 3) AS avg_speed_kmh, round(a, 3) AS diffusion_coeff, round(b, 6) AS global_alpha, round(r, 6) AS r_squared
FROM (SELECT id, count(*) AS points_count, max(t) - min(t) AS duration_s, coalesce(sum({H("p_lon", "p_lat", "lon", "lat")}), 0) AS m FROM prv GROUP BY id)
JOIN (SELECT id, exp(regr_intercept(ln(msd), ln(CAST(lag AS DOUBLE)))) AS a, regr_slope(ln(msd), ln(CAST(lag AS DOUBLE))) AS b, regr_r2(ln(msd), ln(CAST(lag AS DOUBLE))) AS r FROM ind GROUP BY id) USING (id)""",
        PREV, IND,
    ),
    "msd_individual_curves": _with("SELECT key AS id, lag AS tau, round(msd, 3) AS msd, round(alpha, 6) AS alpha_local FROM crv", IND, _alpha("ind", "id", 5, "crv")),
    "alpha_curve": _with("SELECT lag, round(msd, 3) AS msd, round(alpha, 6) AS alpha FROM crv", CURVE),
    "rebound_cutoff_flags": _with("SELECT lag, hit, keep, round(run_min, 6) AS run_min FROM flg", CURVE, FLAGS),
    "transition_point": _with("SELECT lag, round(alpha, 6) AS alpha FROM (SELECT *, lag(alpha) OVER (ORDER BY lag) AS p FROM crv) WHERE alpha <= 1 AND p > 1 ORDER BY lag LIMIT 1", CURVE),
    "power_law_fit": _with("SELECT round(regr_slope(y, x), 6) AS slope, round(regr_r2(y, x), 6) AS r2, round(exp(regr_intercept(y, x)), 3) AS coefficient FROM (SELECT ln(msd) AS y, ln(CAST(lag AS DOUBLE)) AS x FROM ens WHERE msd > 0) HAVING count(*) >= 5", ENS),
    "diffusion_regime": _with("SELECT CASE WHEN alpha < 0.5e0 THEN 'sub' WHEN alpha < 1 THEN 'normal' ELSE 'super' END AS regime, count(*) AS n FROM crv GROUP BY 1", CURVE),
    "cutoff_log": _with("SELECT count(*) AS original, CAST(sum(CAST(keep AS INTEGER)) AS BIGINT) AS vis, CASE WHEN count(*) < 5 THEN 'TooShort' ELSE coalesce(arg_min(CASE WHEN alpha > run_min + 0.2e0 THEN printf('Rebound > 0.2 (Min=%.2f)', run_min) ELSE 'Alpha <= 0' END, lag) FILTER (hit), 'Complete') END AS reason FROM flg", CURVE, FLAGS),
    "rg_summary": _with("SELECT id, round(rg, 3) AS rg FROM rg", RG),
    "rg_elbow": _with(
        "SELECT CAST(k AS INTEGER) AS k, round(j, 6) AS inertia FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, j FROM e{k} WHERE i = (SELECT count(*) FROM v)" for k in range(1, 7)) + ")",
        RG,
        "zz AS (SELECT (rg - (SELECT avg(rg) FROM rg)) / (SELECT stddev_pop(rg) FROM rg) AS z FROM rg)",
        "v AS (SELECT row_number() OVER (ORDER BY z) AS i, sum(z) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS s1, sum(z * z) OVER (ORDER BY z ROWS UNBOUNDED PRECEDING) AS s2 FROM zz)",
        "e1 AS (SELECT i, s2 - s1 * s1 / i AS j FROM v)",
        *[f"e{k} AS (SELECT b.i, min(p.j + (b.s2 - a.s2) - pow(b.s1 - a.s1, 2) / (b.i - a.i)) AS j FROM v b JOIN v a ON a.i < b.i JOIN e{k - 1} p ON p.i = a.i GROUP BY b.i)" for k in range(2, 7)],
    ),
    "rg_clusters": _with("SELECT id, cluster, round(rg, 3) AS rg FROM lab", LABEL),
    "cluster_split_counts": _with("SELECT cluster, count(*) AS n, count(DISTINCT id) AS ids FROM pts JOIN lab USING (id) GROUP BY cluster", LABEL),
    "rg_boxplot": _with("SELECT cluster, any_value(n) AS n, round(any_value(q[1]), 3) AS q1, round(any_value(q[2]), 3) AS q2, round(any_value(q[3]), 3) AS q3, round(min(rg), 3) AS low, round(max(rg), 3) AS high FROM lab JOIN (SELECT cluster, count(*) AS n, quantile_cont(rg, [0.25, 0.5, 0.75]) AS q FROM lab GROUP BY cluster) USING (cluster) WHERE rg BETWEEN q[1] - 1.5e0 * (q[3] - q[1]) AND q[3] + 1.5e0 * (q[3] - q[1]) GROUP BY cluster", LABEL),
    "dist_kernel_density": _with(
        """SELECT measure, round(p, 3) AS "at", round(sum(k * exp(-pow((p - m) / h, 2) / 2)) / any_value(n) / any_value(h) / 2.5066282746310002e0, 8) AS density
FROM (SELECT s.*, low + (high - low) * i / 49 AS p FROM sp s, range(50) g(i)) JOIN ce USING (measure) GROUP BY measure, p""",
        PREV, STEP, MEASURES,
        "tr AS (SELECT *, min(x) OVER (PARTITION BY measure) AS low, max(x) OVER (PARTITION BY measure) AS high FROM (SELECT *, quantile_cont(x, 0.995) OVER (PARTITION BY measure) AS q FROM mea) WHERE x <= q)",
        "sp AS (SELECT measure, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2e0) AS h, any_value(low) AS low, any_value(high) AS high FROM tr WHERE high > low GROUP BY measure HAVING count(*) > 1 AND stddev_samp(x) > 0)",
        "ce AS (SELECT measure, count(*) AS k, avg(x) AS m FROM tr WHERE high > low GROUP BY measure, least(4095, floor((x - low) / (high - low) * 4096)))",
    ),
    "clean_segments": _with(
        f"""SELECT seg_id AS id, seq, t, round(CASE WHEN n >= 3 THEN avg(lon) OVER w ELSE lon END, 6) AS lon, round(CASE WHEN n >= 3 THEN avg(lat) OVER w ELSE lat END, 6) AS lat
FROM s3 WINDOW w AS (PARTITION BY seg_id ORDER BY t, seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
        "bb AS (SELECT pts.*, count(*) OVER (PARTITION BY id) AS n FROM pts, (SELECT quantile_cont(lon, [0.001, 0.999]) AS qx, quantile_cont(lat, [0.001, 0.999]) AS qy FROM pts) WHERE lon BETWEEN qx[1] AND qx[2] AND lat BETWEEN qy[1] AND qy[2])",
        *_fold_of("(SELECT * FROM bb WHERE n >= 5)", _REACH),
        "s0 AS (SELECT id, seq, t, lon, lat FROM (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM f WHERE kept) WHERE c >= 5)",
        "s1 AS (SELECT *, id || '_' || sum(b) OVER (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS seg_id FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY id ORDER BY t, seq) > 300 THEN 1 ELSE 0 END AS b FROM s0))",
        "s2 AS (SELECT *, count(*) OVER (PARTITION BY seg_id) AS n, max(t) OVER (PARTITION BY seg_id) - min(t) OVER (PARTITION BY seg_id) AS span FROM s1)",
        "s3 AS (SELECT * FROM s2 WHERE n >= 5 AND span <= 10800)",
        recursive=True,
    ),
    "grid_density": _with("SELECT * FROM den", _cells(40)),
    "grid_high_density": _with("SELECT id, seq, loncol, latcol FROM cel JOIN den USING (loncol, latcol) WHERE n >= (SELECT quantile_cont(n, 0.5) FROM den)", C400),
    "grid_quantile_classes": _with("SELECT loncol, latcol, n, CAST(1 + " + " + ".join(f"CAST(n > (SELECT quantile_cont(n, {i / 7!r}) FROM den) AS INTEGER)" for i in range(1, 7)) + ' AS INTEGER) AS "class" FROM den', C400),
    "grid_polygons": _with(
        f"SELECT loncol, latcol, n, round(x - {_d(D400 / 2)}, 6) AS west, round(y - {_d(D400 / 2)}, 6) AS south, round(x + {_d(D400 / 2)}, 6) AS east, round(y + {_d(D400 / 2)}, 6) AS north FROM (SELECT *, (SELECT min(lon) FROM pts) + loncol * {_d(D400)} AS x, (SELECT min(lat) FROM pts) + latcol * {_d(D400)} AS y FROM den)", C400
    ),
    "grid_graph_nodes": _with(NODES, GRAPH),
    "grid_graph_edges": _with("SELECT from_node, to_node, round(length_m, 3) AS length_m FROM edg", GRAPH),
    "edge_subdivide": _with(
        "SELECT from_node, to_node, CAST(k AS INTEGER) AS k, round(ax + (bx - ax) * k / n, 4) AS x1, round(ay + (by_ - ay) * k / n, 4) AS y1, round(ax + (bx - ax) * (k + 1) / n, 4) AS x2, round(ay + (by_ - ay) * (k + 1) / n, 4) AS y2 FROM (SELECT *, greatest(1, CAST(ceil(length_m / 800) AS INTEGER)) AS n FROM (SELECT e.*, a.loncol * 400e0 AS ax, a.latcol * 400e0 AS ay, b.loncol * 400e0 AS bx, b.latcol * 400e0 AS by_ FROM edg e JOIN nod a ON a.node_id = from_node JOIN nod b ON b.node_id = to_node)), LATERAL (SELECT unnest(range(n)) AS k)",
        GRAPH,
    ),
    "largest_component": _with("SELECT node, component FROM big", COMP, recursive=True),
    "node_degree_top": _with("SELECT a AS node, count(*) AS degree FROM both_ GROUP BY a ORDER BY degree DESC, node LIMIT 15", GRAPH),
    "start_nodes": _with("SELECT node_id AS node FROM near WHERE k = 1 UNION (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 15) UNION SELECT node_id FROM xy WHERE (SELECT n FROM ext) < 200", STARTS, recursive=True),
    "hop_distance": _with(
        "SELECT start, node, min(d) AS hops FROM hop GROUP BY ALL",
        STARTS,
        "sta AS (SELECT node_id AS node FROM near WHERE k = 1 UNION (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 15) UNION SELECT node_id FROM xy WHERE (SELECT n FROM ext) < 200)",
        "hop AS (SELECT node AS start, node, CAST(0 AS BIGINT) AS d FROM sta UNION ALL SELECT h.start, e.b, min(h.d) + 1 FROM hop h JOIN both_ e ON e.a = h.node WHERE NOT EXISTS (SELECT 1 FROM recurring.hop r WHERE r.start = h.start AND r.node = e.b) GROUP BY h.start, e.b)",
        recursive=True,
    ),
    "curve_preview": _with(
        "SELECT key AS id, lag, round(msd, 3) AS msd, round(alpha, 6) AS alpha FROM crv WHERE key IN (SELECT key FROM (SELECT DISTINCT key FROM crv) ORDER BY md5('42:' || key), key LIMIT 50)",
        IND,
        _alpha("ind", "id", 5, "crv"),
    ),
    "dp_simplify": _with(f"SELECT {FIX} FROM smp", *_simplified("pts"), recursive=True),
    "geodesic_vs_haversine": _with(f"SELECT id, seq, round({H('p_lon', 'p_lat', 'lon', 'lat')}, 3) AS sphere_m, round(metres, 3) AS ellipsoid_m FROM ell", PREV, *_ellipsoid()),
    "process_chain": _with(
        f"SELECT {FIX}, dense_rank() OVER (ORDER BY id) AS new_id FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM smp) WHERE n >= 5",
        PREV,
        SEG,
        "q0 AS (SELECT seg_id AS id, seq, t, lon, lat FROM seg)",
        _neighbours("q0", "q1"),
        f"q2 AS (SELECT id || '_' || sum(CASE WHEN {H('p_lon', 'p_lat', 'lon', 'lat')} > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS id, seq, t, lon, lat FROM q1)",
        _neighbours("q2", "q3"),
        f"q4 AS (SELECT {FIX} FROM ({_sides('q3')}) WHERE NOT {_DRIFT})",
        _neighbours("q4", "q5"),
        f"q6 AS (SELECT {FIX} FROM q5 WHERE NOT {_SAME})",
        *_simplified("q6"),
        recursive=True,
    ),
}
