"""SQL fragments shared by the oracle queries."""

from __future__ import annotations

import math

from chronoweave.functions import geo
from chronoweave.functions.hexgrid import edge_length_m
from workload.tables import ENV, EPISODES, PAIRS, ROADS, TRAJ, ZONE  # noqa: F401


# WGS 84 third flattening, rectifying radius and transverse Mercator series as published (Karney 2011),
# on purpose not taken from the library they check.
THIRD_FLATTENING = 1.67922038638370426e-3
RECTIFYING_RADIUS = 6367449.145823415
SERIES = (8.3773182062446983e-4, 7.608527773572489e-7, 1.197645503242492e-9, 2.4291706803973131e-12)
SCALE = 0.9996


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (f"(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")


def utm(name: str, src: str, quads: list[tuple[str, str, str, str]], zone: int = ZONE) -> str:
    """CTEs adding metre columns to ``src`` under ``name``."""
    e = 2 * math.sqrt(THIRD_FLATTENING) / (1 + THIRD_FLATTENING)
    k = SCALE * RECTIFYING_RADIUS
    a = ", ".join(f"radians({lon}) - radians({zone * 6 - 183}) AS _l{i}, sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat})))) AS _t{i}"
                  for i, (lon, lat, _, _) in enumerate(quads))
    b = ", ".join(f"atan2(_t{i}, cos(_l{i})) AS _xi{i}, atanh(sin(_l{i}) / sqrt(1 + _t{i} * _t{i})) AS _et{i}" for i in range(len(quads)))
    c = ", ".join(
        f"5e5 + {k!r} * (_et{i}" + "".join(f" + {v!r} * cos({2 * j} * _xi{i}) * sinh({2 * j} * _et{i})" for j, v in enumerate(SERIES, 1)) + f") AS {x}, "
        f"{k!r} * (_xi{i}" + "".join(f" + {v!r} * sin({2 * j} * _xi{i}) * cosh({2 * j} * _et{i})" for j, v in enumerate(SERIES, 1)) + f") AS {y}"
        for i, (_, _, x, y) in enumerate(quads))
    return f"{name}_a AS (SELECT *, {a} FROM {src}), {name}_b AS (SELECT *, {b} FROM {name}_a), {name} AS (SELECT *, {c} FROM {name}_b)"


EDGES = f"""{ROADS},
{utm('legs_m', 'legs', [('px', 'py', 'x0', 'y0'), ('qx', 'qy', 'x1', 'y1')])},
edges AS (
  SELECT edge_id, source_id, highway, 5e0 AS class_kmh, x0, y0, x1, y1,
    CAST(round_even(x0 / 0.01e0, 0) AS BIGINT) * 2147483648 + CAST(round_even(y0 / 0.01e0, 0) AS BIGINT) AS u,
    CAST(round_even(x1 / 0.01e0, 0) AS BIGINT) * 2147483648 + CAST(round_even(y1 / 0.01e0, 0) AS BIGINT) AS v,
    sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS length_m,
    sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / (greatest(0.5e0, least(6.6e0, coalesce(CASE
      WHEN maxspeed LIKE '% mph' THEN try_cast(replace(maxspeed, ' mph', '') AS DOUBLE) * 1.609344e0
      WHEN maxspeed LIKE '% km/h' THEN try_cast(replace(maxspeed, ' km/h', '') AS DOUBLE)
      ELSE try_cast(nullif(maxspeed, '') AS DOUBLE) END, 5e0))) / 3.6e0) AS cost_sec
  FROM legs_m WHERE highway <> 'motorway'),
adj AS (SELECT node, nbr, min(cost_sec) AS step FROM (SELECT u AS node, v AS nbr, cost_sec FROM edges UNION ALL SELECT v, u, cost_sec FROM edges) GROUP BY 1, 2)"""


def foot(px: str = "p.x", py: str = "p.y") -> str:
    """Clamped fraction of the perpendicular foot on edge ``e``."""
    return (f"least(1e0, greatest(0e0, (({px} - e.x0) * (e.x1 - e.x0) + ({py} - e.y0) * (e.y1 - e.y0)) / "
            f"(pow(e.x1 - e.x0, 2) + pow(e.y1 - e.y0, 2))))")


def snap(name: str, points: str, key: str, limit: float, extra: str = "") -> str:
    """Nearest edge of every point row (``x, y``) by brute force."""
    return f"""{name}_d AS (
  SELECT p.*, e.edge_id, e.u, e.v, e.cost_sec, e.class_kmh, {foot()} AS fraction,
    sqrt(pow(p.x - (e.x0 + {foot()} * (e.x1 - e.x0)), 2) + pow(p.y - (e.y0 + {foot()} * (e.y1 - e.y0)), 2)) AS snap_m
  FROM {points} p JOIN edges e ON p.x BETWEEN least(e.x0, e.x1) - {limit} AND greatest(e.x0, e.x1) + {limit}
    AND p.y BETWEEN least(e.y0, e.y1) - {limit} AND greatest(e.y0, e.y1) + {limit}),
{name} AS (SELECT * FROM {name}_d WHERE snap_m <= {limit} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY snap_m, edge_id) = 1)"""


ENDS = f"""{EDGES}, {PAIRS},
ends0 AS (SELECT pair_id, 'A' AS role, a_lon AS lon, a_lat AS lat, (b_ms - a_ms) / 1000 - 60 AS cutoff FROM pairs
  UNION ALL SELECT pair_id, 'B', b_lon, b_lat, (b_ms - a_ms) / 1000 - 60 FROM pairs),
{utm('ends', 'ends0', [('lon', 'lat', 'x', 'y')])},
{snap('snapped', 'ends', 'pair_id, role', 50.0)}"""

LABELS = f"""{ENDS},
seeds AS (
  SELECT pair_id, role, u AS node, fraction * cost_sec AS seed, cutoff FROM snapped
  UNION ALL SELECT pair_id, role, v, (1 - fraction) * cost_sec, cutoff FROM snapped),
lab(pair_id, role, node, cost, cutoff) USING KEY (pair_id, role, node) AS (
  SELECT pair_id, role, node, min(seed), max(cutoff) FROM seeds WHERE seed <= cutoff GROUP BY 1, 2, 3
  UNION
  (SELECT l.pair_id, l.role, a.nbr, min(l.cost + a.step), max(l.cutoff)
   FROM lab l JOIN adj a ON a.node = l.node
   LEFT JOIN recurring.lab r ON r.pair_id = l.pair_id AND r.role = l.role AND r.node = a.nbr
   WHERE l.cost + a.step <= l.cutoff AND (r.cost IS NULL OR l.cost + a.step < r.cost)
   GROUP BY 1, 2, 3))"""

PRISM = f"""{LABELS},
direct AS (SELECT l.pair_id, min(l.cost + s.seed) AS shortest FROM lab l JOIN seeds s ON s.pair_id = l.pair_id AND s.role = 'B' AND s.node = l.node
  WHERE l.role = 'A' GROUP BY 1),
status AS (
  SELECT p.pair_id, (p.b_ms - p.a_ms) / 1000 AS budget, n.n = 2 AS snapped, CASE WHEN n.n = 2 THEN d.shortest END AS shortest,
    n.n = 2 AND coalesce(d.shortest <= (p.b_ms - p.a_ms) / 1000 - 60 + 1e-6, false) AS feasible
  FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM snapped GROUP BY 1) n USING (pair_id) LEFT JOIN direct d USING (pair_id)),
touched AS (
  SELECT l.pair_id, e.edge_id, min(CASE WHEN l.role = 'A' AND l.node = e.u THEN l.cost END) AS ua, min(CASE WHEN l.role = 'A' AND l.node = e.v THEN l.cost END) AS va,
    min(CASE WHEN l.role = 'B' AND l.node = e.u THEN l.cost END) AS ub, min(CASE WHEN l.role = 'B' AND l.node = e.v THEN l.cost END) AS vb
  FROM lab l JOIN (SELECT edge_id, u, v, u AS node FROM edges UNION ALL SELECT edge_id, u, v, v FROM edges) e ON e.node = l.node
  JOIN status s ON s.pair_id = l.pair_id AND s.feasible GROUP BY 1, 2),
filled AS (
  SELECT t.pair_id, t.edge_id, e.highway, e.length_m, e.cost_sec AS c, s.budget, s.shortest, px, py, qx, qy,
    coalesce(ua, 1e15) AS ua, coalesce(va, 1e15) AS va, coalesce(ub, 1e15) AS ub, coalesce(vb, 1e15) AS vb
  FROM touched t JOIN edges e USING (edge_id) JOIN legs g USING (edge_id) JOIN status s USING (pair_id)),
tents AS (
  SELECT *, {', '.join(f"least(ua + c * {s}e0, va + c * {1 - s}e0) + least(ub + c * {s}e0, vb + c * {1 - s}e0) AS g{i}" for i, s in enumerate((0.0, 0.25, 0.5, 0.75, 1.0)))}
  FROM filled),
prism AS (
  SELECT pair_id, edge_id, highway, length_m, px, py, qx, qy, budget, least(ua, va) AS forward_sec, least(ub, vb) AS backward_sec,
    least(g0, g4) AS total_min, greatest(0, budget - greatest(g0, g1, g2, g3, g4)) AS act_min, budget - g2 AS act_mid, budget - least(g0, g4) AS act_max,
    least(1e0, greatest(0e0, 0.5e0 + (least(ua, va) - least(ub, vb)) / (2 * budget))) AS time_progress
  FROM tents WHERE least(g0, g4) <= budget - 60 + 1e-6)"""


def hex_of(lon: str, lat: str, res: int, lat0: float) -> tuple[str, str]:
    """Axial coordinates by cube rounding."""
    sx, sy, e = geo.GRID_M_PER_DEG * math.cos(math.radians(lat0)), geo.GRID_M_PER_DEG, edge_length_m(res)
    q = f"((({lon}) * {sx!r} * {math.sqrt(3) / 3!r} - ({lat}) * {sy!r} / 3) / {e!r})"
    r = f"((({lat}) * {sy!r} * {2.0 / 3!r}) / {e!r})"
    s = f"(-{q} - {r})"
    dq, dr, ds = (f"abs(round({v}) - {v})" for v in (q, r, s))
    fix_q = f"({dq} > {dr} AND {dq} > {ds})"
    return (f"CAST(CASE WHEN {fix_q} THEN -round({r}) - round({s}) ELSE round({q}) END AS BIGINT)",
            f"CAST(CASE WHEN NOT {fix_q} AND {dr} > {ds} THEN -round({q}) - round({s}) ELSE round({r}) END AS BIGINT)")


def hex_center(q: str, r: str, res: int, lat0: float) -> tuple[str, str]:
    sx, sy, e = geo.GRID_M_PER_DEG * math.cos(math.radians(lat0)), geo.GRID_M_PER_DEG, edge_length_m(res)
    return f"(({q} + {r} / 2e0) * {e * math.sqrt(3)!r} / {sx!r})", f"({r} * {1.5 * e!r} / {sy!r})"


BANDWIDTH = """ext AS (SELECT count(*) AS n, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1, avg(lon) AS mx, avg(lat) AS my,
    min(t_ms) AS t0, max(t_ms) AS t1 FROM traj),
dist AS (SELECT pow(lon - mx, 2) + pow(lat - my, 2) AS d2 FROM traj, ext),
bw AS (SELECT 0.9e0 * least(sqrt(avg(d2)), quantile_cont(sqrt(d2), 0.5) / 0.6745e0) * pow((SELECT n FROM ext), -1e0 / 6) AS h FROM dist),
grid0 AS (SELECT x0 - h AS gx, y0 - h AS gy, x1 + h - (x0 - h) AS dx, y1 + h - (y0 - h) AS dy, cos(radians((y0 - h + y1 + h) / 2)) AS k, h, t0, t1 FROM ext, bw),
grid1 AS (SELECT *, least(dx, dy) / 50 AS cell, ceil(dx / (least(dx, dy) / 50 / k)) AS c0, ceil(dy / (least(dx, dy) / 50)) AS r0 FROM grid0),
grid AS (
  SELECT gx, gy, h, t0, t1, CASE WHEN c0 * r0 > 2500 THEN floor(c0 * sqrt(2500 / (c0 * r0))) ELSE c0 END AS n_cols,
    CASE WHEN c0 * r0 > 2500 THEN floor(r0 * sqrt(2500 / (c0 * r0))) ELSE r0 END AS n_rows,
    CASE WHEN c0 * r0 > 2500 THEN dx / floor(c0 * sqrt(2500 / (c0 * r0))) ELSE cell / k END AS cx,
    CASE WHEN c0 * r0 > 2500 THEN dy / floor(r0 * sqrt(2500 / (c0 * r0))) ELSE cell END AS cy FROM grid1)"""

CUBE = f"""{TRAJ}, {BANDWIDTH},
binned AS (
  SELECT t.*, (t_ms - t0) / 1000e0 AS t_s, CAST(least(n_cols - 1, floor((lon - gx) / cx)) AS INTEGER) AS col,
    CAST(least(n_rows - 1, floor((lat - gy) / cy)) AS INTEGER) AS row,
    CAST(least(9, floor((t_ms - t0) / ((t1 - t0) / 10e0))) AS INTEGER) AS t_idx FROM traj t, grid)"""

PASTA = f"""{EPISODES},
ended AS (SELECT *, coalesce(lead(start_ms) OVER (PARTITION BY person_id ORDER BY start_ms, episode_id), start_ms + 1800000) AS end_ms,
    activity_type IN ('home', 'work') AS is_fixed FROM episodes),
kept AS (SELECT * FROM ended WHERE end_ms > start_ms),
gaps AS (SELECT *, sum(CASE WHEN is_fixed THEN 1 ELSE 0 END) OVER (PARTITION BY person_id ORDER BY start_ms, episode_id ROWS UNBOUNDED PRECEDING) AS gap FROM kept),
flex AS (SELECT person_id, gap, arg_min(mode, struct_pack(a := start_ms, b := episode_id)) AS mode, max(weight) AS weight, count(*) AS flexible_count
  FROM gaps WHERE NOT is_fixed AND gap > 0 GROUP BY 1, 2),
windows AS (
  SELECT f.*, f.person_id || '-' || f.gap AS window_id, p.lon AS from_lon, p.lat AS from_lat, p.end_ms AS from_ms, p.activity_type AS from_activity,
    n.lon AS to_lon, n.lat AS to_lat, n.start_ms AS to_ms, n.activity_type AS to_activity, (n.start_ms - p.end_ms) / 1000e0 AS budget_s,
    CASE f.mode WHEN 'walking' THEN 5e0 WHEN 'cycling' THEN 15e0 ELSE 5e0 END AS speed_kmh
  FROM flex f JOIN gaps p ON p.person_id = f.person_id AND p.gap = f.gap AND p.is_fixed
  JOIN gaps n ON n.person_id = f.person_id AND n.gap = f.gap + 1 AND n.is_fixed),
checked AS (SELECT *, speed_kmh * 1000 / 3600 AS speed_ms,
  budget_s > 0 AND {haversine('from_lon', 'from_lat', 'to_lon', 'to_lat')} / (speed_kmh * 1000 / 3600) + 600 <= budget_s AS feasible FROM windows)"""

PASTA_CELLS = f"""{PASTA},
pg0 AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM episodes),
pg1 AS (SELECT pg0.*, greatest((SELECT max(speed_ms) * max(budget_s) FROM checked) / 111000, 1000e0 / 111000) * 1.05e0 AS b FROM pg0),
pg2 AS (SELECT x0 - b AS gx, y0 - b AS gy, x1 + b AS hx, y1 + b AS hy, 1000e0 / 111000 AS d FROM pg1),
pg AS (SELECT *, CAST(ceil((hx - gx) / d) AS INTEGER) AS cols, CAST(ceil((hy - gy) / d) AS INTEGER) AS rows FROM pg2),
cells0 AS (
  SELECT w.*, CAST(r.r AS INTEGER) AS row, CAST(c.c AS INTEGER) AS col,
    {haversine('from_lon', 'from_lat', '(gx + (c.c + 0.5e0) * d)', '(gy + (r.r + 0.5e0) * d)')} / speed_ms AS go_s,
    {haversine('(gx + (c.c + 0.5e0) * d)', '(gy + (r.r + 0.5e0) * d)', 'to_lon', 'to_lat')} / speed_ms AS back_s
  FROM checked w, pg JOIN range(0, 20000) r(r) ON r.r < rows JOIN range(0, 20000) c(c) ON c.c < cols
  WHERE w.feasible AND abs(gy + (r.r + 0.5e0) * d - (from_lat + to_lat) / 2) < budget_s * speed_ms / 111000
    AND abs(gx + (c.c + 0.5e0) * d - (from_lon + to_lon) / 2) * 0.65e0 < budget_s * speed_ms / 111000),
cells AS (SELECT *, budget_s - go_s - back_s AS dwell_s FROM cells0 WHERE budget_s - go_s - back_s >= 600)"""
