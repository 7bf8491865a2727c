"""Registered queries on persons who meet, miss each other or keep within their prisms, and on streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.functions import hexgrid
from chronoweave.functions.geo import GRID_M_PER_DEG
from chronoweave.operators import meetings, prism, shared
from chronoweave.operators.grid import Grid
from chronoweave.plans import JOBS
from chronoweave.plans.run import run_job
from chronoweave.session import work_folder
from chronoweave.sources import layout
from chronoweave.streaming import cube as streams
from workload import sql as S
from workload import tables as t
from workload.queries import _PX, _PY, ORACLES, QUERIES, query, r  # noqa: F401

# ================================================================ streams

LAYOUT = streams.Layout(Grid(-79.5, 43.6, 0.005, 0.005, 60, 60), 21_600_000)


@query(f"""WITH {S.TRAJ} SELECT t_ms // 21600000 AS t_idx, CAST(floor((lat - 43.6e0) / 0.005e0) AS INTEGER) AS row,
  CAST(floor((lon - -79.5e0) / 0.005e0) AS INTEGER) AS col, count(*) AS count, round(avg(value), 6) AS env_value FROM traj GROUP BY ALL""")
def streaming_cube(spark, sf):
    """The events table read as a stream of files, cells of six hours on a fixed grid."""
    # a pattern: the table may be one file or a folder
    events = spark.readStream.schema(t.table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")
    folder = work_folder(spark, "stream-cube")
    # files come in any order: nothing is late within the table's month
    streams.update_cube(t.fixes_of(events), LAYOUT, folder, "40 days", "value")
    cells = streams.read_cube(spark, folder)
    return cells.select("t_idx", "row", "col", "count", r(F.col("env_sum") / F.nullif(F.col("env_count"), F.lit(0))).alias("env_value"))


# ================================================================ encounters

REACH_M, MEETING_M, GAP_MS = 250.0, 50.0, 86_400_000

_APPROACHES = f"""{S.TRAJ}, seg AS (SELECT user_id, t_ms AS t0, lead(t_ms) OVER w AS t1, lon AS x0, lat AS y0, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1
  FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id) QUALIFY t1 IS NOT NULL AND t1 - t0 <= {GAP_MS}),
v AS (SELECT *, coalesce((x1 - x0) / nullif(t1 - t0, 0), 0) AS vx, coalesce((y1 - y0) / nullif(t1 - t0, 0), 0) AS vy,
  greatest(cos(radians((y0 + y1) / 2)), 0.01e0) * {GRID_M_PER_DEG!r} AS k FROM seg),
m0 AS (SELECT a.user_id AS user_a, b.user_id AS user_b, greatest(a.t0, b.t0) AS s, least(a.t1, b.t1) AS e, b.x0 AS x0, b.y0 AS y0, b.t0 AS t0, b.vx AS bvx, b.vy AS bvy,
  ((b.x0 + b.vx * (greatest(a.t0, b.t0) - b.t0)) - (a.x0 + a.vx * (greatest(a.t0, b.t0) - a.t0))) * a.k AS rx, (b.vx - a.vx) * a.k AS wx,
  ((b.y0 + b.vy * (greatest(a.t0, b.t0) - b.t0)) - (a.y0 + a.vy * (greatest(a.t0, b.t0) - a.t0))) * {GRID_M_PER_DEG!r} AS ry, (b.vy - a.vy) * {GRID_M_PER_DEG!r} AS wy
  FROM v a JOIN v b ON a.user_id < b.user_id AND a.t0 <= b.t1 AND b.t0 <= a.t1),
m1 AS (SELECT *, wx * wx + wy * wy AS q2, rx * wx + ry * wy AS q1, rx * rx + ry * ry AS q0, CAST(e - s AS DOUBLE) AS span FROM m0),
m2 AS (SELECT *, greatest(0e0, least(span, coalesce(-q1 / nullif(q2, 0e0), 0e0))) AS near FROM m1),
m3 AS (SELECT *, pow(rx + wx * near, 2) + pow(ry + wy * near, 2) AS d2, sqrt(greatest(0e0, q1 * q1 - q2 * (q0 - {REACH_M ** 2!r}))) AS root FROM m2),
met AS (SELECT user_a, user_b, s + near AS t, sqrt(d2) AS d, x0 + bvx * (s + near - t0) AS x, y0 + bvy * (s + near - t0) AS y,
  CASE WHEN q2 = 0 OR (-q1 - root) / q2 <= 0 THEN CAST(s AS DOUBLE) ELSE s + least((-q1 - root) / q2, near) END AS enter_ms,
  CASE WHEN q2 = 0 OR (-q1 + root) / q2 >= span THEN CAST(e AS DOUBLE) ELSE s + greatest((-q1 + root) / q2, near) END AS leave_ms
  FROM m3 WHERE d2 <= {REACH_M ** 2!r})"""


@query(f"""WITH {_APPROACHES} SELECT user_a, user_b, round(t / 1000) AS closest_s, round(enter_ms / 1000) AS enter_s, round(leave_ms / 1000) AS leave_s, round(d, 2) AS closest_m,
  round(x, 6) AS lon, round(y, 6) AS lat FROM met""")
def approaches(spark, sf):
    """Every two motions that come within 250 m of each other while they last."""
    out = meetings.approaches(meetings.motions(t.traj(spark, sf), GAP_MS), REACH_M)
    return out.select("user_a", "user_b", *[F.round(F.col(f"{c}_ms") / 1000).alias(f"{c}_s") for c in ("closest", "enter", "leave")],
                      r("closest_m", 2).alias("closest_m"), r("lon").alias("lon"), r("lat").alias("lat"))


@query(f"""WITH {_APPROACHES}, o AS (SELECT *, CASE WHEN enter_ms <= max(leave_ms) OVER (PARTITION BY user_a, user_b ORDER BY enter_ms, leave_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM met),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_a, user_b ORDER BY enter_ms, leave_ms ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_a, user_b, round(min(enter_ms) / 1000) AS start_s, round(max(leave_ms) / 1000) AS end_s, round(min(d), 2) AS closest_m,
  CASE WHEN min(d) <= {MEETING_M!r} THEN 'meeting' ELSE 'near' END AS kind FROM runs GROUP BY user_a, user_b, run""")
def encounters(spark, sf):
    """Uninterrupted times within 250 m, meetings within 50 m told apart."""
    out = JOBS["encounters"](t.traj(spark, sf), reach_m=REACH_M, meeting_m=MEETING_M, max_gap_ms=GAP_MS)["encounters"]
    return out.select("user_a", "user_b", F.round(F.col("start_ms") / 1000).alias("start_s"), F.round(F.col("end_ms") / 1000).alias("end_s"),
                      r("closest_m", 2).alias("closest_m"), "kind")


_HQ, _HR = S.hex_of("lon", "lat", 8, 44)
_VISITS = f"""{S.TRAJ}, h AS (SELECT *, {_HQ} AS hex_q, {_HR} AS hex_r FROM traj),
c AS (SELECT *, CASE WHEN hex_q = lag(hex_q) OVER w AND hex_r = lag(hex_r) OVER w THEN 0 ELSE 1 END AS moved FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id)),
i AS (SELECT *, sum(moved) OVER (PARTITION BY user_id ORDER BY t_ms, point_id ROWS UNBOUNDED PRECEDING) AS stay FROM c),
visits AS (SELECT user_id, hex_q, hex_r, arg_min(point_id, {{'t': t_ms, 'p': point_id}}) AS visit, min(t_ms) AS arrive_ms, max(t_ms) AS leave_ms, count(*) AS fixes FROM i GROUP BY user_id, stay, hex_q, hex_r)"""


@query(f"WITH {_VISITS} SELECT * FROM visits")
def place_visits(spark, sf):
    return meetings.visits(t.traj(spark, sf), hexgrid.to_hex(F.col("lon"), F.col("lat"), 8, 44.0)).select("user_id", "place.*", "visit", "arrive_ms", "leave_ms", "fixes")


@query(f"""WITH {_VISITS} SELECT v.hex_q, v.hex_r, v.user_id, v.visit, v.leave_ms, n.user_id AS next_user, n.visit AS next_visit, n.arrive_ms AS next_ms,
  (n.arrive_ms - v.leave_ms) / 1000e0 AS gap_s FROM visits v JOIN visits n ON n.hex_q = v.hex_q AND n.hex_r = v.hex_r AND n.user_id <> v.user_id
  AND n.arrive_ms > v.leave_ms AND n.arrive_ms - v.leave_ms <= 14400000 QUALIFY row_number() OVER (PARTITION BY v.visit ORDER BY n.arrive_ms, n.visit) = 1""")
def temporal_misses(spark, sf):
    """The next visitor of a place within four hours of somebody's leaving it."""
    out = JOBS["temporal_misses"](t.traj(spark, sf), max_gap_ms=14_400_000, resolution=8, lat0=44.0)["misses"]
    return out.select("place.*", "user_id", "visit", "leave_ms", "next_user", "next_visit", "next_ms", "gap_s")


# ================================================================ groups and days

GROUP_M = 600.0


@query(f"""WITH RECURSIVE {_APPROACHES.replace(repr(REACH_M ** 2), repr(GROUP_M ** 2))},
o AS (SELECT *, CASE WHEN enter_ms <= max(leave_ms) OVER (PARTITION BY user_a, user_b ORDER BY enter_ms, leave_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM met),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_a, user_b ORDER BY enter_ms, leave_ms ROWS UNBOUNDED PRECEDING) AS run FROM o),
e AS (SELECT user_a, user_b, CAST(round(min(enter_ms)) AS BIGINT) AS s, CAST(round(max(leave_ms)) AS BIGINT) AS e FROM runs GROUP BY user_a, user_b, run),
marks AS (SELECT DISTINCT unnest([s, e]) AS mark FROM e), spans AS (SELECT row_number() OVER (ORDER BY mark) AS nth, mark AS s, lead(mark) OVER (ORDER BY mark) AS e FROM marks),
now AS (SELECT nth, user_a AS a, user_b AS b FROM spans JOIN e ON e.s < spans.e AND spans.s < e.e WHERE spans.e IS NOT NULL),
edges AS (SELECT nth, a, b FROM now UNION SELECT nth, b, a FROM now),
reach(nth, a, b) AS (SELECT nth, a, b FROM edges UNION SELECT r.nth, r.a, e.b FROM reach r JOIN edges e ON e.nth = r.nth AND e.a = r.b),
groups AS (SELECT DISTINCT nth, list_sort(list_distinct(list(b))) AS members FROM reach GROUP BY nth, a),
big AS (SELECT nth, members, nth - row_number() OVER (PARTITION BY members ORDER BY nth) AS island FROM groups WHERE len(members) >= 3)
SELECT array_to_string(members, ',') AS members, len(any_value(members))::INTEGER AS size, round(min(s) / 1000) AS start_s, round(max(e) / 1000) AS end_s
FROM big JOIN spans USING (nth) GROUP BY members, island HAVING max(e) - min(s) >= 60000""")
def bundles(spark, sf):
    """Three or more persons within 600 m of each other, from one to the next, for a minute at least."""
    out = JOBS["bundles"](t.traj(spark, sf), reach_m=GROUP_M, max_gap_ms=GAP_MS, min_ms=60_000)["bundles"]
    return out.select(F.array_join("members", ",").alias("members"), "size", F.round(F.col("start_ms") / 1000).alias("start_s"), F.round(F.col("end_ms") / 1000).alias("end_s"))


_DAYS = f"""{S.TRAJ}, g AS (SELECT *, CASE WHEN t_ms - lag(t_ms) OVER w < 3600000 THEN 0 ELSE 1 END AS new FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t_ms, point_id ROWS UNBOUNDED PRECEDING) AS nth FROM g),
stays AS (SELECT user_id, min(t_ms) AS start_ms, max(t_ms) AS end_ms, avg(lon) AS lon, avg(lat) AS lat, count(*) AS fixes, CAST(floor(avg(lon) / 0.005e0) AS BIGINT) AS cx,
  CAST(floor(avg(lat) / 0.005e0) AS BIGINT) AS cy FROM n GROUP BY user_id, nth),
cores AS (SELECT user_id, cx, cy FROM stays GROUP BY ALL HAVING count(*) >= 3),
hop AS (SELECT a.user_id, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by_ FROM cores a JOIN cores b ON a.user_id = b.user_id AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1),
reach(user_id, ax, ay, bx, by_) AS (SELECT * FROM hop UNION SELECT r.user_id, r.ax, r.ay, h.bx, h.by_ FROM reach r JOIN hop h ON h.user_id = r.user_id AND h.ax = r.bx AND h.ay = r.by_),
named AS (SELECT user_id, ax AS cx, ay AS cy, min({{'cx': bx, 'cy': by_}}) AS station FROM reach GROUP BY 1, 2, 3),
placed AS (SELECT s.*, (SELECT arg_min(m.station, {{'other': m.cx <> s.cx OR m.cy <> s.cy, 'st': m.station}}) FROM named m WHERE m.user_id = s.user_id AND abs(m.cx - s.cx) <= 1 AND abs(m.cy - s.cy) <= 1) AS station FROM stays s)"""


@query(f"""WITH RECURSIVE {_DAYS} SELECT user_id, start_ms, end_ms, fixes, round(lon, 8) AS lon, round(lat, 8) AS lat, station.cx AS station_x, station.cy AS station_y FROM placed""")
def station_stays(spark, sf):
    """Stays between pauses of an hour, and the dense places they belong to."""
    out = JOBS["daily_routines"](t.traj(spark, sf), cell_deg=0.005)["stays"]
    return out.select("user_id", "start_ms", "end_ms", "fixes", r("lon", 8).alias("lon"), r("lat", 8).alias("lat"),
                      F.col("station.cx").alias("station_x"), F.col("station.cy").alias("station_y"))


_SEQUENCES = f"""{_DAYS}, dated AS (SELECT user_id, start_ms // 86400000 AS day, start_ms, station FROM placed WHERE station IS NOT NULL),
moved AS (SELECT * FROM dated QUALIFY station IS DISTINCT FROM lag(station) OVER (PARTITION BY user_id, day ORDER BY start_ms)),
days AS (SELECT user_id, day, list(station.cx || ':' || station.cy ORDER BY start_ms) AS sequence FROM moved GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_SEQUENCES} SELECT user_id, array_to_string(sequence, ' ') AS sequence, count(*) AS days,
  round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM days GROUP BY user_id, sequence""")
def daily_routines(spark, sf):
    """On how many days each person's sequence of stations recurs."""
    out = JOBS["daily_routines"](t.traj(spark, sf), cell_deg=0.005)["routines"]
    text = F.array_join(F.transform("sequence", lambda s: F.concat_ws(":", s["cx"], s["cy"])), " ")
    return out.select("user_id", text.alias("sequence"), "days", r("share").alias("share"))


@query(f"""WITH RECURSIVE {_SEQUENCES}, m AS (SELECT user_id, sequence, unnest(range(1, len(sequence))) AS i FROM days)
SELECT user_id, sequence[i] AS "from", sequence[i + 1] AS "to", count(*) AS count FROM m GROUP BY ALL""")
def station_transitions(spark, sf):
    out = JOBS["daily_routines"](t.traj(spark, sf), cell_deg=0.005)["transitions"]
    return out.select("user_id", *[F.concat_ws(":", f"{c}.cx", f"{c}.cy").alias(c) for c in ("from", "to")], "count")


# ================================================================ prisms

STEP_MS = 30_000
_WALK = 5 / 3.6
_REACH_HEXES = f"""{S.PAIRS}, f AS (SELECT *, (b_ms - a_ms) / 1000e0 AS dt, (a_lon + b_lon) / 2 AS mx, (a_lat + b_lat) / 2 AS my FROM pairs
  WHERE {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000e0 * {_WALK!r}),
r AS (SELECT *, unnest(range(CAST(floor((my * 111320 - dt * 0.9) / {1.5 * hexgrid.edge_length_m(10)!r}) AS BIGINT), CAST(ceil((my * 111320 + dt * 0.9) / {1.5 * hexgrid.edge_length_m(10)!r}) AS BIGINT) + 1)) AS r FROM f),
q AS (SELECT *, unnest(range(CAST(floor((mx * {111320 * 0.7193398003386512!r} - dt * 0.9) / {hexgrid.edge_length_m(10) * 3 ** 0.5!r} - r / 2e0) AS BIGINT), CAST(ceil((mx * {111320 * 0.7193398003386512!r} + dt * 0.9) / {hexgrid.edge_length_m(10) * 3 ** 0.5!r} - r / 2e0) AS BIGINT) + 1)) AS q FROM r),
occupied AS (SELECT pair_id, q.q AS hex_q, q.r AS hex_r,
  CAST(ceil((a_ms + sqrt(pow(({_PX} - a_lon) * cos(radians(a_lat)), 2) + pow({_PY} - a_lat, 2)) * {111000 * 1000 / _WALK!r}) / {STEP_MS}) AS BIGINT) AS first,
  CAST(floor((b_ms - sqrt(pow(({_PX} - b_lon) * cos(radians(b_lat)), 2) + pow({_PY} - b_lat, 2)) * {111000 * 1000 / _WALK!r}) / {STEP_MS}) AS BIGINT) AS last FROM q)"""


def _trips(spark, sf):
    return prism.with_trip(t.pairs(spark, sf), _WALK)


@query(f"WITH {_REACH_HEXES} SELECT * FROM occupied WHERE first <= last")
def prism_occupancy(spark, sf):
    """When each trip can be in each hexagon, in steps of half a minute."""
    return shared.occupancy(_trips(spark, sf), _WALK, STEP_MS, 10, 44.0)


@query(f"""WITH {_REACH_HEXES}, voxels AS (SELECT pair_id, hex_q, hex_r, unnest(range(first, last + 1)) AS at FROM occupied WHERE first <= last)
SELECT a.pair_id, b.pair_id AS other, count(DISTINCT (a.hex_q, a.hex_r)) AS shared_cells, count(*) AS shared_voxels, min(a.at) * {STEP_MS} AS first_ms, max(a.at) * {STEP_MS} AS last_ms
FROM voxels a JOIN voxels b ON a.hex_q = b.hex_q AND a.hex_r = b.hex_r AND a.at = b.at AND a.pair_id < b.pair_id GROUP BY 1, 2""")
def prism_intersections(spark, sf):
    """Trips that could have met: hexagons and instants that both can reach."""
    return JOBS["prism_intersections"](t.pairs(spark, sf), step_ms=STEP_MS, resolution=10, lat0=44.0)["intersections"]


def _anchored(spark, sf):
    """Prisms between a person's consecutive views, of two days at most."""
    views = t.traj(spark, sf).filter("label = 'view'")
    return prism.path_pairs(views).filter("b_ms - a_ms <= 172800000")


_SLOW = 0.5 / 3.6
_CHECKED = f"""{S.TRAJ}, prisms AS (SELECT user_id, lon AS a_lon, lat AS a_lat, t_ms AS a_ms, lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat, lead(t_ms) OVER w AS b_ms
  FROM traj WHERE label = 'view' WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id) QUALIFY b_ms IS NOT NULL AND b_ms - a_ms <= 172800000),
met AS (SELECT t.point_id, count(p.a_ms) AS prisms, count(*) FILTER ({S.haversine('p.a_lon', 'p.a_lat', 't.lon', 't.lat')} <= (t.t_ms - p.a_ms) / 1000e0 * {_SLOW!r}
  AND {S.haversine('t.lon', 't.lat', 'p.b_lon', 'p.b_lat')} <= (p.b_ms - t.t_ms) / 1000e0 * {_SLOW!r}) AS reached
  FROM traj t LEFT JOIN prisms p ON p.user_id = t.user_id AND t.t_ms BETWEEN p.a_ms AND p.b_ms GROUP BY 1),
checked AS (SELECT t.user_id, m.*, CASE WHEN reached > 0 THEN 'inside' WHEN prisms > 0 THEN 'outside' ELSE 'no_prism' END AS status FROM met m JOIN traj t USING (point_id))"""


def _checked(spark, sf):
    acts = t.traj(spark, sf).select(F.col("point_id").alias("activity_id"), "user_id", "t_ms", "lon", "lat")
    return JOBS["observed_activities"](acts, _anchored(spark, sf), mode="custom", custom_kmh=0.5)


@query(f"WITH {_CHECKED} SELECT point_id AS activity_id, user_id, prisms, reached, status FROM checked")
def observed_activities(spark, sf):
    """Whether each fix keeps within the prisms between the person's views."""
    return _checked(spark, sf)["activities"].select("activity_id", "user_id", "prisms", "reached", "status")


@query(f"""WITH {_CHECKED} SELECT user_id, count(*) FILTER (status = 'inside') AS inside, count(*) FILTER (status = 'outside') AS outside,
  count(*) FILTER (status = 'no_prism') AS no_prism FROM checked GROUP BY 1""")
def observed_activity_counts(spark, sf):
    return _checked(spark, sf)["counts"]


# ================================================================ reports and layouts


@query(f"""WITH {S.PAIRS}, f AS (SELECT {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000e0 * {1.2 / 3.6!r} AS ok FROM pairs),
n AS (SELECT count(*) FILTER (ok) AS yes, count(*) FILTER (NOT ok) AS no FROM f)
SELECT 'feasible' AS name, CAST(yes AS DOUBLE) AS value, NULL::VARCHAR AS message FROM n UNION ALL SELECT 'infeasible', no, NULL FROM n
UNION ALL SELECT 'warning', NULL, no || ' trips are too far for their time' FROM n WHERE no > 0""")
def trip_report(spark, sf):
    """What the prisms of slow walkers leave out, counted while they are written."""
    out = run_job(JOBS["two_anchor_prism"], t.pairs(spark, sf), into=work_folder(spark, "prisms"), mode="custom", custom_kmh=1.2, lat0=44.0)
    return out["report"].select("name", "value", "message")


@query(f"""WITH {S.TRAJ}, b AS (SELECT min(t_ms) AS t0, max(t_ms) AS t1, CAST(ceil((max(t_ms) - min(t_ms)) / 1000e0 / 3600) AS BIGINT) AS steps FROM traj),
w AS (SELECT *, (t1 - t0) / 1000e0 / 240 AS wide FROM b)
SELECT 'slices' AS step, 'note' AS name, NULL::DOUBLE AS value, steps || ' slices of 1h; widened to ' || printf('%.2f', wide / 3600) || 'h' AS message FROM w
UNION ALL SELECT 'cubes', 'fixes', count(*), NULL FROM traj""")
def cube_report(spark, sf):
    """Hourly slices of a month, at most 240 of them."""
    out = run_job(JOBS["space_time_cube"], t.traj(spark, sf), into=work_folder(spark, "cube"), method="fixed_duration", duration_s=3600.0, max_slices=240, path=False)
    return out["report"].filter("name <> 'cells'")


_BOX = (-79.47, 43.62, -79.45, 43.64)


@query(f"""WITH {S.ROADS}, b AS (SELECT source_id, min(least(px, qx)) AS west, min(least(py, qy)) AS south, max(greatest(px, qx)) AS east, max(greatest(py, qy)) AS north FROM legs GROUP BY 1)
SELECT source_id, round(west, 6) AS west, round(north, 6) AS north FROM b WHERE west <= {_BOX[2]} AND east >= {_BOX[0]} AND south <= {_BOX[3]} AND north >= {_BOX[1]}""")
def roads_in_box(spark, sf):
    """Streets of a small box, read from a table laid out by place."""
    folder = work_folder(spark, "roads")
    layout.write_places(t.roads(spark, sf), folder, "coords")
    return layout.read_places(spark, folder, _BOX).select("source_id", r("west").alias("west"), r("north").alias("north"))
