"""Every registered query with, where SQL can say it, the same answer in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import hexgrid
from chronoweave.functions import time as when
from chronoweave.functions.geo import corridor_extent, ellipse_extent, extent_area_km2, padded_extent
from chronoweave.functions.roads import congestion_factor, mode_profile
from chronoweave.operators import area, corridor, fold, grid, kernel, pasta, prism, trajectory
from chronoweave.operators import network as net
from chronoweave.plans import JOBS, jobs
from chronoweave.session import cut_lineage
from chronoweave.sources import points, sinks
from workload import sql as S
from workload import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def r(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


# ================================================================ trajectories


@query(f"""WITH {S.TRAJ}, b AS (SELECT min(t_ms) AS t0, max(t_ms) AS t1, greatest(max(lon) - min(lon), max(lat) - min(lat)) AS s FROM traj),
o AS (SELECT *, row_number() OVER (ORDER BY user_id, t_ms, point_id) - 1 AS sequence,
  lag(point_id) OVER w AS p, lead(point_id) OVER w AS n FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id))
SELECT point_id, user_id, sequence, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_index, t_ms AS timestamp_ms,
  round((t_ms - t0) / CAST(t1 - t0 AS DOUBLE), 6) AS time_progress,
  round((t_ms - t0) / CAST(t1 - t0 AS DOUBLE) * greatest(s * 55500, 1000), 3) AS height_m,
  CASE WHEN p IS NULL THEN -1 ELSE sequence - 1 END AS prev_seq, CASE WHEN n IS NULL THEN -1 ELSE sequence + 1 END AS next_seq FROM o, b""")
def path_3d(spark, sf):
    out = JOBS["trajectory"](t.traj(spark, sf))["trajectory"]
    seq = F.col("sequence")
    return out.select("point_id", "user_id", "sequence", "user_index", "timestamp_ms", r("time_progress").alias("time_progress"),
                      r("height_m", 3).alias("height_m"),
                      F.when(F.array_contains("neighbors", seq - 1), seq - 1).otherwise(F.lit(-1)).cast("long").alias("prev_seq"),
                      F.when(F.array_contains("neighbors", seq + 1), seq + 1).otherwise(F.lit(-1)).cast("long").alias("next_seq"))


@query(f"""WITH {S.TRAJ}, e AS (SELECT *, t_ms - min(t_ms // 86400000 * 86400000) OVER (PARTITION BY user_id) AS elapsed_ms FROM traj)
SELECT point_id, elapsed_ms, round(elapsed_ms / CAST((SELECT max(elapsed_ms) FROM e) AS DOUBLE), 6) AS time_progress,
  (SELECT min(t_ms) // 86400000 * 86400000 FROM traj) + elapsed_ms AS timestamp_ms FROM e""")
def path_3d_aligned(spark, sf):
    out = JOBS["trajectory"](t.traj(spark, sf), align=True)["trajectory"]
    return out.select("point_id", "elapsed_ms", r("time_progress").alias("time_progress"), "timestamp_ms")


@query(f"""WITH {S.TRAJ}, o AS (SELECT user_id, min(t_ms) AS f FROM traj GROUP BY 1)
SELECT user_id, f AS first_ms, f // 86400000 * 86400000 AS first_day_ms,
  CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS user_index FROM o""")
def user_origins(spark, sf):
    df = t.traj(spark, sf)
    return (trajectory.user_origin(df).withColumnRenamed("origin_ms", "first_ms")
            .join(trajectory.user_origin(df, "day").withColumnRenamed("origin_ms", "first_day_ms"), "user_id")
            .join(trajectory.user_index(df), "user_id"))


@query(f"""WITH {S.TRAJ} SELECT a.point_id, a.user_id, a.t_ms FROM traj a WHERE EXISTS (SELECT 1 FROM traj b WHERE b.user_id = a.user_id
  AND b.point_id <> a.point_id AND abs(b.t_ms - a.t_ms) <= 86400000 AND {S.haversine('a.lon', 'a.lat', 'b.lon', 'b.lat')} < 1200)""")
def proximity_stays(spark, sf):
    return trajectory.stay_points(t.traj(spark, sf), 1200.0, 86_400_000).select("point_id", "user_id", "t_ms")


@query(f"""WITH {S.TRAJ}, c AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS ch FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id)),
i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY t_ms, point_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(label) AS label, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat, count(*) AS point_count,
  (min(t_ms) + max(t_ms)) / 2 AS timestamp_ms, (max(t_ms) - min(t_ms)) / 1000 AS duration_s FROM i GROUP BY 1, 2""")
def attribute_stays(spark, sf):
    out = JOBS["trajectory"](t.traj(spark, sf), stays=True, stay_field="label")["stay_points"]
    return out.select("user_id", F.col("run").cast("long").alias("run"), "label", r("lon", 8).alias("lon"), r("lat", 8).alias("lat"), "point_count",
                      "timestamp_ms", "duration_s")


@query(f"""WITH {S.TRAJ} SELECT point_id, user_id, t_ms, lead(t_ms) OVER w AS next_t_ms, round(lead(lon) OVER w, 6) AS next_lon,
  round(lead(lat) OVER w, 6) AS next_lat FROM traj WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id) QUALIFY next_t_ms IS NOT NULL""")
def path_segments(spark, sf):
    return trajectory.segments(t.traj(spark, sf)).select("point_id", "user_id", "t_ms", "next_t_ms", r("next_lon").alias("next_lon"), r("next_lat").alias("next_lat"))


def _walk(sql_keep: str, state: str, init: str, table: str, key: str, cols: str) -> str:
    """One row at a time per key, carrying the last kept row."""
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t_ms, point_id) AS rn FROM {table}),
walk AS (SELECT {key}, rn, point_id, {cols}, {init} FROM numbered WHERE rn = 1
  UNION ALL SELECT n.{key}, n.rn, n.point_id, {', '.join('n.' + c.strip() for c in cols.split(','))}, {state} FROM walk w JOIN numbered n ON n.{key} = w.{key} AND n.rn = w.rn + 1)"""


_KEEP = f"(n.t_ms - w.kt >= 600000 AND {S.haversine('w.kx', 'w.ky', 'n.lon', 'n.lat')} >= 2000)"
_ANCHORS = f"""{S.TRAJ}, {_walk('', f"CASE WHEN {_KEEP} THEN n.lon ELSE w.kx END, CASE WHEN {_KEEP} THEN n.lat ELSE w.ky END, CASE WHEN {_KEEP} THEN n.t_ms ELSE w.kt END, {_KEEP}",
    'lon AS kx, lat AS ky, t_ms AS kt, true AS keep', 'traj', 'user_id', 'lon, lat, t_ms')},
anchors AS (SELECT user_id, rn, point_id, lon, lat, t_ms FROM walk WHERE keep OR rn = (SELECT max(rn) FROM numbered n WHERE n.user_id = walk.user_id)
  OR (SELECT max(rn) FROM numbered n WHERE n.user_id = walk.user_id) <= 3)"""


@query(f"WITH RECURSIVE {_ANCHORS} SELECT point_id, user_id, t_ms FROM anchors")
def anchor_selection(spark, sf):
    return fold.anchor_fixes(t.traj(spark, sf), min_dist_m=2000.0).select("point_id", "user_id", "t_ms")


@query(f"""WITH RECURSIVE {_ANCHORS},
p AS (SELECT user_id, lon AS a_lon, lat AS a_lat, t_ms AS a_ms, lead(lon) OVER w AS b_lon, lead(lat) OVER w AS b_lat, lead(t_ms) OVER w AS b_ms FROM anchors
  WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id))
SELECT user_id, count(*) FILTER ({S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000 * (5 / 3.6e0)) AS feasible_segments,
  count(*) FILTER ({S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} > (b_ms - a_ms) / 1000 * (5 / 3.6e0)) AS infeasible_segments FROM p WHERE b_ms IS NOT NULL GROUP BY 1""")
def path_prism_feasibility(spark, sf):
    pairs = prism.with_trip(prism.path_pairs(fold.anchor_fixes(t.traj(spark, sf), min_dist_m=2000.0)), 5 / 3.6)
    return pairs.groupBy("user_id").agg(F.count_if("feasible").alias("feasible_segments"), F.count_if(~F.col("feasible")).alias("infeasible_segments"))


_D = "sqrt(pow((n.lon - w.cx) * 111000 * cos(radians((w.cy + n.lat) / 2)), 2) + pow((n.lat - w.cy) * 111000, 2))"


@query(f"""WITH RECURSIVE {S.TRAJ}, {_walk('', f"CASE WHEN {_D} <= 2500 THEN w.cx + (n.lon - w.cx) / (w.cn + 1) ELSE n.lon END, "
       f"CASE WHEN {_D} <= 2500 THEN w.cy + (n.lat - w.cy) / (w.cn + 1) ELSE n.lat END, CASE WHEN {_D} <= 2500 THEN w.cn + 1 ELSE 1 END, "
       f"CASE WHEN {_D} <= 2500 THEN w.cluster ELSE n.point_id END", 'lon AS cx, lat AS cy, 1 AS cn, point_id AS cluster', 'traj', 'user_id', 'lon, lat, t_ms')}
SELECT user_id, cluster, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat, CAST(floor(median(t_ms)) AS BIGINT) AS t_ms, count(*) AS size FROM walk GROUP BY 1, 2""")
def static_clusters(spark, sf):
    df = t.traj(spark, sf).withColumn("z", F.lit(0.0))
    out = fold.static_clusters(df, "user_id", 2500.0)
    return out.select("user_id", "cluster", r("lon", 8).alias("lon"), r("lat", 8).alias("lat"), "t_ms", "size")


# ================================================================ cube


@query(f"""WITH {S.CUBE} SELECT t_idx, row, col, count(*) AS count, round(avg(value), 6) AS env_value FROM binned GROUP BY 1, 2, 3""")
def cube_cells(spark, sf):
    out = JOBS["space_time_cube"](t.traj(spark, sf), env="value", path=False)["cubes"]
    return out.select("t_idx", "row", "col", "count", r("env_value").alias("env_value"))


@query(f"""WITH {S.CUBE} SELECT row, col, count(*) AS count, round(avg(value), 6) AS env_value FROM binned GROUP BY 1, 2""")
def cube_ground(spark, sf):
    out = JOBS["space_time_cube"](t.traj(spark, sf), env="value", ground=True, path=False)["ground"]
    return out.select("row", "col", "count", r("env_value").alias("env_value"))


@query(f"""WITH {S.TRAJ}, q AS (SELECT list_sort(list_distinct(quantile_cont((t_ms - (SELECT min(t_ms) FROM traj)) / 1000e0, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM traj),
v AS (SELECT (t_ms - m) / 1000e0 AS t_s FROM traj, (SELECT min(t_ms) AS m FROM traj)),
b AS (SELECT least(7, len(list_filter(e[2:], lambda x: x <= t_s))) AS t_idx FROM v, q)
SELECT CAST(t_idx AS INTEGER) AS t_idx, count(*) AS points FROM b GROUP BY 1""")
def equal_count_slices(spark, sf):
    df = t.traj(spark, sf)
    timed = df.withColumn("t_s", (F.col("t_ms") - grid.extent(df).t_min) / 1000.0)
    s = grid.time_slices(timed, F.col("t_s"), "equal_count", 8)
    return timed.groupBy(s.index(F.col("t_s")).alias("t_idx")).agg(F.count(F.lit(1)).alias("points"))


@query(f"""WITH {S.TRAJ}, b AS (SELECT CAST(floor((t_ms - (SELECT min(t_ms) FROM traj) + 3600000) / 1000e0 / 43200) AS INTEGER) AS t_idx FROM traj)
SELECT least(t_idx, (SELECT max(t_idx) FROM b)) AS t_idx, count(*) AS points FROM b GROUP BY 1""")
def fixed_duration_slices(spark, sf):
    df = t.traj(spark, sf)
    timed = df.withColumn("t_s", (F.col("t_ms") - grid.extent(df).t_min) / 1000.0)
    s = grid.time_slices(timed, F.col("t_s"), "fixed_duration", 0, duration_s=43_200.0, anchor_s=-3600.0)
    return timed.groupBy(s.index(F.col("t_s")).alias("t_idx")).agg(F.count(F.lit(1)).alias("points"))


@query(f"""WITH {S.CUBE}, h AS (SELECT greatest((n_cols - 1) * cx, (n_rows - 1) * cy) * 55500 AS total FROM grid),
s AS (SELECT *, least(1, t_s / ((t1 - t0) / 1000e0)) * greatest(total, 1000) AS z FROM binned, h, (SELECT t0, t1 FROM grid)),
n AS (SELECT *, lead(z) OVER w AS next_z, lead(value) OVER w AS nv, lead(t_ms) OVER w AS nt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id))
SELECT point_id, user_id, t_ms AS timestamp_ms, round(z, 3) AS z, round(next_z, 3) AS next_z, round_even((value + nv) / 2, 1) AS env_exposure FROM n WHERE nt IS NOT NULL""")
def cube_segments(spark, sf):
    out = JOBS["space_time_cube"](t.traj(spark, sf), env="value")["segments"]
    return out.select("point_id", "user_id", "timestamp_ms", r("z", 3).alias("z"), r("next_z", 3).alias("next_z"), "env_exposure")


@query(f"""WITH {S.TRAJ}, {S.BANDWIDTH}, s AS (SELECT 0.9e0 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34e0) * pow(count(*), -0.2e0) AS ht
  FROM (SELECT (t_ms - (SELECT min(t_ms) FROM traj)) / 1000e0 AS v FROM traj))
SELECT (SELECT n FROM ext) AS n, round(h, 9) AS h_spatial, round(ht, 4) AS h_temporal, round(cx, 9) AS cell_x, round(cy, 9) AS cell_y, CAST(n_cols AS INTEGER) AS n_cols,
  CAST(n_rows AS INTEGER) AS n_rows, round(cy * 111320, 4) AS cell_m FROM grid, s""")
def grid_layout(spark, sf):
    df = t.traj(spark, sf)
    ext = grid.extent(df)
    h = grid.spatial_bandwidth(df, ext)
    g = grid.grid_spec(ext, h)
    ht = grid.temporal_bandwidth(df, (F.col("t_ms") - ext.t_min) / 1000.0)
    # one row of numbers, each already the result of whole-table aggregations
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", *[r(F.lit(float(v)), d).alias(k) for k, v, d in (
        ("h_spatial", h, 9), ("h_temporal", ht, 4), ("cell_x", g.cell_x, 9), ("cell_y", g.cell_y, 9))],
        F.lit(g.n_cols).alias("n_cols"), F.lit(g.n_rows).alias("n_rows"), r(F.lit(grid.auto_cell_size_m(df)), 4).alias("cell_m"))


# ================================================================ density

_STKDE = f"""{S.TRAJ}, {S.BANDWIDTH}, tb AS (SELECT 0.9e0 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34e0) * pow(count(*), -0.2e0) AS ht
  FROM (SELECT (t_ms - (SELECT min(t_ms) FROM traj)) / 1000e0 AS v FROM traj)),
near AS (
  SELECT r.r AS row, c.c AS col, (t_ms - t0) / 1000e0 AS t_s, (t1 - t0) / 1000e0 AS span, ht, 3 / (pi() * h * h) * pow(1 - (pow(gx + (c.c + 0.5e0) * cx - lon, 2) + pow(gy + (r.r + 0.5e0) * cy - lat, 2)) / (h * h), 2) AS ks
  FROM traj, grid, tb JOIN range(0, 300) r(r) ON r.r < n_rows AND abs(gy + (r.r + 0.5e0) * cy - lat) <= h JOIN range(0, 300) c(c) ON c.c < n_cols AND abs(gx + (c.c + 0.5e0) * cx - lon) <= h
  WHERE pow(gx + (c.c + 0.5e0) * cx - lon, 2) + pow(gy + (r.r + 0.5e0) * cy - lat, 2) <= h * h),
dens AS (
  SELECT CAST(i.i AS INTEGER) AS t_idx, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, sum(ks * 15 / (16 * ht) * pow(1 - pow((t_s - span / 9 * i.i) / ht, 2), 2)) AS density
  FROM near JOIN range(0, 10) i(i) ON abs(t_s - span / 9 * i.i) <= ht GROUP BY 1, 2, 3 HAVING density > 0)"""


@query(f"WITH {_STKDE} SELECT t_idx, row, col, round(density, 5) AS density FROM dens")
def kernel_density(spark, sf):
    return kernel.stkde(t.traj(spark, sf))["cells"].select("t_idx", "row", "col", r("density", 5).alias("density"))


@query(f"WITH {_STKDE} SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(sum(ks), 3) AS density FROM near GROUP BY 1, 2 HAVING sum(ks) > 0")
def kernel_density_2d(spark, sf):
    df = t.traj(spark, sf)
    ext = grid.extent(df)
    h = grid.spatial_bandwidth(df, ext)
    return kernel.density_2d(df, grid.grid_spec(ext, h), h).select("row", "col", r("density", 3).alias("density"))


@query(f"""WITH {_STKDE}, q AS (SELECT quantile_cont(density, [0.9, 0.975, 0.99]) AS q FROM dens)
SELECT t_idx, row, col, CASE WHEN density >= q[3] THEN 3 WHEN density >= q[2] THEN 2 ELSE 1 END AS classification FROM dens, q WHERE density > q[1]""")
def density_classes(spark, sf):
    return kernel.stkde(t.traj(spark, sf))["classified"].select("t_idx", "row", "col", "classification")


@query(f"""WITH {_STKDE}, q AS (SELECT t_idx, quantile_cont(density, [0.9, 0.975, 0.99]) AS q FROM dens GROUP BY 1),
c AS (SELECT d.*, CASE WHEN density > q[3] THEN 3 WHEN density > q[2] AND density < q[3] THEN 2 WHEN density > q[1] AND density < q[2] THEN 1 END AS classification FROM dens d JOIN q USING (t_idx))
SELECT DISTINCT classification, row, col FROM c WHERE classification IS NOT NULL""")
def density_footprint_per_slice(spark, sf):
    return kernel.ground_footprint(kernel.stkde(t.traj(spark, sf), per_slice=True)["classified"])


# ================================================================ exposure and areas


@query(f"""WITH {S.TRAJ}, {S.ENV}, m AS (SELECT t.point_id, e.value, pow(t.lon - e.lon, 2) + pow(t.lat - e.lat, 2) AS d2, e.env_id
  FROM traj t JOIN env e ON e.hour = (t.t_ms // 3600000) % 24)
SELECT t.point_id, CAST((t.t_ms // 3600000) % 24 AS INTEGER) AS hour, round(b.v, 6) AS env_exposure FROM traj t LEFT JOIN
  (SELECT point_id, arg_min(value, struct_pack(a := d2, b := env_id)) AS v FROM m GROUP BY 1) b USING (point_id)""")
def exposure_join(spark, sf):
    out = JOBS["exposure"](t.traj(spark, sf), t.env(spark, sf))["trajectory"]
    return out.select("point_id", "hour", r("env_exposure").alias("env_exposure"))


# A ring with a hole and a concave polygon inside the data's extent.
AREA = [(1, [[(-79.46, 43.62), (-79.30, 43.63), (-79.28, 43.78), (-79.44, 43.77)], [(-79.42, 43.66), (-79.35, 43.66), (-79.35, 43.72), (-79.42, 43.72)]]),
        (2, [[(-79.41, 43.67), (-79.36, 43.67), (-79.36, 43.71), (-79.385, 43.685), (-79.41, 43.71)]])]
_SIDES = [(a, *ring[i], *ring[(i + 1) % len(ring)]) for a, rings in AREA for ring in rings for i in range(len(ring))]
_SIDES_SQL = "sides(area_id, x1, y1, x2, y2) AS (VALUES " + ", ".join("(" + ", ".join([str(s[0])] + [f"{v}::DOUBLE" for v in s[1:]]) + ")" for s in _SIDES) + ")"


def _area_sides(spark):
    rows = [(a, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for a, rings in AREA]
    return area.load_area(spark.createDataFrame(rows, "area_id long, rings array<array<struct<x:double,y:double>>>"))


def _inside_sql(x: str, y: str) -> str:
    border = (f"abs((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)) <= 1e-14 AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2) "
              f"AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2)")
    return (f"(count(*) FILTER ((y1 > {y}) <> (y2 > {y}) AND x1 + ({y} - y1) * (x2 - x1) / nullif(y2 - y1, 0) > {x}) % 2 = 1 "
            f"OR count(*) FILTER ({border}) > 0)")


@query(f"""WITH {S.TRAJ}, {_SIDES_SQL}, p AS (SELECT point_id, area_id, {_inside_sql('lon', 'lat')} AS ins FROM traj, sides GROUP BY point_id, lon, lat, area_id)
SELECT point_id, user_id FROM traj WHERE point_id IN (SELECT point_id FROM p WHERE ins)""")
def points_in_area(spark, sf):
    return area.points_in_area(t.traj(spark, sf), _area_sides(spark)).select("point_id", "user_id")


@query(f"""WITH {S.ROADS}, {_SIDES_SQL}, v AS (SELECT DISTINCT source_id, px AS x, py AS y FROM legs UNION SELECT source_id, qx, qy FROM legs),
p AS (SELECT source_id, x, y, area_id, {_inside_sql('x', 'y')} AS ins FROM v, sides GROUP BY 1, 2, 3, 4),
c AS (SELECT DISTINCT source_id FROM legs, sides WHERE
  ((qx - px) * (y1 - py) - (qy - py) * (x1 - px)) * ((qx - px) * (y2 - py) - (qy - py) * (x2 - px)) < 0
  AND ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) * ((x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1)) < 0)
SELECT source_id FROM p WHERE ins UNION SELECT source_id FROM c""")
def roads_in_area(spark, sf):
    return area.features_in_area(t.roads(spark, sf), _area_sides(spark), "source_id").select("source_id")


# ================================================================ roads


def _edges(spark, sf, mode="walking"):
    return cut_lineage(net.build_edges(t.roads(spark, sf), mode_profile(mode), t.ZONE))


@query(f"WITH {S.EDGES} SELECT edge_id, source_id, highway, round(length_m, 4) AS length_m, round(cost_sec, 4) AS cost_sec FROM edges")
def road_edges(spark, sf):
    return net.build_edges(t.roads(spark, sf), mode_profile("walking"), t.ZONE).select(
        "edge_id", "source_id", "highway", r("length_m", 4).alias("length_m"), r("cost_sec", 4).alias("cost_sec"))


@query(f"""WITH {S.EDGES} SELECT (SELECT count(DISTINCT source_id) FROM legs WHERE highway = 'motorway') AS excluded_features, (SELECT count(*) FROM edges) AS segments""")
def road_statistics(spark, sf):
    roads, profile = t.roads(spark, sf), mode_profile("walking")
    return net.road_stats(roads, net.build_edges(roads, profile, t.ZONE), profile)


@query(f"WITH {S.ENDS} SELECT pair_id, role, edge_id, round(fraction, 6) AS fraction, round(snap_m, 4) AS snap_m FROM snapped")
def snapped_anchors(spark, sf):
    ends = t.pairs(spark, sf).select("pair_id", F.inline(F.array(
        F.struct(F.lit("A").alias("role"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")),
        F.struct(F.lit("B").alias("role"), F.col("b_lon").alias("lon"), F.col("b_lat").alias("lat")))))
    from chronoweave.functions.geo import with_utm
    pts = with_utm(ends.withColumn("origin_id", F.struct("pair_id", "role")), [("lon", "lat", "x", "y")], t.ZONE)
    return net.snap(pts, _edges(spark, sf), 50.0).select("pair_id", "role", "edge_id", r("fraction").alias("fraction"), r("snap_m", 4).alias("snap_m"))


@query(f"""WITH RECURSIVE {S.LABELS} SELECT pair_id, role, count(*) AS nodes, round(sum(cost), 3) AS total_sec, round(max(cost), 4) AS farthest_sec FROM lab GROUP BY 1, 2""")
def shortest_times(spark, sf):
    from chronoweave.functions.geo import with_utm
    ends = t.pairs(spark, sf).select("pair_id", ((F.col("b_ms") - F.col("a_ms")) / 1000 - 60).alias("cutoff"), F.inline(F.array(
        F.struct(F.lit("A").alias("role"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")),
        F.struct(F.lit("B").alias("role"), F.col("b_lon").alias("lon"), F.col("b_lat").alias("lat")))))
    pts = with_utm(ends.withColumn("origin_id", F.struct("pair_id", "role")), [("lon", "lat", "x", "y")], t.ZONE)
    edges = _edges(spark, sf)
    labels = net.origin_times(net.snap(pts, edges, 50.0), edges)
    return labels.groupBy("origin_id").agg(F.count(F.lit(1)).alias("nodes"), r(F.sum("cost"), 3).alias("total_sec"), r(F.max("cost"), 4).alias("farthest_sec")) \
        .select("origin_id.*", "nodes", "total_sec", "farthest_sec")


def _road_prism(spark, sf, **kw):
    return JOBS["road_prism"](t.pairs(spark, sf), t.roads(spark, sf), min_activity_min=1.0, zone=t.ZONE, lat0=44.0, **kw)


@query(f"""WITH RECURSIVE {S.PRISM} SELECT pair_id, edge_id, highway, round(forward_sec, 4) AS forward_sec, round(backward_sec, 4) AS backward_sec, round(act_min, 4) AS activity_sec_min,
  round(act_mid, 4) AS activity_sec_mid, round(act_max, 4) AS activity_sec_max, round(time_progress, 6) AS time_progress, round(px, 6) AS lon0, round(qy, 6) AS lat1 FROM prism""")
def road_prism(spark, sf):
    out = _road_prism(spark, sf, resolution=10)["ppa_roads"]
    return out.select("pair_id", "edge_id", "highway", *[r(c, 4).alias(c) for c in ("forward_sec", "backward_sec", "activity_sec_min", "activity_sec_mid", "activity_sec_max")],
                      r("time_progress").alias("time_progress"), r("lon0").alias("lon0"), r("lat1").alias("lat1"))


@query(f"""WITH RECURSIVE {S.PRISM} SELECT pair_id, coalesce(snapped, false) AS snapped, coalesce(feasible, false) AS feasible, round(shortest, 4) AS shortest_path_sec FROM status""")
def road_prism_status(spark, sf):
    out = _road_prism(spark, sf, resolution=10)["status"]
    return out.select("pair_id", "snapped", "feasible", r("shortest_path_sec", 4).alias("shortest_path_sec"))


@query(f"""WITH RECURSIVE {S.PRISM}, d AS MATERIALIZED (SELECT pair_id, edge_id, forward_sec, backward_sec, budget, coalesce(highway = 'service', false) AS minor FROM prism),
m AS (SELECT pair_id, bool_or(NOT minor) AS major FROM d GROUP BY 1)
SELECT pair_id, edge_id, CAST(s.s AS BIGINT) AS sheet FROM d JOIN m USING (pair_id) JOIN range(0, 8) s(s)
  ON forward_sec <= budget * s.s / 7e0 + 1e-6 AND backward_sec <= budget - budget * s.s / 7e0 + 1e-6 WHERE NOT major OR NOT minor""")
def prism_sheets_major(spark, sf):
    return _road_prism(spark, sf, sheets=8, resolution=10, drop_minor=True)["sheets"].select("pair_id", "edge_id", F.col("sheet").cast("long").alias("sheet"))


@query(f"""WITH RECURSIVE {S.PRISM} SELECT pair_id, edge_id, CAST(s.s AS BIGINT) AS sheet FROM prism JOIN range(0, 8) s(s)
  ON forward_sec <= budget * s.s / 7e0 + 1e-6 AND backward_sec <= budget - budget * s.s / 7e0 + 1e-6""")
def prism_sheets(spark, sf):
    return _road_prism(spark, sf, sheets=8, resolution=10)["sheets"].select("pair_id", "edge_id", F.col("sheet").cast("long").alias("sheet"))


@query(f"""WITH RECURSIVE {S.PRISM} SELECT pair_id, edge_id FROM prism WHERE least(1, forward_sec / budget) <= 0.4 AND least(1, backward_sec / budget) <= 1 - 0.4""")
def prism_at_time(spark, sf):
    return prism.prism_at(_road_prism(spark, sf, resolution=10)["ppa_roads"], 0.4).select("pair_id", "edge_id")


def _surface_sql(res: int) -> str:
    q, rr = S.hex_of("px + (qx - px) * s.s / (k - 1)", "py + (qy - py) * s.s / (k - 1)", res, 44)
    step = hexgrid.SAMPLE_STEP_M[res]
    return f"""WITH RECURSIVE {S.PRISM}, k AS (SELECT *, greatest(2, (ceil(sqrt(pow((qx - px) * 111320 * cos(radians(44)), 2) + pow((qy - py) * 111320, 2)) / {step}) + 1)) AS k FROM prism),
c AS (SELECT DISTINCT pair_id, edge_id, act_max, {q} AS hex_q, {rr} AS hex_r FROM k JOIN range(0, 1000) s(s) ON s.s < k)
SELECT pair_id, hex_q, hex_r, round(max(act_max) / 60, 5) AS dwell_minutes, count(*) AS edge_count FROM c GROUP BY 1, 2, 3"""


@query(_surface_sql(10))
def dwell_surface(spark, sf):
    out = _road_prism(spark, sf, resolution=10)["dwell_surface"]
    return out.select("pair_id", "hex_q", "hex_r", r("dwell_minutes", 5).alias("dwell_minutes"), "edge_count")


@query(f"""WITH RECURSIVE {S.PRISM}, d AS MATERIALIZED (SELECT pair_id, edge_id, forward_sec, backward_sec, budget, px, py, qx, qy FROM prism),
sheet AS MATERIALIZED (SELECT pair_id, CAST(s.s AS BIGINT) AS sheet, px, py, qx, qy FROM d JOIN range(0, 8) s(s)
  ON forward_sec <= budget * s.s / 7e0 + 1e-6 AND backward_sec <= budget - budget * s.s / 7e0 + 1e-6),
tips AS (SELECT pair_id, sheet, px AS x, py AS y FROM sheet UNION ALL SELECT pair_id, sheet, qx, qy FROM sheet),
wide AS (SELECT pair_id, sheet, max(x) - min(x) AS w, max(y) - min(y) AS h, max(x + y) - min(x + y) AS d, max(x - y) - min(x - y) AS e, {", ".join(f"{v}(2 * x {o} y) AS {n}" for v, o, n in (('max', '+', 'a'), ('min', '+', 'b'), ('max', '-', 'c'), ('min', '-', 'f')))} FROM tips GROUP BY 1, 2)
SELECT pair_id, sheet, round(w, 6) AS w, round(h, 6) AS h, round(d, 6) AS d, round(e, 6) AS e, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(f, 6) AS f FROM wide WHERE w > 1e-9 AND h > 1e-9""")
def sheet_hulls(spark, sf):
    """How far the outline of every sheet reaches in eight directions: as far as the road ends."""
    sheets = _road_prism(spark, sf, sheets=8, resolution=10)["sheets"]
    hulls = prism.sheet_hulls(sheets).select("pair_id", F.col("sheet").cast("long").alias("sheet"), F.explode("ring").alias("p"))
    x, y = F.col("p.x"), F.col("p.y")
    wide = hulls.groupBy("pair_id", "sheet").agg(*[(F.max(v) - F.min(v)).alias(n) for n, v in (("w", x), ("h", y), ("d", x + y), ("e", x - y))],
                                                 F.max(2 * x + y).alias("a"), F.min(2 * x + y).alias("b"), F.max(2 * x - y).alias("c"), F.min(2 * x - y).alias("f"))
    return wide.filter("w > 1e-9 and h > 1e-9").select("pair_id", "sheet", *[r(c).alias(c) for c in ("w", "h", "d", "e", "a", "b", "c", "f")])


def _islands(keys: str, src: str) -> str:
    """Overlapping spans (lo, hi) of one key as one."""
    return f"""(SELECT {keys}, min(lo) AS a, max(hi) AS b FROM (SELECT *, sum(CASE WHEN reach + 1e-9 >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part
  FROM (SELECT *, max(hi) OVER (PARTITION BY {keys} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT {keys}, lo, hi FROM {src}))) GROUP BY {keys}, part)"""


# From an entry of A's cone to one of B's, what the delays leave of the budget is room around their middle.
@query(f"""WITH RECURSIVE {S.PRISM},
ways AS MATERIALIZED (SELECT l.pair_id, l.role, e.edge_id, 0e0 AS at, l.cost AS delay FROM lab l JOIN edges e ON l.node = e.u
  UNION ALL SELECT l.pair_id, l.role, e.edge_id, 1e0, l.cost FROM lab l JOIN edges e ON l.node = e.v
  UNION ALL SELECT pair_id, role, edge_id, fraction, 0e0 FROM snapped),
room AS (SELECT a.pair_id, a.edge_id, (a.at + b.at) / 2 AS m, abs(a.at - b.at) AS gap, (s.budget - 60 - a.delay - b.delay + 1e-6) / e.cost_sec AS r
  FROM ways a JOIN ways b ON b.pair_id = a.pair_id AND b.edge_id = a.edge_id AND a.role = 'A' AND b.role = 'B'
  JOIN edges e ON e.edge_id = a.edge_id JOIN status s ON s.pair_id = a.pair_id AND s.feasible),
spans AS (SELECT pair_id, edge_id, greatest(0, m - r / 2) AS lo, least(1, m + r / 2) AS hi FROM room WHERE r >= gap AND least(1, m + r / 2) - greatest(0, m - r / 2) >= 1e-9)
SELECT pair_id, edge_id, round(a, 6) AS a, round(b, 6) AS b FROM {_islands('pair_id, edge_id', 'spans')}""")
def road_prism_exact(spark, sf):
    out = _road_prism(spark, sf, resolution=10, exact=True)["ppa_roads"]
    return out.select("pair_id", "edge_id", F.inline("spans")).select("pair_id", "edge_id", r("a").alias("a"), r("b").alias("b"))


def _trips_track(spark, sf):
    """Fixes for the customers' trips: every order of a customer lies on the straight way of the trip."""
    o = t.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pair_id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("d"))
    f = (F.col("d") % 50) / 50.0
    return o.join(t.pairs(spark, sf), "pair_id").select(
        F.col("o_orderkey").alias("point_id"), "user_id", (F.col("a_ms") + ((F.col("b_ms") - F.col("a_ms")) * (F.col("d") % 50) / 50).cast("long")).alias("t_ms"),
        (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * f).alias("lon"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * f).alias("lat"))


_TRACK = f"""{S.PAIRS}, track AS (SELECT o_orderkey AS point_id, p.user_id, p.pair_id, a_ms + CAST(trunc((b_ms - a_ms) * (d % 50) / 50) AS BIGINT) AS t_ms,
  a_lon + (b_lon - a_lon) * ((d % 50) / 50e0) AS lon, a_lat + (b_lat - a_lat) * ((d % 50) / 50e0) AS lat, a_ms, b_ms
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders) o JOIN pairs p ON p.pair_id = o.o_custkey)"""


@query(f"""WITH {_TRACK}, n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY t_ms, point_id) - 1 AS i, count(*) OVER (PARTITION BY pair_id) AS c FROM track),
j AS (SELECT DISTINCT c, CAST(floor(j.j * (c - 1) / 7e0) AS BIGINT) AS i FROM (SELECT DISTINCT c FROM n WHERE c > 8), range(0, 8) j(j))
SELECT pair_id, point_id, t_ms FROM n WHERE c <= 8 UNION ALL SELECT pair_id, point_id, t_ms FROM n JOIN j USING (c, i)""")
def origin_samples(spark, sf):
    pairs, track = t.pairs(spark, sf), _trips_track(spark, sf)
    return jobs.origin_fixes(pairs, track, 8).select("pair_id", "point_id", "t_ms")


def _origin_areas(spark, sf):
    return JOBS["origin_areas"](t.pairs(spark, sf), _trips_track(spark, sf), t.roads(spark, sf), budget_min=4.0, min_activity_min=1.0,
                                cluster_m=0.0, zone=t.ZONE)


# Reachable share of each edge by inclusion and exclusion of what each end and the snap point reach.
_ORIGINS = f"""{S.EDGES}, {_TRACK},
o AS (SELECT pair_id, point_id, lon, lat FROM track),
{S.utm('om', 'o', [('lon', 'lat', 'x', 'y')])}, {S.snap('snapped', 'om', 'point_id', 50.0)},
seeds AS (SELECT point_id, u AS node, fraction * cost_sec AS seed FROM snapped UNION ALL SELECT point_id, v, (1 - fraction) * cost_sec FROM snapped),
lab(point_id, node, cost) USING KEY (point_id, node) AS (
  SELECT point_id, node, min(seed) FROM seeds WHERE seed <= 90 GROUP BY 1, 2
  UNION (SELECT l.point_id, a.nbr, min(l.cost + a.step) FROM lab l JOIN adj a ON a.node = l.node LEFT JOIN recurring.lab r ON r.point_id = l.point_id AND r.node = a.nbr
    WHERE l.cost + a.step <= 90 AND (r.cost IS NULL OR l.cost + a.step < r.cost) GROUP BY 1, 2)),
t0 AS (SELECT l.point_id, e.edge_id, min(CASE WHEN l.node = e.u THEN l.cost END) AS du, min(CASE WHEN l.node = e.v THEN l.cost END) AS dv, CAST(NULL AS DOUBLE) AS f
    FROM lab l JOIN edges e ON l.node = e.u OR l.node = e.v GROUP BY 1, 2 UNION ALL SELECT point_id, edge_id, NULL, NULL, fraction FROM snapped),
t1 AS (SELECT t0.point_id, t0.edge_id, min(du) AS du, min(dv) AS dv, max(f) AS f, any_value(e.cost_sec) AS c, any_value(e.length_m) AS len FROM t0 JOIN edges e USING (edge_id) GROUP BY 1, 2),
spans AS (SELECT *, CASE WHEN du IS NULL THEN 0 ELSE least(1, (90 - du) / c) END AS left_to, CASE WHEN dv IS NULL THEN 1 ELSE greatest(0, 1 - (90 - dv) / c) END AS right_from,
    CASE WHEN f IS NOT NULL THEN greatest(0, f - 90 / c) END AS s0, CASE WHEN f IS NOT NULL THEN least(1, f + 90 / c) END AS s1 FROM t1),
cover AS (SELECT *, left_to + 1 - right_from - greatest(0, left_to - right_from) + CASE WHEN f IS NULL THEN 0 ELSE
    s1 - s0 - greatest(0, least(left_to, s1) - s0) - greatest(0, s1 - greatest(right_from, s0)) + greatest(0, least(left_to, s1) - greatest(right_from, s0)) END AS share FROM spans)"""


@query(f"""WITH RECURSIVE {_ORIGINS} SELECT o.pair_id, o.point_id AS cluster, s.point_id IS NOT NULL AS reachable, round(coalesce(sum(share * len), 0), 3) AS reachable_length_m,
  round(any_value(s.snap_m), 4) AS snap_distance_m FROM o LEFT JOIN snapped s USING (point_id) LEFT JOIN cover c ON c.point_id = o.point_id GROUP BY o.pair_id, o.point_id, s.point_id""")
def origin_reach(spark, sf):
    out = _origin_areas(spark, sf)["origins"]
    return out.select("pair_id", F.col("origin_id.cluster").alias("cluster"), "reachable", r("reachable_length_m", 3).alias("reachable_length_m"), r("snap_distance_m", 4).alias("snap_distance_m"))


_AT = "list_min(list_transform(ways, lambda w: w.delay + c * abs({s} - w.at)))"


@query(f"""WITH RECURSIVE {_ORIGINS},
w0 AS (SELECT *, list_filter([{{'at': 0e0, 'delay': du}}, {{'at': 1e0, 'delay': dv}}, {{'at': f, 'delay': CASE WHEN f IS NOT NULL THEN 0e0 END}}], lambda w: w.delay IS NOT NULL) AS ways FROM t1),
w1 AS (SELECT point_id, edge_id, c, unnest(ways) AS w FROM w0),
parts AS (SELECT point_id, edge_id, greatest(0, w.at - (90 - w.delay) / c) AS lo, least(1, w.at + (90 - w.delay) / c) AS hi FROM w1 WHERE w.delay <= 90),
spans1 AS (SELECT * FROM parts WHERE hi - lo >= 1e-9),
met AS (SELECT i.*, c, ways, list_transform(ways, lambda w: greatest(a, least(b, w.at))) AS near,
  list_filter(flatten(list_transform(ways, lambda p: list_transform(ways, lambda q: (p.at + q.at) / 2 + (q.delay - p.delay) / (2 * c)))), lambda m: m > a AND m < b) AS peaks
  FROM {_islands('point_id, edge_id', 'spans1')} i JOIN w0 USING (point_id, edge_id)),
timed AS (SELECT *, list_min(list_transform(near, lambda s: {_AT.format(s='s')})) AS lo_t, list_max(list_transform(list_concat([a, b], peaks), lambda s: {_AT.format(s='s')})) AS hi_t FROM met)
SELECT o.pair_id, o.point_id AS cluster, edge_id, round(a, 4) AS a, round(b, 4) AS b, round(lo_t, 3) AS travel_sec_min, round(hi_t, 3) AS travel_sec_max,
  round(240 - 2 * hi_t, 3) AS activity_sec_min, round(240 - 2 * lo_t, 3) AS activity_sec_max FROM timed JOIN o USING (point_id) WHERE 240 - 2 * hi_t + 1e-6 >= 60""")
def origin_road_pieces(spark, sf):
    """Reachable pieces of each fix with travel and activity times."""
    out = _origin_areas(spark, sf)["ppa_roads"]
    return out.select("origin_id.*", "edge_id", r("a", 4).alias("a"), r("b", 4).alias("b"),
                      *[r(c, 3).alias(c) for c in ("travel_sec_min", "travel_sec_max", "activity_sec_min", "activity_sec_max")])


@query(f"""WITH {_TRACK}, g AS (SELECT pair_id, t_ms - lag(t_ms) OVER (PARTITION BY pair_id ORDER BY t_ms, point_id) AS gap FROM track)
SELECT pair_id, CASE WHEN count(gap) >= 1 THEN greatest(360, median(gap) / 1000) ELSE 900 END AS budget_sec FROM g GROUP BY 1""")
def automatic_budget(spark, sf):
    track = _trips_track(spark, sf)
    return jobs.auto_budget(track.select(F.col("user_id").cast("long").alias("pair_id"), "t_ms", "point_id"), 300.0, "point_id")


def _walkers(spark, sf):
    """Each supplier walks along the streets, one fix per delivered line."""
    li = t.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))
    k = F.col("l_orderkey")
    return li.select((k * 8 + F.col("l_linenumber")).alias("point_id"), F.col("l_suppkey").cast("string").alias("user_id"),
                     (F.lit(1_704_067_200_000) + k * 4_000 + F.col("l_linenumber") * 500).alias("t_ms"),
                     (F.lit(t.ORIGIN_LON) + (k % 1500) * 0.00005).alias("lon"),
                     (F.lit(t.ORIGIN_LAT) + F.col("l_suppkey") % 3 * t.STREET_DEG + 0.0001).alias("lat"))


_WALKERS = f"""walkers AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, CAST(l_suppkey AS VARCHAR) AS user_id, 1704067200000 + l_orderkey * 4000 + l_linenumber * 500 AS t_ms,
  -79.5e0 + (l_orderkey % 1500) * 0.00005::DOUBLE AS lon, 43.6e0 + l_suppkey % 3 * 0.002::DOUBLE + 0.0001::DOUBLE AS lat FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2))"""


@query(f"""WITH {S.EDGES}, {_WALKERS}, {S.utm('pm', 'walkers', [('lon', 'lat', 'mx', 'my')])},
pairs2 AS (SELECT *, lead(t_ms) OVER w AS nt, lead(mx) OVER w AS nx, lead(my) OVER w AS ny FROM pm WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id)),
seen AS (SELECT user_id, point_id, (nt - t_ms) / 1000e0 AS dt, sqrt(pow(nx - mx, 2) + pow(ny - my, 2)) / ((nt - t_ms) / 1000e0) * 3.6e0 AS v, (mx + nx) / 2 AS x, (my + ny) / 2 AS y FROM pairs2 WHERE nt IS NOT NULL AND nt > t_ms),
moving AS (SELECT * FROM seen WHERE dt BETWEEN 1 AND 600 AND v BETWEEN 0.7 AND 9), {S.snap('onroad', 'moving', 'point_id', 100.0)}
SELECT user_id, CASE WHEN count(*) >= 8 THEN round(greatest(0.25, least(1.5, median(v / class_kmh))), 6) END AS speed_factor, count(*) AS samples FROM onroad GROUP BY 1""")
def observed_speed(spark, sf):
    out = net.speed_factor(_walkers(spark, sf), _edges(spark, sf), mode_profile("walking"), t.ZONE)
    return out.select("user_id", r("speed_factor").alias("speed_factor"), "samples")


@query(f"""WITH {S.PAIRS}, h AS (SELECT pair_id, CAST(floor((((a_ms + b_ms) / 2 / 3600000e0) % 24 + a_lon / 15 + 24) % 24) AS INTEGER) AS h FROM pairs)
SELECT pair_id, CASE WHEN h IN (7, 8, 16, 17, 18) THEN 0.55e0 WHEN h BETWEEN 6 AND 20 THEN 0.75e0 ELSE 0.95e0 END AS factor FROM h""")
def congestion(spark, sf):
    return t.pairs(spark, sf).select("pair_id", congestion_factor((F.col("a_ms") + F.col("b_ms")) / 2, F.col("a_lon"), "driving").alias("factor"))


def _extent_sql(v: float, safety: float) -> str:
    return f"""m AS (SELECT *, (a_lat + b_lat) / 2 AS ml, (a_lon + b_lon) / 2 AS mn, greatest(0.1, abs(cos(radians((a_lat + b_lat) / 2)))) AS k, ((b_ms - a_ms) / 1000 - 60) * {v / 3.6 / 2!r} AS a0 FROM pairs),
d AS (SELECT *, (b_lon - a_lon) * 111320 * k AS dx, (b_lat - a_lat) * 111320 AS dy FROM m),
e AS (SELECT *, sqrt(dx * dx + dy * dy) / 2 AS c, greatest(a0, sqrt(dx * dx + dy * dy) / 2 + 1) AS a, atan2(dy, dx) AS th FROM d),
b AS (SELECT *, sqrt(greatest(a * a - c * c, 0)) AS b FROM e),
w AS (SELECT *, sqrt(pow(a * cos(th), 2) + pow(b * sin(th), 2)) * {safety} / (111320 * k) AS hx, sqrt(pow(a * sin(th), 2) + pow(b * cos(th), 2)) * {safety} / 111320 AS hy FROM b)"""


@query(f"""WITH {S.PAIRS}, {_extent_sql(6.0, 1.15)} SELECT pair_id, round(mn - hx, 8) AS west, round(ml - hy, 8) AS south, round(mn + hx, 8) AS east, round(ml + hy, 8) AS north,
  round(2 * hx * 111 * greatest(0.1, abs(cos(radians(ml)))) * 2 * hy * 111, 6) AS area_km2 FROM w""")
def reach_extents(spark, sf):
    p = t.pairs(spark, sf).withColumn("k", (F.col("b_ms") - F.col("a_ms")) / 1000 - 60)
    box = p.withColumn("e", ellipse_extent(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.col("k"), 6.0)).select("pair_id", "e.*")
    return box.select("pair_id", *[r(c, 8).alias(c) for c in ("west", "south", "east", "north")],
                      r(extent_area_km2(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("area_km2"))


@query(f"""WITH {S.PAIRS}, g AS (SELECT *, greatest(0.1, abs(cos(radians((a_lat + b_lat) / 2)))) AS k FROM pairs),
h AS (SELECT *, abs(b_lon - a_lon) * 111 * k AS w, abs(b_lat - a_lat) * 111 AS hh, ((b_ms - a_ms) / 1000e0) * {6 / 3.6 * 1.2!r} AS reach FROM g),
m AS (SELECT *, greatest(0, (sqrt(pow(w - hh, 2) + 4 * 25) - (w + hh)) / 4) AS mg FROM h)
SELECT pair_id, round(least(a_lon, b_lon) - mg / (111 * k), 8) AS corridor_west, round(greatest(a_lat, b_lat) + mg / 111, 8) AS corridor_north,
  round(greatest(a_lon, b_lon) + reach / (111000 * k), 8) AS padded_east, round(least(a_lat, b_lat) - reach / 111000, 8) AS padded_south FROM m""")
def corridor_extents(spark, sf):
    p = t.pairs(spark, sf)
    ll = [F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat")]
    pad = padded_extent(F.least(ll[0], ll[2]), F.greatest(ll[0], ll[2]), F.least(ll[1], ll[3]), F.greatest(ll[1], ll[3]), 6.0, (F.col("b_ms") - F.col("a_ms")) / 1000)
    out = p.select("pair_id", corridor_extent(*ll, 25.0).alias("c"), pad.alias("p"))
    return out.select("pair_id", r("c.west", 8).alias("corridor_west"), r("c.north", 8).alias("corridor_north"), r("p.east", 8).alias("padded_east"), r("p.south", 8).alias("padded_south"))


# ================================================================ activity surfaces


@query(f"""WITH {S.PASTA} SELECT person_id, CAST(gap AS BIGINT) AS gap, window_id, from_ms, to_ms, from_activity, to_activity, mode, weight, flexible_count, budget_s, feasible FROM checked""")
def activity_windows(spark, sf):
    w = pasta.with_feasibility(pasta.anchor_windows(pasta.activity_episodes(t.episodes(spark, sf))))
    return w.select("person_id", F.col("gap").cast("long").alias("gap"), "window_id", "from_ms", "to_ms", "from_activity", "to_activity",
                    F.trim("mode").alias("mode"), "weight", "flexible_count", "budget_s", "feasible")


@query(f"""WITH {S.PASTA_CELLS} SELECT row, col, round(sum(dwell_s / 60), 3) AS dwell_minutes, round(sum(dwell_s / 60 * weight), 3) AS weighted_dwell_minutes, count(*) AS window_count,
  count(DISTINCT person_id) AS person_count, string_agg(DISTINCT mode, ',' ORDER BY mode) AS mode FROM cells GROUP BY 1, 2""")
def activity_surface(spark, sf):
    out = JOBS["activity_surface"](t.episodes(spark, sf), cell_m=1000.0)["surface"]
    return out.select("row", "col", r("dwell_minutes", 3).alias("dwell_minutes"), r("weighted_dwell_minutes", 3).alias("weighted_dwell_minutes"),
                      F.col("window_count").cast("long").alias("window_count"), "person_count", "mode")


@query(f"""WITH {S.PASTA_CELLS}, o AS (SELECT min(from_ms) AS g FROM checked),
b AS (SELECT window_id, row, col, g, CAST(trunc(from_ms + go_s * 1000) AS BIGINT) AS early, CAST(trunc(to_ms - back_s * 1000) AS BIGINT) AS late FROM cells, o),
v AS (SELECT b.*, unnest(range(CAST(ceil((early - g) / 300000e0) AS BIGINT), CAST(floor((late - g) / 300000e0) AS BIGINT) + 1)) AS time_bin FROM b),
x AS (SELECT *, least(late, g + (time_bin + 1) * 300000) - greatest(early, g + time_bin * 300000) AS ov FROM v)
SELECT window_id, CAST(time_bin AS BIGINT) AS time_bin, count(*) AS cells, CAST(sum(ov) AS BIGINT) AS dwell_ms FROM x WHERE ov > 0 GROUP BY 1, 2""")
def activity_voxels(spark, sf):
    out = JOBS["activity_surface"](t.episodes(spark, sf), cell_m=1000.0)["voxels"]
    return out.groupBy("window_id", F.col("time_bin").cast("long").alias("time_bin")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("dwell_minutes") * 60_000).cast("long").alias("dwell_ms"))


@query(f"""WITH {S.PASTA}, o AS (SELECT min(from_ms) AS g, greatest((max(to_ms) - min(from_ms)) / 300000e0 * 20, 1000) / greatest(max(to_ms) - min(from_ms), 1) AS zp FROM checked)
SELECT window_id, 'start_anchor' AS anchor_role, from_activity AS activity_type, from_ms AS timestamp_ms, round((from_ms - g) * zp, 4) AS z FROM checked, o WHERE feasible
UNION ALL SELECT window_id, 'end_anchor', to_activity, to_ms, round((to_ms - g) * zp, 4) FROM checked, o WHERE feasible""")
def activity_anchors(spark, sf):
    out = JOBS["activity_surface"](t.episodes(spark, sf))["anchor_windows"]
    return out.select("window_id", "anchor_role", "activity_type", "timestamp_ms", r("z", 4).alias("z"))


def _days(spark, sf):
    """Every user's day is a journey of its own."""
    return t.traj(spark, sf).withColumn("user_id", F.concat_ws("/", "user_id", F.floor(F.col("t_ms") / 86_400_000)))


def _day_ends(spark, sf):
    """Each journey ends three hours after its last fix, at that fix."""
    last = F.max(F.struct("t_ms", "point_id", "lon", "lat")).alias("l")
    return _days(spark, sf).groupBy("user_id").agg(last).select("user_id", F.col("l.lon").alias("b_lon"), F.col("l.lat").alias("b_lat"), (F.col("l.t_ms") + 10_800_000).alias("b_ms"))


_DAYS = f"""{S.TRAJ}, days AS (SELECT * REPLACE (user_id || '/' || (t_ms // 86400000) AS user_id) FROM traj),
ends AS (SELECT user_id, arg_max(lon, struct_pack(a := t_ms, b := point_id)) AS b_lon, arg_max(lat, struct_pack(a := t_ms, b := point_id)) AS b_lat, max(t_ms) + 10800000 AS b_ms FROM days GROUP BY 1),
circles AS (SELECT * FROM (SELECT t.*, b_lon, b_lat, b_ms, (b_ms - t_ms) / 1000e0 - {S.haversine('t.lon', 't.lat', 'b_lon', 'b_lat')} / {5 / 3.6!r} - 600 AS budget_s FROM days t JOIN ends USING (user_id))
  WHERE budget_s > 0 AND budget_s * {5 / 3.6 / 2!r} >= 10),
sized AS (SELECT *, budget_s * {5 / 3.6 / 2!r} AS radius_m FROM circles)"""
_HX, _HY = S.hex_center("q.q", "r.r", 7, 44)


@query(f"""WITH {_DAYS}, b AS (SELECT *, lat * 111320 / {1.5 * hexgrid.edge_length_m(7)!r} AS rm, radius_m * 1.2 / {1.5 * hexgrid.edge_length_m(7)!r} AS rr FROM sized),
r AS (SELECT *, unnest(range(CAST(floor(rm - rr) AS BIGINT) - 1, CAST(ceil(rm + rr) AS BIGINT) + 2)) AS r FROM b),
q0 AS (SELECT *, lon * {111320 * 0.7193398003386512!r} / {hexgrid.edge_length_m(7) * 3 ** 0.5!r} - r / 2e0 AS qm, radius_m * 1.3 / {hexgrid.edge_length_m(7) * 3 ** 0.5!r} AS qr FROM r),
q AS (SELECT *, unnest(range(CAST(floor(qm - qr) AS BIGINT) - 1, CAST(ceil(qm + qr) AS BIGINT) + 2)) AS q FROM q0),
d AS (SELECT q.q AS hex_q, q.r AS hex_r, budget_s - 2 * {S.haversine('lon', 'lat', _HX.replace('r.r', 'q.r'), _HY.replace('r.r', 'q.r'))} / {5 / 3.6!r} AS dwell FROM q)
SELECT hex_q, hex_r, round(sum(dwell) / 60, 3) AS dwell_minutes FROM d WHERE dwell > 0 GROUP BY 1, 2""")
def fix_surface(spark, sf):
    out = JOBS["fix_surface"](_days(spark, sf), _day_ends(spark, sf), resolution=7, lat0=44.0, thin=False)["hex_surface"]
    return out.select("hex_q", "hex_r", r("dwell_minutes", 3).alias("dwell_minutes"))


_MOVED = f"({S.haversine('w.kx', 'w.ky', 'n.lon', 'n.lat')} > 0.15e0 * n.radius_m)"


@query(f"""WITH RECURSIVE {_DAYS}, {_walk('', f"CASE WHEN {_MOVED} THEN n.lon ELSE w.kx END, CASE WHEN {_MOVED} THEN n.lat ELSE w.ky END, {_MOVED}",
       'lon AS kx, lat AS ky, true AS keep', 'sized', 'user_id', 'lon, lat, t_ms, radius_m')}
SELECT user_id, point_id, round(radius_m, 4) AS radius_m FROM walk WHERE keep""")
def thinned_circles(spark, sf):
    out = JOBS["fix_surface"](_days(spark, sf), _day_ends(spark, sf), resolution=7)["circles"]
    return out.select("user_id", "point_id", r("radius_m", 4).alias("radius_m"))


# ================================================================ prisms without roads


@query(f"""WITH {S.PAIRS}, d AS (SELECT *, {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} AS dist FROM pairs)
SELECT pair_id, round(dist, 4) AS dist_m, (b_ms - a_ms) / 1000 AS dt_s, dist <= (b_ms - a_ms) / 1000 * {5 / 3.6!r} AS feasible,
  round(least(greatest(abs(b_lon - a_lon), abs(b_lat - a_lat), 0.001) * 111000, 5000), 4) AS z_end FROM d""")
def anchor_trips(spark, sf):
    """Half of the pairs are handed over end first; they are put in order."""
    p = t.pairs(spark, sf)
    flip = F.col("pair_id") % 2 == 0
    mixed = p.select("pair_id", *[F.when(flip, F.col(("b" if c[0] == "a" else "a") + c[1:])).otherwise(F.col(c)).alias(c)
                                  for c in ("a_lon", "a_lat", "a_ms", "b_lon", "b_lat", "b_ms")])
    out = prism.with_trip(prism.anchor_heights(prism.normalise_anchors(mixed)), 5 / 3.6)
    return out.select("pair_id", r("dist_m", 4).alias("dist_m"), "dt_s", "feasible", r("z_end", 4).alias("z_end"))


def _polygon(radius: str, lat: str, dx: str, dy: str) -> str:
    """Sides of the 48-gon of a reach circle, in degrees from the first anchor."""
    def corner(i: str) -> tuple[str, str]:
        return (f"({dx} + {radius} / (111000 * cos(radians({lat}))) * cos(({i}) % 48 * pi() / 24))", f"({dy} + {radius} / 111000 * sin(({i}) % 48 * pi() / 24))")
    (x0, y0), (x1, y1) = corner("i"), corner("i + 1")
    return f"list_transform(range(0, 48), lambda i: {{'x': {x0}, 'y': {y0}, 'dx': {x1} - {x0}, 'dy': {y1} - {y0}}})"


# The border of the common region is what each polygon's sides have inside the other; its area is the sum of their cross products.
@query(f"""WITH {S.PAIRS}, f AS (SELECT *, (b_ms - a_ms) / 1000e0 * {5 / 3.6!r} AS way FROM pairs WHERE {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000e0 * {5 / 3.6!r}),
s AS (SELECT f.*, CAST(s.s AS INTEGER) AS slice, way * (s.s / 15e0) AS r1, way * (1 - s.s / 15e0) AS r2 FROM f, range(1, 15) s(s)),
rings AS (SELECT pair_id, slice, {_polygon('r1', 'a_lat', '0e0', '0e0')} AS p, {_polygon('r2', 'b_lat', '(b_lon - a_lon)', '(b_lat - a_lat)')} AS q FROM s),
sides AS (SELECT pair_id, slice, unnest(p) AS u, q AS other FROM rings UNION ALL SELECT pair_id, slice, unnest(q), p FROM rings),
cuts AS (SELECT pair_id, slice, u, list_transform(other, lambda w: {{'at': w.dx * (u.y - w.y) - w.dy * (u.x - w.x), 'go': w.dx * u.dy - w.dy * u.dx}}) AS c FROM sides),
parts AS (SELECT pair_id, slice, u, greatest(0e0, coalesce(list_max(list_transform(list_filter(c, lambda k: k.go > 0), lambda k: -k.at / k.go)), 0e0)) AS a,
  least(1e0, coalesce(list_min(list_transform(list_filter(c, lambda k: k.go < 0), lambda k: -k.at / k.go)), 1e0)) AS b FROM cuts WHERE len(list_filter(c, lambda k: k.go = 0 AND k.at < 0)) = 0),
area AS (SELECT pair_id, slice, abs(sum((u.x + a * u.dx) * (u.y + b * u.dy) - (u.x + b * u.dx) * (u.y + a * u.dy))) / 2 * 12321e6 AS m2 FROM parts WHERE a <= b GROUP BY 1, 2)
SELECT pair_id, slice, round(slice / 15e0, 6) AS time_progress, round(m2, 1) AS area_m2 FROM area WHERE m2 > 0""")
def euclidean_prism(spark, sf):
    """Two reach circles intersected at fourteen instants."""
    out = JOBS["two_anchor_prism"](t.pairs(spark, sf))["slices"]
    return out.select("pair_id", F.col("slice").cast("int").alias("slice"), r("time_progress").alias("time_progress"), r("area_m2", 1).alias("area_m2"))


_PX, _PY = S.hex_center("q.q", "q.r", 10, 44)
_PD1 = f"sqrt(pow(({_PX} - a_lon) * cos(radians(a_lat)), 2) + pow({_PY} - a_lat, 2)) * 111000"
_PD2 = f"sqrt(pow(({_PX} - b_lon) * cos(radians(b_lat)), 2) + pow({_PY} - b_lat, 2)) * 111000"


@query(f"""WITH {S.PAIRS}, f AS (SELECT *, (b_ms - a_ms) / 1000e0 AS dt, (a_lon + b_lon) / 2 AS mx, (a_lat + b_lat) / 2 AS my FROM pairs
  WHERE {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000e0 * {5 / 3.6!r}),
r AS (SELECT *, unnest(range(CAST(floor((my * 111320 - dt * 0.9) / {1.5 * hexgrid.edge_length_m(10)!r}) AS BIGINT), CAST(ceil((my * 111320 + dt * 0.9) / {1.5 * hexgrid.edge_length_m(10)!r}) AS BIGINT) + 1)) AS r FROM f),
q AS (SELECT *, unnest(range(CAST(floor((mx * {111320 * 0.7193398003386512!r} - dt * 0.9) / {hexgrid.edge_length_m(10) * 3 ** 0.5!r} - r / 2e0) AS BIGINT), CAST(ceil((mx * {111320 * 0.7193398003386512!r} + dt * 0.9) / {hexgrid.edge_length_m(10) * 3 ** 0.5!r} - r / 2e0) AS BIGINT) + 1)) AS q FROM r),
k AS (SELECT pair_id, q.q, q.r FROM q WHERE greatest(1, ceil({_PD1} / (dt * {5 / 3.6 / 15!r}))) <= least(14, floor(15 - {_PD2} / (dt * {5 / 3.6 / 15!r}))))
SELECT pair_id, count(*) AS cells, round(count(*) * {hexgrid.cell_area_km2(10)!r}, 6) AS area_km2 FROM k GROUP BY 1""")
def potential_path_area(spark, sf):
    out = JOBS["two_anchor_prism"](t.pairs(spark, sf), resolution=10, lat0=44.0)["ppa"]
    return out.select("pair_id", "cells", r("area_km2").alias("area_km2"))


def _mask(grids: DataFrame) -> DataFrame:
    """About one cell in seven closed, by arithmetic on the cell."""
    cells = grids.select("pair_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")) \
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return cells.filter((F.col("pair_id") * 31 + F.col("row") * 7919 + F.col("col") * 6271) % 100 < 15).select("pair_id", "row", "col")


_GRID = f"""{S.PAIRS}, f AS (SELECT *, (b_ms - a_ms) / 1000e0 AS dt, (b_ms - a_ms) / 1000e0 * {5 / 3.6!r} / 111000 * 1.1e0 AS pad FROM pairs
  WHERE {S.haversine('a_lon', 'a_lat', 'b_lon', 'b_lat')} <= (b_ms - a_ms) / 1000e0 * {5 / 3.6!r}),
g0 AS (SELECT *, least(a_lon, b_lon) - pad AS x0, least(a_lat, b_lat) - pad AS y0, greatest(a_lon, b_lon) + pad - (least(a_lon, b_lon) - pad) AS w, greatest(a_lat, b_lat) + pad - (least(a_lat, b_lat) - pad) AS h FROM f),
g1 AS (SELECT *, greatest(w, h) / 14 AS cd FROM g0),
g AS (SELECT *, CAST(greatest(1, ceil(w / cd)) AS INTEGER) AS cols, CAST(greatest(1, ceil(h / cd)) AS INTEGER) AS rows, cd * 111000 / {5 / 3.6!r} AS step FROM g1),
a AS (SELECT *, CAST(least(rows - 1, greatest(0, floor((a_lat - y0) / cd))) AS INTEGER) AS ar, CAST(least(cols - 1, greatest(0, floor((a_lon - x0) / cd))) AS INTEGER) AS ac,
  CAST(least(rows - 1, greatest(0, floor((b_lat - y0) / cd))) AS INTEGER) AS br, CAST(least(cols - 1, greatest(0, floor((b_lon - x0) / cd))) AS INTEGER) AS bc FROM g),
way AS (SELECT DISTINCT pair_id, ar + sign(br - ar) * least(k.k, abs(br - ar)) + i.i AS row, ac + sign(bc - ac) * least(k.k, abs(bc - ac)) + j.j AS col
  FROM a JOIN range(0, 20) k(k) ON k.k <= greatest(abs(br - ar), abs(bc - ac)), range(-1, 2) i(i), range(-1, 2) j(j)),
free AS (SELECT a.pair_id, r.r AS row, c.c AS col, a.step, a.dt FROM a JOIN range(0, 20) r(r) ON r.r < rows JOIN range(0, 20) c(c) ON c.c < cols
  WHERE (pair_id * 31 + r.r * 7919 + c.c * 6271) % 100 >= 15 OR (pair_id, r.r, c.c) IN (SELECT (pair_id, row, col) FROM way)),
gl(pair_id, role, row, col, cost) USING KEY (pair_id, role, row, col) AS (
  SELECT pair_id, 'A', CAST(ar AS BIGINT), CAST(ac AS BIGINT), 0e0 FROM a UNION ALL SELECT pair_id, 'B', br, bc, 0e0 FROM a
  UNION (SELECT l.pair_id, l.role, f.row, f.col, min(l.cost + f.step * CASE WHEN f.row <> l.row AND f.col <> l.col THEN sqrt(2e0) ELSE 1 END)
   FROM gl l JOIN free f ON f.pair_id = l.pair_id AND abs(f.row - l.row) <= 1 AND abs(f.col - l.col) <= 1 AND (f.row <> l.row OR f.col <> l.col)
   LEFT JOIN recurring.gl x ON x.pair_id = l.pair_id AND x.role = l.role AND x.row = f.row AND x.col = f.col
   WHERE l.cost + f.step * CASE WHEN f.row <> l.row AND f.col <> l.col THEN sqrt(2e0) ELSE 1 END <= f.dt
     AND (x.cost IS NULL OR l.cost + f.step * CASE WHEN f.row <> l.row AND f.col <> l.col THEN sqrt(2e0) ELSE 1 END < x.cost - 1e-9) GROUP BY 1, 2, 3, 4))"""


@query(f"""WITH RECURSIVE {_GRID}, c AS (SELECT p.pair_id, p.row, p.col, p.cost AS fa, q.cost AS tb, a.dt FROM gl p JOIN gl q ON q.pair_id = p.pair_id AND q.row = p.row AND q.col = p.col AND q.role = 'B' JOIN a ON a.pair_id = p.pair_id WHERE p.role = 'A')
SELECT pair_id, CAST(s.s AS BIGINT) AS slice, count(*) AS cells FROM c JOIN range(1, 9) s(s) ON fa <= dt * s.s / 9e0 + 1e-9 AND tb <= dt * (1 - s.s / 9e0) + 1e-9 GROUP BY 1, 2""")
def obstacle_grid_prism(spark, sf):
    out = JOBS["grid_prism"](t.pairs(spark, sf), _mask, n_slices=9, grid=14)["slices"]
    return out.groupBy("pair_id", F.col("slice").cast("long").alias("slice")).agg(F.count(F.lit(1)).alias("cells"))


# ================================================================ corridors


@query(f"""WITH {_TRACK}, {S.utm('tm', 'track', [('lon', 'lat', 'x', 'y')])},
n AS (SELECT *, row_number() OVER w - 1 AS segment_index, (lead(t_ms) OVER w - t_ms) / 1000 AS budget_s, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS d FROM tm WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id))
SELECT user_id, segment_index, budget_s, budget_s * {5 / 3.6 / 2!r} < d / 2 AS fallback FROM n WHERE budget_s > 0""")
def segment_areas(spark, sf):
    out = corridor.segment_ppas(_trips_track(spark, sf), 5 / 3.6, t.ZONE)
    return out.select("user_id", F.col("segment_index").cast("long").alias("segment_index"), "budget_s", "fallback")


def _ring_point(i: str) -> str:
    """A corner of a segment's area: on an ellipse around both fixes, or on the half circles at its ends."""
    oval = "{{'x': (x + nx) / 2 + string / 2 * cos({a}) * ux - short * sin({a}) * uy, 'y': (y + ny) / 2 + string / 2 * cos({a}) * uy + short * sin({a}) * ux}}".format(a=f"(({i}) * 2 * pi() / 64)")
    return oval


def _capsule_point(i: str) -> str:
    turn = f"atan2(ny - y, nx - x) + CASE WHEN ({i}) <= 16 THEN -pi() / 2 + ({i}) * pi() / 16 ELSE pi() / 2 + (({i}) - 17) * pi() / 16 END"
    return f"{{'x': CASE WHEN ({i}) <= 16 THEN nx ELSE x END + 100e0 * cos({turn}), 'y': CASE WHEN ({i}) <= 16 THEN ny ELSE y END + 100e0 * sin({turn})}}"


def _corridor_sql(keep: str) -> str:
    """Road pieces inside every segment's area: each side of the ring cuts the road's line, the piece is what all sides leave."""
    return f"""{S.EDGES}, {_TRACK}, {S.utm('tm', 'track', [('lon', 'lat', 'x', 'y')])},
n0 AS (SELECT user_id, point_id, t_ms, x, y, row_number() OVER w - 1 AS segment_index, (lead(t_ms) OVER w - t_ms) / 1000e0 AS budget_s, lead(x) OVER w AS nx, lead(y) OVER w AS ny
  FROM tm WINDOW w AS (PARTITION BY user_id ORDER BY t_ms, point_id)),
n1 AS (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS gap, budget_s * {5 / 3.6!r} AS string FROM n0 WHERE nx IS NOT NULL AND {keep}),
n2 AS (SELECT *, CASE WHEN gap > 0 THEN (nx - x) / gap ELSE 1 END AS ux, CASE WHEN gap > 0 THEN (ny - y) / gap ELSE 0 END AS uy, sqrt(greatest(0, (string - gap) * (string + gap))) / 2 AS short FROM n1),
n3 AS (SELECT *, CASE WHEN string >= gap THEN list_transform(range(0, 64), lambda i: {_ring_point('i')}) ELSE list_transform(range(0, 34), lambda i: {_capsule_point('i')}) END AS ring FROM n2),
n4 AS (SELECT *, list_transform(ring, lambda p, i: {{'x': p.x, 'y': p.y, 'dx': ring[i % len(ring) + 1].x - p.x, 'dy': ring[i % len(ring) + 1].y - p.y}}) AS sides,
  list_min(list_transform(ring, lambda p: p.x)) AS bx0, list_max(list_transform(ring, lambda p: p.x)) AS bx1, list_min(list_transform(ring, lambda p: p.y)) AS by0, list_max(list_transform(ring, lambda p: p.y)) AS by1 FROM n3),
allroads AS (SELECT edge_id, x0, y0, x1, y1 FROM (SELECT * FROM legs_m WHERE sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) >= 0.01)),
hit AS (SELECT n4.user_id, segment_index, point_id, t_ms, e.edge_id, e.x0, e.y0, e.x1, e.y1, list_transform(sides, lambda d: {{'at': d.dx * (e.y0 - d.y) - d.dy * (e.x0 - d.x), 'go': d.dx * (e.y1 - e.y0) - d.dy * (e.x1 - e.x0)}}) AS cuts
  FROM n4 JOIN allroads e ON least(e.x0, e.x1) <= bx1 AND greatest(e.x0, e.x1) >= bx0 AND least(e.y0, e.y1) <= by1 AND greatest(e.y0, e.y1) >= by0),
cut AS (SELECT *, greatest(0e0, coalesce(list_max(list_transform(list_filter(cuts, lambda c: c.go > 0), lambda c: -c.at / c.go)), 0e0)) AS a,
  least(1e0, coalesce(list_min(list_transform(list_filter(cuts, lambda c: c.go < 0), lambda c: -c.at / c.go)), 1e0)) AS b,
  len(list_filter(cuts, lambda c: c.go = 0 AND c.at < 0)) AS outside FROM hit),
pieces AS (SELECT * FROM cut WHERE outside = 0 AND b > a + 1e-12)"""


_CORRIDOR_ROADS = f"""WITH {_corridor_sql('budget_s > 0')} SELECT user_id, segment_index, edge_id, round(a, 6) AS a, round(b, 6) AS b FROM pieces"""


@query(_CORRIDOR_ROADS)
def corridor_roads(spark, sf):
    out = JOBS["corridor"](_trips_track(spark, sf), t.roads(spark, sf), zone=t.ZONE)["road_pieces"]
    return out.select("user_id", F.col("segment_index").cast("long").alias("segment_index"), "edge_id", r("a").alias("a"), r("b").alias("b"))


@query(_CORRIDOR_ROADS)
def corridor_roads_zones(spark, sf):
    """Zones follow the segments, roads their reach."""
    out = JOBS["corridor"](_trips_track(spark, sf), t.roads(spark, sf))["road_pieces"]
    return out.select("user_id", F.col("segment_index").cast("long").alias("segment_index"), "edge_id", r("a").alias("a"), r("b").alias("b"))


@query(f"""WITH {_corridor_sql('true')}, lo AS (SELECT user_id, edge_id, a AS lo, b AS hi FROM pieces),
whole AS (SELECT i.*, x0 + (a + b) / 2 * (x1 - x0) AS mx, y0 + (a + b) / 2 * (y1 - y0) AS my FROM {_islands('user_id, edge_id', 'lo')} i JOIN allroads USING (edge_id)),
d AS (SELECT w.user_id, w.edge_id, a, b, f.point_id, f.t_ms, pow(f.x - mx, 2) + pow(f.y - my, 2) AS d2 FROM whole w JOIN tm f USING (user_id))
SELECT user_id, edge_id, round(a, 6) AS a, round(b, 6) AS b, round(sqrt(min(d2)), 4) AS away_m FROM d GROUP BY user_id, edge_id, a, b""")
def corridor_union(spark, sf):
    """Each road of a user's corridor once, with how far the nearest fix is."""
    from chronoweave.functions.geo import with_utm
    track = _trips_track(spark, sf)
    out = JOBS["corridor"](track, t.roads(spark, sf), zone=t.ZONE, merge=True)["road_pieces"]
    fixes = with_utm(track, [("lon", "lat", "fx", "fy")], t.ZONE).select("user_id", F.col("point_id").alias("fix_id"), F.col("t_ms").alias("timestamp_ms"), "fx", "fy")
    mid = (F.col("a") + F.col("b")) / 2
    away = F.hypot(F.col("x0") + mid * (F.col("x1") - F.col("x0")) - F.col("fx"), F.col("y0") + mid * (F.col("y1") - F.col("y0")) - F.col("fy"))
    # the fix that the job names, with its time
    return out.join(fixes, ["user_id", "fix_id", "timestamp_ms"]).select("user_id", "edge_id", r("a").alias("a"), r("b").alias("b"), r(away, 4).alias("away_m"))


# ================================================================ input and output


@query("""SELECT event_id, epoch_ms(date_trunc('minute', ts)) AS t_ms, CAST(extract(hour FROM ts) AS INTEGER) AS clock_hour, strftime(ts, '%Y-%m-%d %H:%M') AS readable FROM events""")
def mixed_time_formats(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'Z'")).when(k == 1, F.date_format("ts", "M/d/yyyy H:mm"))
            .when(k == 2, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:00")))
    out = when.with_epoch_ms(e.withColumn("seen", text), "seen", on_bad="raise")
    return out.select("event_id", "t_ms", when.clock_hour(F.col("seen")).alias("clock_hour"), when.readable(F.col("t_ms")).alias("readable"))


def _dms_rows(spark, sf):
    c = t.table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey")
    lon = (F.when(k % 4 == 0, F.concat((k % 180).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"), (k % 50).cast("string"), F.lit('"W')))
           .when(k % 4 == 1, F.concat((k % 360).cast("string"), F.lit(".25"))).when(k % 4 == 2, F.lit("n/a")).otherwise(F.concat(F.lit("-"), (k % 90).cast("string"), F.lit(".5 deg"))))
    lat = F.when(k % 4 == 0, F.concat((k % 90).cast("string"), F.lit("°30.5'S"))).otherwise(F.concat(F.lit(" "), (k % 100).cast("string"), F.lit(".125")))
    return c.select(k.alias("id"), lon.alias("x"), lat.alias("y"), (F.lit(1_600_000_000) + k * 60).alias("seen"))


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 180) + (c_custkey % 60) / 60e0 + (c_custkey % 50) / 3600e0) WHEN 1 THEN c_custkey % 360 + 0.25e0 WHEN 3 THEN -(c_custkey % 90 + 0.5e0) END AS lon,
  CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 90) + 30.5e0 / 60) ELSE c_custkey % 100 + 0.125e0 END AS lat FROM customer)
SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, strftime(make_timestamp((1600000000 + id * 60) * 1000000), '%Y-%m-%d %H:%M') AS seen_readable FROM p WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90""")
def csv_points(spark, sf):
    good, _, _ = points.csv_to_points(_dms_rows(spark, sf), "x", "y")
    out = points.add_readable_epochs(good, ("lon", "lat"))
    return out.select("id", r("lon").alias("lon"), r("lat").alias("lat"), "seen_readable")


@query("""WITH p AS (SELECT CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 180) + (c_custkey % 60) / 60e0 + (c_custkey % 50) / 3600e0) WHEN 1 THEN c_custkey % 360 + 0.25e0 WHEN 3 THEN -(c_custkey % 90 + 0.5e0) END AS lon,
  CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 90) + 30.5e0 / 60) ELSE c_custkey % 100 + 0.125e0 END AS lat FROM customer),
s AS (SELECT coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) AS ok FROM p)
SELECT count(*) AS total_rows, count(*) FILTER (ok) AS valid_rows, count(*) FILTER (NOT ok) AS invalid_rows FROM s""")
def csv_quarantine(spark, sf):
    return points.csv_to_points(_dms_rows(spark, sf), "x", "y")[2]


@query(f"WITH {S.ROADS} SELECT source_id, highway, count(*) + 1 AS vertices, round(sum(px), 6) AS sum_lon FROM legs GROUP BY 1, 2")
def osm_ways(spark, sf):
    """The streets handed over as separate nodes and ways."""
    roads = t.roads(spark, sf).select("source_id", "highway", F.posexplode("coords").alias("i", "p"))
    ref = F.col("source_id") * 4 + F.col("i")
    nodes = roads.select(F.lit("node").alias("type"), ref.alias("id"), F.col("p.x").alias("lon"), F.col("p.y").alias("lat"),
                         F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    base = t.roads(spark, sf)
    refs = F.transform(F.sequence(F.lit(0), F.size("coords") - 1), lambda i: F.col("source_id") * 4 + i)
    ways = base.select(F.lit("way").alias("type"), F.col("source_id").alias("id"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"),
                       F.concat(refs, F.array(F.lit(-1).cast("long"))).alias("nodes"), F.create_map(F.lit("highway"), F.col("highway")).alias("tags"))
    out = points.osm_to_roads(nodes.unionByName(ways))
    legs = F.slice("coords", F.lit(1), F.size("coords") - 1)
    return out.select("source_id", "highway", F.size("coords").cast("long").alias("vertices"),
                      r(F.aggregate(legs, F.lit(0.0), lambda a, p: a + p["x"])).alias("sum_lon"))


@query(f"""WITH {S.TRAJ} SELECT point_id AS sequence, user_id, label, t_ms AS timestamp_ms, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(t_ms % 1000 AS VARCHAR), 3, '0') || 'Z' AS time_iso FROM traj""")
def analysis_export(spark, sf):
    df = t.traj(spark, sf).select(F.col("point_id").alias("_sequence"), F.col("user_id").alias("_user_id"), "label", F.col("t_ms").alias("_timestamp"),
                                  F.lit(3.0).alias("z"), F.array(F.lit(1)).alias("color_rgba"), F.lit("x").alias("_layer_config"), F.lit(0.0).alias("dwell_sec_min"))
    return sinks.to_analysis_table(df)


@query(f"""WITH {S.TRAJ}, {S.ENV} SELECT 'fixes' AS source_dataset, count(*) AS rows, count(value) AS with_value FROM traj UNION ALL SELECT 'stations', count(*), count(value) FROM env""")
def merged_sources(spark, sf):
    out = points.merge_sources({"fixes": t.traj(spark, sf), "stations": t.env(spark, sf), "prism": t.traj(spark, sf)}, exclude=("prism",))
    return out.groupBy("source_dataset").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"))


@query(f"""WITH {S.TRAJ}, {S.ENV} SELECT (SELECT count(*) FROM traj) AS input_count, (SELECT count(*) FROM env) AS output_count, round(min(lon), 6) AS min_x, round(min(lat), 6) AS min_y,
  round(max(lon), 6) AS max_x, round(max(lat), 6) AS max_y FROM env""")
def run_summary(spark, sf):
    out = sinks.run_summary({"traj": t.traj(spark, sf)}, {"env": t.env(spark, sf)})
    return out.select("input_count", "output_count", *[r(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])


@query("""SELECT event_id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || CAST(event_id AS VARCHAR) || '.5,' || CAST(user_id AS VARCHAR) || '.25]},"properties":{"label":"' || event_type || '","speed":null}}' AS feature FROM events""")
def geojson_features(spark, sf):
    e = t.table(spark, sf, "events")
    df = e.select((F.col("event_id") + 0.5).alias("lon"), (F.col("user_id") + 0.25).alias("lat"), F.col("event_type").alias("label"), F.lit(float("nan")).alias("speed"))
    text = sinks.to_features(df)
    # the id is read back from the written geometry
    x = F.get_json_object("value", "$.geometry.coordinates[0]").cast("double")
    return text.select(F.floor(x).alias("event_id"), F.col("value").alias("feature"))


@query(f"""WITH {S.TRAJ}, b AS (SELECT min(t_ms) AS t0, max(t_ms) AS t1 FROM traj)
SELECT point_id FROM traj, b WHERE abs((t_ms - t0) / CAST(t1 - t0 AS DOUBLE) - 0.3) <= 0.5 / 8""")
def time_window_view(spark, sf):
    path = JOBS["trajectory"](t.traj(spark, sf))["trajectory"]
    return prism.time_slice(path, 0.3, "window", 8).select("point_id")


