"""Registered queries on readers, writers and opt-in limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweave.plans import JOBS
from chronoweave.schema import TrajectorySchema
from chronoweave.session import work_folder
from chronoweave.sources import points, sinks
from workload import sql as S
from workload import tables as t
from workload.movement import ORACLES, QUERIES  # noqa: F401
from workload.queries import _ORIGINS, _dms_rows, _trips_track, query, r


@query(f"WITH {S.TRAJ} SELECT point_id, user_id, t_ms, lon, lat, label, value FROM traj")
def csv_round_trip(spark, sf):
    """Fixes written as CSV and read back with a schema."""
    folder = work_folder(spark, "csv")
    sinks.write_points_csv(t.traj(spark, sf), folder)
    schema = "longitude double, latitude double, altitude double, point_id long, user_id string, t_ms long, label string, value double"
    rows = points.read_points_csv(spark, folder, schema)
    return rows.select("point_id", "user_id", "t_ms", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "label", "value")


@query(f"WITH {S.TRAJ} SELECT CAST(point_id AS VARCHAR) AS point_id, lon, lat, label FROM traj")
def geojson_points(spark, sf):
    """Point features written and read back."""
    folder = work_folder(spark, "points")
    sinks.write_geojson(t.traj(spark, sf).select("point_id", "lon", "lat", "label"), folder)
    rows = points.only_points(points.read_geojson(spark, folder, lines=True))
    return rows.select(F.col("props")["point_id"].alias("point_id"), "lon", "lat", F.col("props")["label"].alias("label"))


@query(f"""WITH {S.ROADS} SELECT a.highway, a.px AS x0, a.py AS y0, b.qx AS x1, b.qy AS y1, 3 AS vertices FROM legs a JOIN legs b ON b.source_id = a.source_id AND a.leg = 0 AND b.leg = 1""")
def geojson_roads(spark, sf):
    """Road lines written as features and loaded from them."""
    folder = work_folder(spark, "lines")
    sinks.write_geojson(t.roads(spark, sf), folder)
    roads = points.load_roads(points.read_geojson(spark, folder, lines=True))
    first, last = F.element_at("coords", 1), F.element_at("coords", -1)
    return roads.select("highway", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"), F.size("coords").alias("vertices"))


@query("""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 180) + (c_custkey % 60) / 60e0 + (c_custkey % 50) / 3600e0) WHEN 1 THEN c_custkey % 360 + 0.25e0 WHEN 3 THEN -(c_custkey % 90 + 0.5e0) END AS lon,
  CASE c_custkey % 4 WHEN 0 THEN -((c_custkey % 90) + 30.5e0 / 60) ELSE c_custkey % 100 + 0.125e0 END AS lat FROM customer)
SELECT id, ' ' || (id % 100) || '.125' AS lat FROM p WHERE NOT coalesce(lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90, false) ORDER BY id LIMIT 10""")
def first_errors(spark, sf):
    """The first ten customers that cannot be placed."""
    rejected = points.csv_to_points(_dms_rows(spark, sf), "x", "y")[1]
    return points.first_errors(rejected, "id").select("id", "lat")


@query(f"""WITH {S.TRAJ} SELECT point_id, t_ms FROM traj""")
def time_fallback(spark, sf):
    """Views have a number, other events a text as their time; each row takes the column it can be read from."""
    e = t.traj(spark, sf)
    view = F.col("label") == "view"
    text = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    own = e.select("point_id", "lon", "lat", F.when(view, F.col("t_ms")).alias("_timestamp"), F.when(~view, text).otherwise("n/a").alias("time"))
    return TrajectorySchema(point_id="point_id").apply(own).select("point_id", "t_ms")


@query(f"""WITH {S.TRAJ} SELECT point_id, CAST(row_number() OVER (ORDER BY user_id, t_ms, point_id) - 1 AS BIGINT) AS sequence, 0e0 AS height_m FROM traj""")
def ground_path(spark, sf):
    return JOBS["trajectory"](t.traj(spark, sf), flat=True)["trajectory_2d"].select("point_id", "sequence", "height_m")


@query(f"""WITH RECURSIVE {_ORIGINS}, n AS (SELECT point_id, count(*) AS n FROM cover GROUP BY 1)
SELECT o.pair_id, o.point_id AS cluster, least(n.n, 2) AS segments FROM o JOIN n USING (point_id)""")
def best_pieces(spark, sf):
    """At most two pieces of road for each origin."""
    out = JOBS["origin_areas"](t.pairs(spark, sf), _trips_track(spark, sf), t.roads(spark, sf), budget_min=4.0, min_activity_min=1.0, cluster_m=0.0, zone=t.ZONE, max_segments=2)
    return out["ppa_roads"].groupBy("origin_id").agg(F.count(F.lit(1)).alias("segments")).select("origin_id.*", "segments")


@query(f"""WITH {S.PASTA_CELLS}, o AS (SELECT min(from_ms) AS g FROM checked),
b AS (SELECT window_id, row, col, g, CAST(trunc(from_ms + go_s * 1000) AS BIGINT) AS early, CAST(trunc(to_ms - back_s * 1000) AS BIGINT) AS late FROM cells, o),
v AS (SELECT b.*, unnest(range(CAST(ceil((early - g) / 300000e0) AS BIGINT), CAST(floor((late - g) / 300000e0) AS BIGINT) + 1)) AS time_bin FROM b)
SELECT window_id, row, col, time_bin FROM v WHERE least(late, g + (time_bin + 1) * 300000) > greatest(early, g + time_bin * 300000) ORDER BY window_id, row, col, time_bin LIMIT 6000""")
def first_voxels(spark, sf):
    """The cap on voxels that a drawing asks for."""
    out = JOBS["activity_surface"](t.episodes(spark, sf), cell_m=1000.0, max_voxels=6000)["voxels"]
    return out.select("window_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("time_bin").cast("long").alias("time_bin"))


@query(f"WITH {S.PASTA} SELECT window_id, CAST(19 AS BIGINT) AS segments, round(budget_s, 3) AS budget_s FROM checked WHERE feasible")
def window_corridors(spark, sf):
    """The straight ways of all feasible windows, segment by segment, with the zone left to each."""
    out = JOBS["activity_surface"](t.episodes(spark, sf), roads=t.roads(spark, sf), cell_m=1000.0)["window_buffers"]
    return out.groupBy("window_id").agg(F.count(F.lit(1)).alias("segments"), r(F.sum("budget_s"), 3).alias("budget_s"))
