"""Per-segment potential path areas along a path, and the roads inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import capsule, ellipse, middle_lon, ring_bounds, ring_lonlat, utm_zone, with_lonlat, with_utm
from chronoweave.functions.lens import clip_to_area, clip_to_ring
from chronoweave.operators.nearest import nearest
from chronoweave.operators.sequence import Timeline
from chronoweave.operators.skew import lookup_join
from chronoweave.session import cut_lineage, ship_package


def segment_ppas(traj: DataFrame, speed_ms: float, zone: int, south: bool = False, corridor_m: float = 100.0,
                 skip_empty: bool = True, hot_rows: int | None = None) -> DataFrame:
    """One convex ring (planar metres) per consecutive pair of fixes: ellipse, or a corridor when the
    person moved faster than the speed. ``skip_empty`` leaves out pairs without time between them."""
    placed = with_utm(traj, [("lon", "lat", "x", "y")], zone, south)
    return _rings(_segments(placed, ("x", "y"), skip_empty, hot_rows), speed_ms, corridor_m)


def lonlat_segments(traj: DataFrame, skip_empty: bool = True, hot_rows: int | None = None) -> DataFrame:
    """The consecutive pairs of fixes, each with the UTM zone ``_zone`` of its own middle."""
    middle = middle_lon(F.col("lon"), F.col("nlon"))
    return _segments(traj, ("lon", "lat"), skip_empty, hot_rows).withColumn(
        "_zone", F.coalesce(utm_zone(middle), utm_zone(F.col("lon")), utm_zone(F.col("nlon")), F.lit(31)))


def zone_ppas(segments: DataFrame, speed_ms: float, zone: int, corridor_m: float = 100.0) -> DataFrame:
    """The rings of ``lonlat_segments``, all measured in one zone."""
    return _rings(with_utm(segments, [("lon", "lat", "x", "y"), ("nlon", "nlat", "nx", "ny")], zone), speed_ms, corridor_m)


def _segments(traj: DataFrame, xy: tuple[str, str], skip_empty: bool, hot_rows: int | None) -> DataFrame:
    line = Timeline(traj, ["user_id"], "t_ms", "point_id", hot_rows)
    line = line.neighbours(following={f"n{c}": F.col(c) for c in xy} | {"n_ms": F.col("t_ms")}).running(_i=F.lit(1))
    pairs = line.result().filter("n_ms is not null").withColumn("budget_s", (F.col("n_ms") - F.col("t_ms")) / 1000)
    return pairs.filter("budget_s > 0") if skip_empty else pairs


def _rings(pairs: DataFrame, speed_ms: float, corridor_m: float) -> DataFrame:
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "nx", "ny"))
    string = F.col("budget_s") * speed_ms
    oval = ellipse(x, y, nx, ny, string)
    # what the ring is drawn from: a twentieth of its length
    drawn = F.struct("x", "y", "nx", "ny", string.alias("string"), F.lit(float(corridor_m)).alias("radius"))
    return pairs.select("user_id", (F.col("_i") - 1).alias("segment_index"), "point_id", "t_ms", "n_ms", "budget_s",
                        F.coalesce(oval, capsule(x, y, nx, ny, corridor_m)).alias("ring"), oval.isNull().alias("fallback"), drawn.alias("_drawn"))


def ppa_features(ppas: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """The rings in longitude and latitude."""
    return ppas.drop("_drawn").withColumn("ring", ring_lonlat(F.col("ring"), zone, south))


#: Cells that a ring's box spans along a side, at most about.
SPAN = 4


def drawn_bounds() -> Column:
    """Box of the ellipse or the widened line of ``_drawn``, which holds the corners of its ring, without drawing them."""
    x, y, nx, ny, string, radius = (F.col("_drawn")[c] for c in ("x", "y", "nx", "ny", "string", "radius"))
    focal = F.hypot(nx - x, ny - y)
    short = F.sqrt(F.greatest((string - focal) * (string + focal), F.lit(0.0)))

    def side(a: Column, b: Column) -> tuple[Column, Column]:
        half = F.hypot(short, b - a) / 2 + 1e-6  # of an ellipse, however it is turned
        return (F.when(F.col("fallback"), F.least(a, b) - radius - 1e-6).otherwise((a + b) / 2 - half),
                F.when(F.col("fallback"), F.greatest(a, b) + radius + 1e-6).otherwise((a + b) / 2 + half))

    (x0, x1), (y0, y1) = side(x, nx), side(y, ny)
    # least() skips nulls: without a place at both ends there is no ring
    return F.when(focal.isNotNull(), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def ring_cells(ppas: DataFrame, cell_m: float) -> DataFrame:
    """Each ring once for every grid cell its box covers (``_level, _cx, _cy``); cells double in size until a box has few of them."""
    b = drawn_bounds() if "_drawn" in ppas.columns else ring_bounds(F.col("ring"))
    size = F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(cell_m)) / (SPAN * cell_m)))).cast("int")
    own = ppas.withColumn("_b", b).withColumn("_level", level).withColumn("_cell", cell_m * F.pow(F.lit(2.0), F.col("_level")))

    def covered(axis: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(f"_b.{axis}0") / F.col("_cell")), F.floor(F.col(f"_b.{axis}1") / F.col("_cell"))))

    return own.withColumn("_cx", covered("x")).withColumn("_cy", covered("y")).drop("_cell")


def clip_roads(ppas: DataFrame, edges: DataFrame, cell_m: float = 500.0, hot_rows: int | None = None) -> DataFrame:
    """Road pieces inside each ring: ``user_id, segment_index, edge_id, a, b`` as fractions of the edge.

    Both sides are listed in the grid cells their boxes cover, rings in cells of their own size and edges in every size that a ring
    uses; a pair sharing several cells is taken only in the cell holding the low corner of the boxes' overlap. Rings that say what they
    are drawn from (``_drawn``) are listed without their corners, and drawn again where a road is cut.
    """
    ship_package(ppas.sparkSession)
    drawn = "_drawn" in ppas.columns
    shape = ["_drawn", "fallback"] if drawn else ["ring"]
    left = cut_lineage(ring_cells(ppas, cell_m).select("user_id", "segment_index", "point_id", "t_ms", *shape, "_b", "_level", "_cx", "_cy"))
    levels = sorted(r[0] for r in left.select("_level").distinct().collect())  # doublings from the smallest cell to the world
    lo_x, hi_x, lo_y, hi_y = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    right = edges.select("edge_id", "highway", "source_id", "length_m", "x0", "y0", "x1", "y1").withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels or [0]])))
    side = cell_m * F.pow(F.lit(2.0), F.col("_level"))
    right = (right.withColumn("_cx", F.explode(F.sequence(F.floor(lo_x / side), F.floor(hi_x / side))))
             .withColumn("_cy", F.explode(F.sequence(F.floor(lo_y / side), F.floor(hi_y / side)))))
    met = lookup_join(left, right, ["_level", "_cx", "_cy"], hot_rows=hot_rows)
    ox, oy = F.greatest(F.col("_b.x0"), lo_x), F.greatest(F.col("_b.y0"), lo_y)
    once = ((ox <= F.least(F.col("_b.x1"), hi_x)) & (oy <= F.least(F.col("_b.y1"), hi_y))
            & (F.floor(ox / side) == F.col("_cx")) & (F.floor(oy / side) == F.col("_cy")))
    road = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    clip = clip_to_area(*road, F.col("_drawn"), F.col("fallback")) if drawn else clip_to_ring(*road, F.col("ring.x"), F.col("ring.y"))
    cut = met.filter(once).withColumn("_t", clip)
    return cut.filter(F.col("_t.t1") > F.col("_t.t0") + 1e-12).select(
        "user_id", "segment_index", "point_id", "t_ms", "edge_id", "highway", "source_id", "length_m", "x0", "y0", "x1", "y1",
        F.col("_t.t0").alias("a"), F.col("_t.t1").alias("b"))


def union_pieces(pieces: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Each edge's covered parts, overlapping rings merged, one row per part of one user's corridor.

    Pieces measured in several zones (``_zone``) meet as fractions; the edge is then that of its lowest zone.
    """
    cols = ["highway", "source_id", "length_m", "x0", "y0", "x1", "y1"]
    if "_zone" in pieces.columns:
        edge = pieces.groupBy("user_id", "edge_id").agg(F.min_by(F.struct("_zone", *cols), F.col("_zone")).alias("_edge"))
        merged = union_pieces(pieces.drop("_zone"), hot_rows).drop(*cols)
        return merged.join(edge, ["user_id", "edge_id"]).select("user_id", "edge_id", "part", "a", "b", "_edge.*")
    keys = ["user_id", "edge_id"]
    line = Timeline(pieces, keys, "a", "segment_index", hot_rows).prior_max(_reach=F.col("b"))
    line = line.running(part=F.when(F.col("_reach").isNull() | (F.col("a") > F.col("_reach") + 1e-9), 1).otherwise(0))
    return line.result().groupBy(*keys, "part").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), *[F.first(c).alias(c) for c in cols])


def nearest_fix(parts: DataFrame, traj: DataFrame, zone: int, south: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Give each road part the time of the user's fix nearest to its middle."""
    fixes = with_utm(traj, [("lon", "lat", "fx", "fy")], zone, south).select(
        "user_id", "fx", "fy", F.col("point_id").alias("fix_id"), F.col("t_ms").alias("fix_ms"))
    mid = (F.col("a") + F.col("b")) / 2
    pts = parts.withColumns({"mx": F.col("x0") + mid * (F.col("x1") - F.col("x0")), "my": F.col("y0") + mid * (F.col("y1") - F.col("y0")),
                             "_pid": F.concat_ws("/", "user_id", "edge_id", "part")})
    hit = nearest(pts, fixes, ["user_id"], "_pid", "fix_id", ("mx", "my"), ("fx", "fy"), hot_rows)
    return hit.select("user_id", "edge_id", "part", "a", "b", "highway", "source_id", "length_m", "x0", "y0", "x1", "y1",
                      F.col("hit.item.fix_id").alias("fix_id"), F.col("hit.item.fix_ms").alias("timestamp_ms"))


def piece_lines(pieces: DataFrame, zone: int, south: bool = False) -> DataFrame:
    """Add the two ends of each piece in longitude and latitude."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ends = pieces.withColumns({f"_{k}{s}": F.col(f"{k}0") + F.col(s) * d for s in "ab" for k, d in (("x", dx), ("y", dy))})
    return with_lonlat(ends, [("_xa", "_ya", "lon0", "lat0"), ("_xb", "_yb", "lon1", "lat1")], zone, south) \
        .drop("_xa", "_ya", "_xb", "_yb")


def straight_path(pairs: DataFrame, points: int = 20, duration_min: float = 45.0, now_ms: int | None = None) -> DataFrame:
    """Evenly spaced fixes on the straight way between two anchors, for pairs without a track.

    Missing or equal times span at least 45 minutes from now.
    """
    forward = F.coalesce("a_ms", F.lit(0)) <= F.coalesce("b_ms", F.lit(0))

    def pick(first: str, second: str) -> Column:
        return F.when(forward, F.col(first)).otherwise(F.col(second))

    t0, t1 = F.coalesce(pick("a_ms", "b_ms"), F.lit(0)), F.coalesce(pick("b_ms", "a_ms"), F.lit(0))
    blank = (t0 == t1) | (t0 == 0) | (t1 == 0)
    now = F.lit(now_ms).cast("long") if now_ms is not None else F.unix_millis(F.current_timestamp())
    t1 = F.when(blank, now + int(max(duration_min, 45.0) * 60_000)).otherwise(t1)
    t0 = F.when(blank, now).otherwise(t0)
    f = F.col("_i") / max(points - 1, 1)
    keys = [c for c in pairs.columns if c[:2] not in ("a_", "b_")]
    return pairs.withColumns({"_x0": pick("a_lon", "b_lon"), "_y0": pick("a_lat", "b_lat"), "_x1": pick("b_lon", "a_lon"),
                              "_y1": pick("b_lat", "a_lat"), "_t0": t0, "_t1": t1}) \
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))) \
        .select(*keys, F.col("_i").cast("long").alias("point_id"), (F.col("_x0") + f * (F.col("_x1") - F.col("_x0"))).alias("lon"),
                (F.col("_y0") + f * (F.col("_y1") - F.col("_y0"))).alias("lat"),
                (F.col("_t0") + f * (F.col("_t1") - F.col("_t0"))).cast("long").alias("t_ms"))
