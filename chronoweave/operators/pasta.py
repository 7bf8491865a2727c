"""Potential activity surfaces: how long people could stay where, between fixed activities."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import CIRCLE_M_PER_DEG, cell_ring, circle, haversine_m
from chronoweave.functions.hexgrid import hex_center, hex_ring, with_hexes
from chronoweave.functions.roads import preset_kmh
from chronoweave.operators.grid import extent
from chronoweave.operators.sequence import Timeline
from chronoweave.operators.skew import hot_keys, spread
from chronoweave.session import cut_lineage

# Activity types.
FIXED = ("home", "work", "school", "hospital", "errand", "worship", "family", "friend")
FLEXIBLE = ("shopping", "restaurant", "recreation", "entertainment", "leisure")


def option_set(raw, default: tuple) -> list[str]:
    """Comma text or a list -> lower-cased names; nothing given means the default."""
    if raw is None or raw == "":
        return [v.lower() for v in default]
    names = raw.split(",") if isinstance(raw, str) else list(raw)
    return [n for n in (str(v).strip().lower() for v in names) if n]


def activity_episodes(df: DataFrame, *, end_col: str | None = None, fixed=None, flexible=None,
                      default_mode: str = "walking", hot_rows: int | None = None) -> DataFrame:
    """Episodes with an end and a fixed flag.

    Needs ``person_id, episode_id, lon, lat, start_ms``; ``activity_type, mode, weight, is_fixed``
    are optional. Without an end column an episode lasts until the person's next start, the last
    one half an hour. Episodes without positive length are dropped.
    """
    cols = df.columns

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))), F.lit(default)) if name in cols else F.lit(default)

    kind = text("activity_type", "")
    explicit = F.coalesce(F.col("is_fixed").cast("boolean"), F.lit(False)) if "is_fixed" in cols else F.lit(False)
    weight = F.coalesce(F.col("weight").cast("string").try_cast("double"), F.lit(1.0)) if "weight" in cols else F.lit(1.0)
    base = df.filter(F.col("start_ms").isNotNull()).select(
        F.coalesce(F.col("person_id").cast("string"), F.lit("person-1")).alias("person_id"), "episode_id", "lon", "lat", "start_ms",
        *([F.col(end_col).alias("end_ms")] if end_col else []),
        kind.alias("activity_type"), text("mode", default_mode).alias("mode"), weight.alias("weight"),
        F.when(kind.isin(*option_set(fixed, FIXED)), F.lit(True)).when(kind.isin(*option_set(flexible, FLEXIBLE)), F.lit(False))
        .otherwise(explicit).alias("is_fixed"))
    if not end_col:
        line = Timeline(base, ["person_id"], "start_ms", "episode_id", hot_rows)
        base = line.neighbours(following={"_next": F.col("start_ms")}).result()
        base = base.withColumn("end_ms", F.coalesce("_next", F.col("start_ms") + 30 * 60_000)).drop("_next")
    return base.filter(F.col("end_ms") > F.col("start_ms"))


def anchor_windows(episodes: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per run of flexible episodes with a fixed episode on both sides.

    A running count of fixed episodes numbers the gaps; flexible rows aggregate per gap, and the
    two fixed rows around it are found by their own numbers.
    """
    line = Timeline(episodes, ["person_id"], "start_ms", "episode_id", hot_rows)
    gap = line.running(gap=F.col("is_fixed").cast("int")).result()
    flex = gap.filter(~F.col("is_fixed") & (F.col("gap") > 0)).groupBy("person_id", "gap").agg(
        F.min_by("mode", F.struct("start_ms", "episode_id")).alias("_mode"), F.max("weight").alias("weight"),
        F.count(F.lit(1)).alias("flexible_count"))
    fixed = gap.filter("is_fixed")

    def side(prefix: str, shift: int, time: str) -> DataFrame:
        return fixed.select("person_id", (F.col("gap") - shift).alias("gap"), F.col("lon").alias(f"{prefix}_lon"),
                            F.col("lat").alias(f"{prefix}_lat"), F.col(time).alias(f"{prefix}_ms"),
                            F.col("activity_type").alias(f"{prefix}_activity"),
                            *([F.col("mode").alias("_from_mode")] if prefix == "from" else []))

    both = flex.join(side("from", 0, "end_ms"), ["person_id", "gap"]).join(side("to", 1, "start_ms"), ["person_id", "gap"])
    return both.select(
        "person_id", "gap", F.concat_ws("-", "person_id", "gap").alias("window_id"),
        "from_lon", "from_lat", "from_ms", "from_activity", "to_lon", "to_lat", "to_ms", "to_activity",
        F.when(F.col("_mode") != "", F.col("_mode")).otherwise(F.col("_from_mode")).alias("mode"), "weight", "flexible_count",
        ((F.col("to_ms") - F.col("from_ms")) / 1000).alias("budget_s"))


def with_feasibility(windows: DataFrame, fallback_kmh: float = 5.0, min_dwell_min: float = 10.0) -> DataFrame:
    """Add ``speed_kmh, speed_ms, feasible``."""
    w = windows.withColumn("speed_kmh", preset_kmh(F.col("mode"), fallback_kmh))
    w = w.withColumn("speed_ms", F.col("speed_kmh") * 1000 / 3600)
    trip = haversine_m(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")) / F.col("speed_ms")
    return w.withColumn("feasible", (F.col("budget_s") > 0) & (trip + min_dwell_min * 60 <= F.col("budget_s")))


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.agg(F.count_if("feasible").alias("feasible_windows"), F.count_if(~F.col("feasible")).alias("excluded_windows"))


@dataclass(frozen=True)
class PastaGrid:
    min_lon: float
    min_lat: float
    cell_deg: float
    cell_m: float
    cols: int
    rows: int

    def lon(self, col: Column) -> Column:
        return (col + 0.5) * self.cell_deg + self.min_lon

    def lat(self, row: Column) -> Column:
        return (row + 0.5) * self.cell_deg + self.min_lat

    def ring(self, col: Column, row: Column) -> Column:
        return cell_ring(col * self.cell_deg + self.min_lon, row * self.cell_deg + self.min_lat,
                         F.lit(self.cell_deg), F.lit(self.cell_deg))


def pasta_grid(points: DataFrame, windows: DataFrame, cell_m: float = 250.0, cap: int | None = None) -> PastaGrid:
    """Grid over all activity places plus the farthest reach; coarser when over the cap (None: no cap)."""
    ext = extent(points)
    top = windows.agg(F.max("budget_s"), F.max("speed_ms")).first()
    if top[0] is None:
        raise ValueError("no anchor windows: flexible activities need fixed ones on both sides")
    reach = max(top[1] * top[0] / CIRCLE_M_PER_DEG, cell_m / CIRCLE_M_PER_DEG) * 1.05
    x0, y0, x1, y1 = ext.min_lon - reach, ext.min_lat - reach, ext.max_lon + reach, ext.max_lat + reach

    def layout(deg: float) -> tuple[int, int]:
        return max(1, math.ceil((x1 - x0) / deg)), max(1, math.ceil((y1 - y0) / deg))

    deg = cell_m / CIRCLE_M_PER_DEG
    cols, rows = layout(deg)
    if cap and cols * rows > cap:
        scale = math.sqrt(cols * rows / cap)
        deg, cell_m = deg * scale, cell_m * scale
        cols, rows = layout(deg)
    return PastaGrid(x0, y0, deg, cell_m, cols, rows)


#: Windows of one person above which they are dealt over all tasks.
PERSON_ROWS = 20_000


def _by_person(windows: DataFrame) -> DataFrame:
    """Windows of a person in one task before they become cells, so that cells of one person are added up where they are made."""
    if hot_keys(windows, ["person_id"], PERSON_ROWS)[0] is not None:
        return spread(windows)
    spark = windows.sparkSession
    return windows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "person_id")


def window_cells(windows: DataFrame, grid: PastaGrid, min_dwell_min: float = 10.0) -> DataFrame:
    """Cells each feasible window can use, with the two travel times and the stay left.

    Only rows and columns within the window's reach are listed: a usable cell lies within
    ``budget * speed / 2 + half the anchor distance`` of the middle of the two anchors.
    """
    w = _by_person(windows.filter("feasible")).withColumn("_reach", (F.col("budget_s") - min_dwell_min * 60) * F.col("speed_ms") / 2)
    mid_lat, mid_lon = (F.col("from_lat") + F.col("to_lat")) / 2, (F.col("from_lon") + F.col("to_lon")) / 2
    half = F.greatest(F.abs(F.col("from_lat") - F.col("to_lat")), F.lit(0.0)) / 2
    half_lon = F.abs(F.col("from_lon") - F.col("to_lon")) / 2
    # every usable cell is within the reach of the nearer anchor
    dlat = half + F.col("_reach") / CIRCLE_M_PER_DEG
    top = F.greatest(F.abs(mid_lat - dlat), F.abs(mid_lat + dlat))
    dlon = F.when(top > 89.0, F.lit(360.0)).otherwise(
        half_lon + 1.001 * F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.least(F.lit(math.pi / 2), F.col("_reach") / 6_371_000.0))
                                              / F.cos(F.radians(F.least(top, F.lit(89.0))))))))

    def span(mid: Column, d: Column, low: float, n: int) -> tuple[Column, Column]:
        return (F.greatest(F.lit(0), F.floor((mid - d - low) / grid.cell_deg - 0.5)),
                F.least(F.lit(n - 1), F.ceil((mid + d - low) / grid.cell_deg - 0.5)))

    r0, r1 = span(mid_lat, dlat, grid.min_lat, grid.rows)
    c0, c1 = span(mid_lon, dlon, grid.min_lon, grid.cols)
    cells = (w.withColumns({"_r0": r0, "_r1": r1, "_c0": c0, "_c1": c1}).filter("_r0 <= _r1 and _c0 <= _c1")
             .withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1"))))
    lon, lat = grid.lon(F.col("col")), grid.lat(F.col("row"))
    out = cells.select("person_id", "window_id", "mode", "weight", "speed_kmh", "budget_s", "from_ms", "to_ms",
                       F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                       (haversine_m(F.col("from_lon"), F.col("from_lat"), lon, lat) / F.col("speed_ms")).alias("go_s"),
                       (haversine_m(lon, lat, F.col("to_lon"), F.col("to_lat")) / F.col("speed_ms")).alias("back_s"))
    return out.withColumn("dwell_s", F.col("budget_s") - F.col("go_s") - F.col("back_s")) \
        .filter(F.col("dwell_s") >= min_dwell_min * 60)


def pasta_surface(cells: DataFrame) -> DataFrame:
    """Dwell totals per cell. First per cell and person, so a popular cell is already small when its
    persons are counted."""
    dwell = F.col("dwell_s") / 60
    per_person = cells.groupBy("row", "col", "person_id").agg(
        F.sum(dwell).alias("d"), F.sum(dwell * F.col("weight")).alias("w"), F.count(F.lit(1)).alias("n"),
        F.collect_set("mode").alias("modes"))
    return per_person.groupBy("row", "col").agg(
        F.sum("d").alias("dwell_minutes"), F.sum("w").alias("weighted_dwell_minutes"), F.sum("n").alias("window_count"),
        F.count(F.lit(1)).alias("person_count"),
        # at most a handful of mode names
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("modes")))).alias("modes"),
    ).withColumn("mode", F.array_join("modes", ",")).drop("modes")


def surface_height(surface: DataFrame) -> DataFrame:
    """Add ``height_m``; the greatest weighted stay is found when the heights are read, not before."""
    top = F.coalesce(F.nullif(surface.agg(F.max("weighted_dwell_minutes")).scalar(), F.lit(0.0)), F.lit(1.0))
    return surface.withColumn("height_m", F.greatest(F.lit(20.0), F.col("weighted_dwell_minutes") / top * 1000))


def voxels(cells: DataFrame, origin_ms: int, bin_min: float = 5.0, max_voxels: int | None = None) -> DataFrame:
    """Split each cell's possible stay into time bins; ``max_voxels`` keeps the first in window, row,
    column, bin order."""
    bin_ms = int(bin_min * 60_000)
    early = (F.col("from_ms") + F.col("go_s") * 1000).cast("long")
    late = (F.col("to_ms") - F.col("back_s") * 1000).cast("long")
    spans = cells.withColumns({"_early": early, "_late": late}).withColumns({
        "_b0": F.ceil((F.col("_early") - origin_ms) / bin_ms), "_b1": F.floor((F.col("_late") - origin_ms) / bin_ms)})
    binned = spans.filter("_b0 <= _b1").withColumn("time_bin", F.explode(F.sequence("_b0", "_b1")))
    start = F.col("time_bin") * bin_ms + origin_ms
    overlap = F.least(F.col("_late"), start + bin_ms) - F.greatest(F.col("_early"), start)
    out = binned.withColumns({"bin_start_ms": start, "_o": overlap}).filter("_o > 0").select(
        "person_id", "window_id", "row", "col", "time_bin", "bin_start_ms", "mode", "speed_kmh",
        (F.col("_o") / 60_000).alias("dwell_minutes"), (F.col("_o") / 60_000 * F.col("weight")).alias("weighted_dwell_minutes"))
    return out if max_voxels is None else out.orderBy("window_id", "row", "col", "time_bin").limit(max_voxels)


def first_voxels(windows: DataFrame, grid: PastaGrid, min_dwell_min: float, origin_ms: int, bin_min: float, max_voxels: int) -> DataFrame:
    """The first ``max_voxels`` voxels, from the first windows alone: so many more of them until they hold enough."""
    many = max(max_voxels, 1)
    while True:
        first = windows.filter("feasible and window_id is not null").select("window_id").orderBy("window_id").limit(many)
        last = first.agg(F.max("window_id").alias("id"), F.count(F.lit(1)).alias("n")).first()
        # windows of one id come together, as those without an id do
        own = windows.filter(F.col("window_id").isNull() | (F.col("window_id") <= F.lit(last.id)))
        found = cut_lineage(voxels(window_cells(own, grid, min_dwell_min), origin_ms, bin_min, max_voxels))
        if last.n < many or found.count() >= max_voxels:
            return found
        many *= 8


def anchor_rows(windows: DataFrame, origin_ms: int, z_per_ms: float) -> DataFrame:
    """Two rows per feasible window: leaving the first fixed place, reaching the second."""
    roles = F.array(*[F.struct(F.lit(role).alias("anchor_role"), F.col(f"{p}_lon").alias("lon"), F.col(f"{p}_lat").alias("lat"),
                               F.col(f"{p}_ms").alias("timestamp_ms"), F.col(f"{p}_activity").alias("activity_type"))
                      for role, p in (("start_anchor", "from"), ("end_anchor", "to"))])
    return windows.filter("feasible").select("person_id", "window_id", "mode", "weight", F.inline(roles)) \
        .withColumn("z", (F.col("timestamp_ms") - origin_ms) * z_per_ms)


def activity_pasta(df: DataFrame, *, end_col: str | None = None, fixed=None, flexible=None, speed_kmh: float = 5.0,
                   default_mode: str = "walking", min_dwell_min: float = 10.0, bin_min: float = 5.0,
                   cell_m: float = 250.0, cap: int | None = None, max_voxels: int | None = None,
                   hot_rows: int | None = None) -> dict:
    """The whole schedule surface: ``surface, voxels, anchor_windows, windows`` and the grid."""
    episodes = activity_episodes(df, end_col=end_col, fixed=fixed, flexible=flexible, default_mode=default_mode, hot_rows=hot_rows)
    windows = with_feasibility(anchor_windows(episodes, hot_rows), speed_kmh, min_dwell_min).persist()
    grid = pasta_grid(df, windows, cell_m, cap)
    when = windows.agg(F.min("from_ms"), F.max("to_ms")).first()
    height = max((when[1] - when[0]) / (60_000 * bin_min) * 20, 1000)
    cells = window_cells(windows, grid, min_dwell_min)
    return {"surface": pasta_surface(cells), "cells": cells, "windows": windows, "grid": grid,
            "voxels": voxels(cells, when[0], bin_min) if max_voxels is None else first_voxels(windows, grid, min_dwell_min, when[0], bin_min, max_voxels),
            "anchor_windows": anchor_rows(windows, when[0], height / max(when[1] - when[0], 1))}


# ---------------------------------------------------------------- per fix, with one end anchor


def fix_circles(traj: DataFrame, speed_ms: float, min_dwell_s: float = 600.0) -> DataFrame:
    """Reach circle of every fix on its way to the end anchor (``b_lon, b_lat, b_ms`` columns)."""
    to_b = haversine_m(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat"))
    budget = (F.col("b_ms") - F.col("t_ms")) / 1000 - to_b / speed_ms - min_dwell_s
    return traj.withColumn("budget_s", budget).filter("budget_s > 0") \
        .withColumn("radius_m", F.col("budget_s") * (speed_ms / 2)).filter("radius_m >= 10")


def circle_features(circles: DataFrame, steps: int = 32) -> DataFrame:
    return circles.withColumn("ring", circle(F.col("lon"), F.col("lat"), F.col("radius_m"), steps))


def point_hexes(circles: DataFrame, speed_ms: float, resolution: int, lat0: float) -> DataFrame:
    """One row per fix and hexagon it could stay in, with the stay length."""
    near = with_hexes(spread(circles), F.col("lon"), F.col("lat"), F.col("radius_m"), resolution, lat0)
    c = hex_center(F.col("hex_q"), F.col("hex_r"), resolution, lat0)
    away = haversine_m(F.col("lon"), F.col("lat"), c["x"], c["y"])
    return near.withColumn("dwell_s", F.col("budget_s") - 2 * away / speed_ms).filter("dwell_s > 0")


def hex_dwell(pairs: DataFrame, resolution: int, lat0: float, keys: list[str] | None = None) -> DataFrame:
    """Total possible stay per hexagon (summed inside each task before the shuffle)."""
    out = pairs.groupBy(*(keys or []), "hex_q", "hex_r").agg((F.sum("dwell_s") / 60).alias("dwell_minutes"))
    return out.withColumn("ring", hex_ring(F.col("hex_q"), F.col("hex_r"), resolution, lat0))


