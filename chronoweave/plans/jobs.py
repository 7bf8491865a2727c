"""The analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import GRID_M_PER_DEG, box_meets, height_scale_value, lift, middle_lon, utm_zone, with_utm
from chronoweave.functions.hexgrid import auto_resolution, to_hex
from chronoweave.functions.roads import mode_profile, mode_speed_kmh, resolve_speed_factor
from chronoweave.operators import corridor as corridors
from chronoweave.operators import cube as cubes
from chronoweave.operators import exposure as exposures
from chronoweave.operators import kernel, meetings, pasta, prism, routines, shared
from chronoweave.operators import network as net
from chronoweave.operators import trajectory as paths
from chronoweave.operators.area import preclip_roads
from chronoweave.operators.fold import anchor_fixes, static_clusters, thin_circles
from chronoweave.operators.grid import extent
from chronoweave.operators.skew import dealt, lookup_join
from chronoweave.operators.sequence import Timeline, union_all
from chronoweave.report import Report
from chronoweave.session import cut_lineage, stored
from chronoweave.sources.layout import BOX

Outputs = dict[str, DataFrame]

# A disc of so many times its radius holds what is measured in a zone's plane as well.
REACH_SAFETY = 1.15


def roads_near(roads: DataFrame, discs: DataFrame, zone: int) -> DataFrame:
    """The roads whose extent meets the box around all discs (``lon, lat, radius_m``), a superset of what they reach."""
    def away(lon: Column) -> Column:
        return F.pmod(lon - (zone * 6 - 183) + 180, F.lit(360.0)) - 180

    high = F.col("radius_m") * REACH_SAFETY / 110_000
    top = F.abs("lat") + high
    wide = F.when(top >= 89, F.lit(360.0)).otherwise(high / F.cos(F.radians(top)))
    x = away(F.col("lon"))
    box = discs.filter("lon is not null and lat is not null and radius_m is not null").agg(
        F.min(x - wide).alias("w"), F.max(x + wide).alias("e"), F.min(F.col("lat") - high).alias("s"), F.max(F.col("lat") + high).alias("n")).first()
    if box.w is None:
        return roads.limit(0)
    middle = zone * 6 - 183
    if set(BOX) <= set(roads.columns) and box.w + middle >= -180 and box.e + middle <= 180:
        # the table says how far its roads reach: groups of rows outside the box are not read
        return roads.filter(box_meets(BOX, (box.w + middle, box.s, box.e + middle, box.n)))
    lons, lats = F.transform("coords", lambda p: away(p["x"])), F.transform("coords", lambda p: p["y"])
    near = (F.array_min(lats) <= box.n) & (F.array_max(lats) >= box.s)
    if box.w >= -180 and box.e <= 180:
        near &= (F.array_min(lons) <= box.e) & (F.array_max(lons) >= box.w)
    return roads.filter(near)


def by_zone(rows: DataFrame, lon: Column, roads: DataFrame, reach, run) -> Outputs:
    """Run an analysis for each UTM zone that rows lie in, with all roads that its discs (``reach``) can meet, and put the
    results together.

    A row's answer then depends on no other row. There are sixty zones; each is an analysis of its own.
    """
    tagged = rows.withColumn("_zone", utm_zone(lon))
    zones = sorted(r[0] for r in tagged.select("_zone").filter("_zone is not null").distinct().collect())  # sixty at most
    parts = []
    for zone in zones or [31]:
        own = tagged.filter(F.col("_zone") == zone).drop("_zone")
        parts.append(run(own, roads_near(roads, reach(own), zone), zone))
    return {k: union_all([p[k] for p in parts]) for k in parts[0]}


def _discs(df: DataFrame, ends: list[tuple[str, str]], radius: Column) -> DataFrame:
    return df.select(radius.alias("radius_m"), F.inline(F.array(*[F.struct(F.col(a).alias("lon"), F.col(b).alias("lat")) for a, b in ends])))


def _top_ms(mode: str, custom_kmh: float | None) -> float:
    """No road is quicker than this in a mode."""
    return max(0.5, mode_profile(mode, custom_kmh).max_kmh * 1.1) / 3.6


def middle_lat(a: str = "a_lat", b: str = "b_lat") -> Column:
    """Reference latitude of a pair's own hexagons."""
    return F.round((F.col(a) + F.col(b)) / 2)


def trajectory(df: DataFrame, *, align: bool = False, flat: bool = False, stays: bool = False, stay_field: str | None = None,
               dist_m: float = 100.0, window_ms: int = 300_000, hot_rows: int | None = None) -> Outputs:
    """3-D path, optional ground path, optional stays (by attribute or by proximity)."""
    path = paths.trajectory(df, align, hot_rows)
    out = {"trajectory": path}
    if flat:
        out["trajectory_2d"] = paths.flatten(path)
    if stays and stay_field:
        out["stay_points"] = paths.stays_by_field(path, stay_field, hot_rows)
    elif stays:
        out["stay_points"] = paths.stay_points(path, dist_m, window_ms, hot_rows)
    return out


def _note_all(report: Report | None, step: str, warnings: list[str]) -> None:
    for text in warnings if report else ():
        report.note(step, text)


def _watch_trips(report: Report | None, trips: DataFrame) -> DataFrame:
    return trips if report is None else report.watch("trips", trips, lambda n: f"{n['infeasible']} trips are too far for their time" if n["infeasible"] else "",
                                                     feasible=F.count_if("feasible"), infeasible=F.count_if(~F.col("feasible")))


def stkde(df: DataFrame, *, show_trajectory: bool = False, ground: bool = False, report: Report | None = None, **options) -> Outputs:
    res = kernel.stkde(df, **options)
    _note_all(report, "slices", res["warnings"])
    cls = res["classified"].withColumn("ring", res["grid"].ring(F.col("col"), F.col("row")))
    out = {f"stkde_{k}": cls.filter(F.col("classification") == k) for k in (1, 2, 3)}
    if ground:
        out["ground"] = res["ground"].withColumn("ring", res["grid"].ring(F.col("col"), F.col("row")))
    if show_trajectory:
        out["trajectory"] = paths.trajectory(df, options.get("align", False))
    return out


def space_time_cube(df: DataFrame, *, ground: bool = False, report: Report | None = None, **options) -> Outputs:
    res = cubes.space_time_cube(df, **options)
    _note_all(report, "slices", res["warnings"])
    grid = res["grid"]
    cells = res["cubes"].withColumn("ring", lift(grid.ring(F.col("col"), F.col("row")), F.col("z")))
    out = {"cubes": report.watch("cubes", cells, cells=F.count(F.lit(1)), fixes=F.sum("count")) if report else cells}
    if res["segments"] is not None:
        out["segments"] = res["segments"]
    if ground:
        out["ground"] = res["ground"].withColumn("ring", grid.ring(F.col("col"), F.col("row")))
    return out


def path_prism(df: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None, n: int = 10, resolution: int = 9,
               hot_rows: int | None = None) -> Outputs:
    """Prism slices between the meaningful fixes of every user's path."""
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    ext = extent(df)
    pairs = prism.with_trip(prism.path_pairs(anchor_fixes(df), hot_rows), speed)
    height = height_scale_value(ext.min_lon, ext.max_lon, ext.min_lat, ext.max_lat)
    span = float(ext.t_max - ext.t_min or 1)
    slices = prism.euclid_slices(pairs, speed, n, steps=32).withColumn("time_progress", (F.col("timestamp_ms") - ext.t_min) / span)
    slices = slices.withColumns({"z": F.col("time_progress") * height, "height_m": F.col("dt_s") / n * (height / (span / 1000))})
    # every user has hexagons of their own
    refs = pairs.groupBy("user_id").agg(F.round(F.avg("a_lat")).alias("_lat0"))
    cells = prism.ppa_cells(lookup_join(pairs, refs, ["user_id"], hot_rows=hot_rows), speed, n, ["user_id"], resolution, F.col("_lat0"))
    path = df.withColumn("time_progress", (F.col("t_ms") - ext.t_min) / span).withColumn("height_m", F.col("time_progress") * height)
    return {"slices": slices, "trajectory": path, "anchors": path, "ppa_cells": cells,
            "ppa": prism.ppa_area(cells, ["user_id"], resolution), "counts": prism.feasibility_counts(pairs)}


def two_anchor_prism(pairs: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None, n: int = 15, resolution: int = 9,
                     duration_min: float = 0.0, path: DataFrame | None = None, lat0: float | None = None, report: Report | None = None) -> Outputs:
    """Euclidean prism of anchor pairs; infeasible pairs are counted, not drawn. Each pair's hexagons follow its own
    latitude unless ``lat0`` gives one for all."""
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    named = prism.anchor_heights(prism.normalise_anchors(pairs, duration_min), extent(path) if path is not None else None)
    trips = prism.with_trip(named, speed)
    slices = prism.euclid_slices(trips, speed, n)
    slices = slices.withColumn("z", F.col("z_start") + F.col("time_progress") * F.greatest(F.col("z_end") - F.col("z_start"), F.lit(1.0)))
    cells = prism.ppa_cells(trips, speed, n, ["pair_id"], resolution, middle_lat() if lat0 is None else lat0)
    return {"slices": slices, "anchors": prism.prism_anchors(_watch_trips(report, trips)), "ppa_cells": cells,
            "ppa": prism.ppa_area(cells, ["pair_id"], resolution), "counts": prism.feasibility_counts(trips)}


def grid_prism(pairs: DataFrame, blocked, *, mode: str = "walking", custom_kmh: float | None = None, n_slices: int = 15, grid: int = 60,
               report: Report | None = None) -> Outputs:
    """Prism on an obstacle grid. ``blocked`` is a table ``pair_id, row, col`` or a function from the pair grids to one."""
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    grids = cut_lineage(prism.pair_grids(_watch_trips(report, prism.with_trip(prism.normalise_anchors(dealt(pairs)), speed)), speed, grid))
    walls = blocked(grids) if callable(blocked) else blocked
    reach = prism.grid_reach(grids, walls)
    return {"slices": prism.grid_slices(grids, reach, n_slices), "times": prism.role_times(reach), "grids": grids, "anchors": prism.prism_anchors(grids)}


def road_prism(pairs: DataFrame, roads: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None,
               budget_min: float | None = None, min_activity_min: float = 5.0, zone: int | None = None, south: bool = False,
               area: DataFrame | None = None, adjustment: str = "off", manual_factor: float | None = None,
               traj: DataFrame | None = None, drop_minor: bool = False, max_segments: int | None = None,
               sheets: int = 12, resolution: int | None = None, lat0: float | None = None, exact: bool = False,
               hot_rows: int | None = None) -> Outputs:
    """Two-anchor road prism of many pairs with its dwell surface, time sheets and anchors.

    Zone, hexagon size and reference latitude follow each pair unless they are given. Nothing is left out
    unless ``drop_minor`` or ``max_segments`` asks for it, which then holds for ``ppa_roads`` and ``sheets``.
    """
    if zone is None:
        def run(own: DataFrame, near: DataFrame, z: int) -> Outputs:
            return road_prism(own, near, mode=mode, custom_kmh=custom_kmh, budget_min=budget_min, min_activity_min=min_activity_min,
                              zone=z, area=area, adjustment=adjustment, manual_factor=manual_factor, traj=traj, drop_minor=drop_minor,
                              max_segments=max_segments, sheets=sheets, resolution=resolution, lat0=lat0, exact=exact, hot_rows=hot_rows)

        def reach(own: DataFrame) -> DataFrame:
            seconds = F.lit(budget_min * 60.0) if budget_min is not None else (F.col("b_ms") - F.col("a_ms")) / 1000
            # a speed factor is 1.5 at most
            out = _discs(own, [("a_lon", "a_lat"), ("b_lon", "b_lat")],
                         F.greatest(F.lit(0.0), seconds) * (1.5 * _top_ms(mode, custom_kmh)) + mode_profile(mode, custom_kmh).max_snap_m)
            if adjustment == "auto" and traj is not None and "user_id" in own.columns:
                # fixes ten minutes apart at most tell the factor
                seen = traj.join(own.select("user_id").distinct(), "user_id", "left_semi")
                out = out.unionByName(_discs(seen, [("lon", "lat")], F.lit(900.0 * _top_ms(mode, custom_kmh) + 100.0)))
            return out
        return by_zone(pairs, middle_lon(F.col("a_lon"), F.col("b_lon")), roads, reach, run)
    profile = mode_profile(mode, custom_kmh)
    named = prism.anchor_heights(pairs)
    edges = stored(net.build_edges(preclip_roads(roads, area, hot_rows), profile, zone, south), "edges")
    budget = F.lit(budget_min * 60.0) if budget_min is not None else (F.col("b_ms") - F.col("a_ms")) / 1000
    mid_ms = (F.col("a_ms") + F.col("b_ms")) / 2
    observed: Column = F.lit(None).cast("double")
    if adjustment == "auto" and traj is not None and "user_id" in named.columns:
        factors = net.speed_factor(traj, edges, profile, zone, south, hot_rows).select("user_id", F.col("speed_factor").alias("_seen"))
        named = lookup_join(named, factors, ["user_id"], "left", hot_rows=hot_rows)
        observed = F.col("_seen")
    jobs = named.withColumns({"budget_sec": budget.cast("double"), "min_activity_sec": F.lit(max(0.0, min_activity_min * 60.0)),
                              "speed_factor": resolve_speed_factor(adjustment, manual_factor, observed, mid_ms, F.col("a_lon"), mode)})
    res = net.network_prism(jobs, edges, zone, south, profile.max_snap_m, exact, hot_rows)
    # roads are found when a result is read; only what reads them several times has them written
    full = res["roads"]
    if drop_minor or max_segments is not None or resolution is None or lat0 is None:
        full = stored(full, "prism-roads")
    drawn = net.drop_minor(full, mode) if drop_minor else full
    if max_segments is not None:
        drawn = net.uniform_subsample(drawn, ["pair_id"], "edge_id", "edge_id", max_segments, hot_rows)
    own = full
    if resolution is None or lat0 is None:
        refs = pairs.select("pair_id", middle_lat().alias("_ref"))
        box = full.groupBy("pair_id").agg(F.min(F.least("lon0", "lon1")).alias("_w"), F.max(F.greatest("lon0", "lon1")).alias("_e"),
                                          F.min(F.least("lat0", "lat1")).alias("_s"), F.max(F.greatest("lat0", "lat1")).alias("_n"))
        km = GRID_M_PER_DEG / 1000
        shrink = F.greatest(F.lit(0.1), F.abs(F.cos(F.radians("_ref"))))
        km2 = F.greatest(F.lit(1e-6), (F.col("_e") - F.col("_w")) * km * shrink * (F.col("_n") - F.col("_s")) * km)
        own = lookup_join(full, box.join(refs, "pair_id").select("pair_id", "_ref", auto_resolution(km2).alias("_fine")), ["pair_id"], hot_rows=hot_rows)
    surface = prism.dwell_surface(own, F.col("_fine") if resolution is None else resolution, F.col("_ref") if lat0 is None else lat0)
    return {"ppa_roads": drawn, "status": res["status"], "dwell_surface": surface,
            "sheets": prism.prism_sheets(drawn, sheets), "anchors": prism.prism_anchors(named)}


def origin_areas(pairs: DataFrame, traj: DataFrame, roads: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None,
                 budget_min: float | None = None, min_activity_min: float = 5.0, max_origins: int | None = None, cluster_m: float = 50.0,
                 max_segments: int | None = None, zone: int | None = None, south: bool = False, hot_rows: int | None = None) -> Outputs:
    """Reachable roads around every fix between a pair's anchors.

    ``pairs`` carries ``user_id``; fixes within the anchors' window (2 % margin, 15 s at least) are merged where the
    person stood still. ``max_origins`` samples them evenly and ``max_segments`` keeps the best pieces of each.
    """
    if zone is None:
        def run(own: DataFrame, near: DataFrame, z: int) -> Outputs:
            return origin_areas(own, traj, near, mode=mode, custom_kmh=custom_kmh, budget_min=budget_min, min_activity_min=min_activity_min,
                                max_origins=max_origins, cluster_m=cluster_m, max_segments=max_segments, zone=z, hot_rows=hot_rows)

        def reach(own: DataFrame) -> DataFrame:
            # a budget found from the fixes is their window or the activity and ten minutes at most
            window = own.select("pair_id", ((F.col("b_ms") - F.col("a_ms")) * 1.04 / 1000 + 60).alias("_window"))
            seconds = F.lit(budget_min * 60.0) if budget_min is not None else F.greatest(F.col("_window"), F.lit(max(0.0, min_activity_min * 60.0) + 600.0))
            fixes = lookup_join(origin_fixes(own, traj, hot_rows=hot_rows), window, ["pair_id"], hot_rows=hot_rows)
            return _discs(fixes, [("lon", "lat")], seconds * _top_ms(mode, custom_kmh) + mode_profile(mode, custom_kmh).max_snap_m)
        return by_zone(pairs, middle_lon(F.col("a_lon"), F.col("b_lon")), roads, reach, run)
    profile = mode_profile(mode, custom_kmh)
    min_act = max(0.0, min_activity_min * 60.0)
    sampled = origin_fixes(pairs, traj, max_origins, hot_rows)
    origins = cut_lineage(static_clusters(sampled, "pair_id", cluster_m))
    budgets = auto_budget(origins, min_act, hot_rows=hot_rows) if budget_min is None else None
    keyed = with_utm(origins.withColumn("origin_id", F.struct("pair_id", "cluster")), [("lon", "lat", "x", "y")], zone, south)
    if budgets is not None:
        keyed = lookup_join(keyed, budgets, ["pair_id"], hot_rows=hot_rows)
    else:
        keyed = keyed.withColumn("budget_sec", F.lit(budget_min * 60.0))
    keyed = cut_lineage(keyed.select("origin_id", "pair_id", "cluster", "lon", "lat", "z", "t_ms", "size",
                                     "x", "y", F.col("budget_sec").cast("double"),
                                     F.lit(min_act).alias("min_activity_sec")))
    edges = stored(net.build_edges(roads, profile, zone, south), "edges")
    pieces, snapped = net.origin_ppa(keyed.select("origin_id", "x", "y", "budget_sec", "min_activity_sec"), edges, zone, south,
                                     profile.max_snap_m, hot_rows)
    # pieces are found when a result is read: writing them all costs more than finding them again
    summary = net.origin_summary(keyed, pieces, snapped, max_segments or 0)
    return {"ppa_roads": net.top_segments(pieces, max_segments or 0), "origins": keyed.select("origin_id", "pair_id", "lon", "lat", "z", "t_ms", "size")
            .join(summary, "origin_id"), "anchors": prism.prism_anchors(pairs)}


def origin_fixes(pairs: DataFrame, traj: DataFrame, max_origins: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Fixes between each pair's anchors; with ``max_origins`` evenly spaced ones, at most so many a pair.

    A window is listed in the two buckets at most that it touches among buckets as wide as its own length, rounded
    up to a power of two; a fix is listed once for each width in use, of which a long has sixty-three.
    """
    margin = F.greatest(((F.col("b_ms") - F.col("a_ms")) * 0.02).cast("long"), F.lit(15_000))
    windows = pairs.select("pair_id", "user_id", (F.col("a_ms") - margin).alias("_lo"), (F.col("b_ms") + margin).alias("_hi"))
    windows = windows.withColumn("_width", F.pow(F.lit(2.0), F.ceil(F.log2((F.col("_hi") - F.col("_lo") + 1).cast("double")))).cast("long"))
    widths = [r[0] for r in windows.select("_width").filter("_width > 0").distinct().collect()]
    listed = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / F.col("_width")), F.floor(F.col("_hi") / F.col("_width")))))
    fixes = traj.withColumn("_width", F.explode(F.array(*[F.lit(w).cast("long") for w in widths or [1]]))) \
        .withColumn("_bucket", F.floor(F.col("t_ms") / F.col("_width")))
    z = F.col("height_m") if "height_m" in traj.columns else F.lit(0.0)
    hits = lookup_join(fixes, listed, ["user_id", "_width", "_bucket"], hot_rows=hot_rows).filter(F.col("t_ms").between(F.col("_lo"), F.col("_hi")))
    hits = hits.select("pair_id", "point_id", "t_ms", "lon", "lat", z.alias("z"))
    return hits if max_origins is None else net.uniform_subsample(hits, ["pair_id"], "t_ms", "point_id", max_origins, hot_rows)


def auto_budget(origins: DataFrame, min_activity_sec: float, tie: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Budget per pair: the median gap between its origins, never below the activity plus a minute."""
    tie = tie or ("cluster" if "cluster" in origins.columns else "t_ms")
    gaps = Timeline(origins, ["pair_id"], "t_ms", tie, hot_rows).neighbours(previous={"_before": F.col("t_ms")}).result()
    # a greatest() skips nulls, so a pair with one origin needs a case of its own
    gap = F.when(F.col("_gap").isNotNull(), F.greatest(F.lit(min_activity_sec + 60.0), F.col("_gap") / 1000)).otherwise(min_activity_sec + 600.0)
    return gaps.groupBy("pair_id").agg(F.median(F.col("t_ms") - F.col("_before")).alias("_gap")).select("pair_id", gap.alias("budget_sec"))


def fix_surface(traj: DataFrame, anchors: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None, resolution: int = 9,
                min_activity_sec: float = 600.0, lat0: float | None = None, thin: bool = True) -> Outputs:
    """Stay surface of every fix on its way to the user's end anchor (``user_id, b_lon, b_lat, b_ms``)."""
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    ext = extent(traj)
    lat0 = round(ext.mean_lat) if lat0 is None else lat0
    fixes = lookup_join(traj, anchors, ["user_id"])
    circles = pasta.fix_circles(fixes, speed, min_activity_sec)
    height, span = height_scale_value(ext.min_lon, ext.max_lon, ext.min_lat, ext.max_lat), float(max(ext.t_max - ext.t_min, 1))
    shown = thin_circles(circles.select("user_id", "point_id", "t_ms", "lon", "lat", "budget_s", "radius_m")) if thin else circles
    shown = pasta.circle_features(shown).withColumn("z", (F.col("t_ms") - ext.t_min) / span * height)
    surface = pasta.hex_dwell(pasta.point_hexes(circles, speed, max(7, min(12, resolution)), lat0), max(7, min(12, resolution)), lat0)
    return {"hex_surface": surface, "circles": shown}


def activity_surface(df: DataFrame, *, roads: DataFrame | None = None, zone: int | None = None, **options) -> Outputs:
    """Schedule-based surface, voxels and anchor windows; with roads, also the roads of the first feasible window."""
    res = pasta.activity_pasta(df, **options)
    out = {"surface": pasta.surface_height(res["surface"]).withColumn("ring", res["grid"].ring(F.col("col"), F.col("row"))),
           "voxels": res["voxels"], "anchor_windows": res["anchor_windows"], "counts": pasta.window_counts(res["windows"])}
    if roads is not None:
        # every feasible window is the way of a traveller of its own
        ends = res["windows"].filter("feasible").select(
            F.col("window_id").alias("user_id"), F.col("from_lon").alias("a_lon"), F.col("from_lat").alias("a_lat"),
            F.col("from_ms").alias("a_ms"), F.col("to_lon").alias("b_lon"), F.col("to_lat").alias("b_lat"), F.col("to_ms").alias("b_ms"))
        found = corridor(corridors.straight_path(ends), roads, custom_kmh=options.get("speed_kmh", 5.0), mode="custom", zone=zone)
        out.update({f"window_{k}": v.withColumnRenamed("user_id", "window_id") for k, v in found.items()})
    return out


def corridor(traj: DataFrame, roads: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None, zone: int | None = None,
             south: bool = False, corridor_m: float = 100.0, merge: bool = False, cell_m: float = 500.0, hot_rows: int | None = None) -> Outputs:
    """Potential path area of every path segment and the roads in it; ``merge`` gives each road once with its nearest fix.

    Each segment is measured in the zone of its own middle unless a zone is given.
    """
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    if zone is None:
        return _corridor_by_zone(traj, roads, speed, corridor_m, merge, cell_m, hot_rows)
    # every class is a road here: nothing is excluded and speeds play no part
    edges = cut_lineage(net.build_edges(roads, mode_profile("custom", 5.0), zone, south))
    ppas = corridors.segment_ppas(traj, speed, zone, south, corridor_m, skip_empty=not merge, hot_rows=hot_rows)
    pieces = corridors.clip_roads(ppas, edges, cell_m, hot_rows)
    if merge:
        # read several times below; clipping once is cheaper than clipping again
        parts = cut_lineage(corridors.union_pieces(cut_lineage(pieces), hot_rows))
        pieces = corridors.nearest_fix(parts, traj, zone, south, hot_rows)
    return {"buffers": corridors.ppa_features(ppas, zone, south), "road_pieces": corridors.piece_lines(pieces, zone, south)}


def _corridor_by_zone(traj: DataFrame, roads: DataFrame, speed: float, corridor_m: float, merge: bool, cell_m: float, hot_rows: int | None) -> Outputs:
    segments = cut_lineage(corridors.lonlat_segments(traj, not merge, hot_rows))
    zones = sorted(r[0] for r in segments.select("_zone").distinct().collect()) or [31]  # sixty at most
    # the straight way between two fixes is nowhere farther from the nearer one than they are from each other
    dlon, dlat = F.radians(F.col("nlon") - F.col("lon")), F.radians(F.col("nlat") - F.col("lat"))
    half = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians("lat")) * F.cos(F.radians("nlat")) * F.pow(F.sin(dlon / 2), 2)
    apart = 2 * 6_378_137.0 * F.asin(F.least(F.lit(1.0), F.sqrt(half)))
    radius = F.greatest(F.col("budget_s") * speed, apart) + corridor_m
    buffers, found = [], []
    for zone in zones:
        own = segments.filter(F.col("_zone") == zone).drop("_zone")
        near = roads_near(roads, _discs(own, [("lon", "lat"), ("nlon", "nlat")], radius), zone)
        edges = cut_lineage(net.build_edges(near, mode_profile("custom", 5.0), zone))
        ppas = corridors.zone_ppas(own, speed, zone, corridor_m)
        buffers.append(corridors.ppa_features(ppas, zone))
        found.append(corridors.clip_roads(ppas, edges, cell_m, hot_rows).withColumn("_zone", F.lit(zone)))
    if not merge:
        return {"buffers": union_all(buffers), "road_pieces": union_all([corridors.piece_lines(p.drop("_zone"), z) for p, z in zip(found, zones, strict=True)])}
    parts = cut_lineage(corridors.union_pieces(cut_lineage(union_all(found)), hot_rows))
    lines = []
    for zone in zones:
        nearest = corridors.nearest_fix(parts.filter(F.col("_zone") == zone).drop("_zone"), traj, zone, hot_rows=hot_rows)
        lines.append(corridors.piece_lines(nearest, zone))
    return {"buffers": union_all(buffers), "road_pieces": union_all(lines)}


def exposure(traj: DataFrame, env: DataFrame, **options) -> Outputs:
    return {"trajectory": exposures.join_exposure(traj, env, **options)}




def encounters(traj: DataFrame, *, reach_m: float = 100.0, meeting_m: float = 20.0, max_gap_ms: int | None = 3_600_000,
               slot_ms: int = 1_800_000, cell_m: float | None = None, hot_rows: int | None = None) -> Outputs:
    """Times that two users are within ``reach_m`` of each other on their ways, and the nearest approach of every two motions."""
    met = stored(meetings.approaches(meetings.motions(traj, max_gap_ms, hot_rows), reach_m, slot_ms, cell_m, hot_rows=hot_rows), "approaches")
    return {"encounters": meetings.encounters(met, meeting_m, hot_rows), "approaches": met}


def bundles(traj: DataFrame, *, reach_m: float = 100.0, max_gap_ms: int | None = 3_600_000, min_members: int = 3, min_ms: int = 0,
            slot_ms: int = 900_000, hot_rows: int | None = None) -> Outputs:
    """Groups that move or stay within ``reach_m`` of each other, from neighbour to neighbour, with the stretches of time they do."""
    near = meetings.approaches(meetings.motions(traj, max_gap_ms, hot_rows), reach_m, hot_rows=hot_rows)
    met = meetings.encounters(stored(near.select("user_a", "user_b", "enter_ms", "leave_ms"), "approaches"), None, hot_rows)
    return {"bundles": routines.bundles(met, min_members, min_ms, slot_ms, hot_rows)}


def daily_routines(traj: DataFrame, *, gap_ms: int = 3_600_000, cell_deg: float = 0.002, min_stays: int = 3, hot_rows: int | None = None) -> Outputs:
    """Stays, the stations they gather at, and how often a user's days and moves repeat."""
    stays = cut_lineage(routines.stations(routines.sessions(traj, gap_ms), cell_deg, min_stays, hot_rows))
    days = cut_lineage(routines.day_sequences(stays, hot_rows))
    return {"stays": stays, "days": days, "routines": routines.routines(days), "transitions": routines.transitions(days)}


def temporal_misses(traj: DataFrame, *, max_gap_ms: int = 3_600_000, resolution: int = 10, lat0: float | None = None,
                    hot_rows: int | None = None) -> Outputs:
    """Visits of hexagons, and for each the next visitor who came too late."""
    lat0 = round(extent(traj).mean_lat) if lat0 is None else lat0
    seen = cut_lineage(meetings.visits(traj, to_hex(F.col("lon"), F.col("lat"), resolution, lat0), hot_rows))
    return {"misses": meetings.temporal_misses(seen, max_gap_ms, hot_rows), "visits": seen}


def prism_intersections(pairs: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None, step_ms: int = 60_000, resolution: int = 9,
                        lat0: float | None = None, hot_rows: int | None = None, report: Report | None = None) -> Outputs:
    """Prisms that share hexagons at the same instants. Hexagons follow one reference latitude, the pairs' mean unless it is given."""
    speed = mode_speed_kmh(mode, custom_kmh) / 3.6
    trips = prism.with_trip(pairs, speed)
    if lat0 is None:
        lat0 = round(trips.agg(F.avg((F.col("a_lat") + F.col("b_lat")) / 2)).first()[0] or 0.0)
    cells = shared.shared_cells(cut_lineage(shared.occupancy(trips, speed, step_ms, resolution, lat0)), hot_rows=hot_rows)
    return {"intersections": shared.shared_prisms(cells, step_ms), "cells": cells, "counts": prism.feasibility_counts(_watch_trips(report, trips))}


def observed_activities(activities: DataFrame, prisms: DataFrame, *, mode: str = "walking", custom_kmh: float | None = None,
                        hot_rows: int | None = None) -> Outputs:
    """Each activity against the user's prisms, and how many are inside, outside or without one a user."""
    checked = shared.check_activities(activities, prisms, mode_speed_kmh(mode, custom_kmh) / 3.6, hot_rows)
    return {"activities": checked, "counts": shared.activity_counts(checked)}
