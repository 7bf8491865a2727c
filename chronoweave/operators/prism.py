"""Space-time prisms without roads: circles between anchors, and obstacle grids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chronoweave.functions.geo import CIRCLE_M_PER_DEG, GRID_M_PER_DEG, haversine_m, height_scale_value
from chronoweave.functions.hexgrid import Number, cell_area_km2, hex_center, hex_ring, sample_step_m, to_hex, with_hexes
from chronoweave.functions.lens import circle_overlap
from chronoweave.operators.network import relax
from chronoweave.operators.sequence import Timeline
from chronoweave.operators.skew import fits_broadcast, lookup_join, spread
from chronoweave.session import cut_lineage, ship_package, stored


def normalise_anchors(pairs: DataFrame, duration_min: float = 0.0, now_ms: int | None = None) -> DataFrame:
    """Order each pair in time, name its ends, and give equal times a length when one is supplied.

    Pairs without coordinates, or without any length, fail the query.
    """
    cols = pairs.columns
    full = pairs.withColumns({
        "a_ms": F.coalesce("a_ms", F.lit(0)), "b_ms": F.coalesce("b_ms", F.lit(0)),
        **{f"{p}_alt": F.coalesce(f"{p}_alt", F.lit(0.0)) if f"{p}_alt" in cols else F.lit(0.0) for p in "ab"},
        **{f"{p}_label": F.coalesce(F.nullif(F.col(f"{p}_label"), F.lit("")) if f"{p}_label" in cols else F.lit(None).cast("string"),
                                    F.lit(f"Anchor {p.upper()}")) for p in "ab"}})
    swapped, equal = F.col("b_ms") < F.col("a_ms"), F.col("a_ms") == F.col("b_ms")
    now = F.lit(now_ms).cast("long") if now_ms is not None else F.unix_millis(F.current_timestamp())
    missing = F.col("a_lon").isNull() | F.col("a_lat").isNull() | F.col("b_lon").isNull() | F.col("b_lat").isNull()
    start = F.when(missing, F.raise_error(F.lit("anchors need lon and lat")).cast("long"))
    if duration_min <= 0:
        start = start.when(equal, F.raise_error(F.lit("anchors need different times or a duration")).cast("long"))
    start = start.when(equal, now).otherwise(F.least("a_ms", "b_ms"))
    stop = F.when(equal, now + int(duration_min * 60_000)).otherwise(F.greatest("a_ms", "b_ms"))
    names = [f"{p}_{c}" for p in "ab" for c in ("lon", "lat", "alt", "label")]
    picked = [F.when(swapped, F.col(("b" if n[0] == "a" else "a") + n[1:])).otherwise(F.col(n)).alias(n) for n in names]
    others = [c for c in cols if c[:2] not in ("a_", "b_")]
    return full.select(*others, start.alias("a_ms"), stop.alias("b_ms"), *picked)


def with_trip(pairs: DataFrame, speed_ms: float) -> DataFrame:
    """Add ``dt_s, dist_m, feasible``."""
    dist = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    return pairs.withColumns({"dt_s": (F.col("b_ms") - F.col("a_ms")) / 1000, "dist_m": dist}) \
        .withColumn("feasible", F.col("dist_m") <= F.col("dt_s") * speed_ms)


def feasibility_counts(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if("feasible").alias("feasible_segments"), F.count_if(~F.col("feasible")).alias("infeasible_segments"))


def path_pairs(anchors: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Consecutive anchor fixes of each user as anchor pairs."""
    line = Timeline(anchors, ["user_id"], "t_ms", "point_id", hot_rows)
    line = line.neighbours(following={"b_lon": F.col("lon"), "b_lat": F.col("lat"), "b_ms": F.col("t_ms")}).running(_i=F.lit(1))
    return line.result().filter("b_ms is not null").select(
        "user_id", (F.col("_i") - 1).alias("segment"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"),
        F.col("t_ms").alias("a_ms"), "b_lon", "b_lat", "b_ms")


def euclid_slices(pairs: DataFrame, speed_ms: float, n: int = 15, steps: int = 48) -> DataFrame:
    """Reachable region at n-1 instants between the anchors: two reach circles intersected.

    ``ring`` is the region's outline. Slices where the circles do not meet are left out.
    """
    ship_package(pairs.sparkSession)
    s = spread(pairs.filter("feasible")).withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
    frac = F.col("slice") / n
    s = s.withColumns({"time_progress": frac, "timestamp_ms": F.col("a_ms") + frac * (F.col("b_ms") - F.col("a_ms")),
                       "r1": F.col("dt_s") * speed_ms * frac, "r2": F.col("dt_s") * speed_ms * (1 - frac)}).filter("r1 > 0 and r2 > 0")
    overlap = circle_overlap(steps)(F.col("a_lon"), F.col("a_lat"), F.col("r1"), F.col("b_lon"), F.col("b_lat"), F.col("r2"))
    return s.withColumn("_o", overlap).filter(F.col("_o.ring").isNotNull()).select(
        *s.columns, F.col("_o.ring").alias("ring"), (F.col("_o.area") * CIRCLE_M_PER_DEG**2).alias("area_m2"))


def ppa_cells(pairs: DataFrame, speed_ms: float, n: int, keys: list[str], resolution: int, lat0: Number) -> DataFrame:
    """Distinct hexagons whose centre any slice covers: the potential path area as cells.

    A centre at distances d1, d2 from the anchors is covered by the slices from ``d1 n / (v T)`` to
    ``n - d2 n / (v T)``, so each pair lists its cells once instead of once per slice.
    """
    trips = spread(pairs.filter("feasible")).withColumns({
        "_mx": (F.col("a_lon") + F.col("b_lon")) / 2, "_my": (F.col("a_lat") + F.col("b_lat")) / 2, "_r": F.col("dt_s") * (speed_ms / 2)})
    cells = with_hexes(trips, F.col("_mx"), F.col("_my"), F.col("_r"), resolution, lat0)
    c = hex_center(F.col("hex_q"), F.col("hex_r"), resolution, lat0)

    def away(lon: Column, lat: Column) -> Column:
        return F.hypot((c["x"] - lon) * F.cos(F.radians(lat)), c["y"] - lat) * CIRCLE_M_PER_DEG

    per_slice = F.col("dt_s") * (speed_ms / n)
    first = F.greatest(F.lit(1), F.ceil(away(F.col("a_lon"), F.col("a_lat")) / per_slice))
    last = F.least(F.lit(n - 1), F.floor(n - away(F.col("b_lon"), F.col("b_lat")) / per_slice))
    return cells.filter(first <= last).select(*keys, "hex_q", "hex_r").distinct()


def ppa_area(cells: DataFrame, keys: list[str], resolution: int) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) * cell_area_km2(resolution)).alias("area_km2"))


def prism_anchors(pairs: DataFrame) -> DataFrame:
    """Start and end row of each pair with its height (``z_start, z_end`` when present, else 0 and 1)."""
    z0 = F.col("z_start") if "z_start" in pairs.columns else F.lit(0.0)
    z1 = F.col("z_end") if "z_end" in pairs.columns else F.lit(1.0)
    label = [F.col(f"{p}_label") if f"{p}_label" in pairs.columns else F.lit(d) for p, d in (("a", "Anchor A"), ("b", "Anchor B"))]
    rows = F.array(
        F.struct(F.lit("start_anchor").alias("anchor_role"), label[0].alias("anchor_label"), F.col("a_lon").alias("lon"),
                 F.col("a_lat").alias("lat"), F.col("a_ms").alias("timestamp_ms"), z0.alias("z"), F.lit(0.0).alias("time_progress")),
        F.struct(F.lit("end_anchor").alias("anchor_role"), label[1].alias("anchor_label"), F.col("b_lon").alias("lon"),
                 F.col("b_lat").alias("lat"), F.col("b_ms").alias("timestamp_ms"), z1.alias("z"), F.lit(1.0).alias("time_progress")))
    return pairs.select("pair_id", F.inline(rows))


def anchor_heights(pairs: DataFrame, path_extent=None) -> DataFrame:
    """Add ``z_start, z_end``: on the trajectory's own scale when its extent is given, else from the
    anchors' distance."""
    if path_extent is not None:
        e = path_extent
        total = F.lit(height_scale_value(e.min_lon, e.max_lon, e.min_lat, e.max_lat))
        t0, span = F.lit(float(e.t_min)), F.lit(max(float(e.t_max - e.t_min), 1.0))
    else:
        deg = F.greatest(F.abs(F.col("b_lon") - F.col("a_lon")), F.abs(F.col("b_lat") - F.col("a_lat")), F.lit(0.001))
        total = F.least(deg * CIRCLE_M_PER_DEG, F.lit(5000.0))
        t0, span = F.col("a_ms").cast("double"), F.greatest((F.col("b_ms") - F.col("a_ms")).cast("double"), F.lit(1.0))
    return pairs.withColumns({"z_start": (F.col("a_ms") - t0) / span * total, "z_end": (F.col("b_ms") - t0) / span * total})


# ---------------------------------------------------------------- obstacle grid

FRAMES = 20_000  # pairs whose grids and closed cells are broadcast
ROOT2 = math.sqrt(2)
MOVES = [(dr, dc, ROOT2 if dr and dc else float(bool(dr or dc))) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]


def pair_grids(pairs: DataFrame, speed_ms: float, n: int = 60) -> DataFrame:
    """A square-celled grid per pair covering everything within reach, with both anchors' cells."""
    pad = F.col("dt_s") * speed_ms / CIRCLE_M_PER_DEG * 1.1
    lo_x, hi_x = F.least("a_lon", "b_lon") - pad, F.greatest("a_lon", "b_lon") + pad
    lo_y, hi_y = F.least("a_lat", "b_lat") - pad, F.greatest("a_lat", "b_lat") + pad
    g = pairs.filter("feasible").withColumns({"x0": lo_x, "y0": lo_y, "_w": hi_x - lo_x, "_h": hi_y - lo_y})
    g = g.withColumn("cell_deg", F.greatest("_w", "_h") / n)
    g = g.withColumns({"cols": F.greatest(F.lit(1), F.ceil(F.col("_w") / F.col("cell_deg"))).cast("int"),
                       "rows": F.greatest(F.lit(1), F.ceil(F.col("_h") / F.col("cell_deg"))).cast("int"),
                       "step_s": F.col("cell_deg") * CIRCLE_M_PER_DEG / speed_ms})

    def at(v: str, low: str, count: str) -> Column:
        return F.least(F.col(count) - 1, F.greatest(F.lit(0), F.floor((F.col(v) - F.col(low)) / F.col("cell_deg")))).cast("int")

    return g.withColumns({"a_row": at("a_lat", "y0", "rows"), "a_col": at("a_lon", "x0", "cols"),
                          "b_row": at("b_lat", "y0", "rows"), "b_col": at("b_lon", "x0", "cols")}).drop("_w", "_h")


def corridor_cells(grids: DataFrame) -> DataFrame:
    """Cells always open: a three-cell-wide way from one anchor to the other, diagonal first."""
    dr, dc = F.col("b_row") - F.col("a_row"), F.col("b_col") - F.col("a_col")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.abs(dr), F.abs(dc))))
    near = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    way = grids.withColumn("_k", k).withColumn("_n", F.explode(near))
    row = F.col("a_row") + F.signum(dr.cast("double")).cast("int") * F.least(F.col("_k"), F.abs(dr)) + F.col("_n.r")
    col = F.col("a_col") + F.signum(dc.cast("double")).cast("int") * F.least(F.col("_k"), F.abs(dc)) + F.col("_n.c")
    return way.select("pair_id", row.cast("int").alias("row"), col.cast("int").alias("col")).distinct()


def _joined_grids(grids: DataFrame, blocked: DataFrame) -> DataFrame:
    """``pair_id, role, row, col, cost`` by joins, step by step, for grids that no task takes and for pairs that share a number."""
    walls = blocked.join(corridor_cells(grids).hint("merge"), ["pair_id", "row", "col"], "left_anti")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{p}_row").alias("row"), F.col(f"{p}_col").alias("col"))
                      for r, p in (("A", "a"), ("B", "b"))])
    seeds = grids.select("pair_id", F.inline(roles), F.lit(0.0).alias("cost"), F.col("dt_s").alias("cutoff"))

    def word(row: Column, col: Column) -> Column:
        return row.cast("long") * F.lit(1 << 32) + F.shiftright(col.cast("long"), 5)

    def bit(col: Column) -> Column:
        return col.cast("int").bitwiseAND(31)

    # a pair's closed cells travel with its frame, 32 to a number, so all steps of a round stay where the pair is
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("col")))
    packed = walls.groupBy("pair_id", word(F.col("row"), F.col("col")).alias("_w")).agg(F.bit_or(one).alias("_bits")) \
        .groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_walls"))
    frame = cut_lineage(grids.select("pair_id", "rows", "cols", "step_s").join(packed.hint("merge"), "pair_id", "left"))
    frame = F.broadcast(frame) if FRAMES and fits_broadcast(frame, FRAMES) else frame.hint("merge")
    moves = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(c).alias("k")) for a, b, c in MOVES])
    stay = F.array(F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"), F.lit(0.0).alias("k")))

    def expand(wave: DataFrame) -> DataFrame:
        moved = wave.join(frame, "pair_id").withColumn("_m", F.explode(F.when(F.col("fresh"), moves).otherwise(stay))).select(
            "pair_id", "role", (F.col("row") + F.col("_m.dr")).alias("row"), (F.col("col") + F.col("_m.dc")).alias("col"),
            (F.col("cost") + F.col("step_s") * F.col("_m.k")).alias("cost"), "cutoff", "rows", "cols", "_walls", (F.col("_m.k") == 0).alias("own"))
        bits = F.coalesce(F.try_element_at("_walls", word(F.col("row"), F.col("col"))), F.lit(0).cast("long"))
        shut = F.call_function("shiftright", bits, bit(F.col("col"))).bitwiseAND(1) == 1
        return moved.filter("row >= 0 and row < rows and col >= 0 and col < cols").filter(~shut).drop("rows", "cols", "_walls")

    return relax(seeds, expand, ["pair_id", "role", "row", "col"])


def grid_times(grids: DataFrame, blocked: DataFrame) -> DataFrame:
    """Travel time from both anchors to every open cell: ``pair_id, role, row, col, cost``.

    ``blocked``: ``pair_id, row, col``; the corridor between the anchors is opened.
    """
    return role_times(grid_reach(grids, blocked))


def role_times(reach: DataFrame) -> DataFrame:
    """``grid_reach`` with a row for each anchor that a cell is reached from; a pair's cells come once."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("cost")) for r, c in (("A", "from_a"), ("B", "to_b"))])
    return reach.filter("_first").select("pair_id", "row", "col", F.inline(roles)).filter("cost is not null").select("pair_id", "role", "row", "col", "cost")


#: Cells of all grids that one task searches together, and of a grid above which it is searched by joins.
GRID_CELLS = 2_000_000


def grid_reach(grids: DataFrame, blocked: DataFrame) -> DataFrame:
    """Travel times ``from_a`` and ``to_b`` of every open cell that an anchor reaches, with the frame of its grid.

    The grids of many pairs are searched together in one task, where their closed cells meet them; nothing is sent between the steps.
    """
    ship_package(grids.sparkSession)
    walls = blocked.filter("row is not null and col is not null").select("pair_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    size = F.col("rows").cast("long") * F.col("cols")
    shared = grids.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("pair_id")
    small = (size <= GRID_CELLS) & F.col("pair_id").isNotNull()
    whole = grids.filter(small)
    rest = grids.filter(~F.coalesce(small, F.lit(False)))
    if not shared.isEmpty():
        whole, rest = whole.join(shared, "pair_id", "left_anti"), rest.unionByName(whole.join(shared, "pair_id", "left_semi"))
    cells = whole.agg(F.sum(size)).first()[0] or 0
    tasks = max(grids.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / GRID_CELLS))
    part = F.pmod(F.xxhash64("pair_id"), F.lit(tasks)).alias("_task")
    carried = ["dt_s", "x0", "y0", "cell_deg"]
    schema = T.StructType([grids.schema["pair_id"], *[T.StructField(n, T.IntegerType()) for n in ("row", "col")],
                           *[T.StructField(n, T.DoubleType()) for n in ("from_a", "to_b")], *[grids.schema[n] for n in carried]])

    def call(frames: pa.Table, shut: pa.Table) -> pa.Table:
        return _search_grids(frames, shut, carried).cast(to_arrow_schema(schema))

    frames = whole.select(part, "pair_id", "rows", "cols", "step_s", *[f"{p}_{v}" for p in "ab" for v in ("row", "col")], *carried)
    # two sides of one origin must not share a column
    found = frames.groupBy("_task").cogroup(walls.select(part, F.col("pair_id").alias("_pair"), "row", "col").groupBy("_task")).applyInArrow(call, schema).withColumn("_first", F.lit(True))
    times = _joined_grids(rest, walls)
    per = times.groupBy("pair_id", "row", "col").agg(
        F.min(F.when(F.col("role") == "A", F.col("cost"))).alias("from_a"), F.min(F.when(F.col("role") == "B", F.col("cost"))).alias("to_b"))
    # pairs that share a number share their cells, each with its own frame
    frame = rest.select("pair_id", *carried, (F.row_number().over(Window.partitionBy("pair_id").orderBy(*carried)) == 1).alias("_first"))
    joined = per.join(frame, F.equal_null(per["pair_id"], frame["pair_id"])).select(per["pair_id"], "row", "col", "from_a", "to_b", *carried, "_first")
    return found.unionByName(joined)


def _search_grids(frames: pa.Table, shut: pa.Table, carried: list[str]) -> pa.Table:
    """``grid_reach`` of some pairs."""
    rows, cols, step, limit, *ends = (frames[c].to_numpy() for c in ("rows", "cols", "step_s", "dt_s", "a_row", "a_col", "b_row", "b_col"))
    ar, ac, br, bc = (e.astype(np.int64) for e in ends)
    sizes = rows.astype(np.int64) * cols
    first, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    pair = np.repeat(np.arange(len(sizes)), sizes)
    closed = np.zeros(total, bool)

    def mark(which: np.ndarray, row: np.ndarray, col: np.ndarray, value: bool) -> None:
        there = (row >= 0) & (row < rows[which]) & (col >= 0) & (col < cols[which])
        which = which[there]
        closed[first[which] + row[there] * cols[which] + col[there]] = value

    if len(shut) and len(frames):
        own = pc.index_in(shut["_pair"], value_set=frames["pair_id"].combine_chunks())
        known = pc.is_valid(own)
        which = own.filter(known).to_numpy()
        mark(which, *(shut[c].filter(known).to_numpy().astype(np.int64) for c in ("row", "col")), True)
    # the corridor, diagonal first
    dr, dc = br - ar, bc - ac
    long = np.maximum(np.abs(dr), np.abs(dc)) + 1
    which = np.repeat(np.arange(len(long)), long)
    k = np.arange(len(which)) - np.repeat(np.cumsum(long) - long, long)
    row = ar[which] + np.sign(dr)[which] * np.minimum(k, np.abs(dr)[which])
    col = ac[which] + np.sign(dc)[which] * np.minimum(k, np.abs(dc)[which])
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            mark(which, row + i, col + j, False)
    best = np.full(2 * total, np.inf)
    start = limit >= 0
    front = np.concatenate([(first + ar * cols + ac)[start], (total + first + br * cols + bc)[start]])
    best[front] = 0.0
    while len(front):
        cell = front % max(total, 1)
        own = pair[cell]
        wide = cols[own].astype(np.int64)
        row, col = np.divmod(cell - first[own], wide)
        keys, costs = [], []
        for i, j, length in MOVES:
            if length:
                cost = best[front] + step[own] * length
                there = np.flatnonzero((row + i >= 0) & (row + i < rows[own]) & (col + j >= 0) & (col + j < wide) & (cost <= limit[own]))
                to = front[there] + i * wide[there] + j
                better = ~closed[to % total] & (cost[there] < best[to])
                keys.append(to[better])
                costs.append(cost[there][better])
        key, cost = np.concatenate(keys), np.concatenate(costs)
        np.minimum.at(best, key, cost)
        front = np.unique(key)
    found = np.flatnonzero(np.isfinite(best[:total]) | np.isfinite(best[total:]))
    own = pair[found]
    row, col = np.divmod(found - first[own], cols[own].astype(np.int64))
    times = [pa.array(v, mask=~np.isfinite(v)) for v in (best[found], best[total + found])]
    index = pa.array(own)
    return pa.table([frames["pair_id"].take(index), pa.array(row), pa.array(col), *times, *[frames[c].take(index) for c in carried]],
                    names=["pair_id", "row", "col", "from_a", "to_b", *carried])


def grid_slices(grids: DataFrame, times: DataFrame, n: int = 15) -> DataFrame:
    """Cells open at each of n-1 instants: both travel times fit. Closed-form slice range per cell.

    ``times``: what ``grid_reach`` gives, or ``grid_times``.
    """
    if "role" in times.columns:
        per = times.groupBy("pair_id", "row", "col").agg(
            F.min(F.when(F.col("role") == "A", F.col("cost"))).alias("from_a"), F.min(F.when(F.col("role") == "B", F.col("cost"))).alias("to_b"))
        both = lookup_join(per.filter("from_a is not null and to_b is not null"), grids.select("pair_id", "dt_s", "x0", "y0", "cell_deg"), ["pair_id"])
    else:
        both = times.filter("pair_id is not null and from_a is not null and to_b is not null").drop("_first")
    first = F.greatest(F.lit(1), F.ceil(F.col("from_a") * n / F.col("dt_s")))
    last = F.least(F.lit(n - 1), F.floor(n - F.col("to_b") * n / F.col("dt_s")))
    return both.withColumns({"_f": first, "_l": last}).filter("_f <= _l").withColumn("slice", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l")


# ---------------------------------------------------------------- road prism views


def prism_sheets(roads: DataFrame, n: int = 12) -> DataFrame:
    """Road edges on each of n time sheets. Edges without travel times go to the sheet nearest their progress."""
    t, eps = F.col("budget_sec"), 1e-6
    timed = F.col("forward_sec").isNotNull() & F.col("backward_sec").isNotNull() & (t > 0)
    first = F.greatest(F.lit(0), F.ceil((F.col("forward_sec") - eps) * (n - 1) / t))
    last = F.least(F.lit(n - 1), F.floor((t - F.col("backward_sec") + eps) * (n - 1) / t))
    single = F.floor(F.coalesce("time_progress", F.lit(0.5)) * (n - 1) + 0.5)
    lo, hi = F.when(timed, first).otherwise(single), F.when(timed, last).otherwise(single)
    return roads.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi") \
        .withColumn("sheet", F.explode(F.sequence("_lo", "_hi"))).withColumn("sheet_progress", F.col("sheet") / (n - 1)).drop("_lo", "_hi")


HULL_PART = 4_096


def sheet_hulls(sheets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Convex outline of the road ends on each sheet (``ring``, counter-clockwise).

    Points are spread over parts of bounded size; each part keeps only its own outline, and the
    parts are merged until one is left. Only outline points survive a pass.
    """
    ship_package(sheets.sparkSession)
    keys = keys or ["pair_id", "sheet"]
    ring = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    schema = T.StructType([*[sheets.schema[k] for k in keys], T.StructField("ring", ring)])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the roads of a pair come one after another, so most of a sheet's ends meet before anything is sent
        for batch in batches:
            yield from _batch_outlines(pa.Table.from_batches([batch]), keys).cast(to_arrow_schema(schema)).to_batches()

    parts_of = stored(sheets.select(*keys, "lon0", "lat0", "lon1", "lat1").mapInArrow(first, schema), "outlines")
    points = parts_of.select(*keys, F.inline("ring"))

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def outline(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: [{"x": x, "y": y} for x, y in _hull(sorted({(p["x"], p["y"]) for p in g}))])

    def outlines(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(F.collect_list(F.struct("x", "y")).alias("_p")).select(*by, outline("_p").alias("ring"))

    current = points
    while True:  # a point may come from several batches, which only counts against HULL_PART
        top = current.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
        if top <= HULL_PART:
            break
        parts = current.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(math.ceil(2 * top / HULL_PART))))
        current = cut_lineage(outlines(parts, [*keys, "_part"]).select(*keys, F.inline("ring")))
        if (current.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) >= top:
            break  # every point lies on the outline: the answer itself is that long
    return outlines(current, keys).filter(F.size("ring") >= 3)


def _batch_outlines(rows: pa.Table, keys: list[str]) -> pa.Table:
    """The outline of the road ends of every key in some rows."""
    whole = rows.drop_columns(["lon0", "lat0", "lon1", "lat1"])
    tags = np.zeros(len(rows), np.int64)
    for k in keys:
        code = pc.rank(whole[k].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        tags = np.unique(tags * (len(rows) + 1) + code, return_inverse=True)[1]
    which, one = np.unique(tags, return_index=True)
    x = np.concatenate([rows[c].to_numpy() for c in ("lon0", "lon1")])
    y = np.concatenate([rows[c].to_numpy() for c in ("lat0", "lat1")])
    tag, order = np.concatenate([tags, tags]), np.lexsort((y, x, np.concatenate([tags, tags])))
    ends = np.searchsorted(tag[order], np.arange(len(which) + 1)).tolist()
    pts = list(zip(x[order].tolist(), y[order].tolist()))
    rings = [_hull(list(dict.fromkeys(pts[a:b]))) for a, b in zip(ends, ends[1:])]
    flat = np.array([p for r in rings for p in r], float).reshape(-1, 2)
    many = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
    return whole.take(pa.array(one)).select(keys).append_column("ring", pa.ListArray.from_arrays(pa.array(many), found))


def _hull(pts: list) -> list:
    """Outline of sorted distinct points; fewer than three come back as they are."""

    def chain(order: list) -> list:
        kept: list = []
        for p in order:
            while len(kept) > 1 and ((kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1])
                                     - (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0])) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return pts if len(pts) < 3 else chain(pts) + chain(pts[::-1])


def time_slice(df: DataFrame, progress: float, mode: str = "progressive", slices: int = 0, column: str = "time_progress") -> DataFrame:
    """Rows visible at an animation position."""
    if progress >= 1:
        return df
    t = F.coalesce(F.col(column), F.lit(0.0))
    if mode == "progressive":
        return df.filter(t <= progress)
    return df.filter(F.abs(t - progress) <= (0.5 / slices if slices > 0 else 0.05))


def prism_at(roads: DataFrame, t: float) -> DataFrame:
    """Road edges inside both cones at normalised time t."""
    def norm(c: str) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / F.col("budget_sec")))
        return F.when(F.col("budget_sec") > 0, share).otherwise(F.lit(0.0))

    return roads.withColumns({"fwd_norm": norm("forward_sec"), "bwd_norm": norm("backward_sec")}) \
        .filter((F.col("fwd_norm") <= t) & (F.col("bwd_norm") <= 1 - t))


def dwell_surface(roads: DataFrame, resolution: Number, lat0: Number, keys: list[str] | None = None) -> DataFrame:
    """Longest possible stay and edge count per hexagon, from samples along the whole of each reachable edge.

    With columns for resolution and latitude each key has its own hexagons; they must agree within a key.
    """
    keys = keys or ["pair_id"]
    placed = roads.withColumns({"_res": resolution if isinstance(resolution, Column) else F.lit(resolution),
                                "_lat0": lat0 if isinstance(lat0, Column) else F.lit(float(lat0))})
    res, ref = (F.col("_res") if isinstance(resolution, Column) else resolution), (F.col("_lat0") if isinstance(lat0, Column) else lat0)
    cos = F.greatest(F.lit(0.1), F.abs(F.cos(F.radians("_lat0"))))
    length = F.hypot((F.col("lon1") - F.col("lon0")) * GRID_M_PER_DEG * cos, (F.col("lat1") - F.col("lat0")) * GRID_M_PER_DEG)
    k = F.greatest(F.lit(2), F.ceil(length / sample_step_m(res)) + 1).cast("int")
    # one value a sample: as many as the leg's length holds
    bins = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: to_hex(
        F.col("lon0") + (F.col("lon1") - F.col("lon0")) * i / (F.col("_k") - 1),
        F.col("lat0") + (F.col("lat1") - F.col("lat0")) * i / (F.col("_k") - 1), res, ref))
    cells = placed.withColumn("_k", k).select(*keys, "activity_sec_max", "_res", "_lat0", F.explode(F.array_distinct(bins)).alias("_h"))
    out = cells.groupBy(*keys, F.col("_h.hex_q").alias("hex_q"), F.col("_h.hex_r").alias("hex_r")).agg(
        (F.max("activity_sec_max") / 60).alias("dwell_minutes"), F.count(F.lit(1)).alias("edge_count"),
        F.first("_res").alias("_res"), F.first("_lat0").alias("_lat0"))
    return out.withColumn("ring", hex_ring(F.col("hex_q"), F.col("hex_r"), res, ref)).drop("_res", "_lat0")
