"""Road graph as tables: edges, snapping, bounded shortest times, road prisms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.geo import project_on_segment, with_lonlat, with_utm
from chronoweave.functions import spans
from chronoweave.functions.intervals import entries, with_feasible_spans
from chronoweave.functions.roads import (
    MINOR, ModeProfile, clamp_factor, class_speed_table, edge_kmh, maxspeed_kmh)
from chronoweave.operators import tiles
from chronoweave.operators.sequence import Timeline
from chronoweave.operators.skew import broadcast_if_small, dealt, fits_broadcast, lookup_join
from chronoweave.session import cut_lineage, ship_package

NODE_M = 0.01  # end points within a centimetre are one node
HOPS = 6  # expansions between two writes of the labels


def routable(roads: DataFrame, profile: ModeProfile) -> DataFrame:
    """Drop road classes the mode may not use; unclassified roads stay."""
    if not profile.excluded:
        return roads
    barred = roads.sparkSession.createDataFrame([(h,) for h in profile.excluded], "highway string")
    return roads.join(F.broadcast(barred), "highway", "left_anti")  # a dozen fixed rows


def node_id(x: Column, y: Column) -> Column:
    """Centimetre coordinates packed into one number: collision-free, no global counter."""
    return F.rint(x / NODE_M).cast("long") * F.lit(1 << 31) + F.rint(y / NODE_M).cast("long")


def build_edges(roads: DataFrame, profile: ModeProfile, zone: int, south: bool = False) -> DataFrame:
    """Cut roads into one edge per vertex pair with length and travel time."""
    tagged = routable(dealt(roads).withColumn("highway", F.nullif(F.trim("highway"), F.lit(""))), profile)
    speeds = F.broadcast(class_speed_table(roads.sparkSession, profile))
    kmh = edge_kmh(maxspeed_kmh(F.col("maxspeed")), F.col("class_kmh"), profile)
    pairs = F.zip_with(F.slice("coords", F.lit(1), F.size("coords") - 1), F.slice("coords", F.lit(2), F.size("coords")),
                       lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    legs = (tagged.filter(F.size("coords") >= 2).join(speeds, "highway", "left")
            .select("source_id", "highway", F.coalesce("class_kmh", F.lit(profile.default_kmh)).alias("class_kmh"),
                    (kmh / 3.6).alias("_mps"), F.posexplode(pairs).alias("_leg", "_e")))
    metric = legs.select(
        (F.shiftleft("source_id", 20) + F.col("_leg")).alias("edge_id"), "source_id", "highway", "class_kmh", "_mps",
        F.col("_e.p.x").alias("px"), F.col("_e.p.y").alias("py"), F.col("_e.q.x").alias("qx"), F.col("_e.q.y").alias("qy"))
    out = with_utm(metric, [("px", "py", "x0", "y0"), ("qx", "qy", "x1", "y1")], zone, south).drop("px", "py", "qx", "qy")
    out = out.withColumns({"u": node_id(F.col("x0"), F.col("y0")), "v": node_id(F.col("x1"), F.col("y1")),
                           "length_m": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))})
    return out.filter((F.col("length_m") >= NODE_M) & (F.col("u") != F.col("v"))) \
        .withColumn("cost_sec", F.col("length_m") / F.col("_mps")).drop("_mps")


def road_stats(roads: DataFrame, edges: DataFrame, profile: ModeProfile) -> DataFrame:
    """Excluded features and produced segments, in one row."""
    barred = F.col("highway").isin(*profile.excluded) if profile.excluded else F.lit(False)
    excluded = roads.select(F.coalesce(barred, F.lit(False)).cast("int").alias("excluded"), F.lit(0).alias("segments"))
    made = edges.select(F.lit(0).alias("excluded"), F.lit(1).alias("segments"))
    return excluded.unionByName(made).agg(
        F.sum("excluded").alias("excluded_features"), F.sum("segments").alias("segments"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; parallel edges keep the quicker one."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "cost_sec").unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "cost_sec"))
    return both.groupBy("node", "nbr").agg(F.min("cost_sec").alias("step"))


def incidence(edges: DataFrame) -> DataFrame:
    """One row per edge end."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(True).alias("at_u")),
                   F.struct(F.col("v").alias("node"), F.lit(False).alias("at_u")))
    return edges.select("edge_id", F.inline(ends))


# ---------------------------------------------------------------- snapping


def snap(points: DataFrame, edges: DataFrame, max_snap_m: float, point_id: str = "origin_id",
         hot_rows: int | None = None) -> DataFrame:
    """Nearest edge of each point (``x, y`` metres) within the limit; points without one are dropped.

    Points and the edges within the limit around them meet in wide cells, each in one task, where a fine grid finds the
    edges near a point. A cell with many points, or many edges, is dealt to several tasks. Equal distances go to the lowest edge number.
    """
    ship_package(points.sparkSession)
    cell = max(SNAP_CELLS * max_snap_m, 1000.0)
    shape, where = ["edge_id", "u", "v", "cost_sec", "class_kmh"], ["_cx", "_cy", "_part", "_slice"]
    placed = points.filter("x is not null and y is not null").select(
        F.col(point_id).alias("_id"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    cells = _reach_cells(edges.select(*shape, "x0", "y0", "x1", "y1"), max_snap_m, cell)
    used = broadcast_if_small(cut_lineage(placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))))
    counted = cells.join(used, ["_cx", "_cy"]).groupBy("_cx", "_cy", "_n").agg(F.count(F.lit(1)).alias("_edges"))
    known = broadcast_if_small(cut_lineage(counted.select(
        "_cx", "_cy", F.ceil(F.col("_n") / float(SNAP_POINTS)).cast("int").alias("_parts"), F.ceil(F.col("_edges") / float(SNAP_EDGES)).cast("int").alias("_slices"))))
    left = placed.join(known, ["_cx", "_cy"]).withColumn("_part", F.pmod(F.xxhash64("_id", "_x", "_y"), F.col("_parts")).cast("int")) \
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_parts", "_slices")
    right = cells.join(known, ["_cx", "_cy"]).withColumn("_slice", F.pmod(F.xxhash64("edge_id"), F.col("_slices")).cast("int")) \
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_slices")
    schema = T.StructType([points.schema[point_id], *[T.StructField(c, edges.schema[c].dataType) for c in shape],
                           T.StructField("fraction", T.DoubleType()), T.StructField("snap_m", T.DoubleType())])

    def nearest(own: pa.Table, near: pa.Table) -> pa.Table:
        point, edge, fraction, away = _nearest_edges(*(own[c].to_numpy() for c in ("_x", "_y")), near["edge_id"].to_numpy(),
                                                     *(near[c].to_numpy() for c in ("x0", "y0", "x1", "y1")), max_snap_m)
        columns = [own["_id"].take(pa.array(point)), *[near[c].take(pa.array(edge)) for c in shape], pa.array(fraction), pa.array(away)]
        return pa.table(columns, names=schema.names)

    found = left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(nearest, schema)
    best = found.groupBy(point_id).agg(F.min_by(F.struct(*shape, "fraction", "snap_m"), F.struct("snap_m", "edge_id")).alias("_best"))
    return points.join(cut_lineage(best.select(point_id, "_best.*")), point_id)


#: A cell in which points meet edges is so many limits wide; points and edges of a cell that one task takes.
SNAP_CELLS, SNAP_POINTS, SNAP_EDGES = 20, 100_000, 200_000
SNAP_MET = 1_000_000  # points times edges measured together


def _nearest_edges(px: np.ndarray, py: np.ndarray, ids: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray,
                   reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Point, edge, fraction of the edge and distance for every point with an edge within reach."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    good = np.flatnonzero(np.isfinite(px) & np.isfinite(py))
    if not len(good) or not len(ids):
        return none
    cell = max(reach, 10.0)
    cx, cy = np.floor(px[good] / cell).astype(np.int64), np.floor(py[good] / cell).astype(np.int64)

    def covered(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.maximum(np.floor(low / cell), at.min()).astype(np.int64)
        many = np.maximum(np.minimum(np.floor(high / cell), at.max()).astype(np.int64) - low + 1, 0)
        return np.repeat(np.arange(len(low)), many), np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())

    # cells that hold a place within reach of an edge, column by column along its slope
    lo_x, hi_x = np.minimum(x0, x1), np.maximum(x0, x1)
    edge, col = covered(lo_x - reach, hi_x + reach, cx)
    near, far = (np.maximum(lo_x[edge], np.minimum(hi_x[edge], v)) for v in (col * cell - reach, (col + 1) * cell + reach))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (y1 - y0) / (x1 - x0)
        steep = np.abs(x1 - x0)[edge] < 1e-9
        ya, yb = (np.where(steep, other[edge], y0[edge] + slope[edge] * (v - x0[edge])) for v, other in ((near, y0), (far, y1)))
    which, row = covered(np.minimum(ya, yb) - reach, np.maximum(ya, yb) + reach, cy)
    edge, high = edge[which], int(cy.max() - cy.min()) + 1
    key = (col[which] - cx.min()) * high + row - cy.min()
    order = np.argsort(key, kind="stable")
    key, edge = key[order], edge[order]
    at = (cx - cx.min()) * high + cy - cy.min()
    first = np.searchsorted(key, at)
    many = np.searchsorted(key, at, side="right") - first
    total, out = np.cumsum(many), [none]
    low = 0
    while low < len(good):
        end = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + SNAP_MET, side="right")))
        some = many[low:end]
        point = np.repeat(good[low:end], some)
        met = edge[np.repeat(first[low:end] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
        ax, ay, vx, vy = x0[met], y0[met], x1[met] - x0[met], y1[met] - y0[met]
        len2 = vx * vx + vy * vy
        with np.errstate(divide="ignore", invalid="ignore"):
            raw = ((px[point] - ax) * vx + (py[point] - ay) * vy) / len2
        f = np.where(len2 <= 0, 0.0, np.minimum(1.0, np.maximum(0.0, raw)))
        away = np.hypot(px[point] - (ax + f * vx), py[point] - (ay + f * vy))
        close = np.flatnonzero(away <= reach)
        close = close[np.lexsort((ids[met[close]], away[close], point[close]))]
        close = close[np.append(True, point[close][1:] != point[close][:-1])[:len(close)]]
        out.append((point[close], met[close], f[close], away[close]))
        low = end
    return tuple(np.concatenate(c) for c in zip(*out))


def _reach_cells(edges: DataFrame, reach: float, cell: float) -> DataFrame:
    """Add ``_cx, _cy``: cells holding any point within reach of the edge, following its slope."""
    lo_x, hi_x = F.least("x0", "x1"), F.greatest("x0", "x1")
    cols = edges.withColumn("_cx", F.explode(F.sequence(F.floor((lo_x - reach) / cell), F.floor((hi_x + reach) / cell))))
    left = F.greatest(lo_x, F.least(hi_x, F.col("_cx") * cell - reach))
    right = F.greatest(lo_x, F.least(hi_x, (F.col("_cx") + 1) * cell + reach))
    steep = F.abs(F.col("x1") - F.col("x0")) < 1e-9
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))

    def y_at(x: Column, other: str) -> Column:
        return F.when(steep, F.col(other)).otherwise(F.col("y0") + slope * (x - F.col("x0")))

    ya, yb = y_at(left, "y0"), y_at(right, "y1")
    rows = F.sequence(F.floor((F.least(ya, yb) - reach) / cell), F.floor((F.greatest(ya, yb) + reach) / cell))
    return cols.withColumn("_cy", F.explode(rows))


def seeds_of(snapped: DataFrame, key: str = "origin_id") -> DataFrame:
    """Both ends of the snapped edge with the time to get there."""
    ends = F.array(
        F.struct(F.col("u").alias("node"), (F.col("fraction") * F.col("cost_sec")).alias("seed")),
        F.struct(F.col("v").alias("node"), ((1 - F.col("fraction")) * F.col("cost_sec")).alias("seed")))
    return snapped.select(key, "cutoff", F.inline(ends))


# ---------------------------------------------------------------- bounded shortest times


def relax(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """Least cost per ``key`` from all seeds, up to each row's ``cutoff``.

    ``seeds`` holds ``key + cost, cutoff``. ``expand`` takes rows with a ``fresh`` flag and returns
    every row itself (``own`` true) plus the next ones of the fresh rows, so several expansions form
    one straight plan in which only rows that just improved are expanded. Every few expansions the
    labels are merged and written, which bounds both the plan and the work lost with an executor.
    The number of rounds depends on the cutoff, not on the data size.
    """
    labels = cut_lineage(seeds.groupBy(*key).agg(F.min("cost").alias("cost"), F.max("cutoff").alias("cutoff"))
                         .filter("cost <= cutoff").withColumn("fresh", F.lit(True)))
    while not labels.filter("fresh").isEmpty():
        wave = labels.filter("fresh")
        for _ in range(HOPS):
            wave = expand(wave).filter("cost <= cutoff").groupBy(*key).agg(
                F.min("cost").alias("cost"), F.max("cutoff").alias("cutoff"), F.min(F.when(F.col("own"), F.col("cost"))).alias("_was"))
            wave = wave.withColumn("fresh", F.col("_was").isNull() | (F.col("cost") < F.col("_was"))).drop("_was")
        old = labels.select(*key, "cost", "cutoff", F.col("cost").alias("_old"), F.lit(False).alias("_hot"))
        merged = old.unionByName(wave.withColumn("_old", F.lit(None).cast("double")).withColumnRenamed("fresh", "_hot"))
        better = F.col("_hot") & (F.col("_old").isNull() | (F.col("cost") < F.col("_old")))
        labels = cut_lineage(
            merged.groupBy(*key).agg(F.min("cost").alias("cost"), F.max("cutoff").alias("cutoff"), F.min("_old").alias("_old"),
                                     F.max("_hot").alias("_hot")).withColumn("fresh", better).drop("_old", "_hot"))
    return labels.drop("fresh", "cutoff")


def contract(steps: DataFrame, keep: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Take the nodes out of a graph that only pass a way on, and say where they lie.

    ``steps``: both directions of every edge (``node, nbr, step``). A node stays if it has another number of neighbours than two, or is in
    ``keep`` (``node``). Returns the steps between nodes that stay, each over a whole chain, and for the nodes taken out ``node, end,
    dist``: the nodes that stay at both ends of their chain. Ways along a chain are doubled every round, so a chain of n nodes
    takes log2(n) rounds. A ring with no node that stays is reached from nowhere and left out.
    """
    degree = steps.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    inner = degree.filter("_n = 2").select("node").join(keep.select("node").distinct(), "node", "left_anti")
    inner = cut_lineage(inner.withColumn("_inner", F.lit(True)))
    if inner.isEmpty():
        return steps, steps.select("node", F.col("nbr").alias("end"), F.col("step").alias("dist")).limit(0)
    flagged = lookup_join(steps, inner.toDF("nbr", "_pass"), ["nbr"], "left", hot_rows=hot_rows).join(inner, "node", "left")
    flagged = cut_lineage(flagged.select("node", "nbr", "step", F.coalesce("_pass", F.lit(False)).alias("open"), F.coalesce("_inner", F.lit(False)).alias("inner")))
    # the step that follows node -> nbr, when nbr passes on: from nbr to its other neighbour
    follow = flagged.filter("inner").select(F.col("node").alias("at"), F.col("nbr").alias("to"))
    ways = flagged.select("node", "nbr", F.col("nbr").alias("at"), F.col("node").alias("came"), F.col("step").alias("dist"), "open", "inner")
    ways = ways.join(follow, "at", "left").filter("not open or to <> came or to is null")
    ways = cut_lineage(ways.select("node", "nbr", "at", "to", "dist", "open", "inner"))
    longest = max(1, inner.count())
    for _ in range(longest.bit_length() + 1):
        moving = ways.filter("open")
        if moving.isEmpty():
            break
        # a way that stands before the step at -> to goes on as far as the way that begins with that step has got
        ahead = ways.filter("inner").select(F.col("node").alias("at"), F.col("nbr").alias("to"), F.col("at").alias("_at"), F.col("to").alias("_to"),
                                            F.col("dist").alias("_more"), F.col("open").alias("_open"))
        gone = moving.join(ahead, ["at", "to"]).select("node", "nbr", F.col("_at").alias("at"), F.col("_to").alias("to"), (F.col("dist") + F.col("_more")).alias("dist"),
                                                       F.col("_open").alias("open"), "inner")
        ways = cut_lineage(ways.filter("not open").unionByName(gone))
    done = ways.filter("not open")
    short = done.filter("not inner and node <> at").groupBy("node", F.col("at").alias("nbr")).agg(F.min("dist").alias("step"))
    return cut_lineage(short), cut_lineage(done.filter("inner").groupBy("node", F.col("at").alias("end")).agg(F.min("dist").alias("dist")))


def shortest_times(sources: DataFrame, edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """``source, node, cost`` for every node within ``cutoff`` of each source node.

    The search goes from junction to junction; the nodes of the ways between them get their times from both ends afterwards.
    """
    steps = adjacency(edges)
    short, inside = contract(cut_lineage(steps), sources.select(F.col("source").alias("node")), hot_rows)
    stay = short.select("node").union(sources.select("source")).distinct().select("node", F.col("node").alias("nbr"), F.lit(0.0).alias("step"))
    adj = cut_lineage(short.unionByName(stay).withColumnRenamed("node", "_from"))
    table = F.broadcast(adj) if fits_broadcast(adj) else adj

    def expand(wave: DataFrame) -> DataFrame:
        # rows that did not improve get keys no node has, each its own, so they spread evenly and meet nothing
        idle = -F.abs(F.xxhash64("source", "node") % (1 << 62)) - 1
        placed = wave.withColumn("_from", F.when(F.col("fresh"), F.col("node")).otherwise(idle))
        return placed.join(table, "_from", "left").select(
            "source", F.coalesce("nbr", "node").alias("node"), (F.col("cost") + F.coalesce("step", F.lit(0.0))).alias("cost"), "cutoff",
            (F.coalesce("nbr", "node") == F.col("node")).alias("own"))

    start = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), "cutoff")
    found = relax(start, expand, ["source", "node"])
    if inside.isEmpty():
        return found
    reached = lookup_join(found.join(sources, "source").withColumnRenamed("node", "end"), inside, ["end"], hot_rows=hot_rows)
    between = reached.withColumn("cost", F.col("cost") + F.col("dist")).filter("cost <= cutoff").groupBy("source", "node").agg(F.min("cost").alias("cost"))
    return found.unionByName(between)


def origin_times(snapped: DataFrame, edges: DataFrame, key: str = "origin_id", hot_rows: int | None = None) -> DataFrame:
    """``key, node, cost`` within each origin's ``cutoff``.

    The search runs once per distinct start node of a tile, however many origins share it, and each
    origin combines the two searches of its snapped edge.
    """
    near, far = _single(snapped, key)
    taken, roads, left = tiles.deal(*_searches(near, edges, [key]))
    found = tiles.node_times(taken, roads, [key])
    left = left.select(key, "cutoff", "u", "v", "fraction", "cost_sec")
    rest = left if far is None else left.unionByName(far.select(*left.columns))
    return found if rest.isEmpty() else found.unionByName(joined_times(rest, edges, key, hot_rows))


def _single(snapped: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Origins whose key is theirs alone, and the others, if any."""
    shared = snapped.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    if shared.isEmpty():
        return snapped, None
    return snapped.join(shared, key, "left_anti"), snapped.join(shared, key, "left_semi")


def _searches(snapped: DataFrame, edges: DataFrame, keep: list[str], more: list[str] | None = None) -> tuple:
    """What ``tiles.deal`` takes for searches from both ends of a snapped edge."""
    own = snapped.select(*keep, "edge_id", "cutoff", "u", "v", "fraction", "cost_sec", (F.col("fraction") * F.col("cost_sec")).alias("seed_u"),
                         ((1 - F.col("fraction")) * F.col("cost_sec")).alias("seed_v"))
    # measured from one end of the edge, which lies that long behind the start
    reach = F.greatest(F.lit(0.0), F.col("cutoff") + F.col("seed_u")) * F.lit(tiles.top_speed(edges))
    return own, edges, "u", reach, more


def joined_times(snapped: DataFrame, edges: DataFrame, key: str = "origin_id", hot_rows: int | None = None) -> DataFrame:
    """``key, node, cost`` by joins, hop by hop, whatever the size of the graph that the origins reach.

    The search runs once per distinct start node.
    """
    seeds = cut_lineage(seeds_of(snapped, key))
    sources = seeds.groupBy(F.col("node").alias("source")).agg(F.max(F.col("cutoff") - F.col("seed")).alias("cutoff")) \
        .filter("cutoff >= 0")
    times = shortest_times(sources, edges, hot_rows)
    # seeds side may hold one popular node many times; the searches of a node are one bounded list of rows
    joined = lookup_join(seeds.withColumnRenamed("node", "source"), times, ["source"], hot_rows=hot_rows)
    total = F.col("seed") + F.col("cost")
    return joined.filter(total <= F.col("cutoff")).groupBy(key, "node").agg(F.min(total).alias("cost"))


# ---------------------------------------------------------------- one origin, one cone


def origin_ppa(origins: DataFrame, edges: DataFrame, zone: int, south: bool = False, max_snap_m: float = 200.0,
               hot_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Reachable road pieces of each origin, and the snapped origins.

    ``origins``: ``origin_id, x, y, budget_sec, min_activity_sec``. The radius is half of what
    is left after the activity; a piece is kept when the activity fits everywhere on it.
    """
    usable = origins.filter("budget_sec > min_activity_sec").withColumn(
        "cutoff", (F.col("budget_sec") - F.col("min_activity_sec")) / 2)
    snapped = cut_lineage(snap(usable, edges, max_snap_m, hot_rows=hot_rows))
    carried, shape = ["cutoff", "budget_sec", "min_activity_sec"], ["highway", "cost_sec", "length_m", "x0", "y0", "x1", "y1"]
    near, far = _single(snapped, "origin_id")
    taken, roads, left = tiles.deal(*_searches(near, edges, ["origin_id", *carried[1:]], shape))
    pieces = tiles.pieces(taken.drop("cost_sec"), roads, ["origin_id", *carried], shape)
    left = left.select("origin_id", *carried, "edge_id", "u", "v", "fraction", "cost_sec")
    rest = left if far is None else left.unionByName(far.select(*left.columns))
    if not rest.isEmpty():
        pieces = pieces.unionByName(_cut(_joined_edges(rest, edges, shape, carried, hot_rows), ["origin_id", *carried, *shape]))
    budget = F.col("budget_sec")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    out = pieces.select(
        "origin_id", "edge_id", "highway", "a", "b", "length_m",
        F.col("travel_min").alias("travel_sec_min"), F.col("travel_mid").alias("travel_sec_mid"),
        F.col("travel_max").alias("travel_sec_max"),
        (budget - 2 * F.col("travel_max")).alias("activity_sec_min"),
        (budget - 2 * F.col("travel_mid")).alias("activity_sec_mid"),
        (budget - 2 * F.col("travel_min")).alias("activity_sec_max"),
        "cutoff", "budget_sec", "min_activity_sec",
        *[(F.col(f"{k}0") + F.col(s) * d).alias(f"_{k}{s}") for s in "ab" for k, d in (("x", dx), ("y", dy))])
    kept = out.filter(F.col("activity_sec_min") + 1e-6 >= F.col("min_activity_sec"))
    return with_lonlat(kept, [("_xa", "_ya", "lon0", "lat0"), ("_xb", "_yb", "lon1", "lat1")], zone, south) \
        .drop("_xa", "_ya", "_xb", "_yb"), snapped


def _cut(full: DataFrame, keep: list[str]) -> DataFrame:
    """The reachable parts of edges (``du, dv, fraction, cost_sec, cutoff``): the columns ``keep`` and ``tiles.PIECE``."""
    schema = T.StructType([full.schema[c] for c in keep] + T._parse_datatype_string(tiles.PIECE).fields)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, *found = spans.reached(*(batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("du", "dv", "fraction", "cost_sec", "cutoff")))
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch[c].take(pick) for c in [*keep, "edge_id"]], *[pa.array(c) for c in found]], names=schema.names)

    return full.mapInArrow(call, schema)


def _joined_edges(snapped: DataFrame, edges: DataFrame, shape: list[str], carried: list[str], hot_rows: int | None) -> DataFrame:
    """Edges that origins reach, by joins: ``origin_id, edge_id, du, dv, fraction`` with the columns of the edge and of the origin."""
    labels = joined_times(snapped, edges, hot_rows=hot_rows)
    ends = lookup_join(labels, incidence(edges), ["node"], hot_rows=hot_rows)
    touched = ends.select("origin_id", "edge_id", F.when(F.col("at_u"), F.col("cost")).alias("du"),
                          F.when(~F.col("at_u"), F.col("cost")).alias("dv"), F.lit(None).cast("double").alias("fraction"))
    own = snapped.select("origin_id", "edge_id", F.lit(None).cast("double").alias("du"),
                         F.lit(None).cast("double").alias("dv"), "fraction")
    per_edge = touched.unionByName(own).groupBy("origin_id", "edge_id").agg(
        F.min("du").alias("du"), F.min("dv").alias("dv"), F.max("fraction").alias("fraction"))
    # the edge each endpoint belongs to carries the geometry; popular edges are spread
    full = lookup_join(per_edge, edges.select("edge_id", *shape), ["edge_id"], hot_rows=hot_rows)
    return full.join(snapped.select("origin_id", *carried), "origin_id")


def origin_summary(origins: DataFrame, pieces: DataFrame, snapped: DataFrame, top_n: int = 0) -> DataFrame:
    """One row per origin, reachable or not."""
    stats = pieces.groupBy("origin_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.col("length_m") * F.greatest(F.lit(0.0), F.col("b") - F.col("a"))).alias("length_m"),
        F.avg("activity_sec_mid").alias("mean_dwell"))
    n = F.coalesce("segments", F.lit(0))
    return (origins.join(snapped.select("origin_id", "snap_m"), "origin_id", "left").join(stats, "origin_id", "left")
            .select("origin_id", "budget_sec", "min_activity_sec",
                    F.greatest(F.lit(0.0), (F.col("budget_sec") - F.col("min_activity_sec")) / 2).alias("cutoff_sec"),
                    n.alias("reachable_segments"),
                    (F.least(n, F.lit(top_n)) if top_n > 0 else n).alias("rendered_segments"),
                    F.coalesce("length_m", F.lit(0.0)).alias("reachable_length_m"),
                    F.coalesce("mean_dwell", "min_activity_sec").alias("dwell_sec_mean"),
                    F.col("snap_m").alias("snap_distance_m"), F.col("snap_m").isNotNull().alias("reachable")))


def top_segments(pieces: DataFrame, n: int = 300) -> DataFrame:
    """The n pieces of each origin with most activity time; 0 keeps all. Spark limits each task first."""
    if n <= 0:
        return pieces
    w = Window.partitionBy("origin_id").orderBy(F.desc("activity_sec_min"), "edge_id", "a")
    return pieces.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ---------------------------------------------------------------- two anchors, two cones


def network_prism(pairs: DataFrame, edges: DataFrame, zone: int, south: bool = False, max_snap_m: float = 50.0,
                  exact: bool = False, hot_rows: int | None = None) -> dict:
    """Road prism of many anchor pairs: ``roads`` and ``status`` (one row per pair).

    ``pairs``: ``pair_id, a_lon, a_lat, b_lon, b_lat, budget_sec, min_activity_sec`` and optionally
    ``speed_factor`` and ``z_start, z_end``. An edge belongs to the prism when its better end can
    be visited on the way from A to B with the activity done in time. ``exact`` adds the feasible
    spans of each edge, snap points included.
    """
    factor = F.col("speed_factor") if "speed_factor" in pairs.columns else F.lit(1.0)
    z0 = F.col("z_start") if "z_start" in pairs.columns else F.lit(0.0)
    z1 = F.col("z_end") if "z_end" in pairs.columns else F.lit(1.0)
    jobs = pairs.select("pair_id", "a_lon", "a_lat", "b_lon", "b_lat", "budget_sec", "min_activity_sec",
                        factor.alias("speed_factor"), z0.alias("z_start"), z1.alias("z_end")) \
        .withColumn("travel_k", F.col("budget_sec") - F.col("min_activity_sec"))
    roles = F.array(F.struct(F.lit("A").alias("role"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")),
                    F.struct(F.lit("B").alias("role"), F.col("b_lon").alias("lon"), F.col("b_lat").alias("lat")))
    ends = jobs.filter("travel_k > 0").select(
        "pair_id", (F.col("travel_k") * F.col("speed_factor")).alias("cutoff"), F.inline(roles))
    ends = with_utm(ends.withColumn("origin_id", F.struct("pair_id", "role")), [("lon", "lat", "x", "y")], zone, south)
    snapped = cut_lineage(snap(ends, edges, max_snap_m, hot_rows=hot_rows))
    end = F.struct("edge_id", "u", "v", "cost_sec", "cutoff", "fraction")
    ends = snapped.groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("role") == r, end)).alias(r) for r in "AB"]).filter("_n = 2")
    ends = cut_lineage(ends.filter("pair_id is not null").drop("_n"))
    both = ends.select("pair_id")
    snapped = snapped.join(both, "pair_id", "left_semi")

    shape = ["highway", "cost_sec", "length_m", "x0", "y0", "x1", "y1"]
    taken, near, left = _tile_pairs(ends.filter("A is not null and B is not null"), edges, shape)
    direct, labels = tiles.pair_times(taken, near.select(*tiles.TILE, "edge_id", "u", "v", "cost_sec"), ["pair_id"]), None
    if not left.isEmpty():
        apart = snapped.join(left.select("pair_id"), "pair_id", "left_semi")
        labels = cut_lineage(joined_times(apart, edges, hot_rows=hot_rows).select("origin_id.pair_id", "origin_id.role", "node", "cost"))
        seeds_b = seeds_of(apart.filter("role = 'B'")).select("origin_id.pair_id", "node", "seed")
        direct = direct.unionByName(labels.filter("role = 'A'").join(seeds_b, ["pair_id", "node"])
                                    .groupBy("pair_id").agg(F.min(F.col("cost") + F.col("seed")).alias("shortest")))
    status = (jobs.join(both.withColumn("snapped", F.lit(True)), "pair_id", "left").join(direct, "pair_id", "left")
              .select("pair_id", "budget_sec", "min_activity_sec", "travel_k", "speed_factor", "z_start", "z_end",
                      F.coalesce("snapped", F.lit(False)).alias("snapped"),
                      (F.col("shortest") / F.col("speed_factor")).alias("shortest_path_sec")))
    status = cut_lineage(status.withColumn(
        "feasible", F.coalesce(F.col("shortest_path_sec") <= F.col("travel_k") + 1e-6, F.lit(False))))
    live = status.filter("feasible")

    # only pairs that can make the trip go on to their edges
    own = live.drop("snapped", "feasible")
    if exact:
        mark = snapped.groupBy("pair_id").pivot("role", ["A", "B"]).agg(
            F.first("edge_id").alias("edge"), F.first("fraction").alias("fraction"))
        own = own.join(mark, "pair_id")
    full = tiles.prism_times(taken.join(own, "pair_id"), near, own.columns, shape)
    if labels is not None:
        per_edge = _joined_prisms(labels, apart, live, edges, exact, hot_rows)
        rest = lookup_join(per_edge, edges.select("edge_id", *shape), ["edge_id"], hot_rows=hot_rows)
        full = full.unionByName(lookup_join(rest, own, ["pair_id"], hot_rows=hot_rows))
    scale = F.lit(1.0) / F.col("speed_factor")
    full = full.withColumns({c: F.col(c) * scale for c in ("cost_sec", "ua", "va", "ub", "vb")})
    if exact:
        ways = {r: entries(F.col(f"u{r.lower()}"), F.col(f"v{r.lower()}"), F.col(f"{r}_edge") == F.col("edge_id"), F.col(f"{r}_fraction"))
                for r in "AB"}
        full = with_feasible_spans(full, ways["A"], ways["B"], F.col("cost_sec"), F.col("travel_k")).drop("A_edge", "A_fraction", "B_edge", "B_fraction")
    roads = _two_cone(full, zone, south)
    return {"roads": roads, "status": status}


def _tile_pairs(ends: DataFrame, edges: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs with a snapped edge ``A`` and ``B`` by tiles: what ``tiles.deal`` gives."""
    speed = F.lit(tiles.top_speed(edges))
    columns = {}
    for r in "AB":
        p, f, cost = r.lower(), F.col(f"{r}.fraction"), F.col(f"{r}.cost_sec")
        columns |= {f"{p}_own": F.col(f"{r}.edge_id"), f"{p}_u": F.col(f"{r}.u"), f"{p}_v": F.col(f"{r}.v"), f"{p}_seed_u": f * cost, f"{p}_seed_v": (1 - f) * cost}
    rows = ends.select("pair_id", F.col("A.cutoff").alias("cutoff"), F.col("B.cost_sec").alias("_last"), *[c.alias(n) for n, c in columns.items()])
    gap = tiles.apart(F.col("a_u"), F.col("b_u"))
    # where not even the straight way is quick enough there is nothing to search
    rows = rows.filter(~(gap > (F.col("cutoff") + F.col("a_seed_u") + F.col("_last")) * speed * 1.0001 + 1.0)).drop("_last")
    reach = F.greatest(F.col("cutoff") + F.col("a_seed_u"), gap / F.nullif(speed, F.lit(0.0)) + F.col("cutoff") + F.col("b_seed_u")) * speed
    return tiles.deal(rows, edges, "a_u", reach, more)


def _joined_prisms(labels: DataFrame, snapped: DataFrame, live: DataFrame, edges: DataFrame, exact: bool, hot_rows: int | None) -> DataFrame:
    """``pair_id, edge_id, ua, va, ub, vb`` of the edges at labelled nodes, by joins."""
    kept = labels.join(live.select("pair_id"), "pair_id", "left_semi")
    at_ends = lookup_join(kept, incidence(edges), ["node"], hot_rows=hot_rows)

    def label(role: str, at_u: bool) -> Column:
        side = F.col("at_u") if at_u else ~F.col("at_u")
        return F.min(F.when((F.col("role") == role) & side, F.col("cost")))

    measured = at_ends.select("pair_id", "edge_id", "role", "cost", "at_u")
    if exact:
        own = snapped.join(live.select("pair_id"), "pair_id", "left_semi")
        measured = measured.unionByName(own.select(
            "pair_id", "edge_id", "role", F.lit(None).cast("double").alias("cost"),
            F.lit(True).alias("at_u")))
    return measured.groupBy("pair_id", "edge_id").agg(
        label("A", True).alias("ua"), label("A", False).alias("va"), label("B", True).alias("ub"), label("B", False).alias("vb"))


UNREACHED = 1.0e15  # fixed value: stands for an end no search reached


def _two_cone(full: DataFrame, zone: int, south: bool) -> DataFrame:
    ua, va, ub, vb = (F.coalesce(c, F.lit(UNREACHED)) for c in ("ua", "va", "ub", "vb"))
    c, t = F.col("cost_sec"), F.col("budget_sec")

    def both(s: float) -> Column:
        return F.least(ua + c * s, va + c * (1 - s)) + F.least(ub + c * s, vb + c * (1 - s))

    low, mid = F.least(both(0.0), both(1.0)), both(0.5)
    high = F.greatest(both(0.0), both(1.0), mid, both(0.25), both(0.75))
    keep = F.col("_low") <= F.col("travel_k") + 1e-6
    if "spans" in full.columns:
        keep = keep | (F.size("spans") > 0)
    fwd, bwd = F.least(ua, va), F.least(ub, vb)
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (fwd - bwd) / (2 * t) + 0.5))
    out = full.withColumns({"_low": low}).filter(keep).select(
        "pair_id", "edge_id", "highway", "length_m", "x0", "y0", "x1", "y1",
        fwd.alias("forward_sec"), bwd.alias("backward_sec"), F.col("_low").alias("travel_total_min"),
        F.greatest(F.lit(0.0), t - high).alias("activity_sec_min"), (t - mid).alias("activity_sec_mid"),
        (t - F.col("_low")).alias("activity_sec_max"), progress.alias("time_progress"),
        (F.col("z_start") + progress * (F.col("z_end") - F.col("z_start"))).alias("z"),
        "budget_sec", "min_activity_sec", "shortest_path_sec",
        *(["spans"] if "spans" in full.columns else []))
    return with_lonlat(out, [("x0", "y0", "lon0", "lat0"), ("x1", "y1", "lon1", "lat1")], zone, south).drop("x0", "y0", "x1", "y1")


def drop_minor(roads: DataFrame, mode: str, group: str = "pair_id") -> DataFrame:
    """Leave out minor roads, unless a pair would lose everything."""
    minor = F.coalesce(F.col("highway").isin(*MINOR.get(mode, MINOR["driving"])), F.lit(False))
    majors = roads.groupBy(group).agg(F.max((~minor).cast("int")).alias("_major"))
    # only minor roads have to meet their pair
    lone = lookup_join(roads.filter(minor), majors.filter("_major = 0"), [group]).drop("_major")
    return roads.filter(~minor & F.col(group).isNotNull()).unionByName(lone)


def uniform_subsample(df: DataFrame, keys: list[str], order: str, tie: str, n: int, hot_rows: int | None = None) -> DataFrame:
    """At most n evenly spaced rows per key: positions ``trunc(linspace(0, rows - 1, n))``."""
    ranked = Timeline(df, keys, order, tie, hot_rows).running(_i=F.lit(1)).result()
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = lookup_join(ranked, totals, keys, hot_rows=hot_rows)
    i, total = F.col("_i") - 1, F.col("_total")
    # row i is picked when some j in 0..n-1 has trunc(j * (total - 1) / (n - 1)) = i
    j = F.ceil(i * (n - 1) / (total - 1)) if n > 1 else F.lit(0)
    picked = F.floor(j * (total - 1) / max(n - 1, 1)) == i
    return rows.filter((total <= n) | picked).drop("_i", "_total")


# ---------------------------------------------------------------- observed speed


def speed_factor(traj: DataFrame, edges: DataFrame, profile: ModeProfile, zone: int, south: bool = False,
                 hot_rows: int | None = None) -> DataFrame:
    """Per user: median of observed over expected road speed, clamped; null below eight samples."""
    # Gaps of 1..600 s, 0.7 km/h up to 1.5 times the mode's top speed, 100 m to a road.
    placed = with_utm(traj.select("user_id", "t_ms", "point_id", "lon", "lat"), [("lon", "lat", "mx", "my")], zone, south)
    line = Timeline(placed, ["user_id"], "t_ms", "point_id", hot_rows)
    pair = line.neighbours(following={f"n_{c}": F.col(c) for c in ("t_ms", "mx", "my")}).result().filter("n_t_ms is not null")
    dt = (F.col("n_t_ms") - F.col("t_ms")) / 1000
    seen = F.hypot(F.col("n_mx") - F.col("mx"), F.col("n_my") - F.col("my")) / dt * 3.6
    moving = pair.filter(dt.between(1.0, 600.0)).withColumn("observed", seen) \
        .filter(F.col("observed").between(0.7, profile.max_kmh * 1.5))
    mids = moving.select("user_id", F.col("point_id").alias("origin_id"), "observed",
                         ((F.col("mx") + F.col("n_mx")) / 2).alias("x"), ((F.col("my") + F.col("n_my")) / 2).alias("y"))
    on_road = snap(mids, edges, 100.0, hot_rows=hot_rows).filter("class_kmh > 0 and snap_m < 100")
    ratios = on_road.groupBy("user_id").agg(
        F.percentile(F.col("observed") / F.col("class_kmh"), F.lit(0.5)).alias("_median"), F.count(F.lit(1)).alias("samples"))
    return ratios.select("user_id", F.when(F.col("samples") >= 8, clamp_factor(F.col("_median"))).alias("speed_factor"), "samples")
