"""Bounded searches on a road graph, many to a task: a task holds the searches of one tile and the roads they can reach.

A node's number is read as a place (``node_id`` packs one), and the quickest edge bounds how far a search gets in its time. Searches
are dealt to square tiles by where they start, in classes of how far they get, and each tile takes the edges that have an end in it
or within that distance around it. So the whole search of a start runs in one task, without a shuffle a hop. Tiles with
more edges than a task should take are left to the caller, who has a search by joins for them; this also holds for numbers that are no places.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import spans
from chronoweave.operators.skew import broadcast_if_small
from chronoweave.session import cut_lineage, ship_package

#: Edges of a tile above which its searches are done by joins.
TILE_EDGES = 200_000
#: Searches times edges of a tile above which its searches are dealt to several tasks.
TILE_WORK = 20_000_000
#: Searches from one node, more or less, that a task takes.
TILE_SEARCHES = 20_000
#: Edges of searches that are cut together.
TOGETHER = 500_000
#: Searches times nodes of a tile that are searched together.
SEARCHED = 2_000_000
#: Reach of the lowest class in metres; each further class doubles it.
LEAST_REACH_M = 250.0
#: A tile is so many reaches wide.
WIDE = 8
NODE_M = 0.01  # metres in a unit of a node's packed coordinates

TILE = ["_level", "_tx", "_ty", "_part"]


def place(node: Column) -> tuple[Column, Column]:
    """Metres that a node's number stands for."""
    half = 1 << 29
    y = F.pmod(node + F.lit(half), F.lit(1 << 31)) - F.lit(half)
    return (node - y) / float(1 << 31) * NODE_M, y * NODE_M


def apart(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = place(a), place(b)
    return F.hypot(ax - bx, ay - by)


def top_speed(edges: DataFrame) -> float:
    """Most metres a second between the places of an edge's ends; infinite where no time passes between two places."""
    way = apart(F.col("u"), F.col("v"))
    swift = F.when(F.col("cost_sec") > 0, way / F.nullif(F.col("cost_sec"), F.lit(0.0))).when(way > 0, F.lit(math.inf))
    return edges.agg(F.max(swift)).first()[0] or 0.0


def deal(searches: DataFrame, edges: DataFrame, at: str, reach_m: Column, more: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Searches with their tile, the edges of each tile with the columns ``more``, and the searches that no tile takes.

    ``searches`` start at node ``at`` and get ``reach_m`` far from it. ``edges``: ``edge_id, u, v, cost_sec``.
    """
    columns = list(dict.fromkeys(["edge_id", "u", "v", "cost_sec", *(more or [])]))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.nullif(reach_m, F.lit(0.0)) * 1.0001 / LEAST_REACH_M + 1e-6)))
    placed = searches.withColumn("_level", F.when(F.col(at).isNotNull() & (reach_m < 1e7), F.coalesce(level, F.lit(0)).cast("int")))
    side = F.pow(F.lit(2.0), F.col("_level")) * (LEAST_REACH_M * WIDE)
    x, y = place(F.col(at))
    placed = cut_lineage(placed.withColumns({"_tx": F.floor(x / side), "_ty": F.floor(y / side)}))
    tiles = cut_lineage(placed.filter("_level is not null").groupBy("_level", "_tx", "_ty").agg(F.count(F.lit(1)).alias("_searches")))
    levels = sorted(r[0] for r in tiles.select("_level").distinct().collect())  # one for each doubling of the reach
    # an end is within reach of two tiles each way at most
    wide = F.pow(F.lit(2.0), F.col("_level")) * (LEAST_REACH_M * WIDE)

    def near(node: str) -> Column:
        (nx, ny), reach = place(F.col(node)), wide / WIDE
        return F.flatten(F.transform(F.sequence(F.floor((nx - reach) / wide), F.floor((nx + reach) / wide)), lambda i: F.transform(
            F.sequence(F.floor((ny - reach) / wide), F.floor((ny + reach) / wide)), lambda j: F.struct(i.alias("_tx"), j.alias("_ty")))))

    whole = edges.select(*columns).filter("u is not null and v is not null and cost_sec is not null")
    listed = whole.withColumn("_level", F.explode(F.array(*[F.lit(n).cast("int") for n in levels or [0]])))
    listed = listed.select(*columns, "_level", F.inline(F.array_distinct(F.concat(near("u"), near("v")))))
    used = broadcast_if_small(tiles)
    counts = listed.join(used, ["_level", "_tx", "_ty"]).groupBy("_level", "_tx", "_ty", "_searches").agg(F.count(F.lit(1)).alias("_edges"))
    parts = F.greatest(F.ceil(F.col("_searches") * F.col("_edges") / float(TILE_WORK)), F.ceil(F.col("_searches") / float(TILE_SEARCHES)), F.lit(1)).cast("int")
    slices = F.ceil(F.col("_searches") / float(TILE_SEARCHES)).alias("_slices")
    open_ = broadcast_if_small(cut_lineage(counts.filter(F.col("_edges") <= TILE_EDGES).select("_level", "_tx", "_ty", parts.alias("_parts"), slices)))
    known = placed.join(open_, ["_level", "_tx", "_ty"], "left")
    # searches from one node stay together, as one serves all
    together = F.xxhash64(at, F.pmod(F.xxhash64(*searches.columns), F.col("_slices")))
    taken = known.filter("_parts is not null").withColumn("_part", F.pmod(together, F.col("_parts")).cast("int")).drop("_parts", "_slices")
    roads = listed.join(open_.drop("_slices"), ["_level", "_tx", "_ty"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return taken, roads, known.filter("_parts is null").drop("_parts", "_slices", "_level", "_tx", "_ty")


class Roads:
    """The edges of a tile in one task."""

    def __init__(self, table: pa.Table, starts: list[np.ndarray]):
        # edges that share a number are one edge wherever one of them is reached
        self.ids, self.which = np.unique(table["edge_id"].to_numpy(), return_inverse=True)
        u, v = table["u"].to_numpy(), table["v"].to_numpy()
        self.nodes, at = np.unique(np.concatenate([u, v, *starts]), return_inverse=True)
        self.u, self.v = at[:len(u)], at[len(u):2 * len(u)]
        ends, way = np.concatenate([self.u, self.v]), np.concatenate([self.v, self.u])
        order, cost = np.argsort(ends, kind="stable"), table["cost_sec"].to_numpy()
        self.first = np.searchsorted(ends[order], np.arange(len(self.nodes) + 1))
        self.many = np.diff(self.first)
        self.next, self.step = way[order], np.concatenate([cost, cost])[order]

    def times(self, start: int, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Nodes within ``most`` seconds of one, in order, and how long it takes."""
        best: dict[int, float] = {}
        heap = [(0.0, start)]
        while heap:
            cost, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = cost
            ways = slice(self.first[node], self.first[node + 1])
            for nbr, step in zip(self.next[ways].tolist(), self.step[ways].tolist()):
                if nbr not in best and cost + step <= most:
                    heapq.heappush(heap, (cost + step, nbr))
        nodes, costs = np.fromiter(best, np.int64, len(best)), np.fromiter(best.values(), np.float64, len(best))
        order = np.argsort(nodes)
        return nodes[order], costs[order]

    def all_times(self, starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``times`` from every start one after another, and how many nodes each has.

        The searches of a batch go on together, an edge a round; a label is the least sum along a way whichever search finds it. A batch whose labels are
        improved again and again is searched start by start.
        """
        n = len(self.nodes)
        together = max(1, SEARCHED // max(n, 1))
        best = np.full(min(together, len(starts)) * n, np.inf)
        nodes, costs, sizes = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for low in range(0, len(starts), together):
            own, limit = starts[low:low + together], most[low:low + together]
            front = np.arange(len(own)) * n + own
            best[front] = 0.0
            seen, improved, labels = [front], len(front), len(front)
            while len(front) and improved <= 16 * labels + 1_000_000:
                node = front % n
                many = self.many[node]
                pick = np.repeat(self.first[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                key, cost = np.repeat(front - node, many) + self.next[pick], np.repeat(best[front], many) + self.step[pick]
                there = best[key]
                keep = (cost <= limit[key // n]) & (cost < there)
                key, cost, there = key[keep], cost[keep], there[keep]
                np.minimum.at(best, key, cost)
                wins = cost == best[key]
                front, at = np.unique(key[wins], return_index=True)
                fresh = front[np.isinf(there[wins][at])]
                seen.append(fresh)
                improved, labels = improved + len(front), labels + len(fresh)
            found = np.sort(np.concatenate(seen))
            if len(front):
                each = [self.times(s, m) for s, m in zip(own.tolist(), limit.tolist())]
                nodes += [e[0] for e in each]
                costs += [e[1] for e in each]
                sizes.append(np.array([len(e[0]) for e in each]))
            else:
                nodes.append(found % n)
                costs.append(best[found])
                sizes.append(np.bincount(found // n, minlength=len(own)))
            best[found] = np.inf
        return np.concatenate(nodes), np.concatenate(costs), np.concatenate(sizes)

    def labels(self, ends: list[tuple[np.ndarray, np.ndarray]], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, node and least time of every node that a row reaches from its ``ends`` (node, seconds to get there)."""
        row = np.concatenate([np.arange(len(cutoff))] * len(ends))
        node, seed = np.searchsorted(self.nodes, np.concatenate([e[0] for e in ends])), np.concatenate([e[1] for e in ends])
        left = np.concatenate([cutoff] * len(ends)) - seed
        live = left >= 0
        row, node, seed, left = row[live], node[live], seed[live], left[live]
        starts, at = np.unique(node, return_inverse=True)
        most = np.full(len(starts), -1.0)
        np.maximum.at(most, at, left)
        if not len(starts):
            return row, node, seed
        nodes, costs, sizes = self.all_times(starts, most)
        first, many = np.cumsum(sizes) - sizes, sizes[at]
        pick = np.repeat(first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows, reached = np.repeat(row, many), nodes[pick]
        total = np.repeat(seed, many) + costs[pick]
        keep = total <= cutoff[rows]
        key, total = (rows * len(self.nodes) + reached)[keep], total[keep]
        order = np.lexsort((total, key))
        key, total = key[order], total[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        return key[new] // len(self.nodes), key[new] % len(self.nodes), total[new]

    def sides(self, row: np.ndarray, node: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edges at the labelled nodes as sorted ``row * ids + id``, and the times at their two ends (NaN: not reached)."""
        ends, n = np.concatenate([self.u, self.v]), len(self.u)
        order = np.argsort(ends, kind="stable")
        first = np.searchsorted(ends[order], np.arange(len(self.nodes) + 1))
        many = (first[1:] - first[:-1])[node]
        pick = order[np.repeat(first[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        key, at = np.unique(np.repeat(row, many) * len(self.ids) + self.which[pick % max(n, 1)], return_inverse=True)
        times, found = np.full((2, len(key)), np.nan), np.repeat(cost, many)
        for i, side in enumerate((pick < n, pick >= n)):
            np.fmin.at(times[i], at[side], found[side])
        return key, times[0], times[1]

    def index(self, edge_id: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, edge_id)

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table with each edge's number, and how many they are."""
        order, sizes = np.argsort(self.which, kind="stable"), np.bincount(self.which, minlength=len(self.ids))
        many = sizes[ids]
        return order[np.repeat((np.cumsum(sizes) - sizes)[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


def _seeds(t: pa.Table, p: str = "") -> list[tuple[np.ndarray, np.ndarray]]:
    return [(t[f"{p}u"].to_numpy(), t[f"{p}seed_u"].to_numpy()), (t[f"{p}v"].to_numpy(), t[f"{p}seed_v"].to_numpy())]


def _answer(searches: DataFrame, roads: DataFrame, keys: list[str], more: str, run) -> DataFrame:
    """``run(searches, roads)`` of every tile gives the row of a search and the columns of ``more``."""
    ship_package(searches.sparkSession)
    extra = T._parse_datatype_string(more)
    schema = T.StructType([searches.schema[k] for k in keys] + extra.fields)

    def call(left: pa.Table, right: pa.Table) -> pa.Table:
        row, columns = run(left, right)
        own = [left[k].take(pa.array(row)) for k in keys]
        return pa.table([*own, *columns], names=[*keys, *[f.name for f in extra.fields]])

    return searches.groupBy(*TILE).cogroup(roads.groupBy(*TILE)).applyInArrow(call, schema)


def node_times(searches: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, cost`` of every node that a search (``u, v, seed_u, seed_v, cutoff``) reaches."""
    def run(left, right):
        if not len(left):
            return np.zeros(0, np.int64), [pa.array([], pa.int64()), pa.array([], pa.float64())]
        ends = _seeds(left)
        graph = Roads(right, [e[0] for e in ends])
        row, node, cost = graph.labels(ends, left["cutoff"].to_numpy())
        return row, [pa.array(graph.nodes[node]), pa.array(cost)]
    return _answer(searches, roads, keys, "node long, cost double", run)


def edge_times(searches: DataFrame, roads: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """``keys, edge_id, du, dv, own`` and the columns ``more`` of every edge that a search reaches, of its ``own`` edge always."""
    def run(left, right):
        if not len(left):
            return np.zeros(0, np.int64), [pa.array([], t) for t in (pa.int64(), pa.float64(), pa.float64(), pa.bool_())] + [right[c].slice(0, 0) for c in more]
        ends = _seeds(left)
        graph = Roads(right, [e[0] for e in ends])
        key, du, dv = graph.sides(*graph.labels(ends, left["cutoff"].to_numpy()))
        n = len(graph.ids)
        mine = np.arange(len(left)) * n + graph.index(left["edge_id"].to_numpy())
        every = np.union1d(key, mine)
        times, at = np.full((2, len(every)), np.nan), np.searchsorted(every, key)
        times[0][at], times[1][at] = du, dv
        pick, many = graph.rows(every % n)
        columns = [graph.ids[every % n], times[0], times[1], np.isin(every, mine)]
        return np.repeat(every // n, many), [*[pa.array(np.repeat(c, many), from_pandas=True) for c in columns], *[right[c].take(pa.array(pick)) for c in more]]
    kinds = ", ".join(f"{c} {roads.schema[c].dataType.simpleString()}" for c in more)
    return _answer(searches, roads, keys, f"edge_id long, du double, dv double, own boolean, {kinds}", run)


PIECE = "edge_id long, a double, b double, travel_min double, travel_mid double, travel_max double"


def pieces(searches: DataFrame, roads: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """``keys`` and ``PIECE`` of every part of an edge within ``cutoff`` of a search, and the columns ``more`` of the edge.

    A search starts at ``fraction`` of its ``edge_id``.
    """
    def run(left, right):
        if not len(left):
            return np.zeros(0, np.int64), [pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 5)] + [right[c].slice(0, 0) for c in more]
        ends, cutoff = _seeds(left), left["cutoff"].to_numpy()
        graph = Roads(right, [e[0] for e in ends])
        key, du, dv = graph.sides(*graph.labels(ends, cutoff))
        n, fraction, cost = len(graph.ids), left["fraction"].to_numpy(), right["cost_sec"].to_numpy()
        mine = np.arange(len(left)) * n + graph.index(left["edge_id"].to_numpy())
        every = np.union1d(key, mine)
        times, at = np.full((2, len(every)), np.nan), np.searchsorted(every, key)
        times[0][at], times[1][at] = du, dv
        own = np.full(len(every), np.nan)
        own[np.searchsorted(every, mine)] = fraction
        rows, columns, edges = [], [[] for _ in range(6)], []
        for low in range(0, len(every), TOGETHER):
            part = slice(low, low + TOGETHER)
            pick, many = graph.rows(every[part] % n)
            own_row, one = np.repeat(every[part] // n, many), np.repeat(np.arange(len(many)), many)
            row, *found = spans.reached(times[0][part][one], times[1][part][one], own[part][one], cost[pick], cutoff[own_row])
            rows.append(own_row[row])
            edges.append(pick[row])
            for column, values in zip(columns, [graph.ids[every[part][one][row] % n], *found]):
                column.append(values)
        pick = pa.array(np.concatenate(edges))
        return np.concatenate(rows), [*[pa.array(np.concatenate(c)) for c in columns], *[right[c].take(pick) for c in more]]
    kinds = ", ".join(f"{c} {roads.schema[c].dataType.simpleString()}" for c in more)
    return _answer(searches, roads, keys, f"{PIECE}, {kinds}", run)


def pair_times(searches: DataFrame, roads: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, shortest``: the least time from A to B of the searches (``a_`` and ``b_`` ends, one ``cutoff``) whose B is reached in time."""
    def run(left, right):
        if not len(left):
            return np.zeros(0, np.int64), [pa.array([], pa.float64())]
        a, b, cutoff = _seeds(left, "a_"), _seeds(left, "b_"), left["cutoff"].to_numpy()
        graph = Roads(right, [e[0] for e in a + b])
        row, node, cost = graph.labels(a, cutoff)
        short, at = np.full(len(cutoff), np.inf), row * len(graph.nodes) + node
        for end, seed in b if len(at) else []:
            want = np.arange(len(cutoff)) * len(graph.nodes) + np.searchsorted(graph.nodes, end)
            spot = np.minimum(np.searchsorted(at, want), len(at) - 1)
            met = at[spot] == want
            short[met] = np.fmin(short[met], cost[spot[met]] + seed[met])
        met = np.flatnonzero(np.isfinite(short))
        return met, [pa.array(short[met])]
    return _answer(searches, roads, keys, "shortest double", run)


def prism_times(searches: DataFrame, roads: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """``keys, edge_id, ua, va, ub, vb`` and the columns ``more`` of the edges that can be visited on the way from A to B, of both own edges always.

    A search has ``a_`` and ``b_`` ends and one ``cutoff``.
    """
    def run(left, right):
        if not len(left):
            return np.zeros(0, np.int64), [pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 4)] + [right[c].slice(0, 0) for c in more]
        a, b, cutoff = _seeds(left, "a_"), _seeds(left, "b_"), left["cutoff"].to_numpy()
        graph = Roads(right, [e[0] for e in a + b])
        n = len(graph.ids)
        (ka, ua, va), (kb, ub, vb) = graph.sides(*graph.labels(a, cutoff)), graph.sides(*graph.labels(b, cutoff))
        mine = np.unique(np.concatenate([np.arange(len(left)) * n + graph.index(left[f"{p}own"].to_numpy()) for p in ("a_", "b_")]))
        every = np.unique(np.concatenate([ka, kb, mine]))
        times = np.full((4, len(every)), np.nan)
        for i, key, at_u, at_v in ((0, ka, ua, va), (2, kb, ub, vb)):
            at = np.searchsorted(every, key)
            times[i][at], times[i + 1][at] = at_u, at_v
        # no place on another edge takes less than its ends together; what is left is measured by the caller
        least = np.fmin(times[0], times[1]) + np.fmin(times[2], times[3])
        keep = np.isin(every, mine) | (least <= (cutoff * (1 + 1e-9) + 1e-3)[every // n])
        every, times = every[keep], times[:, keep]
        pick, many = graph.rows(every % n)
        columns = [pa.array(np.repeat(c, many), from_pandas=True) for c in (graph.ids[every % n], *times)]
        return np.repeat(every // n, many), [*columns, *[right[c].take(pa.array(pick)) for c in more]]
    kinds = ", ".join(f"{c} {roads.schema[c].dataType.simpleString()}" for c in more)
    return _answer(searches, roads, keys, f"edge_id long, ua double, va double, ub double, vb double, {kinds}", run)
