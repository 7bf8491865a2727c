"""Road searches, snapping, spans, outlines and obstacle grids done for many rows of a task at once."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoweave.functions import intervals, lens, spans
from chronoweave.operators import network as net
from chronoweave.operators import prism, skew, tiles


def _graph(seed, nodes=60, edges=140):
    r = random.Random(seed)
    rows = [(i, r.randrange(nodes), r.randrange(nodes), r.choice([1.0, 2.5, r.random() * 9])) for i in range(edges)]
    return pa.table({"edge_id": [e[0] for e in rows], "u": [e[1] for e in rows], "v": [e[2] for e in rows], "cost_sec": [e[3] for e in rows]})


def test_searches_together_find_what_each_finds(monkeypatch):
    for together in (1, 200, 10**6):
        monkeypatch.setattr(tiles, "SEARCHED", together)
        graph = tiles.Roads(_graph(3), [np.array([999])])
        starts, most = np.arange(len(graph.nodes)), np.linspace(0, 12, len(graph.nodes))
        nodes, costs, sizes = graph.all_times(starts, most)
        alone = [graph.times(s, m) for s, m in zip(starts.tolist(), most.tolist())]
        assert sizes.tolist() == [len(a[0]) for a in alone] and sizes.max() > 10
        assert nodes.tolist() == np.concatenate([a[0] for a in alone]).tolist() and costs.tolist() == np.concatenate([a[1] for a in alone]).tolist()


def test_labels_improved_again_and_again_are_searched_alone(monkeypatch):
    # every further hop finds a slightly quicker way to all that is known
    n = 1500
    rows = [(i, i + 1, 0.001) for i in range(n)] + [(0, i, 1000.0 - i * 0.4) for i in range(2, n)] + [(0, 1, 0.001)]
    table = pa.table({"edge_id": list(range(len(rows))), "u": [r[0] for r in rows], "v": [r[1] for r in rows], "cost_sec": [r[2] for r in rows]})
    graph, alone = tiles.Roads(table, []), []
    monkeypatch.setattr(graph, "times", lambda s, m: alone.append(s) or tiles.Roads.times(graph, s, m))
    nodes, costs, sizes = graph.all_times(np.array([0, 5]), np.array([5000.0, 5000.0]))
    assert sizes.tolist() == [n + 1, n + 1] and math.isclose(costs[n], n * 0.001)
    assert alone == [0, 5]


def test_spans_of_many_edges(spark):
    r = random.Random(5)

    def end():
        return None if r.random() < 0.3 else r.choice([0.0, 90.0, 90.0 + 1e-9, r.random() * 150])
    rows = [(i, end(), end(), r.random() if r.random() < 0.5 else None, r.choice([50.0, 300.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, du double, dv double, f double, c double")
    own, cut = F.col("f").isNotNull(), F.lit(90.0)
    ways = intervals.entries(F.col("du"), F.col("dv"), own, F.coalesce("f", F.lit(0.0)))
    old = df.select("i", "c", ways.alias("w"), F.inline(intervals.reachable_spans(F.col("du"), F.col("dv"), F.col("c"), cut, own, F.coalesce("f", F.lit(0.0)))))
    want = [(x.i, x.a, x.b, *x.t) for x in old.select("i", "a", "b", intervals.span_times(F.col("a"), F.col("b"), F.col("w"), F.col("c")).alias("t")).orderBy("i", "a").collect()]
    columns = [np.array([math.nan if x[k] is None else x[k] for x in rows]) for k in (1, 2, 3, 4)]
    got = list(zip(*(v.tolist() for v in spans.reached(*columns, np.full(len(rows), 90.0)))))
    assert len(got) == len(want) > 300 and [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array(got), np.array(want), rtol=0, atol=1e-9)


def test_snap_lists_an_edge_about_once(spark, monkeypatch):
    r = random.Random(8)
    ways = []
    for i in range(400):
        x, y, turn, long = r.random() * 3000, r.random() * 3000, r.random() * 7, r.choice([10, 90, 900])
        ways.append((i, i, i + 1000, 1.0, 5.0, x, y, x + long * math.cos(turn), y + long * math.sin(turn)))
    ways.append((401, 1, 2, 1.0, 5.0, *ways[0][5:]))  # as near as the first
    edges = spark.createDataFrame(ways, "edge_id long, u long, v long, cost_sec double, class_kmh double, x0 double, y0 double, x1 double, y1 double")
    spots = [(i, r.random() * 3000, r.random() * 3000) for i in range(500)] + [(500, ways[0][5], ways[0][6]), (501, None, 1.0), (502, 9e6, 9e6)]
    points = spark.createDataFrame(spots, "origin_id long, x double, y double")
    listed, real = [], net._reach_cells
    monkeypatch.setattr(net, "_reach_cells", lambda *a: listed.append(real(*a)) or listed[-1])

    def away(p, e):
        vx, vy = e[7] - e[5], e[8] - e[6]
        f = min(1.0, max(0.0, ((p[1] - e[5]) * vx + (p[2] - e[6]) * vy) / (vx * vx + vy * vy)))
        return math.hypot(p[1] - e[5] - f * vx, p[2] - e[6] - f * vy)
    want = {p[0]: min((away(p, e), e[0]) for e in ways) for p in spots if p[1] is not None}
    want = {k: v for k, v in want.items() if v[0] <= 50.0}
    for points_a_task, edges_a_task in ((100_000, 200_000), (7, 9)):
        monkeypatch.setattr(net, "SNAP_POINTS", points_a_task)
        monkeypatch.setattr(net, "SNAP_EDGES", edges_a_task)
        got = {x.origin_id: (x.snap_m, x.edge_id) for x in net.snap(points, edges, 50.0).collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and len(got) > 100 and got[500][1] == 0
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    assert sum(x.count() for x in listed) <= 2 * 2 * len(ways)


def test_many_rows_in_one_partition_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_ROWS", 100)
    monkeypatch.setattr(skew, "PART_ROWS", 50)
    assert skew.spread(spark.range(1000, numPartitions=1)).rdd.getNumPartitions() == 20


def test_outlines_are_made_before_points_are_sent(spark, monkeypatch):
    sheets = spark.range(4000, numPartitions=1).select(
        F.lit(None).cast("long").alias("pair_id"), (F.col("id") % 2).alias("sheet"), (F.col("id") % 60 / 7).alias("lon0"), (F.col("id") % 61 / 5).alias("lat0"),
        (F.col("id") % 59 / 3).alias("lon1"), (F.col("id") % 53 / 11).alias("lat1"))
    kept, real = [], prism.stored
    monkeypatch.setattr(prism, "stored", lambda df, name: kept.append(real(df, name)) or kept[-1])
    got = {r.sheet: [(p.x, p.y) for p in r.ring] for r in prism.sheet_hulls(sheets).collect()}
    rows = sheets.collect()
    for s in (0, 1):
        ends = sorted({p for r in rows if r.sheet == s for p in ((r.lon0, r.lat0), (r.lon1, r.lat1))})
        assert got[s] == prism._hull(ends)
    assert kept[0].select(F.sum(F.size("ring"))).first()[0] < 200


def test_grids_are_searched_in_one_task(spark, monkeypatch):
    pairs = [(p, 0.0, 0.0, 0, 0.002 * (p % 5 + 1), 0.001 * (p % 3), 1_800_000) for p in range(40)] + [(7, 0.0, 0.0, 0, 0.004, 0.0, 900_000), (None, 0.0, 0.0, 0, 0.001, 0.0, 900_000)]
    pairs = spark.createDataFrame(pairs, "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    grids = prism.pair_grids(prism.with_trip(pairs, 5 / 3.6), 5 / 3.6, 12).localCheckpoint()
    cells = grids.select("pair_id", F.explode(F.sequence(F.lit(-1), F.col("rows"))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(12))))
    walls = cells.filter((F.col("pair_id") * 31 + F.col("row") * 7919 + F.col("col") * 6271) % 100 < 30)
    walls = walls.unionByName(spark.createDataFrame([(3, None, 1), (99, 1, 1)], "pair_id long, row int, col int")).localCheckpoint()
    seeds, real = [], prism.relax
    monkeypatch.setattr(prism, "relax", lambda s, *a: seeds.append(s.count()) or real(s, *a))

    def found(most):
        monkeypatch.setattr(prism, "GRID_CELLS", most)
        reach = prism.grid_reach(grids, walls)
        slices = prism.grid_slices(grids, reach, 6)
        return (sorted((-1 if r.pair_id is None else r.pair_id, r.role, r.row, r.col, round(r.cost, 6)) for r in prism.role_times(reach).collect()),
                sorted((r.pair_id, r.row, r.col, r.slice, round(r.from_a, 6), round(r.to_b, 6), r.x0, r.dt_s) for r in slices.collect()))
    by_tasks, by_joins = found(100_000), found(1)
    assert by_tasks == by_joins and len(by_tasks[0]) > 2000 and len(by_tasks[1]) > 1000
    assert seeds == [2 * 3, 2 * 42]  # only pairs that share a number, or have none, go by joins


def test_only_sides_near_a_border_are_cut(monkeypatch):
    r = np.random.default_rng(4)
    lon, lat, one = r.uniform(-80, -79.9, 300), r.uniform(43, 43.1, 300), r.uniform(1, 900, 300)
    far, turn = r.uniform(0, 1, 300) * 0.012 * (np.arange(300) % 5 > 0), r.uniform(0, 7, 300)
    two = np.where(np.arange(300) % 7 == 0, one, r.uniform(1, 900, 300))
    other = lon + far * np.cos(turn), lat + far * np.sin(turn), two
    p, q = lens._rings(lon, lat, one, 48), lens._rings(*other, 48)
    step, edge = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    # every side against every side
    away = p[:, :, None] - q[:, None]
    num = edge[:, None, :, 0] * away[..., 1] - edge[:, None, :, 1] * away[..., 0]
    den = edge[:, None, :, 0] * step[:, :, None, 1] - edge[:, None, :, 1] * step[:, :, None, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -num / den
    low, high = np.where(den > 0, t, 0.0).max(axis=2).clip(0.0, None), np.where(den < 0, t, 1.0).min(axis=2).clip(None, 1.0)
    out = (low > high) | ((den == 0) & (num < 0)).any(axis=2)
    cut, real = [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda a: cut.append(a.sum()) or real(a))
    a, b = lens._sides_inside(p, q, *other)
    assert np.array_equal(np.isnan(a[..., 0]), out) and 0.1 < out.mean() < 0.9
    assert np.allclose(a[~out], (p + low[..., None] * step)[~out], rtol=0, atol=1e-13) and np.allclose(b[~out], (p + high[..., None] * step)[~out], rtol=0, atol=1e-13)
    assert sum(cut) < 0.4 * out.size
