"""Bounds that hold the work of large groups and large shapes, and answers that do not depend on them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import corridor, kernel, pasta, quantiles
from chronoweave.operators.grid import Grid
from chronoweave.operators.nearest import nearest
from chronoweave.plans import JOBS


@pytest.mark.parametrize("most", [4, 10_000])
def test_quantiles_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "GROUP_VALUES", most)
    r = random.Random(1)
    groups = {"a": [r.gauss(0, 1e6) for _ in range(700)], "b": [5.0] * 30 + [7.0], "c": [1.5], "d": [r.randint(0, 3) * 1.0 for _ in range(90)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan")), ("e", None)]
    probs = [0.0, 0.25, 0.9, 0.975, 1.0]
    got = {g.k: g.q for g in quantiles.group_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", probs).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile(vs, probs), rel=1e-12)


@pytest.mark.parametrize("error", [0.05, 0.002])
def test_approximate_quantiles_keep_their_error(spark, error):
    rows = spark.range(200_000).select(F.pow(F.xxhash64("id").cast("double") / 1e18, F.lit(3)).alias("v")).repartition(7)
    values = np.sort([x.v for x in rows.collect()])
    probs = [0.01, 0.25, 0.5, 0.9, 0.999]
    for p, q in zip(probs, quantiles.quantiles(rows, F.col("v"), probs, error)):
        rank = np.searchsorted(values, q) / len(values)
        assert abs(rank - p) <= error + 1 / len(values)
    assert quantiles.quantiles(rows, F.col("v"), probs) == pytest.approx(np.quantile(values, probs))
    assert np.isnan(quantiles.quantiles(rows.limit(0), F.col("v"), [0.5], error)[0])


@pytest.mark.parametrize("uneven", [False, True])
def test_many_slices_are_a_range(spark, uneven):
    r = random.Random(2)
    points = [(r.uniform(0, 1), r.uniform(0, 1), r.uniform(-50, 350)) for _ in range(150)]
    grid, h, w = Grid(0.0, 0.0, 0.1, 0.1, 10, 10), 0.15, 25.0
    centers = [i * 10.0 + (i % 3 if uneven else 0) for i in range(30)]
    got = kernel.density(spark.createDataFrame(points, "lon double, lat double, t_s double"), grid, centers, h, w).collect()
    want = {}
    for x, y, t in points:
        for i, c in enumerate(centers):
            for row in range(10):
                for col in range(10):
                    d2 = (col * .1 + .05 - x) ** 2 + (row * .1 + .05 - y) ** 2
                    if d2 < h * h and abs(t - c) < w:
                        k = 3 / (np.pi * h * h) * (1 - d2 / h / h) ** 2 * 15 / 16 / w * (1 - ((t - c) / w) ** 2) ** 2
                        want[i, row, col] = want.get((i, row, col), 0) + k
    assert len(want) > 500 and {(x.t_idx, x.row, x.col): x.density for x in got} == {k: pytest.approx(v) for k, v in want.items()}


def test_a_large_ring_has_few_cells(spark):
    ring = lambda x, y, s: [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]
    sizes = [10.0, 400.0, 3_000.0, 900_000.0]
    rings = spark.createDataFrame([("u", i, i, 0, ring(123.0 * i, -77.0, s)) for i, s in enumerate(sizes)],
                                  "user_id string, segment_index long, point_id long, t_ms long, ring array<struct<x:double,y:double>>")
    assert corridor.ring_cells(rings, 500.0).groupBy("segment_index").count().agg(F.max("count")).first()[0] <= (corridor.SPAN + 1) ** 2
    edges = spark.createDataFrame([(i, "x", i, 1.0, 130.0 * i, -200.0, 130.0 * i + 40, 400.0) for i in range(40)],
                                  "edge_id long, highway string, source_id long, length_m double, x0 double, y0 double, x1 double, y1 double")
    got = {(p.segment_index, p.edge_id) for p in corridor.clip_roads(rings, edges, 500.0).collect()}
    want = set()
    for i, s in enumerate(sizes):
        x, y = 123.0 * i, -77.0
        for e in range(40):
            # the edge climbs 600 m over 40 m: where is it between the ring's sides?
            lo = max(0.0, (y + 200) / 600, (x - 130.0 * e) / 40)
            hi = min(1.0, (y + s + 200) / 600, (x + s - 130.0 * e) / 40)
            if hi > lo:
                want.add((i, e))
    assert got == want


def test_groups_of_very_different_extent(spark):
    """A street's users in a world's table: each group is searched in cells of its own."""
    r = random.Random(3)
    items = [(i, "street", r.uniform(0, 1e-3), r.uniform(0, 1e-3)) for i in range(150)] + [(1000 + i, "world", r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(150)]
    points = [(i, r.choice(["street", "world", "none"]), r.uniform(-1e-3, 2e-3), r.uniform(-1e-3, 2e-3)) for i in range(120)]
    got = nearest(spark.createDataFrame(points, "p long, g string, x double, y double"), spark.createDataFrame(items, "i long, g string, x double, y double"), ["g"], "p", "i").collect()
    assert len(got) == len(points)
    where = {p: (g, x, y) for p, g, x, y in points}
    for h in got:
        g, x, y = where[h.p]
        near = min(((x - a) ** 2 + (y - b) ** 2, i) for i, k, a, b in items if k == g) if g != "none" else None
        assert (h.hit["item"]["i"] if h.hit else None) == (near[1] if near else None)


def test_rings_are_listed_without_their_corners(spark, monkeypatch):
    """Ellipses and widened lines in every direction are cut as before, and only what they are drawn from is written and shuffled."""
    r = random.Random(5)
    fixes = [(u * 100 + i, f"u{u}", i * 60_000 * (1 + u % 3), r.uniform(-79.51, -79.49), 43.6 + i * r.choice([0, 1e-4, 2e-3])) for u in range(6) for i in range(6)]
    fixes += [(900, "u1", 130_000, None, 43.6), (901, "u2", 190_000, -79.5, None)]
    rings = corridor.segment_ppas(spark.createDataFrame(fixes, "point_id long, user_id string, t_ms long, lon double, lat double"), 1.4, 17)
    assert {x.fallback for x in rings.collect()} == {True, False}
    at = rings.selectExpr("ring[0].x AS x", "ring[0].y AS y").filter("x is not null and y is not null").collect()
    assert len(at) < rings.count()
    edges = spark.createDataFrame([(i, "x", i, 1.0, p.x + r.uniform(-300, 300), p.y + r.uniform(-300, 300), p.x + r.uniform(-300, 300), p.y + r.uniform(-300, 300))
                                   for i, p in enumerate(at * 6)],
                                  "edge_id long, highway string, source_id long, length_m double, x0 double, y0 double, x1 double, y1 double")
    seen, plain = [], corridor.cut_lineage
    monkeypatch.setattr(corridor, "cut_lineage", lambda df: seen.append(df.columns) or plain(df))

    def cut(ppas):
        return {(p.user_id, p.segment_index, p.edge_id): (pytest.approx(p.a, abs=1e-9), pytest.approx(p.b, abs=1e-9)) for p in corridor.clip_roads(ppas, edges, 200.0).collect()}

    got = cut(rings)
    assert "ring" not in seen[0]
    want = {k: (a.expected, b.expected) for k, (a, b) in cut(rings.drop("_drawn")).items()}
    assert len(want) > 50 and want == got


def test_first_voxels_come_from_the_first_windows(spark, monkeypatch):
    """Windows become cells until the voxels asked for are there; they are those that all windows would give."""
    rows = [(f"p{p:02d}", p * 100 + i, -79.5 + (p * 7 + i * 3) % 10 / 1000, 43.6 + i / 1000, i * 2_700_000 + p * 1000, "home" if i % 2 == 0 else "shopping", "walking")
            for p in range(40) for i in range(5)]
    df = spark.createDataFrame(rows, "person_id string, episode_id long, lon double, lat double, start_ms long, activity_type string, mode string")
    keys, seen, plain = ["window_id", "row", "col", "time_bin"], [], pasta.window_cells
    every = sorted(tuple(v) for v in JOBS["activity_surface"](df, cell_m=500.0)["voxels"].select(*keys).collect())
    windows = JOBS["activity_surface"](df, cell_m=500.0)["anchor_windows"].select("window_id").distinct().count()
    assert len(every) > 200 and windows >= 40

    def cells(w, *rest):
        seen.append(w.filter("feasible").count())
        return plain(w, *rest)

    monkeypatch.setattr(pasta, "window_cells", cells)
    for many in (0, 5, 200, len(every) + 7):
        seen.clear()
        got = sorted(tuple(v) for v in JOBS["activity_surface"](df, cell_m=500.0, max_voxels=many)["voxels"].select(*keys).collect())
        assert got == every[:many]
        if many == 5:
            assert min(seen[1:]) <= 5 < seen[0]
