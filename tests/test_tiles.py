"""Road searches by tiles: the same rows as by joins, without a shuffle a hop."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.roads import mode_profile
from chronoweave.operators import network as net
from chronoweave.operators import tiles


def streets(spark, n=14):
    """A lattice of bent streets around 9° east, one of them a way of many vertices and one listed twice."""
    step = 0.001
    rows = []
    for i in range(n):
        for j in range(n):
            x, y = 9.0 + i * step, 45.0 + j * step
            rows.append((len(rows), "residential" if (i + j) % 3 else "service", None, [(x, y), (x + step / 2, y + 0.0001), (x + step, y)]))
            rows.append((len(rows), "residential", "30", [(x, y), (x, y + step)]))
    rows.append((len(rows), "primary", None, [(9.0 + k * step / 5, 45.0 - 0.0002 * (k % 2)) for k in range(60)]))
    rows.append(rows[40])
    return spark.createDataFrame(rows, "source_id long, highway string, maxspeed string, coords array<struct<x:double,y:double>>")


def pairs_of(spark):
    rows = [(p, 9.0 + 0.0011 * p, 45.0002, 0, 9.0 + 0.0011 * p + 0.002, 45.003 + 0.0001 * p, 300_000 + 60_000 * p) for p in range(9)]
    rows += [(20, 9.0001, 45.0001, 0, 9.0135, 45.0135, 120_000), (21, 9.0, 45.0, 0, 12.0, 45.0, 600_000), rows[3], (22, 9.0041, 45.0021, 0, 9.0041, 45.0021, 400_000)]
    return spark.createDataFrame(rows, "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")


def table(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_numbers_of_nodes_are_places(spark):
    xs = spark.createDataFrame([(350_123.456, 4_912_345.678), (-12.34, 9_999_999.0), (700_000.0, -250.5)], "x double, y double")
    px, py = tiles.place(net.node_id(F.col("x"), F.col("y")))
    for r in xs.select("x", "y", px.alias("px"), py.alias("py")).collect():
        assert abs(r.x - r.px) <= 0.0051 and abs(r.y - r.py) <= 0.0051


@pytest.mark.parametrize("limits", [{"LEAST_REACH_M": 40.0, "WIDE": 2, "TILE_WORK": 500, "TILE_SEARCHES": 2}])
def test_tiles_find_what_joins_find(spark, monkeypatch, limits):
    from chronoweave.plans import JOBS
    for k, v in limits.items():
        monkeypatch.setattr(tiles, k, v)
    roads, pairs = streets(spark), pairs_of(spark)
    edges = net.build_edges(roads, mode_profile("walking", None), 32).localCheckpoint()
    points = spark.createDataFrame([(i, 9.0002 + 0.0007 * i, 45.0001 + 0.0003 * i, 40.0 * (i % 7)) for i in range(18)] + [(3, 9.004, 45.004, 100.0)],
                                   "origin_id long, lon double, lat double, cutoff double")
    points = net.with_utm(points, [("lon", "lat", "x", "y")], 32)
    snapped = net.snap(points, edges, 60.0).localCheckpoint()
    origins = points.select("origin_id", "x", "y", (F.col("cutoff") * 2 + 60).alias("budget_sec"), F.lit(60.0).alias("min_activity_sec"))

    def found():
        prism = JOBS["road_prism"](pairs, roads, min_activity_min=1.0, zone=32, resolution=10, lat0=45.0, exact=True)
        return [table(net.origin_times(snapped, edges)), table(net.origin_ppa(origins, edges, 32, max_snap_m=60.0)[0]),
                table(prism["ppa_roads"].drop("spans")), table(prism["status"])]

    by_tiles = found()
    monkeypatch.setattr(tiles, "TILE_EDGES", 0)
    by_joins = found()
    assert by_tiles == by_joins
    assert all(len(rows) > 10 for rows in by_tiles[:3])


def test_searches_need_no_rounds(spark, monkeypatch):
    def refuse(*args, **kw):
        raise AssertionError("a search by joins")

    edges = net.build_edges(streets(spark), mode_profile("walking", None), 32)
    points = net.with_utm(spark.createDataFrame([(1, 9.0041, 45.0022, 200.0)], "origin_id long, lon double, lat double, cutoff double"), [("lon", "lat", "x", "y")], 32)
    monkeypatch.setattr(net, "relax", refuse)
    assert net.origin_times(net.snap(points, edges, 60.0), edges).count() > 5
