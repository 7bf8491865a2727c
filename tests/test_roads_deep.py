"""Searches over long ways: the same times as a plain search, in fewer rounds."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import network as net

EDGES = "edge_id long, u long, v long, cost_sec double"


def plain_times(edges, sources):
    near = {}
    for _, u, v, c in edges:
        near.setdefault(u, []).append((v, c))
        near.setdefault(v, []).append((u, c))
    out = {}
    for s, cutoff in sources:
        best, heap = {}, [(0.0, s)]
        while heap:
            c, n = heapq.heappop(heap)
            if n in best or c > cutoff:
                continue
            best[n] = c
            for m, step in near.get(n, ()):
                if m not in best:
                    heapq.heappush(heap, (c + step, m))
        out |= {(s, n): c for n, c in best.items()}
    return out


def winding(seed, junctions=12, ways=20, most=25):
    """Junctions joined by ways of many vertices, dead ends, parallel ways, a loop at a junction and a ring apart."""
    r = random.Random(seed)
    edges, fresh = [], 1000
    for _ in range(ways):
        a, b = r.randrange(junctions), r.randrange(junctions)
        line = [a, *range(fresh, fresh + r.randint(0 if a != b else 2, most)), b]
        fresh += most + 1
        edges += [(len(edges) + i, x, y, r.uniform(1, 9)) for i, (x, y) in enumerate(zip(line, line[1:]))]
    ring = list(range(5000, 5006))
    edges += [(9000 + i, x, y, 1.0) for i, (x, y) in enumerate(zip(ring, ring[1:] + ring[:1]))]
    return [(i, *e[1:]) for i, e in enumerate(edges)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_times_along_winding_ways(spark, seed):
    edges = winding(seed)
    sources = [(0, 120.0), (3, 60.0), (1005, 90.0), (5002, 2.5), (1000, 3.0), (7777, 5.0)]
    got = net.shortest_times(spark.createDataFrame(sources, "source long, cutoff double"), spark.createDataFrame(edges, EDGES)).collect()
    want = plain_times(edges, sources)
    assert len(got) == len(want)
    assert {(g.source, g.node): pytest.approx(g.cost) for g in got} == want


def test_chains_are_contracted(spark):
    edges = [(i, i, i + 1, 2.0) for i in range(100)] + [(200, 50, 999, 1.0)]
    steps = net.adjacency(spark.createDataFrame(edges, EDGES))
    short, inside = net.contract(steps, spark.createDataFrame([(10,)], "node long"))
    assert {(s.node, s.nbr): s.step for s in short.collect()} == {
        (0, 10): 20.0, (10, 0): 20.0, (10, 50): 80.0, (50, 10): 80.0, (50, 100): 100.0, (100, 50): 100.0, (50, 999): 1.0, (999, 50): 1.0}
    ends = {}
    for i in inside.collect():
        ends.setdefault(i.node, {})[i.end] = i.dist
    assert len(ends) == 97 and ends[20] == {10: 20.0, 50: 60.0} and ends[99] == {50: 98.0, 100: 2.0}


def test_rounds_follow_junctions(spark, monkeypatch):
    """A street of 600 vertices and eight junctions by car: at most a fifth of the rounds that a search from vertex to vertex takes."""
    edges = [(i, i, i + 1, 1.0) for i in range(600)] + [(1000 + j, 75 * j + 40, 10_000 + j, 1.0) for j in range(8)]
    table = spark.createDataFrame(edges, EDGES)
    sources = [(0, 10_000.0), (300, 10_000.0)]
    rounds, real = [0], net.relax

    def counting(seeds, expand, key):
        def counted(wave):
            rounds[0] += 1
            return expand(wave)
        return real(seeds, counted, key)

    monkeypatch.setattr(net, "relax", counting)
    got = net.shortest_times(spark.createDataFrame(sources, "source long, cutoff double"), table).collect()
    assert {(g.source, g.node): g.cost for g in got} == plain_times(edges, sources)
    assert rounds[0] <= 600 / 5 / 2


def test_prism_of_a_long_trip_on_a_winding_road(spark):
    """Two hours on foot along one road of a thousand vertices: every leg between the anchors belongs to the prism."""
    from chronoweave.plans import JOBS
    n = 1000
    coords = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((F.lit(9.0) + i * 0.00005).alias("x"), (F.lit(0.0) + F.abs(i % 2) * 0.00001).alias("y")))
    roads = spark.range(1).select(F.lit(1).cast("long").alias("source_id"), F.lit("residential").alias("highway"), F.lit(None).cast("string").alias("maxspeed"), coords.alias("coords"))
    pairs = spark.createDataFrame([(1, 9.0, 0.0, 0, 9.05, 0.0, 7_200_000)], "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    out = JOBS["road_prism"](pairs, roads, min_activity_min=5.0)
    status = out["status"].first()
    assert status.feasible and 5_565 / 5 * 3.6 <= status.shortest_path_sec <= 5_750 / 5 * 3.6
    assert out["ppa_roads"].count() == n
