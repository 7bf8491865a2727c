"""Meetings, misses, prisms against prisms and streams, against plain versions of each."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.geo import GRID_M_PER_DEG
from chronoweave.operators import meetings, prism, shared
from chronoweave.operators.grid import Grid
from chronoweave.operators.overlap import overlapping
from chronoweave.plans import JOBS
from chronoweave.streaming import cube as streams

FIXES = "point_id long, user_id string, t_ms long, lon double, lat double"


@pytest.mark.parametrize("hot", [None, 3])
def test_overlapping_intervals_of_all_lengths(spark, hot):
    r = random.Random(1)

    def some(n, k):
        rows = [(i, r.choice("ab"), s := r.randint(-5000, 5000), s + int(2 ** r.uniform(0, k)) - 1) for i in range(n)]
        return rows + [(n, "a", 5, 5), (n + 1, "a", 6, 2), (n + 2, "b", None, 9), (n + 3, None, 1, 4), (n + 4, "c", -9000, 9000)]

    left, right = some(70, 13), some(60, 4)
    a = spark.createDataFrame(left, "i int, k string, s long, e long")
    b = spark.createDataFrame(right, "j int, k string, p long, q long")
    got = sorted((x.i, x.j) for x in overlapping(a, b, ["k"], ("s", "e"), ("p", "q"), hot).collect())
    assert got == sorted((i, j) for i, k, s, e in left for j, m, p, q in right if k and k == m and None not in (s, e, p, q) and s <= e and p <= q and s <= q and p <= e)


def plain_approaches(rows, reach):
    users = {}
    for i, u, t, x, y in sorted(rows, key=lambda f: (f[1], f[2], f[0])):
        users.setdefault(u, []).append((i, t, x, y))
    moves = [(u, a, b) for u, line in users.items() for a, b in zip(line, line[1:])]
    out = {}
    for u, a, b in moves:
        k = max(math.cos(math.radians((a[3] + b[3]) / 2)), .01) * GRID_M_PER_DEG
        for w, c, d in moves:
            s, e = max(a[1], c[1]), min(b[1], d[1])
            if u >= w or s > e:
                continue

            def at(p, q, t):
                f = (t - p[1]) / (q[1] - p[1]) if q[1] > p[1] else 0.0
                return p[2] + (q[2] - p[2]) * f, p[3] + (q[3] - p[3]) * f

            def gap(t):
                (x, y), (z, v) = at(a, b, t), at(c, d, t)
                return math.hypot((z - x) * k, (v - y) * GRID_M_PER_DEG)

            lo, hi = s, e
            for _ in range(200):
                m, n = lo + (hi - lo) / 3, hi - (hi - lo) / 3
                lo, hi = (lo, n) if gap(m) <= gap(n) else (m, hi)
            if gap((lo + hi) / 2) <= reach:
                out[a[0], c[0]] = gap((lo + hi) / 2)
    return out


def walkers(seed=2, users=14, fixes=12):
    r = random.Random(seed)
    rows = [(u * 100 + i, f"u{u}", r.randint(0, 7200) * 1000, -79 + r.uniform(0, .02), 43 + r.uniform(0, .02)) for u in range(users) for i in range(fixes)]
    return rows + [(9000, "still", 0, -79.0, 43.01), (9001, "still", 7_000_000, -79.0, 43.01), (9002, "still", 7_000_000, -78.99, 43.01), (9100, "alone", 5, -79.0, 43.01)]


@pytest.mark.parametrize("bounds", [{}, {"crowded": 12, "hot_rows": 6}, {"crowded": 25, "slot_ms": 128_000, "cell_m": 100.0}])
def test_every_approach_once(spark, bounds):
    rows = walkers()
    moves = meetings.motions(spark.createDataFrame(rows, FIXES))
    got = meetings.approaches(moves, 90.0, **bounds).collect()
    want = plain_approaches(rows, 90.0)
    assert len(want) > 30 and len(got) == len(want)
    assert {(g.seg_a, g.seg_b): pytest.approx(g.closest_m, abs=1e-3) for g in got} == want
    for g in got:
        assert g.enter_ms <= g.closest_ms <= g.leave_ms


def test_encounters_are_uninterrupted(spark):
    # b walks past a, stays within reach for a while over several fixes, leaves and comes back
    a = [(i, "a", i * 60_000, 0.0, 0.0) for i in range(0, 11)]
    b = [(100 + i, "b", i * 60_000, x / GRID_M_PER_DEG, 0.0) for i, x in enumerate([200, 0, 10, 40, 200, 300, 200, 95, 200, 300, 400])]
    out = JOBS["encounters"](spark.createDataFrame(a + b, FIXES), reach_m=100.0, meeting_m=5.0)["encounters"].orderBy("start_ms").collect()
    assert [(round(e.start_ms), round(e.end_ms), e.kind) for e in out] == [(30_000, 202_500, "meeting"), (417_143, 422_857, "near")]
    assert out[0].closest_m == pytest.approx(0, abs=1e-6) and out[1].closest_m == pytest.approx(95, abs=1e-6)


def test_motions_with_a_long_gap_are_no_evidence(spark):
    rows = [(1, "a", 0, 0.0, 0.0), (2, "a", 100, 0.0, 0.0), (3, "b", 0, 0.0, 0.0), (4, "b", 10_000, 0.0, 0.0)]
    moves = meetings.motions(spark.createDataFrame(rows, FIXES), 1000)
    assert [m.seg for m in moves.collect()] == [1]


def test_a_crowded_cell_is_opened(spark):
    """A hundred thousand fixes of one hour in one cell: no bucket keeps more rows than a task takes."""
    n = F.col("id")
    rows = spark.range(100_000).select(n.alias("point_id"), (n % 1000).cast("string").alias("user_id"), (F.floor(n / 1000) * 36_000 + n % 1000 * 31).alias("t_ms"),
                                       ((n * 7919 % 1000) / 1e6).alias("lon"), ((n * 6271 % 1000) / 1e6).alias("lat"))
    listed = meetings.buckets(meetings.motions(rows), 1.0, 3_600_000, 500.0, 5_000)
    sizes = listed.groupBy(*meetings.BUCKET).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    assert sizes.most <= 5_000 and sizes.rows >= 2 * 99_000


def test_a_long_motion_travels_few_times(spark, monkeypatch):
    """Day-long motions are listed in each half hour inside a task, not before the rows are shuffled."""
    rows = [(u * 10 + i, f"u{u}", i * 86_000_000, -79 + u * 2e-4, 43 + i * .01) for u in range(20) for i in range(4)]
    moves, seen = meetings.motions(spark.createDataFrame(rows, FIXES)), []
    plain = meetings.buckets
    monkeypatch.setattr(meetings, "buckets", lambda *a: seen.append(plain(*a)) or seen[-1])
    got = meetings.approaches(moves, 100.0).collect()
    assert {(g.seg_a, g.seg_b): pytest.approx(g.closest_m, abs=1e-3) for g in got} == plain_approaches(rows, 100.0) and len(got) > 100
    assert seen[0].count() <= 20 * moves.count()


@pytest.mark.parametrize("hot", [None, 5])
def test_next_visitor_of_a_place(spark, hot):
    r = random.Random(3)
    seen = [(r.choice("pq"), r.choice("abc"), 10 * i, s := r.randint(0, 60), s + r.randint(0, 6)) for i in range(120)]
    got = {g.visit: (g.next_user, g.next_visit, g.next_ms, g.gap_s) for g in meetings.temporal_misses(
        spark.createDataFrame(seen, "place string, user_id string, visit long, arrive_ms long, leave_ms long"), 9, hot).collect()}
    want = {}
    for place, user, visit, _, leave in seen:
        later = sorted((t, v, u) for p, u, v, t, _ in seen if p == place and u != user and leave < t <= leave + 9)
        if later:
            want[visit] = (later[0][2], later[0][1], later[0][0], (later[0][0] - leave) / 1000)
    assert got == want and len(want) > 40


def test_visits_of_places(spark):
    rows = [(1, "a", 0, 0.0, 0.0), (2, "a", 5, 0.0, 0.0), (3, "a", 9, 1.0, 0.0), (4, "a", 12, 0.0, 0.0), (5, "b", 3, 0.0, 0.0)]
    got = meetings.visits(spark.createDataFrame(rows, FIXES), F.col("lon"), 2).orderBy("visit").collect()
    assert [(v.place, v.user_id, v.visit, v.arrive_ms, v.leave_ms, v.fixes) for v in got] == [
        (0.0, "a", 1, 0, 5, 2), (1.0, "a", 3, 9, 9, 1), (0.0, "a", 4, 12, 12, 1), (0.0, "b", 5, 3, 3, 1)]
    out = JOBS["temporal_misses"](spark.createDataFrame(rows, FIXES), max_gap_ms=10)["misses"].collect()
    assert [(m.visit, m.next_visit) for m in out] == [(5, 4)]


@pytest.mark.parametrize("hot", [None, 2])
def test_prisms_that_intersect(spark, hot):
    r = random.Random(5)
    pairs = [(i, -79 + r.uniform(0, .004), 43 + r.uniform(0, .004), t := r.randint(0, 900) * 1000, -79 + r.uniform(0, .004), 43 + r.uniform(0, .004), t + r.choice([400, 900, 3000]) * 1000) for i in range(12)]
    table = spark.createDataFrame(pairs, "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    occupied = shared.occupancy(prism.with_trip(table, 1.0), 1.0, 60_000, 10, 43.0)
    cells = {}
    for o in occupied.collect():
        for at in range(o.first, o.last + 1):
            cells.setdefault((o.hex_q, o.hex_r, at), []).append(o.pair_id)
    want = {}
    for (q, h, at), ids in cells.items():
        for a in ids:
            for b in ids:
                if a < b:
                    want.setdefault((a, b), []).append((q, h, at))
    got = {(g.pair_id, g.other): g for g in shared.shared_prisms(shared.shared_cells(occupied, hot_rows=hot), 60_000).collect()}
    assert want and got.keys() == want.keys()
    for k, v in want.items():
        times = [at * 60_000 for _, _, at in v]
        assert (got[k].shared_cells, got[k].shared_voxels, got[k].first_ms, got[k].last_ms) == (len({c[:2] for c in v}), len(v), min(times), max(times))


def test_observed_activities(spark):
    deg = 1 / GRID_M_PER_DEG
    prisms = spark.createDataFrame([("a", 0.0, 0.0, 0, 100 * deg, 0.0, 400_000), ("a", 0.0, 0.0, 100_000, 0.0, 0.0, 10_000_000)],
                                   "user_id string, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    acts = [(1, "a", 100_000, 90 * deg, 0.0), (2, "a", 50_000, 90 * deg, 0.0), (3, "a", -1, 0.0, 0.0), (4, "b", 100_000, 0.0, 0.0), (5, "a", 0, 0.0, 0.0),
            (6, "a", 300_000, 190 * deg, 0.0), (7, "a", 9_990_000, 50 * deg, 0.0), (8, "a", None, 0.0, 0.0), (9, "a", 5, None, 0.0), (10, None, 5, 0.0, 0.0)]
    out = JOBS["observed_activities"](spark.createDataFrame(acts, "activity_id long, user_id string, t_ms long, lon double, lat double"), prisms, mode="custom", custom_kmh=3.6)
    got = {g.activity_id: (g.prisms, g.reached, g.status) for g in out["activities"].collect()}
    assert got == {1: (2, 1, "inside"), 2: (1, 0, "outside"), 3: (0, 0, "no_prism"), 4: (0, 0, "no_prism"), 5: (1, 1, "inside"), 6: (2, 2, "inside"),
                   7: (1, 0, "outside"), 8: (0, 0, "no_prism"), 9: (1, 0, "outside"), 10: (0, 0, "no_prism")}
    assert {c.user_id: (c.inside, c.outside, c.no_prism) for c in out["counts"].collect()} == {"a": (3, 3, 2), "b": (0, 0, 1), None: (0, 0, 1)}


def _file(folder, name, rows, age):
    import pandas as pd
    path = f"{folder}/{name}.parquet"
    pd.DataFrame(rows, columns=["point_id", "t_ms", "lon", "lat", "value"]).to_parquet(path)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_stream_counts_what_a_batch_counts(spark, tmp_path):
    layout = streams.Layout(Grid(0.0, 0.0, 1.0, 1.0, 4, 3), 1000, 250)
    r = random.Random(7)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    os.mkdir(source)

    def rows(k, first, last):
        return [(k * 1000 + i, r.randint(first, last), r.uniform(-.5, 4.5), r.uniform(0, 3), r.choice([1.5, float("nan"), 4.0])) for i in range(80)]

    parts = [rows(k, k * 1500, k * 1500 + 1499) for k in range(4)]
    for k, part in enumerate(parts):
        _file(source, f"p{k}", part, k)
    schema = "point_id long, t_ms long, lon double, lat double, value double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    batch = lambda: {tuple(x) for x in streams.batch_cube(spark.read.schema(schema).parquet(source), layout, "value").select(*streams.KEYS, "count", "env_sum", "env_count").collect()}
    cube = lambda: {tuple(x) for x in streams.read_cube(spark, folder).collect()}
    streams.update_cube(stream(), layout, folder, "0 seconds", "value")
    assert cube() == batch() and sum(x.late for x in streams.late_fixes(spark, folder).collect()) == 0
    before = cube()
    streams.update_cube(stream(), layout, folder, "0 seconds", "value")  # nothing new: nothing repeated
    assert cube() == before
    inside = [p for p in rows(8, 100, 240) if 0 <= p[2] < 4]
    _file(source, "late", inside + [(9999, 6100, 1.5, 1.5, 1.0)], 10)  # slice -1 is long closed
    streams.update_cube(stream(), layout, folder, "0 seconds", "value")
    late = {x.t_idx: x.late for x in streams.late_fixes(spark, folder).collect() if x.late}
    assert late == {-1: len(inside)}
    assert cube() - before == {x for x in batch() - before if x[0] != -1}
    _file(source, "late2", [(10_000, 6200, 1.5, 1.5, 1.0)], 11)
    streams.update_cube(stream(), layout, folder, "0 seconds", "value")  # goes on from its checkpoint
    assert sum(x[3] for x in cube()) == sum(x[3] for x in batch()) - len(inside)


def test_jobs_on_empty_tables(spark):
    none = spark.createDataFrame([], FIXES)
    assert JOBS["encounters"](none)["encounters"].collect() == []
    assert JOBS["temporal_misses"](none, lat0=40.0)["misses"].collect() == []
    pairs = spark.createDataFrame([], "pair_id long, user_id string, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    assert JOBS["prism_intersections"](pairs)["intersections"].collect() == []
    acts = spark.createDataFrame([], "activity_id long, user_id string, t_ms long, lon double, lat double")
    assert JOBS["observed_activities"](acts, pairs)["activities"].collect() == []
