import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.operators import area, cube, fold, grid, kernel, network, pasta, prism, trajectory
from chronoweave.operators.nearest import nearest
from chronoweave.operators.quantiles import exact_quantiles
from chronoweave.operators.sequence import Timeline, key_offsets
from chronoweave.operators.skew import salted_join


@pytest.fixture(scope="module")
def hot(spark):
    """One user owns most rows, many of them at a single instant."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"u{i % 11}", 1_700_000_000_000 if i % 5 == 0 else 1_700_000_000_000 + rng.randrange(10_000) * 1000,
             -79.4 + rng.random() * 0.02, 43.6 + rng.random() * 0.02, rng.choice("abc"), rng.random()) for i in range(1200)]
    return spark.createDataFrame(rows, "point_id long, user_id string, t_ms long, lon double, lat double, label string, value double").cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_timeline_is_the_same_when_split(hot):
    def work(limit):
        line = Timeline(hot, ["user_id"], "t_ms", "point_id", limit).neighbours({"p": F.col("label")}, {"n": F.col("point_id")})
        line = line.running(rn=F.lit(1)).prior_max(top=F.col("value")).key_minimum(first=F.col("t_ms"))
        return line.result().select("point_id", "p", "n", "rn", "top", "first")

    split = Timeline(hot, ["user_id"], "t_ms", "point_id", 40)
    assert split.split and split.df.groupBy(*split.group).count().agg(F.max("count")).first()[0] <= 80
    assert same(work(None), work(40))


def test_stays_and_runs_are_the_same_when_split(hot):
    assert same(trajectory.stay_points(hot, 300.0, 60_000), trajectory.stay_points(hot, 300.0, 60_000, hot_rows=40))
    runs = [trajectory.stays_by_field(trajectory.trajectory(hot), "label", limit).select("user_id", "run", "label", "point_count") for limit in (None, 40)]
    assert same(*runs)


def test_stay_points_against_all_pairs(hot):
    rows = hot.collect()

    def dist(a, b):
        p, q = math.radians(a.lat), math.radians(b.lat)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b.lon - a.lon) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {a.point_id for a in rows if any(b.point_id != a.point_id and b.user_id == a.user_id and abs(a.t_ms - b.t_ms) <= 20_000 and dist(a, b) < 120 for b in rows)}
    got = {r.point_id for r in trajectory.stay_points(hot, 120.0, 20_000).collect()}
    assert 0 < len(want) < len(rows) and got == want


def test_salted_join_matches_plain_join(hot, spark):
    users = hot.select("user_id").distinct().withColumn("k", F.length("user_id"))
    plain = hot.join(users, "user_id").select("point_id", "k")
    assert same(plain, salted_join(hot, users, ["user_id"], hot_rows=50).select("point_id", "k"))


def test_key_offsets(hot):
    counts = hot.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    got = {r.user_id: (r.o, r.i) for r in key_offsets(counts, ["user_id"], {"o": F.col("n"), "i": F.lit(1)}).collect()}
    seen = 0
    for i, r in enumerate(sorted(counts.collect())):
        assert got[r.user_id] == (seen, i)
        seen += r.n


def test_exact_quantiles(hot, monkeypatch):
    import chronoweave.operators.quantiles as q

    monkeypatch.setattr(q, "FETCH", 50)
    values = np.array([r.v for r in hot.select(F.round("value", 2).alias("v")).collect()])
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    assert exact_quantiles(hot, F.round("value", 2), probs) == pytest.approx(np.quantile(values, probs).tolist())


@pytest.mark.parametrize("limit", [30, 10_000])
def test_folds_do_not_depend_on_blocks(hot, limit):
    def walk(step_state):
        kept = []
        for r in step_state:
            if not kept or (r.t_ms - kept[-1].t_ms >= 60_000 and fold._earth(kept[-1].lon, kept[-1].lat, r.lon, r.lat) >= 500):
                kept.append(r)
        return kept

    users: dict = {}
    for r in sorted(hot.collect(), key=lambda r: (r.user_id, r.t_ms, r.point_id)):
        users.setdefault(r.user_id, []).append(r)
    want = set()
    for rows in users.values():
        want |= {r.point_id for r in walk(rows)} | {rows[-1].point_id}
    got = {r.point_id for r in fold.anchor_fixes(hot, 60_000, 500.0, block_rows=limit).collect()}
    assert got == want


def test_clusters_do_not_depend_on_blocks(hot):
    df = hot.withColumn("z", F.lit(1.0))
    a, b = (fold.static_clusters(df, "user_id", 700.0, block_rows=n).select("user_id", "cluster", "size") for n in (30, 10_000))
    assert same(a, b)


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    items = np.vstack([rng.random((150, 2)), 0.5 + rng.random((400, 2)) * 1e-4, [[0.2, 0.2]] * 5])  # a dense spot and copies
    pts = np.vstack([rng.random((300, 2)), rng.random((40, 2)) * 8 - 4, 0.5 + rng.random((40, 2)) * 2e-4])
    i_df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(items)], "iid long, x double, y double").withColumn("g", F.lit(1))
    p_df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid long, x double, y double").withColumn("g", F.lit(1))
    got = {r.pid: (r.hit.item.iid, r.hit.d2) for r in nearest(p_df, i_df, ["g"], "pid", "iid").collect()}
    assert len(got) == len(pts)
    for k, p in enumerate(pts):
        d2 = ((items - p) ** 2).sum(axis=1)
        assert got[k][1] == pytest.approx(d2.min(), rel=1e-9, abs=1e-18) and d2[got[k][0]] == pytest.approx(d2.min(), rel=1e-9, abs=1e-18)
    empty = nearest(p_df.withColumn("g", F.lit(2)), i_df, ["g"], "pid", "iid")
    assert empty.count() == len(pts) and empty.filter("hit is not null").count() == 0


def test_area_border_counts_and_holes_do_not(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]
    hole = [{"x": 0.4, "y": 0.4}, {"x": 0.6, "y": 0.4}, {"x": 0.6, "y": 0.6}, {"x": 0.4, "y": 0.6}]
    sides = area.load_area(spark.createDataFrame([(1, [ring, hole])], "area_id long, rings array<array<struct<x:double,y:double>>>"))
    pts = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 1.0, 0.5), (4, 1.1, 0.5), (5, 0.0, 0.0), (6, 0.4, 0.5)], "id int, lon double, lat double")
    assert {r.id for r in area.points_in_area(pts, sides).collect()} == {1, 3, 5, 6}
    lines = spark.createDataFrame([(1, [{"x": -1.0, "y": 0.1}, {"x": 2.0, "y": 0.1}]), (2, [{"x": -1.0, "y": 2.0}, {"x": 2.0, "y": 2.0}]),
                                   (3, [{"x": 0.45, "y": 0.5}, {"x": 0.55, "y": 0.5}])], "source_id long, coords array<struct<x:double,y:double>>")
    assert {r.source_id for r in area.features_in_area(lines, sides, "source_id").collect()} == {1}
    big = spark.createDataFrame([(1, [{"x": -5.0, "y": -5.0}, {"x": 5.0, "y": -5.0}, {"x": 0.0, "y": 9.0}])], "id long, coords array<struct<x:double,y:double>>")
    assert area.features_in_area(big, sides, "id", closed=True).count() == 1


def test_area_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 60
    ang = np.sort(rng.random(n) * 2 * np.pi)
    rad = 0.3 + rng.random(n)
    ring = [{"x": float(r * np.cos(a)), "y": float(r * np.sin(a))} for a, r in zip(ang, rad)]
    sides = area.load_area(spark.createDataFrame([(1, [ring])], "area_id long, rings array<array<struct<x:double,y:double>>>"))
    pts = rng.random((600, 2)) * 3 - 1.5
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, lon double, lat double")

    def inside(x, y):
        odd = False
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if (p["y"] > y) != (q["y"] > y) and p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]) > x:
                odd = not odd
        return odd

    assert {r.id for r in area.points_in_area(df, sides).collect()} == {i for i, (x, y) in enumerate(pts) if inside(x, y)}


def test_cube_counts_add_up(hot):
    out = cube.space_time_cube(hot, env="value", align=True)
    assert out["cubes"].agg(F.sum("count")).first()[0] == hot.count() == out["ground"].agg(F.sum("count")).first()[0]
    assert out["segments"].count() == hot.count() - hot.select("user_id").distinct().count()


def test_density_conserves_mass_on_a_fine_grid(hot):
    ext = grid.extent(hot)
    h = 0.004
    g = grid.grid_spec(ext, h, cell_deg=0.0005, cap=10**6)
    mass = kernel.density_2d(hot, g, h).agg(F.sum("density")).first()[0] * g.cell_x * g.cell_y
    assert mass == pytest.approx(hot.count(), rel=0.02)


def test_many_slices_equal_few(hot, monkeypatch):
    timed = hot.withColumn("t_s", (F.col("t_ms") - 1_700_000_000_000) / 1000.0)
    g = grid.grid_spec(grid.extent(hot), 0.004)
    run = lambda: {(r.t_idx, r.row, r.col): r.density for r in kernel.density(timed, g, [0.0, 3000.0, 6000.0], 0.004, 2000.0).collect()}
    wide = run()
    monkeypatch.setattr(kernel, "WIDE_SLICES", 1)
    assert run() == pytest.approx(wide)


def test_time_slices():
    s = grid.Slices([0.0, 10.0, 20.0])
    assert s.n == 2 and s.centers() == [5.0, 15.0]


def test_fixed_slices_widen_at_the_cap(spark):
    df = spark.range(2).select((F.col("id") * 10_000.0).alias("t"))
    s = grid.time_slices(df, F.col("t"), "fixed_duration", 0, duration_s=10.0, max_slices=240)
    assert s.n == 240 and s.warnings
    whole = grid.time_slices(df, F.col("t"), "fixed_duration", 0, duration_s=10.0)
    assert whole.n == 1000 and not whole.warnings
    times = spark.createDataFrame([(10.0 * i + d,) for i in range(0, 1000, 7) for d in (-1e-9, 0.0, 4.0)], "t double")
    tree = grid.Slices(whole.edges)
    assert times.filter(whole.index(F.col("t")) != tree.index(F.col("t"))).count() == 0
    with pytest.raises(ValueError):
        grid.time_slices(df, F.col("t"), "fixed_duration", 0)


def test_lattice_times_are_manhattan(spark):
    n, cost = 7, 10.0
    nodes = [(r, c) for r in range(n) for c in range(n)]
    edges = [(r * n + c, r * n + c + 1, cost) for r, c in nodes if c < n - 1] + [(r * n + c, (r + 1) * n + c, cost) for r, c in nodes if r < n - 1]
    e = spark.createDataFrame(edges, "u long, v long, cost_sec double")
    src = spark.createDataFrame([(0, 75.0), (24, 1000.0)], "source long, cutoff double")
    got = {(r.source, r.node): r.cost for r in network.shortest_times(src, e).collect()}
    want = {(s, r * n + c): (abs(r - s // n) + abs(c - s % n)) * cost for s in (0, 24) for r, c in nodes}
    assert got == {k: v for k, v in want.items() if k[0] == 24 or v <= 75.0}


def test_shuffled_adjacency_gives_the_same(spark, monkeypatch):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (0, 2, 20.0)], "u long, v long, cost_sec double")
    src = spark.createDataFrame([(0, 100.0)], "source long, cutoff double")
    monkeypatch.setattr(network, "fits_broadcast", lambda *_: False)
    assert {r.node: r.cost for r in network.shortest_times(src, e).collect()} == {0: 0.0, 1: 5.0, 2: 10.0}


def test_sheet_hulls_against_extremes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pts = rng.random((500, 4))
    df = spark.createDataFrame([(1, 0, *map(float, p)) for p in pts], "pair_id int, sheet int, lon0 double, lat0 double, lon1 double, lat1 double")
    monkeypatch.setattr(prism, "HULL_PART", 64)
    ring = [(p.x, p.y) for p in prism.sheet_hulls(df).first().ring]
    cloud = np.vstack([pts[:, :2], pts[:, 2:]])
    for a in np.linspace(0, 2 * np.pi, 50):
        d = np.array([np.cos(a), np.sin(a)])
        assert (np.array(ring) @ d).max() == pytest.approx((cloud @ d).max())
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        assert ((x1 - x0) * (cloud[:, 1] - y0) - (y1 - y0) * (cloud[:, 0] - x0)).min() > -1e-12


def test_windows_need_fixed_ends(spark):
    rows = [("p", 1, 0.0, 0.0, 0, "home"), ("p", 2, 0.01, 0.0, 3_600_000, "shopping"), ("p", 3, 0.02, 0.0, 10_800_000, "work"), ("p", 4, 0.0, 0.0, 18_000_000, "leisure")]
    df = spark.createDataFrame(rows, "person_id string, episode_id long, lon double, lat double, start_ms long, activity_type string")
    w = pasta.with_feasibility(pasta.anchor_windows(pasta.activity_episodes(df))).collect()
    assert len(w) == 1 and (w[0].from_activity, w[0].to_activity, w[0].budget_s, w[0].feasible) == ("home", "work", 7200.0, True)


def test_time_filters(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (None,)], "time_progress double")
    assert prism.time_slice(df, 0.3).count() == 2
    assert prism.time_slice(df, 0.5, "window", 10).count() == 1
    assert prism.time_slice(df, 1.0).count() == 3


def test_blocks_stay_small_on_fractions_and_ties(spark):
    """A hot key ordered by fractions, one whose rows share an instant, and one crowded at one end."""
    rows = [("f", i, i / 2000.0) for i in range(2000)] + [("t", i, 0.5) for i in range(2000)] + [("c", i, 1.0 / (1 + i * i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, a double")
    line = Timeline(df, ["k"], "a", "i", 50)
    assert line.split and line.df.groupBy(*line.group).count().agg(F.max("count")).first()[0] <= 50
    got = line.running(n=F.lit(1)).neighbours(previous={"p": F.col("i")}).result()
    plain = Timeline(df, ["k"], "a", "i").running(n=F.lit(1)).neighbours(previous={"p": F.col("i")}).result()
    assert sorted(map(tuple, got.select("k", "i", "n", "p").collect()), key=repr) == sorted(map(tuple, plain.select("k", "i", "n", "p").collect()), key=repr)


def test_row_budget_does_not_grow_with_the_table(spark):
    from chronoweave.operators import skew

    df = spark.range(5000).select(F.lit("one").alias("k"))
    hot, budget = skew.hot_keys(df, ["k"], 100)
    assert budget == 100 and hot.first()._parts == 50 and skew.hot_keys(df, ["k"])[0] is None
    assert skew.HOT_ROWS == skew.hot_keys(df, ["k"])[1]
    # a table with nothing but its key is spread too
    spread = skew.salted_join(df, spark.createDataFrame([("one", 1)], "k string, v int"), ["k"], hot_rows=100)
    assert spread.count() == 5000
