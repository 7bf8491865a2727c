"""Components, bundles and daily routines against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import routines
from chronoweave.operators.components import connected
from chronoweave.plans import JOBS

DAY = 86_400_000


def plain_components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("hot", [None, 3])
def test_components(spark, hot):
    r = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, 501 + i) for i in range(40)]
    edges = chain + star + [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(900, 900)]
    got = {c.node: c.component for c in connected(spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long"), hot).collect()}
    assert got == plain_components(edges)
    assert connected(spark.createDataFrame([], "a string, b string")).collect() == []


def plain_bundles(met, least, min_ms):
    marks = sorted({t for _, _, s, e in met for t in (s, e)})
    live, out = {}, []
    for s, e in zip(marks, marks[1:]):
        comp = {}
        for x, c in plain_components([(a, b) for a, b, f, t in met if f < e and s < t]).items():
            comp.setdefault(c, set()).add(x)
        groups = {tuple(sorted(m)) for m in comp.values() if len(m) >= least}
        for m in list(live):
            if m not in groups:
                out.append((m, *live.pop(m)))
        for m in groups:
            live[m] = (live[m][0] if m in live else s, e)
    return sorted((m, s, e) for m, s, e in out + [(m, *x) for m, x in live.items()] if e - s >= min_ms)


@pytest.mark.parametrize("slot", [7, 50, 100_000])
def test_bundles(spark, slot):
    r = random.Random(2)
    met = []
    for _ in range(70):
        a, b = sorted(r.sample("abcdefghij", 2))
        s = r.randint(0, 180)
        met.append((a, b, s, s + r.randint(1, 40)))
    table = spark.createDataFrame([(a, b, float(s), float(e)) for a, b, s, e in met] + [("x", "y", 5.0, 5.0)], "user_a string, user_b string, start_ms double, end_ms double")
    got = sorted((tuple(b.members), b.start_ms, b.end_ms) for b in routines.bundles(table, 3, 2, slot).collect())
    want = plain_bundles(met, 3, 2)
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("hot", [1, 30, 400])
def test_crowded_slots_of_bundles(spark, hot):
    """Groups within slots that lasting encounters crowd, and over their borders."""
    r = random.Random(5)
    users = [f"u{i}" for i in range(24)]
    met = [(*sorted(r.sample(users[:12], 2)), s := r.randint(0, 40), s + r.randint(200, 300)) for _ in range(40)]
    met += [(*sorted(r.sample(users, 2)), s := r.randint(0, 300), s + r.randint(1, 30)) for _ in range(60)]
    table = spark.createDataFrame([(a, b, float(s), float(e)) for a, b, s, e in met] + [("x", None, 5.0, 9.0), ("x", "y", None, 9.0)],
                                  "user_a string, user_b string, start_ms double, end_ms double")
    for min_ms in (0, 6):
        got = sorted((tuple(b.members), b.start_ms, b.end_ms) for b in routines.bundles(table, 3, min_ms, 50, hot).collect())
        want = plain_bundles(met, 3, min_ms)
        assert len(want) > 10 and got == want


def test_crowds_are_not_listed_for_every_change(spark):
    """What is shuffled for a crowd follows its encounters, not their product with the beginnings and endings among them."""
    r = random.Random(6)
    users = [f"u{i:02}" for i in range(36)]
    met = [(a, b, s := r.randint(0, 400_000), s + r.randint(1, 400_000)) for i, a in enumerate(users) for b in users[i + 1:]]
    table = spark.createDataFrame([(a, b, float(s), float(e)) for a, b, s, e in met], "user_a string, user_b string, start_ms double, end_ms double")

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().endswith(".data")}

    before = shuffled()
    got = sorted((tuple(b.members), b.start_ms, b.end_ms) for b in routines.bundles(table, 3, 2_000).collect())
    assert sum(n for name, n in shuffled().items() if name not in before) < 400_000
    assert got == plain_bundles(met, 3, 2_000) and len(got) > 1


def test_walking_together(spark):
    """Three walk side by side for ten minutes, then one turns away."""
    rows = []
    for k, u in enumerate("abc"):
        for i in range(21):
            away = 0.002 * max(0, i - 10) if u == "c" else 0.0
            rows.append((k * 100 + i, u, i * 60_000, 0.0001 * i, 0.0002 * k + away))
    out = JOBS["bundles"](spark.createDataFrame(rows, "point_id long, user_id string, t_ms long, lon double, lat double"), reach_m=30.0)["bundles"].collect()
    assert [(b.members, b.size, b.start_ms) for b in out] == [(["a", "b", "c"], 3, 0)] and 600_000 < out[0].end_ms < 660_000


def test_sessions_and_stations(spark):
    r = random.Random(3)
    fixes = [(i, r.choice("ab"), r.randint(0, 60 * DAY), r.uniform(0, .008), r.uniform(0, .008)) for i in range(400)]
    stays = routines.sessions(spark.createDataFrame(fixes, "point_id long, user_id string, t_ms long, lon double, lat double"), 3_600_000)
    placed = routines.stations(stays, 0.001, 4).collect()
    assert sum(p.fixes for p in placed) == 400
    cells = {}
    for p in placed:
        cells.setdefault((p.user_id, int(p.lon // .001), int(p.lat // .001)), []).append(p)
    cores = {c for c, v in cells.items() if len(v) >= 4}
    touch = lambda a, b: a[0] == b[0] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 1
    comp = plain_components([(a, b) for a in cores for b in cores if touch(a, b)])
    for c, v in cells.items():
        near = [comp[k][1:] for k in cores if touch(c, k)]
        want = comp[c][1:] if c in cores else min(near) if near else None
        assert all((tuple(p.station) if p.station else None) == want for p in v)


def test_days_repeat(spark):
    home, work, shop = (0.0, 0.0), (0.5, 0.5), (0.9, 0.1)
    rows, n = [], 0
    for day in range(10):
        stops = [home, work, home] if day % 5 else [home, shop, work, home]
        for k, (x, y) in enumerate(stops):
            for minute in (0, 10):
                rows.append((n := n + 1, "a", day * DAY + (6 + 4 * k) * 3_600_000 + minute * 60_000, x + .001, y + .001))
    rows.append((9999, "a", 20 * DAY, 5.0, 5.0))  # seen once: no station
    out = JOBS["daily_routines"](spark.createDataFrame(rows, "point_id long, user_id string, t_ms long, lon double, lat double"), cell_deg=0.01, min_stays=2)
    assert out["stays"].filter("station is null").count() == 1
    name = {(0, 0): "h", (50, 50): "w", (90, 10): "s"}
    text = lambda q: "".join(name[tuple(x)] for x in q)
    assert {text(x.sequence): (x.days, x.share) for x in out["routines"].collect()} == {"hwh": (8, 0.8), "hswh": (2, 0.2)}
    assert {text([x["from"], x["to"]]): x["count"] for x in out["transitions"].collect()} == {"hw": 8, "wh": 10, "hs": 2, "sw": 2}
    assert out["days"].select(F.max("day")).first()[0] == 9
