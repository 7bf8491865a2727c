"""What a step costs follows its input: no hidden broadcasts, no eager by-products, no call a tiny group."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.hexgrid import with_hexes
from chronoweave.llm.matches import same_spans
from chronoweave.operators import fold, pasta, prism
from chronoweave.operators.overlap import overlapping, width_of
from chronoweave.operators.skew import salted_join
from chronoweave.plans import JOBS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bins_at_a_pole_stay_within_the_world(spark):
    rows = spark.createDataFrame([(1, 10.0, 90.0, 300.0), (2, 10.0, 44.0, 300.0), (3, 10.0, 44.0, None)], "id int, lon double, lat double, r double")
    got = {r["id"]: r for r in with_hexes(rows, F.col("lon"), F.col("lat"), F.col("r"), 6, 44.0).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("hex_r").alias("rows")).collect()}
    assert got[2]["n"] < 20 and 3 not in got
    around = 360 * 111_320 * 0.7193398 / (3729.0 * 3**0.5)  # bins of one row around the world
    assert got[1]["n"] <= got[1]["rows"] * (around + 4)


def test_large_lookups_are_not_broadcast_by_a_guess(spark):
    big = spark.range(100).withColumn("k", F.col("id") % 7)
    small = spark.range(7).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("v"))
    for hot_rows in (None, 5):
        joined = salted_join(big, small, ["k"], hot_rows=hot_rows)
        assert "SortMergeJoin" in plan(joined)
        assert joined.count() == 100 * 51


def test_tiny_groups_share_a_call_and_long_ones_span_batches(spark):
    rows = [(f"u{u}", t, u * 100 + t) for u in range(40) for t in range(1 + u % 5)] + [("long", t, 10_000 + t) for t in range(60)]
    df = spark.createDataFrame(rows, "user_id string, t_ms long, point_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for limit in (10, 1000):
            def step(block, start):
                n, marks = (0.0 if start is None else start["n"]), []
                for _ in block["t_ms"]:
                    n += 1
                    marks.append(int(n))
                return marks, {"n": n}

            out = fold.chained(df, "user_id", "t_ms", "point_id", [], step, ["n"], T.LongType(), limit)
            assert {(r.user_id, r.t_ms): r["mark"] for r in out.collect()} == {(u, t): t + 1 for u, t, _ in rows}
            if limit == 1000:
                assert "FlatMapGroupsInPandas" not in plan(out)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_anchor_windows_do_not_wait_for_the_surface(spark, monkeypatch):
    rows = [("p", 1, 0.0, 0.0, 0, "home"), ("p", 2, 0.001, 0.0, 600_000, "shopping"), ("p", 3, 0.002, 0.0, 7_200_000, "work")]
    df = spark.createDataFrame(rows, "person_id string, episode_id long, lon double, lat double, start_ms long, activity_type string")
    whole = JOBS["activity_surface"](df, cell_m=500.0)
    top = whole["surface"].agg(F.max("weighted_dwell_minutes")).first()[0]
    assert all(abs(r.height_m - max(20.0, r.weighted_dwell_minutes / top * 1000)) < 1e-9 for r in whole["surface"].collect())
    real = pasta.window_cells
    monkeypatch.setattr(pasta, "window_cells", lambda *a, **k: real(*a, **k).withColumn("dwell_s", F.raise_error(F.lit("read")).cast("double")))
    assert JOBS["activity_surface"](df, cell_m=500.0)["anchor_windows"].count() == 2


def test_wider_steps_between_classes_list_less_and_meet_the_same(spark):
    lengths = [0, 1, 5, 40, 300, 5_000, 70_000, 900_000, 10_000_000, 170_000_000]
    left = [(i % 3, i, i * 977, i * 977) for i in range(60)]
    right = [(j % 3, j, j * 613 - n // 2, j * 613 - n // 2 + n) for j, n in enumerate(lengths * 4)]
    a, b = spark.createDataFrame(left, "k long, i long, s long, e long"), spark.createDataFrame(right, "k long, j long, p long, q long")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    for step, hot in ((1, None), (4, None), (4, 3)):
        out = overlapping(a, b, ["k"], ("s", "e"), ("p", "q"), hot, step)
        assert sorted((x.i, x.j) for x in out.collect()) == want
    spans = spark.createDataFrame([(2**n,) for n in range(40)], "n long")
    assert spans.select(width_of(F.col("n"), 4)).distinct().count() <= 11 and spans.filter(width_of(F.col("n"), 4) <= F.col("n")).isEmpty()


def test_walls_stay_with_their_pair(spark, monkeypatch):
    pairs = spark.createDataFrame([(p, 0.0, 0.0, 0, 0.002 * (p + 1), 0.001, 1_800_000) for p in range(3)],
                                  "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")

    def blocked(grids):
        cells = grids.select("pair_id", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
        return cells.filter((F.col("pair_id") + F.col("row") * 7 + F.col("col") * 3) % 5 == 0).select("pair_id", "row", "col")

    plans, relax = [], prism.relax

    def watched(seeds, expand, key):
        plans.append(plan(expand(seeds.withColumn("fresh", F.lit(True)))))
        return relax(seeds, expand, key)

    monkeypatch.setattr(prism, "relax", watched)
    found = []
    for frames in (20_000, 0):
        monkeypatch.setattr(prism, "FRAMES", frames)
        out = JOBS["grid_prism"](pairs, blocked, grid=40)
        found.append(sorted((r.pair_id, r.role, r.row, r.col, round(r.cost, 6)) for r in out["times"].collect()))
        shut = out["times"].join(blocked(out["grids"]).join(prism.corridor_cells(out["grids"]), ["pair_id", "row", "col"], "left_anti"), ["pair_id", "row", "col"], "left_semi")
        assert shut.isEmpty() and not blocked(out["grids"]).isEmpty()
    assert found[0] == found[1] and len(found[0]) > 1000
    assert "Broadcast" not in plans[1] and plans[1].count("Join") == 1  # one meeting with the pair's own frame


def test_spans_compare_by_their_characters():
    codes = np.array([ord(c) for c in "abcdefgh abcdefgh abcdefgx a abc"], np.uint32)
    for add in (0, 70_000):  # characters above 16 bits are compared one by one
        own = codes + add
        first, end = np.array([0, 9, 27, 9]), np.array([8, 17, 28, 9])
        assert same_spans(own, first, end, np.array([9, 0, 0, 0]), np.array([17, 8, 1, 0]))
        assert not same_spans(own, first, end, np.array([9, 18, 0, 0]), np.array([17, 26, 1, 0]))
        assert not same_spans(own, first, end, np.array([9, 0, 0, 0]), np.array([17, 8, 2, 0]))
