"""Counts taken on the way, time columns to choose from, and tables laid out by place."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import time as when
from chronoweave.functions.geo import box_contains, box_meets
from chronoweave.operators import area
from chronoweave.plans import JOBS
from chronoweave.plans.jobs import auto_budget, roads_near
from chronoweave.plans.run import run_job
from chronoweave.report import Report
from chronoweave.schema import TrajectorySchema
from chronoweave.sources import layout, points


def jobs_of(spark, name, work):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    work()
    sc.setJobGroup("none", "none")
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_a_report_costs_no_scan(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 1.0, 2.0), (2, "soon", 1.0, 2.0), (3, None, 1.0, 2.5), (4, "2024-01-01 11:00:00", 1.5, 2.0)]
    df = spark.createDataFrame(rows, "id long, at string, lon double, lat double")
    schema = TrajectorySchema(time="at", point_id="id")
    report = Report()
    write = lambda d, n: lambda: d.write.parquet(str(tmp_path / n))
    plain = jobs_of(spark, "plain", write(schema.apply(df), "a"))
    counted = jobs_of(spark, "counted", write(schema.apply(df, report=report), "b"))
    assert plain == counted > 0
    got = [tuple(r) for r in report.table(spark).collect()]
    assert got == [("time", "rows", 4.0, None), ("time", "kept", 2.0, None), ("time", "warning", None, "2 of 4 rows have no readable time")]


def test_points_clipped_and_counted(spark):
    square = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]]
    sides = area.load_area(spark.createDataFrame([(1, square)], "area_id long, rings array<array<struct<x:double,y:double>>>"))
    pts = spark.createDataFrame([(i, i / 10, 0.5) for i in range(20)], "id long, lon double, lat double")
    report = Report()
    assert area.clip_points(pts, sides, report).count() == 11
    assert {(r.name, r.value) for r in report.table(spark).collect()} == {("points", 20.0), ("kept", 11.0)}


def test_jobs_report_what_they_leave_out(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0.0, 0.0, 0, 0.0, 0.001, 600_000), (2, 0.0, 0.0, 0, 0.0, 1.0, 600_000)],
                                  "pair_id long, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long")
    out = run_job(JOBS["two_anchor_prism"], pairs, into=str(tmp_path / "p"), lat0=0.0)
    assert [(r.name, r.value, r.message) for r in out["report"].collect()] == [
        ("feasible", 1.0, None), ("infeasible", 1.0, None), ("warning", None, "1 trips are too far for their time")]
    assert out["anchors"].count() == 4
    fixes = spark.createDataFrame([(i, "u", i * 3_600_000, 0.01 * i, 0.0) for i in range(50)], "point_id long, user_id string, t_ms long, lon double, lat double")
    out = run_job(JOBS["space_time_cube"], fixes, into=str(tmp_path / "c"), method="fixed_duration", duration_s=60.0, max_slices=10, path=False)
    rows = {r.name: r for r in out["report"].collect()}
    assert rows["fixes"].value == 50 and "widened" in rows["note"].message
    assert out["cubes"].agg(F.max("t_idx")).first()[0] == 9


def test_first_time_that_can_be_read(spark):
    rows = [(1, None, "2024-01-01T00:00:01"), (2, 1_700_000_000, "x"), (3, None, "x")]
    df = spark.createDataFrame(rows, "id long, _timestamp long, time string").withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})
    got = {r.point_id: r.t_ms for r in TrajectorySchema(point_id="id").apply(df).collect()}
    assert got == {1: 1_704_067_201_000, 2: 1_700_000_000_000}
    with pytest.raises(ValueError, match="not found"):
        TrajectorySchema(time=("a", "b")).apply(df)
    bad = df.filter("id = 3")
    with pytest.raises(ValueError, match="could not parse any time"):
        when.with_epoch_ms(bad, ["_timestamp", "time"], "some")
    assert when.with_epoch_ms(df, "time", "some").count() == 1
    assert when.with_epoch_ms(df.limit(0), "time", "some").count() == 0


def test_slice_anchors(spark):
    assert when.anchor_millis(spark, 1_700_000_000) == when.anchor_millis(spark, 1_700_000_000_000) == 1_700_000_000_000
    assert when.anchor_millis(spark, "2024-01-01 06:00") == 1_704_088_800_000
    assert when.anchor_millis(spark, " ") is when.anchor_millis(spark, "noon") is when.anchor_millis(spark, None) is None
    fixes = spark.createDataFrame([(i, "u", 1_704_067_200_000 + i * 3_600_000, 0.01 * i, 0.0) for i in range(24)], "point_id long, user_id string, t_ms long, lon double, lat double")
    for anchor in ("2023-12-31 18:00:00", 1_704_045_600):
        out = JOBS["space_time_cube"](fixes, method="fixed_duration", duration_s=36_000.0, anchor_ms=anchor, path=False)["cubes"]
        # slices begin at 18:00 of the day before, 04:00, 14:00
        assert {r.t_idx: r.n for r in out.groupBy("t_idx").agg(F.sum("count").alias("n")).collect()} == {0: 4, 1: 10, 2: 10}


def test_first_rejected_rows(spark):
    rows = [(i, str(200 - i), "5") for i in range(60)] + [(99, "x", "y")]
    _, rejected, _ = points.csv_to_points(spark.createDataFrame(rows, "line long, x string, y string").repartition(5), "x", "y")
    got = points.first_errors(rejected, "line").collect()
    assert [r.line for r in got] == list(range(10)) and all(r.error for r in got)
    assert points.first_errors(rejected, "line", 100).count() == 21


def test_budget_of_a_pair_with_one_origin(spark):
    origins = spark.createDataFrame([(1, 0, 10), (2, 0, 10), (2, 400_000, 11), (3, 0, 1), (3, 720_000, 2)], "pair_id long, t_ms long, cluster long")
    assert {r.pair_id: r.budget_sec for r in auto_budget(origins, 300.0).collect()} == {1: 900.0, 2: 400.0, 3: 720.0}


def test_boxes(spark):
    b = spark.createDataFrame([(0.0, 0.0, 2.0, 1.0)], "west double, south double, east double, north double")
    box = ("west", "south", "east", "north")
    cases = [((2, 1, 3, 3), True, False), ((2.1, 0, 3, 3), False, False), ((0.5, 0.5, 1, 1), True, True), ((0, 0, 2.0000005, 1), True, True), ((-1, -1, 5, 5), True, False)]
    for other, meets, contains in cases:
        got = b.select(box_meets(box, other).alias("m"), box_contains(box, other).alias("c")).first()
        assert (got.m, got.c) == (meets, contains)


def test_place_on_the_curve(spark):
    r = random.Random(1)
    some = [(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(50)] + [(-180.0, -90.0), (180.0, 90.0)]

    def plain(lon, lat):
        x, y = (min((1 << 24) - 1, int((v - a) / s * (1 << 24))) for v, a, s in ((lon, -180, 360), (lat, -90, 180)))
        return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(24))

    got = spark.createDataFrame(some, "lon double, lat double").withColumn("p", layout.curve_place(F.col("lon"), F.col("lat"))).collect()
    assert [g.p for g in got] == [plain(g.lon, g.lat) for g in got]


def rows_read(df):
    """Rows that the scan of a plan gave on, after running it."""
    n = len(df.collect())
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return n, leaf.metrics().apply("numOutputRows").value()


def test_a_box_reads_little(spark, tmp_path):
    n = F.col("id")
    lon, lat = (n * 7919 % 100_003) / 100_003.0 * 20 - 90, (n * 6271 % 99_991) / 99_991.0 * 10 + 40
    line = F.array(F.struct(lon.alias("x"), lat.alias("y")), F.struct((lon + 0.01).alias("x"), (lat + 0.01).alias("y")))
    roads = spark.range(120_000).select(n.alias("source_id"), F.lit("residential").alias("highway"), F.lit(None).cast("string").alias("maxspeed"), line.alias("coords"))
    path = str(tmp_path / "roads")
    layout.write_places(roads, path, "coords", files=4, group_bytes=64 << 10)
    whole = spark.read.parquet(path)
    for box in ((-85.0, 43.0, -84.5, 43.5), (-80.0, 45.0, -79.0, 46.0)):
        found, read = rows_read(layout.read_places(spark, path, box))
        assert found == layout.with_bounds(roads, "coords").filter(box_meets(layout.BOX, box)).count() > 50
        assert read < 120_000 / 4
    # a job asks for the roads of a zone the same way, and gets what a table without bounds gives
    discs = spark.createDataFrame([(-81.0, 45.0, 3000.0)], "lon double, lat double, radius_m double")
    some, read = rows_read(roads_near(whole, discs, 17))
    assert read < 120_000 / 4 and some == roads_near(roads, discs, 17).count() > 0
