import math

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import coords, geo, hexgrid, intervals, roads
from chronoweave.functions import time as when
from chronoweave.functions.lens import circle_overlap, clip_to_ring


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_text_times(spark):
    rows = [("2024-01-31T10:00:00Z", 1706695200000), ("2024-01-31 10:00:00.250", 1706695200250), ("1/31/2024 10:00", 1706695200000),
            ("2024-01-31T10:00:00+05:00", 1706695200000), ("2024/01/31 10:00:00", 1706695200000), ("2024-01-31", 1706659200000), ("junk", None)]
    df = spark.createDataFrame(rows, "s string, want long").withColumn("got", when.text_epoch_ms(F.col("s")))
    assert all(r.got == r.want for r in df.collect())


def test_numeric_times_split_seconds_and_milliseconds(spark):
    df = spark.createDataFrame([(1706695200.0, 1706695200000), (1706695200000.0, 1706695200000), (float("nan"), None)], "v double, want long")
    assert all(r.got == r.want for r in df.withColumn("got", when.numeric_epoch_ms(F.col("v"))).collect())


def test_bad_time_modes(spark):
    df = spark.createDataFrame([("2024-01-31",), ("no",)], "t string")
    assert when.with_epoch_ms(df, "t").count() == 1
    with pytest.raises(Exception, match="cannot parse"):
        when.with_epoch_ms(df, "t", on_bad="raise").collect()
    with pytest.raises(ValueError):
        when.with_epoch_ms(df, "nope")


def test_clock_hour_is_as_written(spark):
    df = spark.createDataFrame([("2022-09-16 00:09:07", 0), ("11/4/2022 7:07", 7), ("2022-09-16T23:00:00+02:00", 23), ("x", None)], "s string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", when.clock_hour(F.col("s"))).collect())


@pytest.mark.parametrize("text,want", [("40°26'46\"N", 40 + 26 / 60 + 46 / 3600), ("73°58.5'W", -(73 + 58.5 / 60)), ("12.5", 12.5), ("-3.25 deg", -3.25),
                                       ("n/a", None), ("", None), ("33 52 10 S", -(33 + 52 / 60 + 10 / 3600))])
def test_coordinates(spark, text, want):
    got = one(spark, coords.parse_coordinate(F.lit(text)))
    assert got == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("tag,want", [("50", 50.0), ("30 mph", 30 * 1.609344), ("50 km/h", 50.0), ("walk", None), ("", None), (None, None), ("nan", None)])
def test_maxspeed(spark, tag, want):
    got = one(spark, roads.maxspeed_kmh(F.lit(tag).cast("string")))
    assert got == (pytest.approx(want) if want is not None else None)


def test_haversine_and_utm_roundtrip(spark):
    assert one(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(math.radians(1) * 6371000)
    df = spark.createDataFrame([(-79.4, 43.65), (-81.0, 43.0), (-78.1, 10.0)], "lon double, lat double")
    out = geo.with_lonlat(geo.with_utm(df, [("lon", "lat", "x", "y")], 17), [("x", "y", "lon2", "lat2")], 17).collect()
    for r in out:
        assert (r.lon2, r.lat2) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))
    # published control point: the central meridian maps to 500 km east
    assert next(r for r in out if r.lon == -81.0).x == pytest.approx(500000.0, abs=1e-6)


def test_utm_control_points(spark):
    """The tower in Toronto at its published grid position, and its mirror image in the south."""
    lat, lon = 43 + 38 / 60 + 33.24 / 3600, -(79 + 23 / 60 + 13.7 / 3600)
    df = spark.createDataFrame([(lon, lat), (lon, -lat)], "lon double, lat double")
    north = geo.with_utm(df, [("lon", "lat", "x", "y")], 17).collect()
    assert (north[0].x, north[0].y) == (pytest.approx(630084, abs=1), pytest.approx(4833438, abs=1))
    south = geo.with_utm(df, [("lon", "lat", "x", "y")], 17, True).collect()
    assert (south[1].x, south[1].y) == (pytest.approx(630084, abs=1), pytest.approx(10_000_000 - 4833438, abs=1))


def test_ring_lonlat_matches_columns(spark):
    df = spark.createDataFrame([(630000.0, 4835000.0)], "x double, y double")
    a = geo.with_lonlat(df, [("x", "y", "lon", "lat")], 17).first()
    b = df.select(geo.ring_lonlat(F.array(F.struct("x", "y")), 17).alias("r")).first()["r"][0]
    assert (a.lon, a.lat) == (pytest.approx(b.x, abs=1e-12), pytest.approx(b.y, abs=1e-12))


def test_ellipse_string_length(spark):
    ring = one(spark, geo.ellipse(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(0.0), F.lit(1000.0)))
    assert len(ring) == 64
    assert all(math.hypot(p.x, p.y) + math.hypot(p.x - 600, p.y) == pytest.approx(1000.0) for p in ring)
    assert one(spark, geo.ellipse(F.lit(0.0), F.lit(0.0), F.lit(600.0), F.lit(0.0), F.lit(500.0))) is None


def test_capsule_keeps_its_distance(spark):
    for p in one(spark, geo.capsule(F.lit(0.0), F.lit(0.0), F.lit(300.0), F.lit(400.0), 100.0)):
        t = max(0.0, min(1.0, (p.x * 300 + p.y * 400) / 250000))
        assert math.hypot(p.x - 300 * t, p.y - 400 * t) == pytest.approx(100.0)


def test_circle_overlap_area(spark):
    """Two equal circles on the equator against the closed-form lens."""
    r, d = 1000.0, 1200.0
    df = spark.createDataFrame([(0.0, 0.0, r, d / 111000, 0.0, r), (0.0, 0.0, 100.0, 1.0, 0.0, 100.0), (0.0, 0.0, 50.0, 0.0, 0.0, 900.0)],
                               "a double, b double, c double, d double, e double, f double")
    got = df.select(circle_overlap(400)(*df.columns).alias("o")).select("o.*").collect()
    lens = 2 * r * r * math.acos(d / (2 * r)) - d / 2 * math.sqrt(4 * r * r - d * d)
    assert got[0].area * 111000**2 == pytest.approx(lens, rel=1e-3)
    assert got[1].ring is None
    assert got[2].area * 111000**2 == pytest.approx(math.pi * 2500, rel=1e-3)


def test_circle_overlaps_do_not_depend_on_their_batch(spark):
    rows = [(10.0 + i % 7 * 1e-3, 40.0, 50.0 + i * 13 % 400, 10.003, 40.0 + i % 5 * 1e-3, 30.0 + i * 7 % 300) for i in range(150)]
    df = spark.createDataFrame(rows, "lon1 double, lat1 double, r1 double, lon2 double, lat2 double, r2 double").coalesce(1)
    many = df.select(circle_overlap(48)(*df.columns).alias("o")).select("o.*").collect()
    one = df.repartition(150).select(*df.columns, circle_overlap(48)(*df.columns).alias("o")).select(*df.columns, "o.*").collect()
    alone = {tuple(r)[:6]: (r.ring, r.area) for r in one}
    assert any(m.ring is None and m.area is None for m in many) and sum(m.ring is not None for m in many) > 30
    for row, m in zip(rows, many, strict=True):
        assert alone[row] == (m.ring, m.area)
        if m.ring is not None:
            x, y = ([p[c] - m.ring[0][c] for p in m.ring] for c in "xy")
            shoelace = abs(sum(x[i - 1] * y[i] - x[i] * y[i - 1] for i in range(len(x)))) / 2
            assert len(m.ring) >= 3 and m.area == pytest.approx(shoelace, rel=1e-9)


def test_clip_to_ring(spark):
    square = "array(0D, 2D, 2D, 0D)", "array(0D, 0D, 2D, 2D)"
    df = spark.createDataFrame([(-1.0, 1.0, 3.0, 1.0), (0.5, 0.5, 1.0, 1.0), (-1.0, 3.0, 3.0, 3.0)], "ax double, ay double, bx double, by double")
    got = df.select(clip_to_ring(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.expr(square[0]), F.expr(square[1])).alias("t")).select("t.*").collect()
    assert (got[0].t0, got[0].t1) == (pytest.approx(0.25), pytest.approx(0.75))
    assert (got[1].t0, got[1].t1) == (0.0, 1.0)
    assert got[2].t0 > got[2].t1


CASES = [  # du, dv, cost, cutoff, snapped, fraction -> spans
    (0.0, None, 100.0, 50.0, False, 0.0, [(0, 0.5)]), (None, None, 100.0, 10.0, True, 0.5, [(0.4, 0.6)]), (0.0, 0.0, 100.0, 50.0, False, 0.0, [(0, 1)]),
    (10.0, 20.0, 100.0, 50.0, False, 0.0, [(0, 0.4), (0.7, 1)])]


def test_reachable_spans(spark):
    df = spark.createDataFrame([c[:6] for c in CASES], "du double, dv double, c double, k double, s boolean, f double").coalesce(1)
    cols = [F.col(x) for x in ("du", "dv", "c", "k", "s", "f")]
    for got, case in zip(df.select(intervals.reachable_spans(*cols).alias("v")).collect(), CASES):
        assert [(s.a, s.b) for s in got.v] == [pytest.approx(x) for x in case[6]]


def test_span_times_peak_in_the_middle(spark):
    ways = intervals.entries(F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(0.0))
    got = one(spark, intervals.span_times(F.lit(0.0), F.lit(1.0), ways, F.lit(100.0)))
    assert (got.travel_min, got.travel_mid, got.travel_max) == (0.0, 50.0, 50.0)


@pytest.mark.parametrize("a,b,k,want", [((0.0, 100.0), (100.0, 0.0), 200.0, [(0, 1)]), ((0.0, 100.0), (100.0, 0.0), 50.0, []),
                                        ((0.0, 100.0), (0.0, 100.0), 100.0, [(0, 0.5)])])
def test_feasible_spans(spark, a, b, k, want):
    ways = [intervals.entries(F.lit(u), F.lit(v), F.lit(False), F.lit(0.0)) for u, v in (a, b)]
    got = intervals.with_feasible_spans(spark.range(1), *ways, F.lit(100.0), F.lit(k)).first().spans
    assert [(s.a, s.b) for s in got] == [pytest.approx(w) for w in want]


def test_spans_against_sampling(spark):
    """Reachable and feasible parts and travel times of random edges, sampled at 2000 places."""
    import numpy as np

    rng = np.random.default_rng(4)
    def end():
        return None if rng.random() < 0.3 else float(rng.uniform(0, 150))
    rows = [(i, end(), end(), end(), end(), float(rng.uniform(20, 200)), float(rng.uniform(0, 260)), bool(rng.random() < 0.3), float(rng.random()),
             bool(rng.random() < 0.3), float(rng.random())) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, ua double, va double, ub double, vb double, c double, k double, sa boolean, fa double, sb boolean, fb double")
    col = F.col
    a, b = intervals.entries(col("ua"), col("va"), col("sa"), col("fa")), intervals.entries(col("ub"), col("vb"), col("sb"), col("fb"))
    out = intervals.with_feasible_spans(df, a, b, col("c"), col("k"))
    out = out.withColumns({"r": intervals.reachable_spans(col("ua"), col("va"), col("c"), col("k"), col("sa"), col("fa")),
                           "t": intervals.span_times(F.lit(0.2), F.lit(0.9), a, col("c"))})
    s = np.linspace(0, 1, 2001)

    def cone(u, v, c, snapped, f):
        ways = [d + c * np.abs(s - p) for p, d in ((0, u), (1, v), (f, 0.0 if snapped else None)) if d is not None]
        return np.min(ways, axis=0) if ways else np.full(len(s), np.inf)

    for x in out.collect():
        ta, tb = cone(x.ua, x.va, x.c, x.sa, x.fa), cone(x.ub, x.vb, x.c, x.sb, x.fb)
        for spans, fits in ((x.r, ta <= x.k), (x.spans, ta + tb <= x.k)):
            inside = np.zeros(len(s), bool)
            for p in spans:
                inside |= (s >= p.a - 1e-6) & (s <= p.b + 1e-6)
            edge = np.zeros(len(s), bool)
            edge[1:-1] = (fits[1:-1] != fits[:-2]) | (fits[1:-1] != fits[2:])
            assert ((inside == fits) | edge).mean() > 0.999
        part = ta[(s >= 0.2) & (s <= 0.9)]
        if np.isfinite(part).all():
            assert (x.t.travel_min, x.t.travel_max) == (pytest.approx(part.min(), abs=0.1), pytest.approx(part.max(), abs=0.1))


def test_hexagons_partition_the_plane(spark):
    pts = spark.range(400).select((F.col("id") % 20 * 0.01 - 79.5).alias("x"), (F.floor(F.col("id") / 20) * 0.01 + 43.5).alias("y"))
    h = hexgrid.to_hex(F.col("x"), F.col("y"), 8, 44.0)
    c = hexgrid.hex_center(F.col("h.hex_q"), F.col("h.hex_r"), 8, 44.0)
    sx = geo.GRID_M_PER_DEG * math.cos(math.radians(44))
    far = pts.withColumn("h", h).select(F.hypot((c["x"] - F.col("x")) * sx, (c["y"] - F.col("y")) * geo.GRID_M_PER_DEG).alias("d"))
    assert far.agg(F.max("d")).first()[0] <= hexgrid.edge_length_m(8) + 1e-6


def test_congestion_by_local_hour(spark):
    eight_utc = F.lit(8 * 3_600_000.0)
    assert one(spark, roads.congestion_factor(eight_utc, F.lit(0.0), "driving")) == 0.55
    assert one(spark, roads.congestion_factor(eight_utc, F.lit(60.0), "driving")) == 0.75
    assert one(spark, roads.congestion_factor(eight_utc, F.lit(-90.0), "driving")) == 0.95
    assert one(spark, roads.congestion_factor(eight_utc, F.lit(0.0), "walking")) == 1.0
