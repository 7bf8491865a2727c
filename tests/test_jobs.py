"""End to end on tiny made-up scenes with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import prism
from chronoweave.plans import JOBS
from chronoweave.sources import points, sinks

ROADS = "source_id long, highway string, maxspeed string, coords array<struct<x:double,y:double>>"
PAIRS = "pair_id long, user_id string, a_lon double, a_lat double, a_ms long, b_lon double, b_lat double, b_ms long"


KMH5 = 5 / 3.6


@pytest.fixture(scope="module")
def road(spark):
    """One straight road of seven vertices along the equator, about 3.3 km."""
    return spark.createDataFrame([(1, "residential", None, [(i * 0.005, 0.0) for i in range(7)])], ROADS).cache()


def test_two_anchor_road_prism(spark, road):
    """A walk of 0.025 degrees with 80 minutes, with 8 minutes, and from a place without a road."""
    pair = spark.createDataFrame([(11, "u", 0.0, 0.0, 0, 0.025, 0.0, 4_800_000), (12, "u", 0.0, 0.0, 0, 0.025, 0.0, 480_000), (13, "u", 0.0, 1.0, 0, 0.025, 0.0, 480_000)], PAIRS)
    out = JOBS["road_prism"](pair, road, zone=31)
    status = {r.pair_id: (r.snapped, r.feasible) for r in out["status"].collect()}
    assert status == {11: (True, True), 12: (True, False), 13: (False, False)}
    edges = out["ppa_roads"].collect()
    # the whole road: the last edge beyond B is a way of 400 s out and 400 s back
    assert {r.pair_id for r in edges} == {11} and len(edges) == 6
    direct = edges[0].shortest_path_sec
    assert direct == pytest.approx(0.025 * 111320 / KMH5, rel=2e-3)
    for e in edges:
        beyond = max(0.0, min(e.lon0, e.lon1) - 0.025) * 111320 / KMH5
        assert e.activity_sec_max == pytest.approx(4800 - direct - 2 * beyond, rel=3e-3) and e.activity_sec_min <= e.activity_sec_mid + 1e-9
        assert e.travel_total_min <= e.budget_sec - e.min_activity_sec + 1e-6
    assert out["sheets"].count() > 0 and out["dwell_surface"].agg(F.max("dwell_minutes")).first()[0] == pytest.approx((4800 - direct) / 60, rel=1e-6)
    slow = JOBS["road_prism"](pair.filter("pair_id = 11"), road, zone=31, adjustment="manual", manual_factor=0.4)["status"].first()
    assert not slow.feasible and slow.shortest_path_sec == pytest.approx(2.5 * direct, rel=1e-9)
    exact = JOBS["road_prism"](pair.filter("pair_id = 11"), road, zone=31, exact=True)["ppa_roads"]
    spans = exact.select(F.inline("spans")).agg(F.min("a"), F.max("b")).first()
    assert spans == (0.0, 1.0)


def test_origin_areas_on_one_street(spark):
    """Five fixes walking a street: each reaches 120 s to both sides, cut at the street's ends."""
    street = spark.createDataFrame([(1, "residential", None, [(0.001 * i, 0.0) for i in range(9)])], ROADS)
    traj = spark.createDataFrame([(i, "u", i * 90_000, 0.002 * i, 0.0) for i in range(5)], "point_id long, user_id string, t_ms long, lon double, lat double")
    pair = spark.createDataFrame([(7, "u", 0.0, 0.0, 0, 0.008, 0.0, 360_000)], PAIRS)
    options = {"budget_min": 7.0, "min_activity_min": 3.0, "zone": 31}
    out = JOBS["origin_areas"](pair, traj, street, **options)
    pieces = out["ppa_roads"].collect()
    assert pieces and all(p.activity_sec_min + 1e-6 >= 180 and 0 <= p.a < p.b <= 1 for p in pieces)
    assert max(p.travel_sec_max for p in pieces) <= 120 + 1e-6
    origins = out["origins"].collect()
    reach, length = 120 * KMH5, 0.008 * 111320
    assert len(origins) == 5
    for o in origins:
        x = o.lon * 111320
        assert o.reachable and o.reachable_length_m == pytest.approx(min(x, reach) + min(length - x, reach), rel=5e-3)
    capped = JOBS["origin_areas"](pair, traj, street, max_segments=2, max_origins=3, **options)
    assert capped["origins"].count() == 3
    assert capped["ppa_roads"].groupBy("origin_id").count().agg(F.max("count")).first()[0] == 2


def _town(k: int, lon: float, lat: float):
    """Two crossing streets of about 4 km and a pair that walks along one of them."""
    streets = [(10 * k + 1, "residential", None, [(lon + 0.004 * i, lat) for i in range(11)]),
               (10 * k + 2, "residential", None, [(lon + 0.02, lat - 0.02 + 0.004 * i) for i in range(11)])]
    return streets, (k, f"u{k}", lon + 0.001, lat + 0.0001, k * 1000, lon + 0.015, lat - 0.0001, k * 1000 + 4_000_000)


def test_a_pair_is_alone_in_a_table_of_many_regions(spark):
    """Three zones, both hemispheres and a trip beside a zone border: together as each by itself."""
    towns = [_town(1, -79.4, 43.65), _town(2, 2.3, 48.85), _town(3, 151.2, -33.87), _town(4, 11.985, 45.4), _town(5, -58.4, -34.6)]
    roads = spark.createDataFrame([s for streets, _ in towns for s in streets], ROADS)
    pairs = spark.createDataFrame([p for _, p in towns], PAIRS)

    def rows(p):
        out = JOBS["road_prism"](p, roads, min_activity_min=2.0)
        return {"roads": sorted(map(tuple, out["ppa_roads"].select("pair_id", "edge_id", "length_m", "forward_sec", "activity_sec_max").collect())),
                "status": sorted(map(tuple, out["status"].select("pair_id", "feasible", "shortest_path_sec").collect())),
                "hexes": sorted(map(tuple, out["dwell_surface"].select("pair_id", "hex_q", "hex_r", "dwell_minutes").collect()))}

    whole = rows(pairs)
    assert {s[0] for s in whole["status"] if s[1]} == {1, 2, 3, 4, 5}
    for k in (1, 3, 4):
        alone = rows(pairs.filter(F.col("pair_id") == k))
        for name, got in alone.items():
            assert got == [r for r in whole[name] if r[0] == k]


def test_zones_keep_the_roads_of_long_paths_and_trips(spark):
    """Towns along a path over eight zones, a road that starts far outside, and a trip far past its zone's border."""
    towns = [(k, "residential", None, [(lon - 0.01, 45.0), (lon + 0.01, 45.0)]) for k, lon in enumerate((-120.0, -110.3, -98.2, -87.1, -75.0))]
    long = [(50, "primary", None, [(-160.0 + 0.5 * i, 45.0 if i >= 80 else 50.0) for i in range(91)])]
    roads = spark.createDataFrame(towns + long, ROADS)
    traj = spark.createDataFrame([(k, "u", k * 1000, lon, 45.0) for k, lon in enumerate((-120.0, -110.3, -98.2, -87.1, -75.0))],
                                 "point_id long, user_id string, t_ms long, lon double, lat double")
    out = JOBS["corridor"](traj, roads, corridor_m=60_000.0)
    assert {r.source_id for r in out["road_pieces"].collect()} == {0, 1, 2, 3, 4, 50}
    assert {r.segment_index for r in out["buffers"].collect()} == {0, 1, 2, 3}
    merged = JOBS["corridor"](traj, roads, corridor_m=60_000.0, merge=True)["road_pieces"].collect()
    assert {r.source_id for r in merged} == {0, 1, 2, 3, 4, 50} and len(merged) == len({(m.edge_id, m.part) for m in merged})
    assert all(abs(m.lat0 - 45) < 1 and m.fix_id == m.source_id for m in merged if m.source_id < 5)

    road = spark.createDataFrame([(1, "motorway", None, [(0.1 + 0.5 * i, 45.0) for i in range(21)]), (2, "motorway", None, [(10.1 + 0.5 * i, 45.0) for i in range(9)])], ROADS)
    pair = spark.createDataFrame([(1, "u", 5.2, 45.0, 0, 5.8, 45.0, 50_000_000)], PAIRS)
    east = JOBS["road_prism"](pair, road, mode="driving")["ppa_roads"].agg(F.max(F.greatest("lon0", "lon1"))).first()[0]
    assert east == pytest.approx(14.1, abs=0.01)


def test_fixes_meet_windows_of_any_length(spark):
    pairs = spark.createDataFrame([(1, "u", 0.0, 0.0, 0, 0.0, 0.0, 60_000), (2, "u", 0.0, 0.0, 50_000, 0.0, 0.0, 700_000_000), (3, "v", 0.0, 0.0, 0, 0.0, 0.0, 10)], PAIRS)
    traj = spark.createDataFrame([(i, "u", i * 7_000_000, 0.0, 0.0) for i in range(-3, 110)] + [(500, "u", 70_000, 0.0, 0.0), (501, "v", 20_000, 0.0, 0.0)],
                                 "point_id long, user_id string, t_ms long, lon double, lat double")
    from chronoweave.plans import jobs
    got = {(r.pair_id, r.point_id) for r in jobs.origin_fixes(pairs, traj).collect()}
    want = set()
    for p in pairs.collect():
        margin = max(int((p.b_ms - p.a_ms) * 0.02), 15_000)
        want |= {(p.pair_id, f.point_id) for f in traj.collect() if f.user_id == p.user_id and p.a_ms - margin <= f.t_ms <= p.b_ms + margin}
    assert got == want


def test_hex_listing_does_not_hold_a_disc(spark):
    """One overnight budget by car: more rows than an array should hold, each a hexagon near the fix."""
    from chronoweave.functions.hexgrid import with_hexes
    df = spark.createDataFrame([(0.0, 44.0, 300_000.0)], "lon double, lat double, r double")
    out = with_hexes(df, F.col("lon"), F.col("lat"), F.col("r"), 7, 44.0)
    assert "array" not in str(out.schema) and out.count() > 3.14 * 300**2 / 5.17


def test_euclidean_prism_and_path_area(spark):
    pair = spark.createDataFrame([(1, "u", 0.0, 0.0, 0, 0.01, 0.0, 3_600_000), (2, "u", 0.0, 0.0, 0, 1.0, 0.0, 60_000)], PAIRS)
    out = JOBS["two_anchor_prism"](pair, n=10, resolution=9)
    assert out["counts"].first() == (1, 1)
    rows = out["slices"].orderBy("slice").collect()
    assert [r.slice for r in rows] == list(range(1, 10))
    v, t, d = 5 / 3.6, 3600.0, 0.01 * 111000
    r1, r2 = v * t * 0.5, v * t * 0.5
    lens = 2 * r1 * r1 * math.acos(d / (2 * r1)) - d / 2 * math.sqrt(4 * r1 * r1 - d * d)
    assert r1 == r2 and rows[4].area_m2 == pytest.approx(lens, rel=0.01)
    assert out["ppa"].first().area_km2 >= max(r.area_m2 for r in rows) / 1e6 * 0.9


def test_anchor_order_and_errors(spark):
    pair = spark.createDataFrame([(1, "u", 0.0, 0.0, 500, 0.01, 0.0, 100)], PAIRS)
    got = prism.normalise_anchors(pair).first()
    assert (got.a_ms, got.b_ms, got.a_lon, got.a_label) == (100, 500, 0.01, "Anchor B")
    equal = spark.createDataFrame([(1, "u", 0.0, 0.0, 5, 0.01, 0.0, 5)], PAIRS)
    with pytest.raises(Exception, match="different times"):
        prism.normalise_anchors(equal).collect()
    timed = prism.normalise_anchors(equal, duration_min=10, now_ms=1000).first()
    assert (timed.a_ms, timed.b_ms) == (1000, 601_000)


def test_corridor_pieces_lie_inside(spark, road):
    traj = spark.createDataFrame([(1, "u", 0, 0.001, 0.0005), (2, "u", 600_000, 0.006, 0.0005), (3, "u", 601_000, 0.016, 0.0)], "point_id long, user_id string, t_ms long, lon double, lat double")
    out = JOBS["corridor"](traj, road, zone=31)
    buffers = {r.segment_index: r.fallback for r in out["buffers"].collect()}
    assert buffers == {0: False, 1: True}
    pieces = out["road_pieces"].collect()
    assert {p.segment_index for p in pieces} == {0, 1}
    span = [(p.lon0, p.lon1) for p in pieces if p.segment_index == 0]
    # the ellipse around the first leg reaches (833 - 560) / 2 metres beyond its ends
    assert min(a for a, _ in span) == pytest.approx(0.001 - 134 / 111320, abs=3e-4) and max(b for _, b in span) == pytest.approx(0.006 + 134 / 111320, abs=3e-4)
    merged = JOBS["corridor"](traj, road, zone=31, merge=True)["road_pieces"].collect()
    assert len(merged) == len({(m.edge_id, m.part) for m in merged}) and all(m.fix_id in (1, 2, 3) for m in merged)


def test_fix_surface_shrinks_towards_the_end(spark):
    traj = spark.createDataFrame([(i, "u", i * 600_000, 0.002 * i, 0.0) for i in range(5)], "point_id long, user_id string, t_ms long, lon double, lat double")
    end = spark.createDataFrame([("u", 0.008, 0.0, 7_200_000)], "user_id string, b_lon double, b_lat double, b_ms long")
    out = JOBS["fix_surface"](traj, end, resolution=9)
    assert out["hex_surface"].agg(F.min("dwell_minutes")).first()[0] > 0
    radii = [r.radius_m for r in out["circles"].orderBy("t_ms").collect()]
    assert radii == sorted(radii, reverse=True)


def test_activity_surface_with_roads(spark, road):
    rows = [("p", 1, 0.0, 0.0, 0, "home"), ("p", 2, 0.01, 0.0, 1_800_000, "shopping"), ("p", 3, 0.015, 0.0, 7_200_000, "work")]
    df = spark.createDataFrame(rows, "person_id string, episode_id long, lon double, lat double, start_ms long, activity_type string")
    out = JOBS["activity_surface"](df, roads=road, zone=31)
    s = out["surface"]
    assert s.agg(F.min("dwell_minutes")).first()[0] >= 10 and s.agg(F.max("person_count")).first()[0] == 1
    assert out["voxels"].agg(F.sum("dwell_minutes")).first()[0] <= s.agg(F.sum("dwell_minutes")).first()[0]
    assert out["window_road_pieces"].count() > 0 and out["window_buffers"].count() == 19 and "window_id" in out["window_buffers"].columns


def test_input_and_output_round_trip(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text("lon,lat,note,seen\n10.5,20.5,\"a,b\",1600000000\nbad,1,x,1600000060\n,,,\n200,1,y,1600000120\n")
    df = points.read_points_csv(spark, str(csv))
    good, rejected, stats = points.csv_to_points(df, "lon", "lat")
    assert stats.first() == (3, 1, 2) and rejected.count() == 2
    assert points.add_readable_epochs(good).first().seen_readable == "2020-09-13 12:26"
    with pytest.raises(Exception, match="Invalid coordinates"):
        points.csv_to_points(df, "lon", "lat", skip_invalid=False)[0].collect()
    sinks.write_geojson(good.withColumn("w", F.lit(float("inf"))), str(tmp_path / "g"))
    back = points.read_geojson(spark, str(tmp_path / "g"), lines=True).first()
    assert (back.lon, back.lat, back.props["note"], back.props["w"]) == (10.5, 20.5, "a,b", None)
    sinks.write_points_csv(good, str(tmp_path / "c"))
    out = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (out.longitude, out.note) == ("10.5", "a,b")


def test_geojson_collections(spark, tmp_path):
    f = tmp_path / "fc.json"
    f.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"highway":"primary"}},'
                 '{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[5,5],[6,6]]]},"properties":{}},'
                 '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{}},'
                 '{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4,5]},"properties":{"n":{"a":1}}}]}')
    df = points.read_geojson(spark, str(f))
    assert points.load_roads(df).count() == 3
    assert [len(r) for r in points.load_area_features(df).first().rings] == [3]
    p = points.only_points(df).first()
    assert (p.lon, p.lat, p.alt, p.props["n"]) == (3.0, 4.0, 5.0, '{"a":1}')
    assert {r.name for r in points.field_summary(df).collect()} >= {"highway", "lon", "geom_type"}
    with pytest.raises(ValueError):
        points.only_points(df.filter("geom_type = 'Polygon'"))
