"""Research areas: keep whole features that touch a union of polygons.

An area is a table of polygon sides ``(area_id, x1, y1, x2, y2)``; holes are further rings of
the same ``area_id``. A regular grid over the area is prepared once: for every cell whether its
centre is inside each polygon, and the sides passing through it. A point then needs only its
own cell: it is inside when the way to the cell centre crosses an odd number of sides more than
the centre's own state says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import ring_bounds
from chronoweave.operators.skew import lookup_join
from chronoweave.report import Report

MAX_GRID = 256  # cells per axis, so the cell table stays below 65 536 keys


def load_area(features: DataFrame) -> DataFrame:
    """Polygon features -> sides. Needs ``area_id`` and ``rings array<array<struct<x,y>>>``."""
    rings = features.filter(F.col("rings").isNotNull()).select("area_id", F.explode("rings").alias("ring")) \
        .filter(F.size("ring") >= 3)
    pairs = F.transform("ring", lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"),
        F.element_at("ring", i % F.size("ring") + 1)["x"].alias("_"),
        F.element_at("ring", (i + 1) % F.size("ring") + 1)["x"].alias("x2"),
        F.element_at("ring", (i + 1) % F.size("ring") + 1)["y"].alias("y2")))
    sides = rings.select("area_id", F.inline(pairs)).drop("_")
    return sides.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


@dataclass
class AreaIndex:
    cells: DataFrame  # cx, cy, polys array<struct<inside, sides array<struct<x1,y1,x2,y2>>>>
    sides: DataFrame  # cx, cy, x1, y1, x2, y2
    x0: float
    y0: float
    step_x: float
    step_y: float
    size: int

    def cell(self, x: Column, y: Column) -> dict[str, Column]:
        return {"_cx": F.floor((x - self.x0) / self.step_x), "_cy": F.floor((y - self.y0) / self.step_y)}

    def in_box(self, x: Column, y: Column) -> Column:
        return (x.between(self.x0, self.x0 + self.step_x * self.size)
                & y.between(self.y0, self.y0 + self.step_y * self.size))


def index_area(area: DataFrame) -> AreaIndex | None:
    """Prepare the grid; null when the area is empty."""
    b = area.agg(F.count(F.lit(1)).alias("n"), F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
                 F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1")).first()
    if not b["n"]:
        return None
    size = max(8, min(MAX_GRID, int(4 * b["n"] ** 0.5)))
    # a sliver of padding keeps the outermost vertices strictly inside the last cell
    sx = max((b["x1"] - b["x0"]) * (1 + 1e-9), 1e-9) / size
    sy = max((b["y1"] - b["y0"]) * (1 + 1e-9), 1e-9) / size
    x0, y0 = b["x0"], b["y0"]

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), c))

    lo_y, hi_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    # rows whose centre line the side crosses (half-open), and where
    rows = (area.withColumns({"_r0": clamp(F.floor((lo_y - y0) / sy) - 1), "_r1": clamp(F.floor((hi_y - y0) / sy) + 1)})
            .withColumn("_cy", F.explode(F.sequence("_r0", "_r1")))
            .withColumn("_yc", (F.col("_cy") + 0.5) * sy + y0)
            .filter((F.col("y1") > F.col("_yc")) != (F.col("y2") > F.col("_yc"))))
    cut_x = F.col("x1") + (F.col("_yc") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = rows.groupBy("area_id", "_cy").agg(F.collect_list(cut_x).alias("_xs"))
    inside = (lines.withColumn("_cx", F.explode(F.sequence(F.lit(0), F.lit(size - 1)).cast("array<bigint>")))
              .filter(F.size(F.filter("_xs", lambda x: x > (F.col("_cx") + 0.5) * sx + x0)) % 2 == 1)
              .select("area_id", "_cx", F.col("_cy").cast("long").alias("_cy"), F.lit(True).alias("inside")))
    sides = (area
             .withColumns({"_a": clamp(F.floor((F.least("x1", "x2") - x0) / sx)), "_b": clamp(F.floor((F.greatest("x1", "x2") - x0) / sx)),
                           "_c": clamp(F.floor((lo_y - y0) / sy)), "_d": clamp(F.floor((hi_y - y0) / sy))})
             .withColumn("_cx", F.explode(F.sequence("_a", "_b"))).withColumn("_cy", F.explode(F.sequence("_c", "_d")))
             .select("area_id", F.col("_cx").cast("long").alias("_cx"), F.col("_cy").cast("long").alias("_cy"), "x1", "y1", "x2", "y2"))
    edged = sides.groupBy("area_id", "_cx", "_cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("sides"))
    cells = (inside.join(edged, ["area_id", "_cx", "_cy"], "full_outer")
             .groupBy("_cx", "_cy").agg(F.collect_list(F.struct(
                 F.coalesce("inside", F.lit(False)).alias("inside"),
                 F.coalesce("sides", F.array().cast(edged.schema["sides"].dataType)).alias("sides"))).alias("polys")))
    return AreaIndex(cells, sides.drop("area_id"), x0, y0, sx, sy, size)


def _on_side(x: Column, y: Column, s: Column) -> Column:
    cross = (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
    return ((F.abs(cross) <= 1e-14) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"]))
            & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])))


def _inside(x: Column, y: Column, cx: Column, cy: Column, polys: Column) -> Column:
    """Walk from the point along its row to the centre's column, then along that column."""

    def crossings(sides: Column) -> Column:
        def flips(s: Column) -> Column:
            at_row = s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])
            row = ((s["y1"] > y) != (s["y2"] > y)) & ((at_row > x) != (at_row > cx))
            at_col = s["y1"] + (cx - s["x1"]) * (s["y2"] - s["y1"]) / (s["x2"] - s["x1"])
            col = ((s["x1"] > cx) != (s["x2"] > cx)) & ((at_col > y) != (at_col > cy))
            return row.cast("int") + col.cast("int")

        return F.aggregate(F.transform(sides, flips), F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)))

    return F.exists(polys, lambda p: F.exists(p["sides"], lambda s: _on_side(x, y, s))
                    | ((crossings(p["sides"]) % 2 == 1) != p["inside"]))


def clip_points(df: DataFrame, area: DataFrame, report: Report, hot_rows: int | None = None) -> DataFrame:
    """``points_in_area`` with the points before and after it in a report; both are counted in the pass that clips."""
    seen = report.watch("area", df, points=F.count(F.lit(1)))
    return report.watch("area", points_in_area(seen, area, hot_rows=hot_rows), kept=F.count(F.lit(1)))


def points_in_area(df: DataFrame, area: DataFrame | AreaIndex, x: str = "lon", y: str = "lat",
                   hot_rows: int | None = None) -> DataFrame:
    """Points inside or on the border of any polygon. An area without polygons keeps everything."""
    index = area if isinstance(area, AreaIndex) else index_area(area)
    if index is None:
        return df
    px, py = F.col(x), F.col(y)
    near = df.filter(index.in_box(px, py)).withColumns(index.cell(px, py))
    joined = lookup_join(near, index.cells, ["_cx", "_cy"], hot_rows=hot_rows)
    cx = (F.col("_cx") + 0.5) * index.step_x + index.x0
    cy = (F.col("_cy") + 0.5) * index.step_y + index.y0
    return joined.filter(_inside(px, py, cx, cy, F.col("polys"))).drop("polys", "_cx", "_cy")


def features_in_area(df: DataFrame, area: DataFrame, feature_id: str, coords: str = "coords", closed: bool = False,
                     hot_rows: int | None = None) -> DataFrame:
    """Whole lines (or, ``closed``, simple polygons) touching the area: a vertex inside, a crossing of
    borders, or, for polygons, an area swallowed whole."""
    index = index_area(area)
    if index is None:
        return df
    slim = df.select(feature_id, coords)
    ring = F.col(coords)
    vertices = slim.select(feature_id, F.explode(coords).alias("v")).select(feature_id, F.col("v.x").alias("lon"), F.col("v.y").alias("lat"))
    by_vertex = points_in_area(vertices, index, hot_rows=hot_rows).select(feature_id)
    last = F.size(ring) if closed else F.size(ring) - 1
    legs = F.transform(F.slice(ring, F.lit(1), last), lambda p, i: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"),
        F.element_at(ring, (i + 1) % F.size(ring) + 1)["x"].alias("bx"),
        F.element_at(ring, (i + 1) % F.size(ring) + 1)["y"].alias("by")))
    lo = index.cell(F.least("ax", "bx"), F.least("ay", "by"))
    hi = index.cell(F.greatest("ax", "bx"), F.greatest("ay", "by"))

    def clamp(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(index.size - 1), c))

    seg = slim.select(feature_id, F.inline(legs)).withColumns(
        {"_a": lo["_cx"], "_b": hi["_cx"], "_c": lo["_cy"], "_d": hi["_cy"]}) \
        .filter((F.col("_b") >= 0) & (F.col("_a") < index.size) & (F.col("_d") >= 0) & (F.col("_c") < index.size)) \
        .withColumn("_cx", F.explode(F.sequence(clamp(F.col("_a")), clamp(F.col("_b"))))) \
        .withColumn("_cy", F.explode(F.sequence(clamp(F.col("_c")), clamp(F.col("_d")))))
    met = lookup_join(seg.drop("_a", "_b", "_c", "_d"), index.sides, ["_cx", "_cy"], hot_rows=hot_rows)

    def turn(ox, oy, px, py, qx, qy) -> Column:
        return F.signum((F.col(px) - F.col(ox)) * (F.col(qy) - F.col(oy)) - (F.col(py) - F.col(oy)) * (F.col(qx) - F.col(ox)))

    crossing = ((turn("ax", "ay", "bx", "by", "x1", "y1") * turn("ax", "ay", "bx", "by", "x2", "y2") < 0)
                & (turn("x1", "y1", "x2", "y2", "ax", "ay") * turn("x1", "y1", "x2", "y2", "bx", "by") < 0))
    # an area corner on the line itself: no proper crossing, still touching
    def corner(x: str, y: str) -> Column:
        return _on_side(F.col(x), F.col(y), F.struct(F.col("ax").alias("x1"), F.col("ay").alias("y1"),
                                                     F.col("bx").alias("x2"), F.col("by").alias("y2")))
    touching = by_vertex.unionByName(met.filter(crossing | corner("x1", "y1")).select(feature_id))
    if closed:
        # one corner per polygon, looked up from the grid cells each feature's box covers
        seeds = area.groupBy("area_id").agg(F.first("x1").alias("sx"), F.first("y1").alias("sy"))
        seeds = seeds.withColumns(index.cell(F.col("sx"), F.col("sy"))).drop("area_id")
        box = ring_bounds(ring)
        a, b = index.cell(box["x0"], box["y0"]), index.cell(box["x1"], box["y1"])
        covers = (slim.withColumns({"_a": a["_cx"], "_b": b["_cx"], "_c": a["_cy"], "_d": b["_cy"]})
                  .filter((F.col("_b") >= 0) & (F.col("_a") < index.size) & (F.col("_d") >= 0) & (F.col("_c") < index.size))
                  .withColumn("_cx", F.explode(F.sequence(clamp(F.col("_a")), clamp(F.col("_b")))))
                  .withColumn("_cy", F.explode(F.sequence(clamp(F.col("_c")), clamp(F.col("_d"))))))
        tested = lookup_join(covers, seeds, ["_cx", "_cy"], hot_rows=hot_rows)
        sx, sy = F.col("sx"), F.col("sy")
        hits = F.filter(F.transform(ring, lambda p, i: F.struct(
            p.alias("p"), F.element_at(ring, (i + 1) % F.size(ring) + 1).alias("q"))),
            lambda e: ((e["p"]["y"] > sy) != (e["q"]["y"] > sy))
            & (e["p"]["x"] + (sy - e["p"]["y"]) * (e["q"]["x"] - e["p"]["x"]) / (e["q"]["y"] - e["p"]["y"]) > sx))
        touching = touching.unionByName(tested.filter(F.size(hits) % 2 == 1).select(feature_id))
    return df.join(touching.distinct(), feature_id, "left_semi")


def preclip_roads(roads: DataFrame, area: DataFrame | None, hot_rows: int | None = None, keep_all_if_none: bool = False) -> DataFrame:
    """Whole roads touching the area; ``keep_all_if_none`` gives the full network when none does."""
    if area is None:
        return roads
    kept = features_in_area(roads, area, "source_id", hot_rows=hot_rows)
    return roads if keep_all_if_none and kept.isEmpty() else kept
