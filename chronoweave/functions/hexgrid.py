"""Hexagonal bins as column math.

Positions are laid on a plane (longitude shrunk by the cosine of one reference latitude) and
binned into pointy-top hexagons addressed by axial coordinates ``hex_q, hex_r``. Each finer
resolution has one seventh of the area, starting at 36.129 km2 for resolution 6.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import GRID_M_PER_DEG, vertex

TARGET_CELLS = 20_000
# Spacing of samples along a road per resolution, metres.
SAMPLE_STEP_M = {6: 7000.0, 7: 2600.0, 8: 1000.0, 9: 370.0, 10: 140.0, 11: 53.0}


# Resolution and reference latitude may be numbers, or columns where each row has its own.
Number = float | Column


def cell_area_km2(resolution: Number) -> Number:
    if isinstance(resolution, Column):
        return F.lit(36.129) / F.pow(F.lit(7.0), resolution - 6)
    return 36.129 / 7 ** (resolution - 6)


def edge_length_m(resolution: Number) -> Number:
    squared = cell_area_km2(resolution) * (2 * 1e6 / (3 * math.sqrt(3)))
    return F.sqrt(squared) if isinstance(resolution, Column) else math.sqrt(2 * cell_area_km2(resolution) * 1e6 / (3 * math.sqrt(3)))


def sample_step_m(resolution: Number) -> Number:
    if not isinstance(resolution, Column):
        return SAMPLE_STEP_M[resolution]
    return F.element_at(F.create_map(*[F.lit(x) for kv in SAMPLE_STEP_M.items() for x in kv]), resolution.cast("int"))


def auto_resolution(box_km2: Column) -> Column:
    """Finest resolution from 10 down to 6 whose expected cell count stays near the target."""
    out = F.lit(6)
    for r in (7, 8, 9, 10):
        out = F.when(0.4 * box_km2 / cell_area_km2(r) <= TARGET_CELLS, F.lit(r)).otherwise(out)
    return out


def _scales(lat0: Number) -> tuple[Number, float]:
    if isinstance(lat0, Column):
        return F.cos(F.radians(lat0)) * GRID_M_PER_DEG, GRID_M_PER_DEG
    return GRID_M_PER_DEG * math.cos(math.radians(lat0)), GRID_M_PER_DEG


def to_hex(lon: Column, lat: Column, resolution: Number, lat0: Number) -> Column:
    """``struct<hex_q,hex_r>`` of the bin containing a position."""
    sx, sy = _scales(lat0)
    e = edge_length_m(resolution)
    x, y = lon * sx, lat * sy
    q = (x * (math.sqrt(3) / 3) - y / 3) / e
    r = y * (2.0 / 3) / e
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return F.struct(F.when(fix_q, -rr - rs).otherwise(rq).cast("long").alias("hex_q"),
                    F.when(fix_r, -rq - rs).otherwise(rr).cast("long").alias("hex_r"))


def hex_center(q: Column, r: Column, resolution: Number, lat0: Number) -> Column:
    sx, sy = _scales(lat0)
    e = edge_length_m(resolution)
    return vertex((q + r / 2) * (e * math.sqrt(3)) / sx, r * (1.5 * e) / sy)


def hex_ring(q: Column, r: Column, resolution: Number, lat0: Number) -> Column:
    sx, sy = _scales(lat0)
    e = edge_length_m(resolution)
    c = hex_center(q, r, resolution, lat0)
    corners = [((e * math.cos(math.radians(60 * k - 30))) / sx, (e * math.sin(math.radians(60 * k - 30))) / sy) for k in range(6)]
    return F.array(*[vertex(c["x"] + dx, c["y"] + dy) for dx, dy in corners])


def with_hexes(df: DataFrame, lon: Column, lat: Column, radius_m: Column, resolution: Number, lat0: Number) -> DataFrame:
    """Each row once for every bin whose centre may lie within the radius: ``hex_q, hex_r`` are added.

    Rows of bins are listed first and the bins of a row after that, so no value holds a whole disc. Near a pole every
    longitude is within reach; bins more than half the world away are the same places again and are not listed.
    """
    sx, sy = _scales(lat0)
    e = edge_length_m(resolution)
    # the reach in degrees of longitude follows the point's own latitude, with a little slack
    widen = F.greatest(F.lit(1.0), (sx if isinstance(sx, Column) else F.lit(sx)) / (F.cos(F.radians(lat)) * GRID_M_PER_DEG))
    reach, half = radius_m * widen * 1.05, sx * F.lit(180.0)
    wide, tall = F.when((reach > half) & ~F.isnan(reach), half).otherwise(reach) + e, radius_m * 1.05 + e
    x, y = lon * sx, lat * sy
    out = df.withColumn("hex_r", F.explode(F.sequence(F.ceil((y - tall) / (e * 1.5)), F.floor((y + tall) / (e * 1.5)))))
    first = F.ceil((x - wide) / (e * math.sqrt(3)) - F.col("hex_r") / 2)
    last = F.floor((x + wide) / (e * math.sqrt(3)) - F.col("hex_r") / 2)
    return out.withColumn("hex_q", F.explode(F.sequence(first, F.greatest(first, last))))
