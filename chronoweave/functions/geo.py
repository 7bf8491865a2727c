"""Distances, projection and small convex geometry as column expressions.

Geometry is ``array<struct<x,y>>``; rings are open (no repeated first vertex) unless a function
says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.bind import bind

EARTH_M = 6_371_000.0
# Three metres-per-degree constants, each tied to the operators that use it.
GRID_M_PER_DEG = 111_320.0
CIRCLE_M_PER_DEG = 111_000.0
EXTENT_KM_PER_DEG = 111.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def lift(ring: Column, z: Column) -> Column:
    """Give every vertex the same height."""
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z")))


def height_scale_value(min_lon: float, max_lon: float, min_lat: float, max_lat: float, floor_deg: float = 1e-9) -> float:
    return max(max(max_lon - min_lon, max_lat - min_lat, floor_deg) * CIRCLE_M_PER_DEG * 0.5, 1000.0)


# ---------------------------------------------------------------- UTM (Krueger series, 4th order)

_A, _F = 6_378_137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0, _FALSE_E, _FALSE_N_SOUTH = 0.9996, 500_000.0, 10_000_000.0
# Published Krueger coefficients as polynomials in the third flattening.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def middle_lon(a: Column, b: Column) -> Column:
    """Middle of the shorter way between two longitudes."""
    return a + (F.pmod(b - a + 180, F.lit(360.0)) - 180) / 2


def utm_zone_value(lon: float) -> int:
    return int((lon + 180) / 6) % 60 + 1


# The series is evaluated in stages, each bound to a name, so no intermediate is computed twice.


def _utm_angles(lon: Column, lat: Column, zone: int) -> dict[str, Column]:
    e = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    return {"lam": F.radians(lon) - math.radians(zone * 6 - 183), "t": F.sinh(F.atanh(s) - e * F.atanh(s * e))}


def _utm_plane(v: dict[str, Column]) -> dict[str, Column]:
    return {"xi": F.atan2(v["t"], F.cos(v["lam"])), "eta": F.atanh(F.sin(v["lam"]) / F.sqrt(v["t"] * v["t"] + 1))}


def _utm_metres(v: dict[str, Column], south: bool) -> dict[str, Column]:
    xi, eta = v["xi"], v["eta"]
    north, east = xi, eta
    for j, a in enumerate(ALPHA, start=1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return {"x": east * (_K0 * _RECT) + _FALSE_E, "y": north * (_K0 * _RECT) + (_FALSE_N_SOUTH if south else 0.0)}


def _deg_plane(x: Column, y: Column, south: bool) -> dict[str, Column]:
    return {"xi": (y - (_FALSE_N_SOUTH if south else 0.0)) / (_K0 * _RECT), "eta": (x - _FALSE_E) / (_K0 * _RECT)}


def _deg_sphere(v: dict[str, Column]) -> dict[str, Column]:
    xi, eta = v["xi"], v["eta"]
    xi_p, eta_p = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return {"xi": xi_p, "eta": eta_p}


def _deg_lines(v: dict[str, Column]) -> dict[str, Column]:
    return {"lam": F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])), "chi": F.asin(F.sin(v["xi"]) / F.cosh(v["eta"]))}


def _deg_final(v: dict[str, Column], zone: int) -> dict[str, Column]:
    phi = v["chi"]
    for j, d in enumerate(DELTA, start=1):
        phi = phi + d * F.sin(2 * j * v["chi"])
    return {"x": F.degrees(v["lam"]) + (zone * 6 - 183), "y": F.degrees(phi)}


def _staged(df: DataFrame, quads: list[tuple[str, str, str, str]], first, *rest) -> DataFrame:
    """Run the stages for several coordinate columns at once and name the results.

    The results are bound, so later filters read them instead of repeating the series.
    """
    keep = df.columns
    out = df.withColumns({f"_{n}_{i}": c for i, (a, b, _, _) in enumerate(quads) for n, c in first(F.col(a), F.col(b)).items()})
    names = [n for n in first(F.lit(0.0), F.lit(0.0))]
    for stage in rest:
        made, new = [], []
        for i in range(len(quads)):
            got = stage({n: F.col(f"_{n}_{i}") for n in names})
            new = list(got)
            made += [c.alias(f"_{n}_{i}") for n, c in got.items()]
        out, names = out.select(*keep, *made), new
    done = {q[2 + k]: F.col(f"_{n}_{i}") for i, q in enumerate(quads) for k, n in enumerate(("x", "y"))}
    return bind(out, done).select(*[c for c in keep if c not in done], *done)


def with_utm(df: DataFrame, quads: list[tuple[str, str, str, str]], zone: int, south: bool = False) -> DataFrame:
    """Add metre columns: each quad is ``(lon column, lat column, new x, new y)``, all in one UTM zone."""
    return _staged(df, quads, lambda a, b: _utm_angles(a, b, zone), _utm_plane, lambda v: _utm_metres(v, south))


def with_lonlat(df: DataFrame, quads: list[tuple[str, str, str, str]], zone: int, south: bool = False) -> DataFrame:
    """Inverse of ``with_utm``: ``(x column, y column, new lon, new lat)``."""
    return _staged(df, quads, lambda a, b: _deg_plane(a, b, south), _deg_sphere, _deg_lines, lambda v: _deg_final(v, zone))


def ring_lonlat(ring: Column, zone: int, south: bool = False) -> Column:
    """A ring in metres -> longitude and latitude."""
    out = F.transform(ring, lambda p: F.struct(*[c.alias(n) for n, c in _deg_plane(p["x"], p["y"], south).items()]))

    def apply(stage, names: tuple[str, str]):
        return lambda p: F.struct(*[c.alias(n) for n, c in stage({n: p[n] for n in names}).items()])

    out = F.transform(out, apply(_deg_sphere, ("xi", "eta")))
    out = F.transform(out, apply(_deg_lines, ("xi", "eta")))
    return F.transform(out, apply(lambda v: _deg_final(v, zone), ("lam", "chi")))


# ---------------------------------------------------------------- rings


def circle(lon: Column, lat: Column, radius_m: Column, steps: int = 32) -> Column:
    """Ring of ``steps`` vertices around a point, counter-clockwise from east."""
    ry = radius_m / CIRCLE_M_PER_DEG
    rx = radius_m / (F.cos(F.radians(lat)) * CIRCLE_M_PER_DEG)
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)),
        lambda i: vertex(lon + rx * F.cos(i * (2 * math.pi / steps)), lat + ry * F.sin(i * (2 * math.pi / steps))),
    )


def cell_ring(x0: Column, y0: Column, dx: Column, dy: Column) -> Column:
    return F.array(vertex(x0, y0), vertex(x0 + dx, y0), vertex(x0 + dx, y0 + dy), vertex(x0, y0 + dy))


def ellipse(ax: Column, ay: Column, bx: Column, by: Column, string_m: Column, points: int = 64) -> Column:
    """Locus with foci A and B and the given string length (planar metres); null if too short.

    Points around the middle on the unit vector of the axis and its normal, scaled by the half axes.
    """
    gap = F.hypot(bx - ax, by - ay)
    ux = F.when(gap > 0, (bx - ax) / gap).otherwise(F.lit(1.0))
    uy = F.when(gap > 0, (by - ay) / gap).otherwise(F.lit(0.0))
    long_ = string_m / 2
    short = F.sqrt(F.greatest((string_m - gap) * (string_m + gap), F.lit(0.0))) / 2

    def at(i: Column) -> Column:
        along, across = long_ * F.cos(i * (2 * math.pi / points)), short * F.sin(i * (2 * math.pi / points))
        return vertex((ax + bx) / 2 + along * ux - across * uy, (ay + by) / 2 + along * uy + across * ux)

    return F.when(string_m >= gap, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def capsule(ax: Column, ay: Column, bx: Column, by: Column, radius: float, per_quadrant: int = 8) -> Column:
    """Segment widened by ``radius``: a half circle at each end."""
    theta = F.atan2(by - ay, bx - ax)
    half = 2 * per_quadrant

    def arc(cx: Column, cy: Column, start: float) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(half)),
            lambda i: vertex(cx + radius * F.cos(theta + start + i * (math.pi / half)),
                             cy + radius * F.sin(theta + start + i * (math.pi / half))),
        )

    return F.concat(arc(bx, by, -math.pi / 2), arc(ax, ay, math.pi / 2))


def ring_bounds(ring: Column) -> Column:
    """``struct<x0,y0,x1,y1>``."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def project_on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Foot of the perpendicular clamped to the segment: ``struct<fraction,x,y,distance>``."""
    vx, vy = bx - ax, by - ay
    len2 = vx * vx + vy * vy
    raw = ((px - ax) * vx + (py - ay) * vy) / len2
    f = F.when(len2 <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    x, y = ax + f * vx, ay + f * vy
    return F.struct(f.alias("fraction"), x.alias("x"), y.alias("y"), F.hypot(px - x, py - y).alias("distance"))


# ---------------------------------------------------------------- boxes

Box = tuple  # west, south, east, north: numbers, columns or names of columns


def _sides(box: Box) -> list[Column]:
    return [F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v)) for v in box]


def box_meets(a: Box, b: Box) -> Column:
    """Whether two boxes have a point in common, borders included. Bounds that are columns against numbers reach the reader."""
    (w, s, e, n), (w2, s2, e2, n2) = _sides(a), _sides(b)
    return (w <= e2) & (e >= w2) & (s <= n2) & (n >= s2)


def box_contains(outer: Box, inner: Box, tolerance: float = 1e-6) -> Column:
    """Whether a box holds another, up to a tolerance in degrees."""
    (w, s, e, n), (w2, s2, e2, n2) = _sides(outer), _sides(inner)
    return (w <= w2 + tolerance) & (s <= s2 + tolerance) & (e >= e2 - tolerance) & (n >= n2 - tolerance)


# ---------------------------------------------------------------- extents


def extent_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    cos = F.greatest(F.lit(0.1), F.abs(F.cos(F.radians((north + south) / 2))))
    dx = F.greatest(F.lit(0.0), (east - west) * EXTENT_KM_PER_DEG * cos)
    return dx * F.greatest(F.lit(0.0), (north - south) * EXTENT_KM_PER_DEG)


def _around(lon: Column, lat: Column, half_lon: Column, half_lat: Column) -> Column:
    return F.struct((lon - half_lon).alias("west"), (lat - half_lat).alias("south"), (lon + half_lon).alias("east"), (lat + half_lat).alias("north"))


def _shrink(lat: Column) -> Column:
    """Length of a degree of longitude as a share of one of latitude, never below a tenth."""
    return F.greatest(F.lit(0.1), F.abs(F.cos(F.radians(lat))))


def padded_extent(min_lon: Column, max_lon: Column, min_lat: Column, max_lat: Column,
                  max_kmh: float, cutoff_s: Column, safety: float = 1.2) -> Column:
    """A box and the farthest reach at top speed on every side."""
    lat = (min_lat + max_lat) / 2
    reach = F.greatest(F.lit(0.0), cutoff_s) * (max_kmh / 3.6 * safety) / CIRCLE_M_PER_DEG
    return _around((min_lon + max_lon) / 2, lat, (max_lon - min_lon) / 2 + reach / _shrink(lat), (max_lat - min_lat) / 2 + reach)


def ellipse_extent(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column,
                   budget_s: Column, max_kmh: float, safety: float = 1.15) -> Column:
    """Axis-aligned box around everything reachable between two anchors within the budget.

    With foci 2 * (cx, cy) apart and half axes a and b, an ellipse reaches ``hypot(b, cx)`` to the east and
    ``hypot(b, cy)`` to the north of its middle, however it is turned.
    """
    lat = (a_lat + b_lat) / 2
    metres_lon = GRID_M_PER_DEG * _shrink(lat)
    cx, cy = (b_lon - a_lon) / 2 * metres_lon, (b_lat - a_lat) / 2 * GRID_M_PER_DEG
    focal = F.hypot(cx, cy)
    half = F.greatest(budget_s * (max_kmh / 3.6 / 2), focal + 1.0)
    b = F.sqrt((half - focal) * (half + focal))
    return _around((a_lon + b_lon) / 2, lat, F.hypot(b, cx) * safety / metres_lon, F.hypot(b, cy) * safety / GRID_M_PER_DEG)


def corridor_extent(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, target_km2: float) -> Column:
    """Box around both anchors, as much wider as higher than their own, of the target area; their own box if that is larger.

    Half sides x and y with ``x - y`` given and ``4 * x * y`` the target: half the difference d and the root of
    ``d * d`` plus a quarter of the target give both.
    """
    lat = (a_lat + b_lat) / 2
    km_lon = EXTENT_KM_PER_DEG * _shrink(lat)
    w, h = F.abs(b_lon - a_lon) / 2 * km_lon, F.abs(b_lat - a_lat) / 2 * EXTENT_KM_PER_DEG
    d = (w - h) / 2
    root = F.sqrt(d * d + target_km2 / 4)
    return _around((a_lon + b_lon) / 2, lat, F.greatest(w, root + d) / km_lon, F.greatest(h, root - d) / EXTENT_KM_PER_DEG)
