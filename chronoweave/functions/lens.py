"""Overlap of two reach circles, both drawn as regular polygons, for a whole Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.functions.geo import CIRCLE_M_PER_DEG

OVERLAP = "struct<ring:array<struct<x:double,y:double>>,area:double>"


def _rings(lon: np.ndarray, lat: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """(rows, steps, 2) vertices, counter-clockwise from east."""
    ang = np.arange(steps) * (2 * np.pi / steps)
    ry = r / CIRCLE_M_PER_DEG
    rx = r / (CIRCLE_M_PER_DEG * np.cos(np.radians(lat)))
    return np.stack([lon[:, None] + rx[:, None] * np.cos(ang), lat[:, None] + ry[:, None] * np.sin(ang)], axis=2)


def _sides_inside(p: np.ndarray, q: np.ndarray, lon: np.ndarray, lat: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the part of every side of ``p`` inside the convex ring ``q``, a circle of ``_rings``; NaN where there is none."""
    start, step = p, np.roll(p, -1, axis=1) - p
    # seen from the middle of q its corners are at distance one and its sides no nearer than this
    near = np.cos(np.pi / q.shape[1])
    ry = r / CIRCLE_M_PER_DEG
    rx = r / (CIRCLE_M_PER_DEG * np.cos(np.radians(lat)))
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = (p[..., 0] - lon[:, None]) / rx[:, None], (p[..., 1] - lat[:, None]) / ry[:, None]
        dx, dy = step[..., 0] / rx[:, None], step[..., 1] / ry[:, None]
        away = np.hypot(x, y)
        foot = np.clip(-(x * dx + y * dy) / (dx * dx + dy * dy), 0.0, 1.0)
        outside = np.hypot(x + foot * dx, y + foot * dy) > 1 + 1e-6
        inside = (away < near - 1e-6) & (np.roll(away, -1, axis=1) < near - 1e-6)
    t0, t1 = np.where(outside, np.nan, 0.0), np.where(outside, np.nan, 1.0)
    # only sides near the border of q are cut by its sides
    row, side = np.nonzero(~outside & ~inside)
    edge = np.roll(q, -1, axis=1) - q
    px, py, sx, sy = (np.ascontiguousarray(v[row, side, i])[:, None] for v in (start, step) for i in (0, 1))
    qx, qy, ex, ey = (v[row, :, i] for v in (q, edge) for i in (0, 1))
    num = ex * (py - qy)
    num -= ey * (px - qx)
    den = ex * sy
    den -= ey * sx
    with np.errstate(divide="ignore", invalid="ignore"):
        t = num / den
    np.negative(t, out=t)
    low = np.where(den > 0, t, 0.0).max(axis=1).clip(0.0, None)
    high = np.where(den < 0, t, 1.0).min(axis=1).clip(None, 1.0)
    out = (low > high) | ((den == 0) & (num < 0)).any(axis=1)
    t0[row, side], t1[row, side] = np.where(out, np.nan, low), np.where(out, np.nan, high)
    return start + t0[..., None] * step, start + t1[..., None] * step


#: Pairs of circles measured together.
TOGETHER = 256


def circle_overlap(steps: int):
    """Column function ``(lon1, lat1, r1, lon2, lat2, r2) -> struct<ring, area>`` (square degrees), null if apart."""

    @F.arrow_udf(OVERLAP)
    def overlap(lon1: pa.Array, lat1: pa.Array, r1: pa.Array, lon2: pa.Array, lat2: pa.Array, r2: pa.Array) -> pa.Array:
        given = [np.asarray(c.to_numpy(zero_copy_only=False), float) for c in (lon1, lat1, r1, lon2, lat2, r2)]
        rows = len(given[0])
        sizes, corners, area = np.zeros(rows, np.int64), [], np.full(rows, np.nan)
        for lo in range(0, rows, TOGETHER):
            part = [c[lo:lo + TOGETHER] for c in given]
            p, q = _rings(*part[:3], steps), _rings(*part[3:], steps)
            pts = np.concatenate([*_sides_inside(p, q, *part[3:]), *_sides_inside(q, p, *part[:3])], axis=1)
            none = np.isnan(pts[..., 0])
            mid = np.nanmean(np.where(none.all(axis=1)[:, None, None], 0.0, pts), axis=1)
            ang = np.arctan2(pts[..., 1] - mid[:, None, 1], pts[..., 0] - mid[:, None, 0])
            order = np.argsort(ang, axis=1, kind="stable")  # corners that there are not come last
            pts, there = np.take_along_axis(pts, order[..., None], axis=1), ~np.take_along_axis(none, order, axis=1)
            before = np.roll(pts, 1, axis=1)
            before[:, 0] = pts[np.arange(len(pts)), np.maximum(there.sum(axis=1) - 1, 0)]
            with np.errstate(invalid="ignore"):
                keep = there & (np.abs(pts - before).max(axis=2) > 1e-12)
            many = keep.sum(axis=1)
            keep &= (many >= 3)[:, None]
            drawn = np.flatnonzero(many >= 3)
            many = many[drawn]
            sizes[lo + drawn] = many
            if not len(drawn):
                continue
            flat, first = pts[keep], np.cumsum(many) - many
            corners.append(flat)
            own = flat - np.repeat(flat[first], many, axis=0)
            after = np.arange(1, len(flat) + 1)
            after[first + many - 1] = first
            area[lo + drawn] = np.abs(np.add.reduceat(own[:, 0] * own[after, 1] - own[after, 0] * own[:, 1], first)) / 2
        flat, none = np.concatenate([*corners, np.zeros((0, 2))]), pa.array(sizes == 0)
        vertices = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["x", "y"])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        rings = pa.ListArray.from_arrays(ends, vertices, mask=none)
        return pa.StructArray.from_arrays([rings, pa.array(area, mask=sizes == 0)], names=["ring", "area"])

    return overlap.asNondeterministic()  # keeps the planner from evaluating it once more inside a filter


def _inside(a: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part of each line, from ``a`` along ``d``, inside the ring of its row; 1 and 0 where there is none."""
    ex, ey = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    num = ex * (a[:, 1:2] - y) - ey * (a[:, 0:1] - x)
    den = ex * d[:, 1:2] - ey * d[:, 0:1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = -num / den
    lo = np.where(den > 0, t, 0.0).max(axis=1).clip(0.0, None)
    hi = np.where(den < 0, t, 1.0).min(axis=1).clip(None, 1.0)
    out = ((den == 0) & (num < 0)).any(axis=1)
    return np.where(out, 1.0, lo), np.where(out, 0.0, hi)


def _clip(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    a = np.column_stack([ax, ay]).astype(float)
    d = np.column_stack([bx, by]).astype(float) - a
    t0, t1 = np.zeros(len(a)), np.ones(len(a))
    sides = np.array([len(v) for v in xs])
    for n in np.unique(sides):  # rings of one length are handled together
        for rows in np.array_split(np.flatnonzero(sides == n), max(1, (sides == n).sum() // 4096)):
            x, y = np.stack(xs.iloc[rows].to_list()), np.stack(ys.iloc[rows].to_list())
            t0[rows], t1[rows] = _inside(a[rows], d[rows], x, y)
    return pd.DataFrame({"t0": t0, "t1": t1})


def _oval(x, y, nx, ny, string, points: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Corners of ``geo.ellipse``."""
    gap = np.hypot(nx - x, ny - y)
    apart = np.where(gap > 0, gap, 1.0)
    ux, uy = np.where(gap > 0, (nx - x) / apart, 1.0), np.where(gap > 0, (ny - y) / apart, 0.0)
    short = np.sqrt(np.maximum((string - gap) * (string + gap), 0.0)) / 2
    turn = np.arange(points) * (2 * np.pi / points)
    along, across = (string / 2)[:, None] * np.cos(turn), short[:, None] * np.sin(turn)
    return (((x + nx) / 2)[:, None] + along * ux[:, None] - across * uy[:, None], ((y + ny) / 2)[:, None] + along * uy[:, None] + across * ux[:, None])


def _widened(x, y, nx, ny, radius, per_quadrant: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Corners of ``geo.capsule``."""
    theta, half = np.arctan2(ny - y, nx - x)[:, None], 2 * per_quadrant
    turn, r = np.arange(half + 1) * (np.pi / half), radius[:, None]
    out, back = theta - np.pi / 2 + turn, theta + np.pi / 2 + turn
    return (np.concatenate([nx[:, None] + r * np.cos(out), x[:, None] + r * np.cos(back)], axis=1),
            np.concatenate([ny[:, None] + r * np.sin(out), y[:, None] + r * np.sin(back)], axis=1))


def _clip_area(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, drawn: pd.DataFrame, fallback: pd.Series) -> pd.DataFrame:
    a = np.column_stack([ax, ay]).astype(float)
    d = np.column_stack([bx, by]).astype(float) - a
    x, y, nx, ny, string, radius = (drawn[c].to_numpy(float) for c in ("x", "y", "nx", "ny", "string", "radius"))
    t0, t1, wide = np.zeros(len(a)), np.ones(len(a)), fallback.to_numpy(bool)
    for kind in (False, True):
        every = np.flatnonzero(wide == kind)
        for low in range(0, len(every), 4096):
            rows = every[low:low + 4096]
            ends = x[rows], y[rows], nx[rows], ny[rows]
            t0[rows], t1[rows] = _inside(a[rows], d[rows], *(_widened(*ends, radius[rows]) if kind else _oval(*ends, string[rows])))
    return pd.DataFrame({"t0": t0, "t1": t1})


def clip_to_ring(ax: Column, ay: Column, bx: Column, by: Column, xs: Column, ys: Column) -> Column:
    """Part of A->B inside a convex counter-clockwise ring given as two arrays: ``struct<t0,t1>``, empty if t0 > t1."""
    clip = F.pandas_udf(_clip, "struct<t0:double,t1:double>").asNondeterministic()  # evaluated once, not again inside a filter on it
    return clip(ax, ay, bx, by, xs, ys)


def clip_to_area(ax: Column, ay: Column, bx: Column, by: Column, drawn: Column, fallback: Column) -> Column:
    """``clip_to_ring`` for the ellipse with foci ``x, y`` and ``nx, ny`` and length ``string`` of ``drawn``, or the capsule of its ``radius``
    where ``fallback`` holds: the corners are made here, so that they travel nowhere."""
    clip = F.pandas_udf(_clip_area, "struct<t0:double,t1:double>").asNondeterministic()  # evaluated once, not again inside a filter on it
    return clip(ax, ay, bx, by, drawn, fallback)
