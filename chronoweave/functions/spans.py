"""The spans of ``intervals`` for whole columns of edges at once: an edge is a row, each of its entries a column (NaN: no entry)."""

from __future__ import annotations

import numpy as np

EPS = 1e-9


def within(middle: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of [0, 1] that lies ``half`` around a place; infinite ends if there is none."""
    with np.errstate(invalid="ignore"):
        a, b = np.maximum(0.0, middle - half), np.minimum(1.0, middle + half)
        there = (half >= 0) & (b - a >= EPS)
    return np.where(there, a, np.inf), np.where(there, b, -np.inf)


def merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of every span of the union of each row's spans."""
    if not a.size:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    order = np.argsort(a, axis=1, kind="stable")
    a, b = np.take_along_axis(a, order, axis=1), np.take_along_axis(b, order, axis=1)
    there, reach = np.isfinite(a), np.maximum.accumulate(b, axis=1)
    new = there.copy()
    new[:, 1:] &= ~(reach[:, :-1] + EPS >= a[:, 1:])
    row, at = np.nonzero(new)
    last = np.append(row[1:] != row[:-1], True)[:len(row)]
    stop = np.where(last, a.shape[1] - 1, np.append(at[1:], 0)[:len(row)] - 1)
    return row, a[row, at], reach[row, stop]


def travel_time(s: np.ndarray, at: np.ndarray, delay: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Least time to position s of each row."""
    out = np.full(len(s), np.nan)
    for i in range(at.shape[1]):
        out = np.fmin(out, delay[:, i] + cost * np.abs(s - at[:, i]))
    return out


def reached(du: np.ndarray, dv: np.ndarray, own: np.ndarray, cost: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of each edge within its cutoff: row, begin, end and the least, middle and greatest time to get there.

    ``du, dv``: times at the ends, ``own``: fraction at which a search starts on the edge; NaN where there is none.
    """
    zero = np.zeros(len(du))
    at = np.stack([zero, zero + 1.0, own], axis=1)
    delay = np.stack([du, dv, np.where(np.isnan(own), np.nan, 0.0)], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(cost > 0, (cutoff[:, None] - delay).T / cost, np.nan).T
    row, a, b = merge(*within(at, half))
    at, delay, cost = at[row], delay[row], cost[row]
    least, most = np.full(len(row), np.nan), np.full(len(row), -np.inf)
    for i in range(3):
        spot = np.maximum(a, np.minimum(b, at[:, i]))
        least = np.fmin(least, np.where(np.isnan(delay[:, i]), np.nan, travel_time(spot, at, delay, cost)))
    meet = [(at[:, p] + at[:, q]) / 2 + (delay[:, q] - delay[:, p]) / (2 * cost) for p, q in ((0, 1), (0, 2), (2, 1))]
    with np.errstate(invalid="ignore"):
        for spot in (a, b, *(np.where((m > a) & (m < b), m, np.nan) for m in meet)):
            most = np.fmax(most, travel_time(spot, at, delay, cost))
    return row, a, b, least, travel_time((a + b) / 2, at, delay, cost), most
