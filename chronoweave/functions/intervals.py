"""Travel time along one road edge, and the parts of the edge inside a time budget.

A position on an edge is a fraction s in [0, 1]. An edge is entered at a few places: at an end that was
reached, after the delay of getting there, and on the edge an anchor was snapped to at the anchor's own foot
without delay. From an entry at p with delay d, position s is reached after ``d + cost * |s - p|``; the
travel time is the least over all entries. Unreached ends are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import spans
from chronoweave.session import ship_package

_ENTRY = "struct<at:double,delay:double>"
_SPAN = "struct<a:double,b:double>"
EPS = 1e-9
SLACK_S = 1e-6


def entries(du: Column, dv: Column, snapped: Column, fraction: Column) -> Column:
    """Where an edge is entered: ``array<struct<at, delay>>``."""
    def entry(at: Column, delay: Column) -> Column:
        return F.struct(at.cast("double").alias("at"), delay.cast("double").alias("delay"))

    options = F.array(F.when(du.isNotNull(), entry(F.lit(0.0), du)), F.when(dv.isNotNull(), entry(F.lit(1.0), dv)),
                      F.when(snapped, entry(fraction, F.lit(0.0)))).cast(f"array<{_ENTRY}>")
    return F.filter(options, lambda e: e.isNotNull())


def travel_time(s: Column, ways: Column, cost: Column) -> Column:
    """Least time to position s; null where nothing enters the edge."""
    return F.array_min(F.transform(ways, lambda e: e["delay"] + cost * F.abs(s - e["at"])))


def merge_spans(spans: Column, eps: float = EPS) -> Column:
    """Union of overlapping ``struct<a,b>`` spans."""

    def absorb(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        touches = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] + eps >= s["a"])
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))) \
            .otherwise(F.concat(acc, F.array(s)))

    return F.when(F.size(spans) == 0, spans).otherwise(
        F.aggregate(
            F.slice(F.array_sort(spans), F.lit(2), F.size(spans)),
            F.slice(F.array_sort(spans), F.lit(1), F.lit(1)), absorb,
        ))


def _within(middle: Column, half: Column) -> Column:
    """The part of [0, 1] that lies ``half`` around a place; null if there is none."""
    a, b = F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)
    return F.when((half >= 0) & (b - a >= EPS), F.struct(a.alias("a"), b.alias("b"))).cast(_SPAN)


def _kept(spans: Column) -> Column:
    return merge_spans(F.filter(spans, lambda s: s.isNotNull()))


def reachable_spans(du: Column, dv: Column, cost: Column, cutoff: Column, snapped: Column, fraction: Column) -> Column:
    """Parts of an edge one origin reaches within the cutoff: what is left after the delay, around each entry."""
    ways = entries(du, dv, snapped, fraction)
    return F.when(cost > 0, _kept(F.transform(ways, lambda e: _within(e["at"], (cutoff - e["delay"]) / cost)))) \
        .otherwise(F.array().cast(f"array<{_SPAN}>"))


def span_times(a: Column, b: Column, ways: Column, cost: Column) -> Column:
    """Least, middle and greatest travel time over a span.

    The least is at the place of the span nearest to some entry; the greatest at an end of the span or
    where the ways from two entries meet.
    """
    nearest = F.transform(ways, lambda e: travel_time(F.greatest(a, F.least(b, e["at"])), ways, cost))
    meet = F.flatten(F.transform(ways, lambda p: F.transform(
        ways, lambda q: (p["at"] + q["at"]) / 2 + (q["delay"] - p["delay"]) / (2 * cost))))
    peaks = F.concat(F.array(a, b), F.filter(meet, lambda s: (s > a) & (s < b)))
    return F.struct(F.array_min(nearest).alias("travel_min"), travel_time((a + b) / 2, ways, cost).alias("travel_mid"),
                    F.array_max(F.transform(peaks, lambda s: travel_time(s, ways, cost))).alias("travel_max"))


def with_feasible_spans(df: DataFrame, ways_a: Column, ways_b: Column, cost: Column, budget: Column, out: str = "spans") -> DataFrame:
    """Add the parts of an edge where time from A plus time to B stays within the budget.

    Entering at p and leaving at q leaves ``budget - delays`` for ``|s - p| + |s - q|``: the places around the
    middle of p and q, as far as half of that; the answer is the union over all pairs of entries.
    """
    ship_package(df.sparkSession)
    return df.withColumn(out, _room(ways_a, ways_b, cost.cast("double"), budget.cast("double") + SLACK_S))


def _padded(ways: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places and delays of each row's entries, a column each."""
    many = pc.fill_null(pc.list_value_length(ways), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = ways.flatten(), np.repeat(np.arange(len(many)), many)
    spot = row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    out = np.full((2, len(many), max(many.max(initial=0), 1)), np.nan)
    for i, name in enumerate(("at", "delay")):
        out[i][spot] = flat.field(name).to_numpy(zero_copy_only=False)
    return out[0], out[1]


def _rooms(ways_a: pa.Array, ways_b: pa.Array, cost: pa.Array, budget: pa.Array) -> pa.Array:
    (pa_at, pa_delay), (pb_at, pb_delay) = _padded(ways_a), _padded(ways_b)
    c, k = (v.to_numpy(zero_copy_only=False).astype(float) for v in (cost, budget))
    low, high = [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        for p in range(pa_at.shape[1]):
            for q in range(pb_at.shape[1]):
                room = (k - pa_delay[:, p] - pb_delay[:, q]) / c
                a, b = spans.within((pa_at[:, p] + pb_at[:, q]) / 2, np.where(room >= np.abs(pa_at[:, p] - pb_at[:, q]), room / 2, np.nan))
                low.append(a)
                high.append(b)
    row, a, b = spans.merge(np.stack(low, axis=1), np.stack(high, axis=1))
    none = pc.or_(ways_a.is_null(), ways_b.is_null())
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(c)))]).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(ends), found, mask=none)


def _room(ways_a: Column, ways_b: Column, cost: Column, budget: Column) -> Column:
    room = F.arrow_udf(_rooms, f"array<{_SPAN}>").asNondeterministic()  # evaluated once, not again inside a filter on it
    return room(ways_a, ways_b, cost, budget)
