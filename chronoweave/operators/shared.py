"""Prisms against prisms, and observed activities against prisms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import CIRCLE_M_PER_DEG, haversine_m
from chronoweave.functions.hexgrid import hex_center, with_hexes
from chronoweave.operators.overlap import overlapping
from chronoweave.operators.skew import lookup_join, spread


def occupancy(trips: DataFrame, speed_ms: float, step_ms: int, resolution: int, lat0: float, key: str = "pair_id") -> DataFrame:
    """``key, hex_q, hex_r, first, last``: the instants ``first * step_ms`` to ``last * step_ms`` at which a trip can be in a hexagon.

    ``trips``: anchor pairs with ``dt_s`` and ``feasible``. A centre at d1 metres from the start and d2 from the end can be reached
    from ``a_ms + d1 / v`` to ``b_ms - d2 / v``, without a gap, so a hexagon is one row whatever the number of instants. All
    trips share the hexagons of one resolution and reference latitude.
    """
    own = spread(trips.filter("feasible")).withColumns({
        "_mx": (F.col("a_lon") + F.col("b_lon")) / 2, "_my": (F.col("a_lat") + F.col("b_lat")) / 2, "_r": F.col("dt_s") * (speed_ms / 2)})
    cells = with_hexes(own, F.col("_mx"), F.col("_my"), F.col("_r"), resolution, lat0)
    c = hex_center(F.col("hex_q"), F.col("hex_r"), resolution, lat0)

    def way_ms(lon: Column, lat: Column) -> Column:
        return F.hypot((c["x"] - lon) * F.cos(F.radians(lat)), c["y"] - lat) * (CIRCLE_M_PER_DEG * 1000 / speed_ms)

    first = F.ceil((F.col("a_ms") + way_ms(F.col("a_lon"), F.col("a_lat"))) / step_ms)
    last = F.floor((F.col("b_ms") - way_ms(F.col("b_lon"), F.col("b_lat"))) / step_ms)
    return cells.select(key, "hex_q", "hex_r", first.alias("first"), last.alias("last")).filter("first <= last")


def shared_cells(occupied: DataFrame, key: str = "pair_id", hot_rows: int | None = None) -> DataFrame:
    """Hexagons and instants that two prisms have in common: ``key, other, hex_q, hex_r, first, last`` with ``key < other``.

    Instants are never listed: intervals meet by their lengths, see ``overlapping``.
    """
    others = occupied.select(F.col(key).alias("other"), "hex_q", "hex_r", F.col("first").alias("_first"), F.col("last").alias("_last"))
    met = overlapping(occupied, others, ["hex_q", "hex_r"], ("first", "last"), ("_first", "_last"), hot_rows)
    return met.filter(F.col(key) < F.col("other")).select(
        key, "other", "hex_q", "hex_r", F.greatest("first", "_first").alias("first"), F.least("last", "_last").alias("last"))


def shared_prisms(cells: DataFrame, step_ms: int, key: str = "pair_id") -> DataFrame:
    """One row for two prisms that intersect: hexagons in common, hexagons times instants, first and last instant."""
    return cells.groupBy(key, "other").agg(
        F.count(F.lit(1)).alias("shared_cells"), F.sum(F.col("last") - F.col("first") + 1).alias("shared_voxels"),
        (F.min("first") * step_ms).alias("first_ms"), (F.max("last") * step_ms).alias("last_ms"))


INSIDE, OUTSIDE, NO_PRISM = "inside", "outside", "no_prism"


def check_activities(activities: DataFrame, prisms: DataFrame, speed_ms: float, hot_rows: int | None = None) -> DataFrame:
    """Adds ``prisms`` (windows of the user that hold the activity's instant), ``reached`` (those whose two cones hold its place) and ``status``.

    ``activities``: ``activity_id`` (unique), ``user_id, t_ms, lon, lat``; ``prisms``: ``user_id`` and both anchors. An activity is
    ``inside`` if a prism holds it, ``outside`` if there are prisms of its time but none holds it, else ``no_prism``. Windows may be
    of very different lengths. Activities without a time or user have no prism, those without a place are in none.
    """
    windows = prisms.select("user_id", "a_lon", "a_lat", F.col("a_ms").cast("long").alias("a_ms"), "b_lon", "b_lat", F.col("b_ms").cast("long").alias("b_ms"))
    points = activities.select("user_id", "activity_id", "lon", "lat", F.col("t_ms").alias("_t"))
    met = overlapping(points, windows, ["user_id"], ("_t", "_t"), ("a_ms", "b_ms"), hot_rows, doublings=4)
    there = haversine_m(F.col("a_lon"), F.col("a_lat"), F.col("lon"), F.col("lat")) <= (F.col("_t") - F.col("a_ms")) / 1000 * speed_ms
    back = haversine_m(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat")) <= (F.col("b_ms") - F.col("_t")) / 1000 * speed_ms
    found = met.groupBy("activity_id").agg(F.count(F.lit(1)).alias("prisms"), F.count_if(there & back).alias("reached"))
    out = lookup_join(activities, found, ["activity_id"], "left", hot_rows=hot_rows).fillna(0, ["prisms", "reached"])
    return out.withColumn("status", F.when(F.col("reached") > 0, INSIDE).when(F.col("prisms") > 0, OUTSIDE).otherwise(NO_PRISM))


def activity_counts(checked: DataFrame) -> DataFrame:
    """Activities of each status a user."""
    return checked.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in (INSIDE, OUTSIDE, NO_PRISM)])
