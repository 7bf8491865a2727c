"""Ordered trajectories: sequence, neighbours, progress, segments, stays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import CIRCLE_M_PER_DEG, haversine_m, height_scale_value
from chronoweave.functions.time import DAY_MS
from chronoweave.operators.grid import extent
from chronoweave.operators.sequence import Timeline, key_offsets
from chronoweave.operators.skew import lookup_join


def user_origin(df: DataFrame, unit: str = "instant") -> DataFrame:
    """First instant, or midnight of the first day, per user."""
    first = F.min("t_ms")
    if unit == "day":
        first = F.floor(first / DAY_MS) * DAY_MS
    return df.groupBy("user_id").agg(first.cast("long").alias("origin_ms"))


def with_elapsed(df: DataFrame, align: bool, unit: str = "instant", hot_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Add ``elapsed_ms`` from the user's own start. Needs more than one user to take effect."""
    if not align or df.select("user_id").distinct().limit(2).count() < 2:
        return df, False
    joined = lookup_join(df, user_origin(df, unit), ["user_id"], "left", hot_rows=hot_rows)
    return joined.withColumn("elapsed_ms", F.col("t_ms") - F.col("origin_ms")).drop("origin_ms"), True


def user_index(df: DataFrame) -> DataFrame:
    """Zero-based position of each user in user order."""
    return key_offsets(df.select("user_id").distinct(), ["user_id"], {"user_index": F.lit(1)})


def trajectory(df: DataFrame, align: bool = False, hot_rows: int | None = None) -> DataFrame:
    """The 3-D path: one row per fix with sequence, progress, height and neighbour numbers."""
    ext = extent(df)
    users = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"),
                                      F.max("t_ms").alias("last_ms"))
    users = users.withColumn("origin_ms", (F.floor(F.col("first_ms") / DAY_MS) * DAY_MS).cast("long"))
    users = key_offsets(users, ["user_id"], {"offset": F.col("n"), "user_index": F.lit(1)})
    span = users.agg(F.max(F.col("last_ms") - F.col("origin_ms")).alias("longest"),
                     F.count(F.lit(1)).alias("users")).first()
    aligned = align and span["users"] > 1

    line = Timeline(df, ["user_id"], "t_ms", "point_id", hot_rows).running(_rn=F.lit(1)).result()
    rows = lookup_join(line, users.select("user_id", "n", "offset", "user_index", "origin_ms"), ["user_id"],
                       hot_rows=hot_rows)
    seq = F.col("offset") + F.col("_rn") - 1
    height = height_scale_value(ext.min_lon, ext.max_lon, ext.min_lat, ext.max_lat)
    if aligned:
        elapsed = F.col("t_ms") - F.col("origin_ms")
        progress = elapsed / F.lit(float(span["longest"])) if span["longest"] > 0 else F.lit(0.0)
        shown = elapsed + F.lit(math.floor(ext.t_min / DAY_MS) * DAY_MS)
    else:
        progress = (F.col("t_ms") - ext.t_min) / F.lit(float(ext.t_max - ext.t_min or 1))
        shown = F.col("t_ms")
    neighbours = F.filter(
        F.array(F.when(F.col("_rn") > 1, seq - 1), F.when(F.col("_rn") < F.col("n"), seq + 1)),
        lambda i: i.isNotNull())
    out = rows.withColumns({
        "sequence": seq.cast("long"),
        "time_progress": progress,
        "height_m": progress * height,
        "timestamp_ms": shown.cast("long"),
        "neighbors": neighbours,
    })
    if aligned:
        out = out.withColumn("elapsed_ms", F.col("t_ms") - F.col("origin_ms"))
    return out.drop("_rn", "n", "offset", "origin_ms")


def flatten(df: DataFrame) -> DataFrame:
    """The same rows on the ground plane."""
    return df.withColumn("height_m", F.lit(0.0))


def segments(df: DataFrame, carry: list[str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """Consecutive pairs of one user's fixes; the attributes are those of the first."""
    names = ["lon", "lat", "t_ms", *(carry or [])]
    line = Timeline(df, ["user_id"], "t_ms", "point_id", hot_rows)
    paired = line.neighbours(following={f"next_{c}": F.col(c) for c in names}).result()
    return paired.filter(F.col("next_t_ms").isNotNull())


def stays_by_field(traj: DataFrame, field: str, hot_rows: int | None = None) -> DataFrame:
    """One row per run of equal values along a user's path."""
    value = F.coalesce(F.col(field).cast("string"), F.lit("nan"))
    line = Timeline(traj.withColumn("_v", value), ["user_id"], "t_ms", "point_id", hot_rows)
    line = line.neighbours(previous={"_prev": F.col("_v")})
    line = line.running(run=F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("_v")), 1).otherwise(0))
    at = F.struct("t_ms", "point_id")
    runs = line.result().groupBy("user_id", "run").agg(
        F.first("_v").alias("label"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        F.avg("height_m").alias("height_m"), F.count(F.lit(1)).alias("point_count"),
        F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms"),
        F.min_by("time_progress", at).alias("_p0"), F.max_by("time_progress", at).alias("_p1"),
    )
    return runs.select(
        "user_id", "run", "label", "lon", "lat", "height_m", "point_count",
        ((F.col("_p0") + F.col("_p1")) / 2).alias("time_progress"),
        ((F.col("start_ms") + F.col("end_ms")) / 2).alias("timestamp_ms"),
        ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"),
    )


def stay_points(df: DataFrame, dist_m: float = 100.0, window_ms: int = 300_000, hot_rows: int | None = None) -> DataFrame:
    """Fixes that have another fix of the same user within the time window and nearer than ``dist_m``.

    Decided in three steps, each on fewer rows, so no step lists the pairs of a dense group:
    the previous and next fix settle most rows; a second fix in the same small square (whose
    diagonal is below the distance) settles crowded places; the few rows left, at most one per
    square and window, are compared with the fixes in the surrounding squares.
    """
    near = {"_lon": F.col("lon"), "_lat": F.col("lat"), "_t": F.col("t_ms")}
    line = Timeline(df, ["user_id"], "t_ms", "point_id", hot_rows)
    step1 = line.neighbours({f"p{k}": v for k, v in near.items()}, {f"n{k}": v for k, v in near.items()}).result()

    def close(side: str) -> Column:
        return haversine_m(F.col("lon"), F.col("lat"), F.col(f"{side}_lon"), F.col(f"{side}_lat")) < dist_m

    in_p = F.coalesce(F.col("t_ms") - F.col("p_t") <= window_ms, F.lit(False))
    in_n = F.coalesce(F.col("n_t") - F.col("t_ms") <= window_ms, F.lit(False))
    step1 = step1.withColumn("_state", F.when((in_p & close("p")) | (in_n & close("n")), F.lit(1))
                             .when(~in_p & ~in_n, F.lit(0)))
    step1 = step1.drop(*[f"{s}{k}" for s in "pn" for k in near])
    if step1.filter(F.col("_state").isNull()).isEmpty():
        return step1.filter(F.col("_state") == 1).select(*df.columns)

    lat_deg = dist_m / CIRCLE_M_PER_DEG
    cos = F.greatest(F.lit(0.01), F.cos(F.radians((F.floor(F.col("lat")) + F.lit(0.5)))))
    # small square: side 0.6 * distance, so its diagonal stays below the distance within a degree of latitude
    small = {"_sx": F.floor(F.col("lon") * cos / (lat_deg * 0.6)), "_sy": F.floor(F.col("lat") / (lat_deg * 0.6))}
    keyed = step1.withColumns(small)
    square = Timeline(keyed, ["user_id", "_sx", "_sy"], "t_ms", "point_id", hot_rows)
    step2 = square.neighbours({f"p{k}": v for k, v in near.items()}, {f"n{k}": v for k, v in near.items()}).result()
    in_p = F.coalesce(F.col("t_ms") - F.col("p_t") <= window_ms, F.lit(False))
    in_n = F.coalesce(F.col("n_t") - F.col("t_ms") <= window_ms, F.lit(False))
    step2 = step2.withColumn("_state", F.coalesce(
        F.col("_state"), F.when((in_p & close("p")) | (in_n & close("n")), F.lit(1))))
    step2 = step2.drop(*[f"{s}{k}" for s in "pn" for k in near], "_sx", "_sy")

    # compare what is left square by square; longitude reach follows the row's own latitude
    def cells(lon: Column, lat: Column, t: Column) -> dict[str, Column]:
        return {"_cy": F.floor(lat / lat_deg), "_ct": F.floor(t / window_ms),
                "_cx": F.floor(lon / (lat_deg / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs(F.floor(lat)) + 1.0)))))}

    rest = step2.filter(F.col("_state").isNull())
    home = cells(F.col("lon"), F.col("lat"), F.col("t_ms"))
    reach = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    probes = (rest.select("user_id", "point_id", "lon", "lat", "t_ms")
              .withColumn("_dy", F.explode(reach)).withColumn("_qy", F.floor(F.col("lat") / lat_deg) + F.col("_dy"))
              .withColumn("_band", F.explode(F.array_distinct(F.array(  # whole-degree bands the neighbour row may use
                  F.floor(F.col("_qy") * lat_deg), F.floor((F.col("_qy") + 1) * lat_deg)))))
              .withColumn("_w", lat_deg / F.greatest(F.lit(0.01), F.cos(F.radians(F.abs(F.col("_band")) + 1.0))))
              .withColumn("_dx", F.explode(reach)).withColumn("_dt", F.explode(reach))
              .select("user_id", "_band", F.col("point_id").alias("_pid"), F.col("lon").alias("_plon"),
                      F.col("lat").alias("_plat"), F.col("t_ms").alias("_pt"),
                      F.col("_qy").alias("_cy"), (F.floor(F.col("lon") / F.col("_w")) + F.col("_dx")).alias("_cx"),
                      (F.floor(F.col("t_ms") / window_ms) + F.col("_dt")).alias("_ct")))
    others = df.select("user_id", "point_id", "lon", "lat", "t_ms").withColumns(home) \
        .withColumn("_band", F.floor("lat"))
    hits = (lookup_join(others, probes, ["user_id", "_band", "_cx", "_cy", "_ct"], hot_rows=hot_rows)
            .filter((F.col("point_id") != F.col("_pid")) & (F.abs(F.col("t_ms") - F.col("_pt")) <= window_ms)
                    & (haversine_m(F.col("_plon"), F.col("_plat"), F.col("lon"), F.col("lat")) < dist_m))
            .select(F.col("_pid").alias("point_id"), "user_id").distinct())
    found = rest.join(hits, ["user_id", "point_id"], "left_semi")
    return step2.filter(F.col("_state") == 1).unionByName(found).select(*df.columns)
