"""Space-time cube: counts and mean exposure per cell and slice, and its ground projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.time import anchor_millis, readable
from chronoweave.operators.grid import Grid, Slices, extent, grid_spec, spatial_bandwidth, time_slices
from chronoweave.operators.trajectory import segments, with_elapsed


def bin_points(df: DataFrame, grid: Grid, slices: Slices) -> DataFrame:
    """Add ``t_idx, row, col``; needs ``lon, lat, t_s``."""
    return df.withColumns({"t_idx": slices.index(F.col("t_s")), "row": grid.row_of(F.col("lat")),
                           "col": grid.col_of(F.col("lon"))})


def count_cells(binned: DataFrame, env: str | None = None) -> DataFrame:
    """Sparse cells: partial sums per task first, so one crowded cell is one small record."""
    value = F.col(env).cast("double") if env else F.lit(None).cast("double")
    value = F.when(~F.isnan(value), value)
    return binned.groupBy("t_idx", "row", "col").agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("env_sum"), F.count(value).alias("env_count"))


def ground(cells: DataFrame) -> DataFrame:
    """Collapse time: exposure is total over total, not a mean of means."""
    return cells.groupBy("row", "col").agg(
        F.sum("count").alias("count"), F.sum("env_sum").alias("env_sum"), F.sum("env_count").alias("env_count"),
    ).select("row", "col", "count", (F.col("env_sum") / F.nullif(F.col("env_count"), F.lit(0))).alias("env_value"))


def space_time_cube(df: DataFrame, *, cell_m: float | None = None, cell_deg: float | None = None, n_slices: int = 10,
                    method: str = "equal_interval", duration_s: float | None = None, anchor_ms: float | str | None = None,
                    env: str | None = None, align: bool = False, path: bool = True, max_slices: int | None = None, hot_rows: int | None = None) -> dict:
    """``cubes``, ``ground``, ``segments`` (unless ``path`` is off) and the layout (``grid``, ``slices``, ``warnings``)."""
    ext = extent(df)
    warnings: list[str] = []
    timed, aligned = with_elapsed(df, align, hot_rows=hot_rows)
    elapsed = F.col("elapsed_ms") if aligned else F.col("t_ms") - F.lit(ext.t_min)
    timed = timed.withColumn("elapsed_ms", elapsed).withColumn("t_s", elapsed / 1000.0)
    grid = grid_spec(ext, spatial_bandwidth(df, ext), cell_m, cell_deg)
    anchor_s = None
    anchor_ms = anchor_millis(df.sparkSession, anchor_ms)
    if method == "fixed_duration" and anchor_ms is not None:
        if aligned:
            warnings.append("slice anchor ignored: aligned time has no wall clock")
        else:
            anchor_s = (anchor_ms - ext.t_min) / 1000.0
    span = None if aligned else (0.0, (ext.t_max - ext.t_min) / 1000.0)
    slices = time_slices(timed, F.col("t_s"), method, n_slices, duration_s, anchor_s, span, max_slices)
    warnings += slices.warnings

    cells = count_cells(bin_points(timed, grid, slices), env)
    slab = grid.height_m / slices.n
    edges = F.array(*[F.lit(e) for e in slices.edges])
    lo, hi = F.element_at(edges, F.col("t_idx") + 1), F.element_at(edges, F.col("t_idx") + 2)

    def stamp(sec):
        return (sec * 1000).cast("long") + ext.t_min

    cubes = cells.select(
        "t_idx", "row", "col", "count",
        (F.col("env_sum") / F.nullif(F.col("env_count"), F.lit(0))).alias("env_value"),
        (F.col("t_idx") * slab).alias("z"), F.lit(slab).alias("height_m"),
        stamp((lo + hi) / 2).alias("timestamp_ms"),
        F.concat(readable(stamp(lo)), F.lit(" – "), readable(stamp(hi))).alias("time_range"),
    )
    return {"cubes": cubes, "ground": ground(cells), "segments": cube_segments(timed, grid, slices, ext.t_min, env, hot_rows) if path else None,
            "grid": grid, "slices": slices, "warnings": warnings}


def cube_segments(timed: DataFrame, grid: Grid, slices: Slices, t_min: int, env: str | None = None,
                  hot_rows: int | None = None) -> DataFrame:
    """The path threaded through the cube stack, with the mean exposure of both ends."""
    carry = ["t_s", *([env] if env else [])]
    seg = segments(timed, carry, hot_rows)
    out = seg.select(
        "user_id", "point_id", "lon", "lat", slices.height(F.col("t_s"), grid.height_m).alias("z"),
        "next_lon", "next_lat", slices.height(F.col("next_t_s"), grid.height_m).alias("next_z"),
        (F.col("elapsed_ms") + t_min).alias("timestamp_ms"),
        *([F.col(env).cast("double").alias("_a"), F.col(f"next_{env}").cast("double").alias("_b")] if env else []),
    )
    if not env:
        return out
    a, b = F.nanvl("_a", F.lit(None)), F.nanvl("_b", F.lit(None))
    mean = F.rint((a + b) / 2 * 10) / 10
    return out.withColumn("env_exposure", F.coalesce(mean, a, b)).drop("_a", "_b")
