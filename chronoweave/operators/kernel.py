"""Space-time kernel density on a sparse cell grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.time import anchor_millis, readable
from chronoweave.operators.grid import (
    Extent, Grid, Slices, extent, grid_spec, spatial_bandwidth, temporal_bandwidth, time_slices)
from chronoweave.operators.quantiles import group_quantiles, quantiles
from chronoweave.operators.skew import broadcast_if_small, spread
from chronoweave.operators.trajectory import with_elapsed
from chronoweave.session import cut_lineage

# Up to this many slices every slice is one running sum of the same aggregation.
WIDE_SLICES = 24


def spatial_kernel(d2: Column, h: float) -> Column:
    u = F.lit(1.0) - d2 / (h * h)
    return F.lit(3.0 / (math.pi * h * h)) * u * u


def temporal_kernel(dt: Column, h: float) -> Column:
    u = F.lit(1.0) - F.pow(dt / h, 2)
    return F.when(F.abs(dt) <= h, F.lit(15.0 / (16.0 * h)) * u * u).otherwise(F.lit(0.0))


def _near_cells(df: DataFrame, grid: Grid, h: float) -> DataFrame:
    """One row per point and cell whose centre lies within the bandwidth (``row, col, ks``).

    The cell ranges come from the disc itself, row by row, so nothing outside it is produced.
    """
    y, x = F.col("lat"), F.col("lon")
    r0 = F.greatest(F.lit(0), F.ceil((y - h - grid.y_min) / grid.cell_y - 0.5))
    r1 = F.least(F.lit(grid.n_rows - 1), F.floor((y + h - grid.y_min) / grid.cell_y - 0.5))
    rows = df.filter(r0 <= r1).withColumn("row", F.explode(F.sequence(r0, r1)))
    dy = grid.center_y(F.col("row")) - y
    half = F.sqrt(F.greatest(F.lit(0.0), F.lit(h * h) - dy * dy))
    # one cell of slack on each side; the exact test below decides
    c0 = F.greatest(F.lit(0), F.ceil((x - half - grid.x_min) / grid.cell_x - 0.5 - 1e-9))
    c1 = F.least(F.lit(grid.n_cols - 1), F.floor((x + half - grid.x_min) / grid.cell_x - 0.5 + 1e-9))
    cells = rows.withColumns({"_c0": c0, "_c1": c1}).filter("_c0 <= _c1") \
        .withColumn("col", F.explode(F.sequence("_c0", "_c1"))).drop("_c0", "_c1")
    d2 = F.pow(grid.center_x(F.col("col")) - x, 2) + F.pow(grid.center_y(F.col("row")) - y, 2)
    return cells.withColumn("_d2", d2).filter(F.col("_d2") <= h * h) \
        .withColumn("ks", spatial_kernel(F.col("_d2"), h)).drop("_d2")


def _slices_in_reach(t: Column, centers: list[float], h: float) -> Column:
    """The slices whose centre is within the bandwidth of an instant, with their weights; evenly spaced ones are a range of numbers."""
    step = (centers[-1] - centers[0]) / (len(centers) - 1)
    if step > 0 and all(abs(c - (centers[0] + step * i)) <= 1e-9 * step for i, c in enumerate(centers)):
        first = F.greatest(F.lit(0), F.ceil((t - h - centers[0]) / step - 1e-9))
        last = F.least(F.lit(len(centers) - 1), F.floor((t + h - centers[0]) / step + 1e-9))
        reach = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        slots = F.transform(reach, lambda i: F.struct(i.cast("int").alias("t_idx"), temporal_kernel(t - (centers[0] + step * i), h).alias("kt")))
    else:
        slots = F.array(*[F.struct(F.lit(i).alias("t_idx"), temporal_kernel(t - c, h).alias("kt")) for i, c in enumerate(centers)])
    return F.filter(slots, lambda s: s["kt"] > 0)


def density(points: DataFrame, grid: Grid, centers: list[float], h_s: float, h_t: float) -> DataFrame:
    """``t_idx, row, col, density`` for cells with a positive sum; needs ``lon, lat, t_s``."""
    if len(centers) <= WIDE_SLICES:
        weights = [f"kt{i}" for i in range(len(centers))]
        weighted = points.select("lon", "lat", *[
            temporal_kernel(F.col("t_s") - c, h_t).alias(w) for w, c in zip(weights, centers)])
        # a point outside every slice's window adds nothing
        weighted = weighted.filter(F.greatest(*weights, F.lit(0.0)) > 0)
        sums = _near_cells(weighted, grid, h_s).groupBy("row", "col").agg(
            *[F.sum(F.col("ks") * F.col(w)).alias(w) for w in weights])
        stacked = sums.select("row", "col", F.posexplode(F.array(*weights)).alias("t_idx", "density"))
    else:
        weighted = points.select("lon", "lat", _slices_in_reach(F.col("t_s"), centers, h_t).alias("slots")).filter(F.size("slots") > 0)
        stacked = (_near_cells(weighted, grid, h_s)
                   .select("row", "col", "ks", F.inline("slots"))
                   .groupBy("t_idx", "row", "col").agg(F.sum(F.col("ks") * F.col("kt")).alias("density")))
    return stacked.filter("density > 0").select(
        F.col("t_idx").cast("int").alias("t_idx"), F.col("row").cast("int").alias("row"),
        F.col("col").cast("int").alias("col"), "density")


def density_2d(points: DataFrame, grid: Grid, h_s: float) -> DataFrame:
    """Plain spatial density, time ignored."""
    near = _near_cells(points.select("lon", "lat"), grid, h_s)
    return near.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")) \
        .agg(F.sum("ks").alias("density")).filter("density > 0")


PROBS = [0.90, 0.975, 0.99]  # fixed values: class thresholds


def density_thresholds(cells: DataFrame, error: float | None = None) -> list[float]:
    """Quantiles of all positive cell densities, every slice pooled; with ``error`` off by at most that share of all ranks."""
    return quantiles(cells.filter("density > 0"), F.col("density"), PROBS, error)


def _class_of(d: Column, q90: Column, q975: Column, q99: Column) -> Column:
    return F.when(d >= q99, F.lit(3)).when(d >= q975, F.lit(2)).when(d > q90, F.lit(1)).otherwise(F.lit(0))


def classify(cells: DataFrame, thresholds: list[float] | None = None, per_slice: bool = False) -> DataFrame:
    """Add ``classification`` 1..3 and drop the rest.

    Pooled thresholds by default; per slice, each slice is ranked on its own and every bound is strict.
    """
    if per_slice:
        limits = group_quantiles(cells, "t_idx", "density", PROBS)
        rows = cells.join(broadcast_if_small(limits), "t_idx")
        d, q = F.col("density"), F.col("q")
        cls = F.when(d > q[2], 3).when((d > q[1]) & (d < q[2]), 2).when((d > q[0]) & (d < q[1]), 1)
        return rows.withColumn("classification", cls).drop("q").filter("classification is not null")
    q = thresholds or density_thresholds(cells)
    return cells.withColumn("classification", _class_of(F.col("density"), *[F.lit(v) for v in q])) \
        .filter("classification > 0")


def ground_footprint(classified: DataFrame) -> DataFrame:
    """Each class's distinct cells seen from above."""
    return classified.select("classification", "row", "col").distinct()


def stkde(df: DataFrame, *, h_spatial: float | None = None, h_temporal: float | None = None,
          cell_m: float | None = None, cell_deg: float | None = None, n_slices: int = 10,
          method: str = "equal_interval", duration_s: float | None = None, anchor_ms: float | str | None = None,
          align: bool = False, per_slice: bool = False, cap: int | None = None, max_slices: int | None = None, quantile_error: float | None = None,
          hot_rows: int | None = None) -> dict:
    """``cells`` (density), ``classified``, ``ground`` (2-D density) and the layout."""
    ext: Extent = extent(df)
    timed, aligned = with_elapsed(df, align, hot_rows=hot_rows)
    elapsed = F.col("elapsed_ms") if aligned else F.col("t_ms") - F.lit(ext.t_min)
    timed = timed.withColumn("t_s", elapsed / 1000.0)
    h_s = h_spatial or spatial_bandwidth(df, ext, quantile_error) or 1e-9
    h_t = h_temporal or temporal_bandwidth(timed, F.col("t_s"), quantile_error) or 1e-9
    grid = grid_spec(ext, h_s, cell_m, cell_deg, cap)

    warnings: list[str] = []
    slices: Slices | None = None
    if method == "equal_interval":
        row = timed.agg(F.min("t_s"), F.max("t_s"), F.avg("t_s")).first()
        if n_slices <= 1:
            centers = [row[2]]
        else:
            step = (row[1] - row[0]) / (n_slices - 1)
            centers = [row[0] + step * i for i in range(n_slices - 1)] + [row[1]]
    else:
        anchor_s, anchor_ms = None, anchor_millis(df.sparkSession, anchor_ms)
        if method == "fixed_duration" and anchor_ms is not None:
            if aligned:
                warnings.append("slice anchor ignored: aligned time has no wall clock")
            else:
                anchor_s = (anchor_ms - ext.t_min) / 1000.0
        slices = time_slices(timed, F.col("t_s"), method, n_slices, duration_s, anchor_s)
        warnings += slices.warnings
        centers = slices.centers()

    # at most grid cells x slices rows, read several times below
    cells = cut_lineage(density(spread(timed, ext.n), grid, centers, h_s, h_t))
    slab = grid.height_m / max(len(centers), 1)
    stamp = (F.element_at(F.array(*[F.lit(float(c)) for c in centers]), F.col("t_idx") + 1) * 1000).cast("long") + ext.t_min
    classified = classify(cells, per_slice=per_slice).withColumns({
        "z": F.col("t_idx") * slab, "height_m": F.lit(slab), "side_length": F.lit(grid.side_deg), "timestamp_ms": stamp})
    if slices is not None:
        edges = F.array(*[F.lit(e) for e in slices.edges])

        def edge(i: int) -> Column:
            return readable((F.element_at(edges, F.col("t_idx") + i) * 1000).cast("long") + ext.t_min)

        classified = classified.withColumn("time_range", F.concat(edge(1), F.lit(" – "), edge(2)))
    if aligned:
        classified = classified.withColumn("elapsed_ms", F.col("timestamp_ms") - ext.t_min)
    return {"cells": cells, "classified": classified, "ground": density_2d(spread(df, ext.n), grid, h_s), "grid": grid,
            "centers": centers, "h_spatial": h_s, "h_temporal": h_t, "warnings": warnings}


