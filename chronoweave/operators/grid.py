"""Extent, robust bandwidths, grid layout and time slices.

Everything here ends in a handful of numbers, so the results are plain Python values; the
data stays in aggregations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.geo import GRID_M_PER_DEG, cell_ring, height_scale_value
from chronoweave.operators.quantiles import exact_quantiles, quantiles

# Fixed value: cells of an automatic grid, by which its cell size is chosen.
AUTO_CELLS = 2_500


@dataclass(frozen=True)
class Extent:
    n: int
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float
    mean_lon: float
    mean_lat: float
    var_lon: float = 0.0
    var_lat: float = 0.0
    t_min: int | None = None
    t_max: int | None = None


def extent(df: DataFrame) -> Extent:
    aggs = [F.count(F.lit(1)).alias("n"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"),
            F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
            F.avg("lon").alias("mean_lon"), F.avg("lat").alias("mean_lat"), F.var_pop("lon").alias("var_lon"), F.var_pop("lat").alias("var_lat")]
    if "t_ms" in df.columns:
        aggs += [F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max")]
    row = df.agg(*aggs).first()
    if not row["n"]:
        raise ValueError("no usable points")
    return Extent(**row.asDict())


def spatial_bandwidth(df: DataFrame, ext: Extent | None = None, error: float | None = None) -> float:
    """0.9 * min(SD, median distance / 0.6745) * n^(-1/6), distances to the mean centre in degrees.

    With ``error`` the median may be off by that share of all ranks.
    """
    ext = ext or extent(df)
    d2 = F.pow(F.col("lon") - ext.mean_lon, 2) + F.pow(F.col("lat") - ext.mean_lat, 2)
    # the mean squared distance to the mean is the sum of both variances, which the extent has
    sd = math.sqrt((ext.var_lon or 0.0) + (ext.var_lat or 0.0))
    median = quantiles(df, F.sqrt(d2), [0.5], error)[0]
    if sd == 0 and median == 0:
        return 0.0
    return 0.9 * min(sd, median / 0.6745 if median > 0 else sd) * ext.n ** (-1 / 6)


def temporal_bandwidth(df: DataFrame, t: Column, error: float | None = None) -> float:
    """0.9 * min(sigma, IQR / 1.34) * n^(-1/5); with ``error`` the quartiles may be off by that share of all ranks."""
    row = df.agg(F.stddev_pop(t).alias("sd"), F.count(t).alias("n")).first()
    q1, q3 = quantiles(df, t, [0.25, 0.75], error)
    sd, iqr = row["sd"] or 0.0, q3 - q1
    if sd == 0 and iqr == 0:
        return 0.0
    return 0.9 * min(sd, iqr / 1.34 if iqr > 0 else sd) * row["n"] ** (-1 / 5)


@dataclass(frozen=True)
class Grid:
    x_min: float
    y_min: float
    cell_x: float
    cell_y: float
    n_cols: int
    n_rows: int

    def center_x(self, col: Column) -> Column:
        return (col + 0.5) * self.cell_x + self.x_min

    def center_y(self, row: Column) -> Column:
        return (row + 0.5) * self.cell_y + self.y_min

    def col_of(self, x: Column) -> Column:
        i = ((x - self.x_min) / self.cell_x).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.n_cols - 1), i))

    def row_of(self, y: Column) -> Column:
        i = ((y - self.y_min) / self.cell_y).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.n_rows - 1), i))

    def ring(self, col: Column, row: Column) -> Column:
        return cell_ring(col * self.cell_x + self.x_min, row * self.cell_y + self.y_min,
                         F.lit(self.cell_x), F.lit(self.cell_y))

    @property
    def height_m(self) -> float:
        return height_scale_value(0.0, (self.n_cols - 1) * self.cell_x, 0.0, (self.n_rows - 1) * self.cell_y, 1e-15)

    @property
    def side_deg(self) -> float:
        return max((self.n_cols - 1) * self.cell_x, (self.n_rows - 1) * self.cell_y, 1e-15)


def grid_spec(ext: Extent, pad: float, cell_m: float | None = None, cell_deg: float | None = None,
              cap: int | None = None) -> Grid:
    """Cells square on the ground over the padded extent. A cell that was asked for is kept, unless a cap is
    asked for too; the automatic cell is a fiftieth of the shorter side, wider where that makes too many."""
    pad = pad if pad > 0 else 1e-9
    x_min, y_min = ext.min_lon - pad, ext.min_lat - pad
    dx, dy = ext.max_lon + pad - x_min, ext.max_lat + pad - y_min
    wanted = cell_m / GRID_M_PER_DEG if cell_m and cell_m > 0 else cell_deg if cell_deg and cell_deg > 0 else None
    cell = wanted or min(dx, dy) / 50.0
    cell = cell if cell > 0 else 1.0
    cos = max(math.cos(math.radians((y_min + (ext.max_lat + pad)) / 2)), 0.01)
    cell_x, cell_y = cell / cos, cell
    cols, rows = math.ceil(dx / cell_x), math.ceil(dy / cell_y)
    limit = cap or (None if wanted else AUTO_CELLS)
    if limit and cols * rows > limit:
        scale = math.sqrt(limit / (cols * rows))
        cols, rows = max(1, int(cols * scale)), max(1, int(rows * scale))
        cell_x, cell_y = dx / cols, dy / rows
    return Grid(x_min, y_min, cell_x, cell_y, cols, rows)


def auto_cell_size_m(df: DataFrame) -> float:
    """Side in metres of the cell an automatic grid would use."""
    ext = extent(df)
    return grid_spec(ext, spatial_bandwidth(df, ext)).cell_y * GRID_M_PER_DEG


@dataclass(frozen=True)
class Slices:
    """Slice edges in seconds from the run's reference instant."""

    edges: list[float]
    warnings: list[str] = field(default_factory=list)
    step: float | None = None  # of evenly spaced edges, each at the first one plus its number of steps

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def centers(self) -> list[float]:
        return [(a + b) / 2 for a, b in zip(self.edges, self.edges[1:])]

    def index(self, t: Column) -> Column:
        """Right-open bins, the last one closed: by arithmetic on even edges, else a balanced comparison tree."""
        if self.step:
            def edge(i: Column) -> Column:
                return i * F.lit(self.step) + F.lit(self.edges[0])

            guess = F.floor((t - self.edges[0]) / self.step)
            exact = F.when(t < edge(guess), guess - 1).when(t >= edge(guess + 1), guess + 1).otherwise(guess)
            return F.greatest(F.lit(0), F.least(F.lit(self.n - 1), exact)).cast("int")

        def pick(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(t < F.lit(self.edges[mid + 1]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

        return pick(0, self.n - 1)

    def height(self, t: Column, total: float) -> Column:
        """Every slice is one slab of equal height; linear inside a slice."""
        i = self.index(t)
        if self.step:
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - (i * F.lit(self.step) + F.lit(self.edges[0]))) / self.step))
            return (i + share) * (total / self.n)
        lo = F.element_at(F.array(*[F.lit(e) for e in self.edges[:-1]]), i + 1)
        hi = F.element_at(F.array(*[F.lit(e) for e in self.edges[1:]]), i + 1)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - lo) / (hi - lo)))
        return (i + share) * (total / self.n)


def time_slices(df: DataFrame, t: Column, method: str, n: int, duration_s: float | None = None,
                anchor_s: float | None = None, span: tuple[float, float] | None = None, max_slices: int | None = None) -> Slices:
    """Slice edges by ``equal_interval``, ``equal_count`` or ``fixed_duration``; ``max_slices`` widens the last kind."""
    if span is None:
        row = df.agg(F.min(t), F.max(t)).first()
        span = float(row[0]), float(row[1])
    lo, hi = span
    n = max(int(n), 1)
    if hi <= lo:
        return Slices([lo, lo + 1.0])
    if method == "equal_count":
        raw = sorted(set(exact_quantiles(df, t, [i / n for i in range(n + 1)])))
        if len(raw) < 2:
            return Slices([lo, hi])
        notes = []
        if len(raw) < n + 1:
            notes.append(f"equal count gave {len(raw) - 1} slices instead of {n}: many points share a time")
        return Slices([lo, *raw[1:-1], hi], notes)
    if method == "fixed_duration":
        if not duration_s or duration_s <= 0:
            raise ValueError("slice duration must be greater than 0 for fixed_duration")
        origin = lo if anchor_s is None else anchor_s
        start = origin + math.floor((lo - origin) / duration_s) * duration_s
        steps, notes = max(1, math.ceil((hi - start) / duration_s)), []
        if max_slices and steps > max_slices:
            wide = (hi - start) / max_slices
            notes.append(f"{steps} slices of {duration_s / 3600:g}h; widened to {wide / 3600:.2f}h")
            steps, duration_s = max_slices, wide
        return Slices([start + duration_s * i for i in range(steps + 1)], notes, duration_s)
    step = (hi - lo) / n
    return Slices([lo + step * i for i in range(n)] + [hi], [], step)
