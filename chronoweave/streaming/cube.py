"""Space-time cube of a stream of fixes on a fixed grid.

A grid that follows from the data needs all of it; with a grid and slices that are given, cells can be counted as files arrive.
Spark keeps the cells of slices that the watermark has not passed as state. Each micro-batch writes the cells it changed to a
folder of its own number, so a batch that is repeated after a failure replaces its own rows and nothing else; the cube is the last row
of each cell. Fixes older than the watermark reach no cell. A second query counts what was read by slice, and the late ones are the
difference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.cube import count_cells
from chronoweave.operators.grid import Grid

KEYS = ["t_idx", "row", "col"]


@dataclass(frozen=True)
class Layout:
    """Cells and slices that are known beforehand; slices are as long as each other and one starts at ``origin_ms``."""

    grid: Grid
    slice_ms: int
    origin_ms: int = 0

    def slice_of(self, t_ms: Column) -> Column:
        return F.floor((t_ms - self.origin_ms) / self.slice_ms)

    def bin(self, points: DataFrame) -> DataFrame:
        """Adds ``row, col``; fixes outside the grid and without a time or position are left out."""
        g = self.grid
        x, y = F.floor((F.col("lon") - g.x_min) / g.cell_x), F.floor((F.col("lat") - g.y_min) / g.cell_y)
        return points.withColumns({"row": y.cast("int"), "col": x.cast("int")}).filter(
            F.col("t_ms").isNotNull() & F.col("row").between(0, g.n_rows - 1) & F.col("col").between(0, g.n_cols - 1))


def batch_cube(points: DataFrame, layout: Layout, env: str | None = None) -> DataFrame:
    """``t_idx, row, col, count, env_sum, env_count`` of a table that is complete."""
    return count_cells(layout.bin(points).withColumn("t_idx", layout.slice_of(F.col("t_ms"))), env)


def stream_cells(points: DataFrame, layout: Layout, delay: str, env: str | None = None) -> DataFrame:
    """The same cells of a stream, as far as its watermark (the latest fix of earlier batches, less ``delay``) lets them change."""
    slices = F.window("_at", f"{layout.slice_ms} milliseconds", startTime=f"{layout.origin_ms % layout.slice_ms} milliseconds")
    value = F.col(env).cast("double") if env else F.lit(None).cast("double")
    value = F.when(~F.isnan(value), value)
    own = layout.bin(points).withColumn("_at", F.timestamp_millis("t_ms")).withWatermark("_at", delay)
    cells = own.groupBy(slices.alias("_w"), "row", "col").agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("env_sum"), F.count(value).alias("env_count"))
    return cells.withColumn("t_idx", layout.slice_of(F.unix_millis("_w.start"))).drop("_w").select(*KEYS, "count", "env_sum", "env_count")


def _drain(rows: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    query = (rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def update_cube(points: DataFrame, layout: Layout, folder: str, delay: str = "0 seconds", env: str | None = None) -> None:
    """Take in what has arrived since the last call and stop; ``folder``, in shared storage, holds results and checkpoints.

    ``points`` is a stream of fixes (``t_ms, lon, lat``). A call after a failure goes on where the checkpoint stands, and a
    call without new files changes nothing.
    """
    def cells(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/cells/batch={number}")

    def read(batch: DataFrame, number: int) -> None:
        batch.groupBy("t_idx").agg(F.count(F.lit(1)).alias("read")).write.mode("overwrite").parquet(f"{folder}/read/batch={number}")

    _drain(stream_cells(points, layout, delay, env), "update", f"{folder}/checkpoint-cells", cells)
    _drain(layout.bin(points).select(layout.slice_of(F.col("t_ms")).alias("t_idx")), "append", f"{folder}/checkpoint-read", read)


def read_cube(spark: SparkSession, folder: str) -> DataFrame:
    """The cube so far: of each cell the row of the last batch that changed it."""
    rows = spark.read.option("basePath", f"{folder}/cells").parquet(f"{folder}/cells/batch=*")
    last = F.max_by(F.struct("count", "env_sum", "env_count"), F.col("batch"))
    return rows.groupBy(*KEYS).agg(last.alias("_last")).select(*KEYS, "_last.*")


def late_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """``t_idx, read, counted, late``: fixes of each slice that were read, those in its cells, and those that came after the watermark."""
    read = spark.read.option("basePath", f"{folder}/read").parquet(f"{folder}/read/batch=*").groupBy("t_idx").agg(F.sum("read").alias("read"))
    counted = read_cube(spark, folder).groupBy("t_idx").agg(F.sum("count").alias("counted"))
    both = read.join(counted, "t_idx", "left").fillna(0, ["counted"])
    return both.withColumn("late", F.col("read") - F.col("counted"))
