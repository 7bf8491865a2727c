"""Tables of places laid out so that a box reads little: rows near each other stand together, and say how far they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.geo import box_meets

BOX = ("west", "south", "east", "north")
#: Bits of each coordinate in the order of rows.
BITS = 24


def with_bounds(df: DataFrame, coords: str | None = None) -> DataFrame:
    """Adds ``west, south, east, north``: of the line ``coords`` (``x, y``), else of the point ``lon, lat``."""
    if coords is None:
        return df.withColumns({"west": F.col("lon"), "south": F.col("lat"), "east": F.col("lon"), "north": F.col("lat")})
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return df.withColumns({"west": F.array_min(xs), "south": F.array_min(ys), "east": F.array_max(xs), "north": F.array_max(ys)})


def _spread(c: Column) -> Column:
    """A zero bit between every two bits of a number of up to ``BITS`` bits."""
    out = c
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << k for k in range(0, 64, 2 * shift)) & ((1 << 63) - 1)
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def curve_place(lon: Column, lat: Column) -> Column:
    """Place on a curve that goes through the world quarter by quarter, at every scale."""
    def level(v: Column, low: float, size: float) -> Column:
        top = (1 << BITS) - 1
        return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - low) / size * (1 << BITS)))).cast("long")

    return _spread(level(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(level(lat, -90.0, 180.0)), 1))


def write_places(df: DataFrame, path: str, coords: str | None = None, files: int | None = None, group_bytes: int = 4 << 20, mode: str = "error") -> None:
    """Write a table in the order of the curve, with its bounds; each group of rows then covers a small box, which Parquet keeps the limits of.

    ``files``: number of files, else what Spark's partitions come to.
    """
    bounded = with_bounds(df, coords)
    place = curve_place((F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2)
    keyed = bounded.withColumn("_place", place)
    ranged = keyed.repartitionByRange(files, "_place") if files else keyed.repartitionByRange("_place")
    ranged.sortWithinPartitions("_place").drop("_place").write.mode(mode).option("parquet.block.size", group_bytes).parquet(path)


def read_places(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The table, or the rows whose bounds meet ``box`` (west, south, east, north); groups of rows outside it are not read."""
    df = spark.read.parquet(path)
    return df if box is None else df.filter(box_meets(BOX, box))
