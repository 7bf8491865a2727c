"""Canonical table layouts and option records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.time import TIME_FIELDS, with_epoch_ms
from chronoweave.report import Report

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
POINT_Z = T.StructType(POINT.fields + [T.StructField("z", T.DoubleType())])
LINE = T.ArrayType(POINT)

TRAJECTORY = T.StructType([
    T.StructField("point_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("t_ms", T.LongType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
ENVIRONMENT = T.StructType([
    T.StructField("env_id", T.LongType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("hour", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
ROADS = T.StructType([
    T.StructField("source_id", T.LongType()),
    T.StructField("highway", T.StringType()),
    T.StructField("maxspeed", T.StringType()),
    T.StructField("coords", LINE),
])
ANCHOR_PAIRS = T.StructType([
    T.StructField("pair_id", T.LongType()),
    T.StructField("a_lon", T.DoubleType()),
    T.StructField("a_lat", T.DoubleType()),
    T.StructField("a_ms", T.LongType()),
    T.StructField("b_lon", T.DoubleType()),
    T.StructField("b_lat", T.DoubleType()),
    T.StructField("b_ms", T.LongType()),
])
EPISODES = T.StructType([
    T.StructField("person_id", T.StringType()),
    T.StructField("episode_id", T.LongType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("activity_type", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("weight", T.DoubleType()),
])


@dataclass(frozen=True)
class TrajectorySchema:
    """Caller's column names for the canonical trajectory columns; of several time columns the first that a row can be read from counts."""

    time: str | tuple[str, ...] = TIME_FIELDS
    lon: str = "lon"
    lat: str = "lat"
    user: str | None = None
    point_id: str | None = None

    def apply(self, df: DataFrame, on_bad: str = "drop", report: Report | None = None) -> DataFrame:
        """Rename to the canonical columns; a missing user becomes ``unknown``."""
        for name in filter(None, (self.lon, self.lat, self.point_id)):
            if name not in df.columns:
                raise ValueError(f"column '{name}' not found in data")
        user: Column = F.lit("unknown")
        if self.user and self.user in df.columns:
            user = F.coalesce(F.col(self.user).cast("string"), F.lit("unknown"))
        pid = F.col(self.point_id) if self.point_id else F.xxhash64(*[F.col(c) for c in df.columns])
        timed = with_epoch_ms(df, self.time, on_bad, report)
        return timed.select(
            pid.alias("point_id"), user.alias("user_id"), "t_ms",
            F.col(self.lon).cast("double").alias("lon"),
            F.col(self.lat).cast("double").alias("lat"),
            *[c for c in df.columns
              if c not in {self.lon, self.lat, self.user, self.point_id, "point_id", "user_id", "t_ms", "lon", "lat"}],
        )
