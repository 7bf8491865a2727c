"""Environmental exposure: the nearest environment reading of the same clock hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.time import clock_hour, hour_of_ms
from chronoweave.operators.nearest import nearest


def with_hour(df: DataFrame, time_text: str | None = None) -> DataFrame:
    """Add ``hour`` from the written time, else from ``t_ms``."""
    return df.withColumn("hour", clock_hour(F.col(time_text)) if time_text else hour_of_ms(F.col("t_ms")))


def join_exposure(traj: DataFrame, env: DataFrame, value: str = "value", time_text: str | None = None,
                  hot_rows: int | None = None) -> DataFrame:
    """Add ``env_exposure``: nearest in degrees within the hour, null when the hour has no readings."""
    v = F.col(value).cast("double")
    readings = env.filter(v.isNotNull() & ~F.isnan(v)).select(
        F.col("hour").cast("int").alias("hour"), F.col("lon").alias("_elon"), F.col("lat").alias("_elat"),
        F.col("env_id").alias("_eid"), v.alias("_evalue"))
    fixes = with_hour(traj, time_text)
    hit = nearest(fixes, readings, ["hour"], "point_id", "_eid", ("lon", "lat"), ("_elon", "_elat"), hot_rows)
    return hit.withColumn("env_exposure", F.col("hit")["item"]["_evalue"]).drop("hit")
