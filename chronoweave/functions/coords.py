"""Coordinate text: plain decimals, numbers with trailing text, degrees-minutes-seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_DMS = r"^(-?)(\d+(?:\.\d+)?)[°\s]*(?:(\d+(?:\.\d+)?)['′\s]\s*)?(?:(\d+(?:\.\d+)?)[\"″\s]\s*)?([NSEWnsew]?)$"


def dms_to_degrees(c: Column) -> Column:
    s = F.trim(c)

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(s, _DMS, i), F.lit("")).try_cast("double"), F.lit(0.0))

    size = part(2) + part(3) / 60 + part(4) / 3600
    negative = (F.regexp_extract(s, _DMS, 1) == "-") | F.upper(F.regexp_extract(s, _DMS, 5)).isin("S", "W")
    return F.when(s.rlike(_DMS), F.when(negative, -size).otherwise(size))


def parse_coordinate(c: Column) -> Column:
    """Degrees, or null. Text with a degree sign or a compass letter is read as DMS."""
    s = F.trim(c.cast("string"))
    number = F.nullif(F.regexp_extract(s, _NUMBER, 1), F.lit("")).try_cast("double")
    value = F.when(s.rlike(r"[°NSEWnsew]") & s.rlike(_DMS), dms_to_degrees(s)).otherwise(number)
    return F.when(~F.isnan(value), value)


def coordinate_error(lon: Column, lat: Column) -> Column:
    """Reason a row cannot be placed on the map; null for a good row."""
    return (
        F.when(lon.isNull() | lat.isNull(), F.lit("Invalid coordinates"))
        .when((lon < -180) | (lon > 180), F.concat(F.lit("Longitude out of range: "), lon.cast("string")))
        .when((lat < -90) | (lat > 90), F.concat(F.lit("Latitude out of range: "), lat.cast("string")))
    )
