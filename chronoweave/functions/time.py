"""Timestamps: anything the input holds -> epoch milliseconds, and back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.bind import bind
from chronoweave.report import Report, counted_filter

DAY_MS = 86_400_000

# Text layouts accepted besides ISO.
TEXT_FORMATS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "M/d/yyyy",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d H:mm",
    "yyyy/M/d",
    "yyyy-M-d H:mm:ss",
    "yyyy-M-d H:mm",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy H:mm",
    "d MMM yyyy",
)

_TRAILING_ZONE = r"^(.*\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:[zZ]|UTC|GMT|[+-]\d{2}:?\d{2})$"


def ntz_millis(c: Column) -> Column:
    """Wall-clock milliseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(c.cast("date")).cast("bigint")
    seconds = F.hour(c) * 3600 + F.minute(c) * 60
    return day * DAY_MS + seconds * 1000 + (F.extract(F.lit("SECOND"), c) * 1000).cast("bigint")


def numeric_epoch_ms(c: Column) -> Column:
    """Seconds below 1e12 in magnitude, milliseconds from there on."""
    v = c.cast("double")
    ms = F.when(F.abs(v) < 1e12, v * 1000).otherwise(v)
    return F.when(v.isNull() | F.isnan(v), None).otherwise(ms.cast("bigint"))


def text_epoch_ms(c: Column) -> Column:
    """Per-row parse of mixed text layouts; the written clock time is kept and the zone dropped."""
    s = F.regexp_replace(F.trim(c), _TRAILING_ZONE, "$1")
    iso = s.try_cast("timestamp_ntz")
    # only slash, single-digit or month-name layouts need the slower pattern parsers
    other = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in TEXT_FORMATS])
    return ntz_millis(F.coalesce(iso, other))


def epoch_ms(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.NumericType):
        return numeric_epoch_ms(c)
    if isinstance(dtype, T.TimestampNTZType):
        return ntz_millis(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("bigint") * DAY_MS
    return text_epoch_ms(c.cast("string"))


#: Columns in which a time is looked for when none is named.
TIME_FIELDS = ("_timestamp", "timestamp", "time")


def with_epoch_ms(df: DataFrame, time_col: str | Sequence[str], on_bad: str = "drop", report: Report | None = None) -> DataFrame:
    """Add ``t_ms``, of the first of several time columns that a row can be read from; names that the table lacks are passed over.

    Unparseable rows are dropped, kept as null (``keep``) or fail the query (``raise``); ``some`` drops them, but fails here
    when not one row has a time. A ``report`` counts them.
    """
    names = [time_col] if isinstance(time_col, str) else list(time_col)
    known = [c for c in names if c in df.columns]
    if not known:
        raise ValueError(f"time attribute {' or '.join(repr(c) for c in names)} not found in data")
    # the parsers of text are long; each is bound once
    parsed = bind(df, {f"_ms{i}": epoch_ms(F.col(c), df.schema[c].dataType) for i, c in enumerate(known)})
    t_ms = F.coalesce(*[F.col(f"_ms{i}") for i in range(len(known))])
    if on_bad == "raise":
        t_ms = F.coalesce(t_ms, F.raise_error(F.concat(F.lit("cannot parse time "), F.coalesce(*[F.col(c).cast("string") for c in known], F.lit("null")))).cast("bigint"))
    out = parsed.withColumn("t_ms", t_ms).drop(*[f"_ms{i}" for i in range(len(known))])
    if on_bad not in ("drop", "some"):
        return out
    if on_bad == "some" and out.filter("t_ms is not null").isEmpty() and not df.isEmpty():
        raise ValueError(f"could not parse any time from {' or '.join(repr(c) for c in known)}")
    return counted_filter(report, "time", out, F.col("t_ms").isNotNull(), "rows have no readable time")


def anchor_millis(spark: SparkSession, anchor: float | str | None) -> int | None:
    """A wall-clock instant given as seconds or milliseconds, or as text; nothing for blank or unreadable text."""
    if anchor is None or isinstance(anchor, str) and not anchor.strip():
        return None
    kind = T.StringType() if isinstance(anchor, str) else T.DoubleType()
    return spark.range(1).select(epoch_ms(F.lit(anchor), kind)).first()[0]


def clock_hour(c: Column) -> Column:
    """Hour of day exactly as written in the text."""
    return F.regexp_extract(c, r"[ T](\d{1,2}):", 1).try_cast("int")


def hour_of_ms(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / 3_600_000).cast("int")


def as_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def readable(ms: Column) -> Column:
    """``2024-01-31 23:05`` in UTC."""
    return F.date_format(as_timestamp(ms), "yyyy-MM-dd HH:mm")


def iso(ms: Column) -> Column:
    return F.date_format(as_timestamp(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
