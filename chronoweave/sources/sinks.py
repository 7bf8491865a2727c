"""Writers and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.time import iso


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, times become ISO text."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return df.withColumns(out) if out else df


def _position(p: Column, z: bool) -> Column:
    return F.array(p["x"], p["y"], p["z"]) if z else F.array(p["x"], p["y"])


def geometry_json(df: DataFrame) -> Column:
    """GeoJSON geometry from whichever geometry columns the table has: ``ring``, ``coords`` or ``lon, lat``."""
    cols = df.columns
    if "ring" in cols:
        z = "z" in df.schema["ring"].dataType.elementType.names
        ring = F.transform("ring", lambda p: _position(p, z))
        closed = F.concat(ring, F.slice(ring, F.lit(1), F.lit(1)))
        return F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    if "coords" in cols:
        z = "z" in df.schema["coords"].dataType.elementType.names
        return F.struct(F.lit("LineString").alias("type"), F.transform("coords", lambda p: _position(p, z)).alias("coordinates"))
    height = next((c for c in ("height_m", "alt", "z") if c in cols), None)
    at = [F.col("lon"), F.col("lat"), *([F.coalesce(F.col(height).cast("double"), F.lit(0.0))] if height else [])]
    return F.struct(F.lit("Point").alias("type"), F.array(*at).alias("coordinates"))


def to_features(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, as text."""
    safe = json_safe(df)
    props = [c for c in df.columns if c not in ("ring", "coords", "lon", "lat")]
    body = F.struct(F.lit("Feature").alias("type"), geometry_json(safe).alias("geometry"), F.struct(*props).alias("properties"))
    return safe.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Newline-delimited features, written by all tasks in parallel."""
    to_features(df).write.mode(mode).text(path)


# Internal names that carry meaning, and their plain names.
ANALYSIS_NAMES = {
    "_timestamp": "timestamp_ms", "_user_id": "user_id", "_confidence": "confidence_level", "_original_index": "source_row_index",
    "_sequence": "sequence", "_elapsed_ms": "elapsed_ms", "_slice": "slice_index", "_segment": "segment_index",
    "_stay_id": "stay_id", "_stay_label": "stay_label", "_stay_duration": "stay_duration_sec", "_stay_point_count": "stay_point_count",
    "_ppa_total_area_m2": "ppa_area_m2", "_ppa_total_area_km2": "ppa_area_km2", "_speed_kmh": "speed_kmh", "_time_span_min": "time_span_min",
    "_distance_m": "anchor_distance_m", "_feasible_segments": "feasible_segments", "_infeasible_segments": "infeasible_segments",
}
# Drawing-only fields and duplicate names.
DRAWING = ("z", "z_axis", "side_length", "color_rgba", "fwd_norm", "bwd_norm", "height_m", "time_progress")
ALIASES = ("dwell_sec_min", "dwell_sec_mid", "dwell_sec_max")
GEOMETRY = ("ring", "coords", "parts", "start", "end")


def to_analysis_table(df: DataFrame, label: str | None = None, dataset_type: str | None = None, tool: str | None = None) -> DataFrame:
    """Flat attributes for a GIS: meaningful names, 2-D geometry, no drawing helpers, no nested values."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    out: list[Column] = []
    names = set(df.columns)
    for f in df.schema.fields:
        if f.name in GEOMETRY:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out.append(F.transform(f.name, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias(f.name))
            continue
        plain = ANALYSIS_NAMES.get(f.name)
        if isinstance(f.dataType, nested) or f.name in DRAWING or f.name in ALIASES or (f.name.startswith("_") and not plain):
            continue
        if plain and plain in names:
            continue
        out.append(F.col(f.name).alias(plain or f.name))
    stamp = next((c for c in ("_timestamp", "timestamp_ms") if c in names), None)
    if stamp:
        out.append(iso(F.col(stamp)).alias("time_iso"))
    for key, value in (("dataset_label", label), ("dataset_type", dataset_type), ("tool", tool)):
        if value is not None:
            out.append(F.lit(value).alias(key))
    return df.select(*out)


def write_points_csv(df: DataFrame, path: str, mode: str = "errorifexists", keys: list[str] | None = None) -> None:
    """Points with every scalar attribute. Open properties become one JSON text column, or a column for each of ``keys``."""
    rows = df.filter(F.col("geom_type") == "Point") if "geom_type" in df.columns else df
    alt = next((c for c in ("alt", "height_m", "z") if c in df.columns), None)
    extra: list[Column] = []
    if "props" in df.columns:
        extra = [F.to_json("props").alias("props")] if keys is None else [F.col("props")[k].alias(k) for k in keys]
    nested = (T.ArrayType, T.MapType, T.StructType)
    plain = [f.name for f in df.schema.fields if f.name not in ("lon", "lat", alt, "geom_type") and not isinstance(f.dataType, nested)]
    out = rows.select(F.col("lon").alias("longitude"), F.col("lat").alias("latitude"),
                      (F.col(alt) if alt else F.lit(None).cast("double")).alias("altitude"), *plain, *extra)
    out.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def run_summary(inputs: dict[str, DataFrame], outputs: dict[str, DataFrame]) -> DataFrame:
    """One row: rows in, rows out, and the box around every output."""
    counts = [df.select(F.lit(1).alias("i"), F.lit(0).alias("o"), *[F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
              for df in inputs.values()]
    for df in outputs.values():
        if "ring" in df.columns or "coords" in df.columns:
            g = F.col("ring" if "ring" in df.columns else "coords")
            xs, ys = F.transform(g, lambda p: p["x"]), F.transform(g, lambda p: p["y"])
            box = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]
        elif "lon" in df.columns:
            box = [F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat")]
        else:
            box = [F.lit(None).cast("double")] * 4
        counts.append(df.select(F.lit(0).alias("i"), F.lit(1).alias("o"), *[b.alias(c) for b, c in zip(box, ("x0", "y0", "x1", "y1"))]))
    return reduce(DataFrame.unionAll, counts).agg(
        F.sum("i").alias("input_count"), F.sum("o").alias("output_count"), F.min("x0").alias("min_x"), F.min("y0").alias("min_y"),
        F.max("x1").alias("max_x"), F.max("y1").alias("max_y"))
