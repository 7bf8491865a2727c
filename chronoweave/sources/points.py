"""Point, road and area input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions.bind import bind
from chronoweave.functions.coords import coordinate_error, parse_coordinate
from chronoweave.functions.roads import LANDED_CLASSES
from chronoweave.functions.time import readable

READABLE = "_readable"
# Plausible epoch seconds and milliseconds (years 2000 to 2100).
EPOCH_S = (9.46e8, 4.1e9)
EPOCH_MS = (9.46e11, 4.1e12)


def read_points_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header. Pass a schema on large inputs: inference reads the data twice."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.dropna("all")


def csv_to_points(df: DataFrame, lon: str, lat: str, alt: str | None = None, skip_invalid: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(good, rejected, stats)``: rows that can be placed, rows that cannot with the reason, and totals."""
    if not lon or not lat:
        raise ValueError("longitude and latitude columns must be named")
    others = [c for c in df.columns if c not in {lon, lat, alt}]
    raw = df.select(F.col(lon).cast("string").alias("_raw_lon"), F.col(lat).cast("string").alias("_raw_lat"),
                    (F.col(alt).cast("string") if alt else F.lit(None).cast("string")).alias("_raw_alt"), *others)
    placed = bind(raw, {c: parse_coordinate(F.col(f"_raw_{c}")) for c in ("lon", "lat", "alt")})
    checked = placed.withColumn("error", coordinate_error(F.col("lon"), F.col("lat")))
    fine = F.col("error").isNull()
    if not skip_invalid:
        fine = F.when(fine, F.lit(True)).otherwise(F.raise_error(F.col("error")).cast("boolean"))
    good = checked.filter(fine).select("lon", "lat", "alt", *others)
    rejected = checked.filter("error is not null").select(F.col("_raw_lon").alias("lon"), F.col("_raw_lat").alias("lat"), *others, "error")
    stats = checked.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("error").isNull()).alias("valid_rows"),
                        F.count_if(F.col("error").isNotNull()).alias("invalid_rows"))
    return good, rejected, stats


def first_errors(rejected: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rejected rows by a column that tells their place in the input: ``order, lon, lat, error``."""
    return rejected.select(order, "lon", "lat", "error").orderBy(order).limit(n)


def _is_epoch(c: Column) -> Column:
    return c.between(*EPOCH_S) | c.between(*EPOCH_MS)


def epoch_columns(df: DataFrame, exclude: tuple = ()) -> list[str]:
    """Numeric columns that hold values which all look like epoch times: one pass over the whole table."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude
               and not f.name.endswith(READABLE) and f.name + READABLE not in df.columns]
    if not numeric:
        return []
    row = df.agg(*[x for i, c in enumerate(numeric) for x in (
        F.count(F.col(c)).alias(f"n{i}"), F.count_if(_is_epoch(F.col(c).cast("double"))).alias(f"k{i}"))]).first()
    return [c for i, c in enumerate(numeric) if row[f"n{i}"] and row[f"n{i}"] == row[f"k{i}"]]


def epoch_to_readable(c: Column) -> Column:
    v = c.cast("double")
    return F.when(_is_epoch(v), readable(F.when(v <= EPOCH_S[1], v * 1000).otherwise(v)))


def add_readable_epochs(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    return df.withColumns({c + READABLE: epoch_to_readable(F.col(c)) for c in epoch_columns(df, exclude)})


# ---------------------------------------------------------------- GeoJSON

_FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features as ``geom_type, lon, lat, alt, parts, props``.

    A FeatureCollection is one JSON document and therefore one task per file; ``lines`` reads the
    splittable form with one feature per line.
    """
    if lines:
        rows = spark.read.schema(_FEATURE).json(path)
    else:
        whole = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])
        rows = spark.read.schema(whole).option("multiLine", True).json(path).select(F.inline("features"))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")

    def as_line(c: Column) -> Column:
        return F.transform(c, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    point = F.from_json(text, "array<double>")
    line = F.from_json(text, "array<array<double>>")
    nested = F.from_json(text, "array<array<array<double>>>")
    deep = F.from_json(text, "array<array<array<array<double>>>>")
    parts = (F.when(kind == "LineString", F.array(as_line(line)))
             .when(kind.isin("MultiLineString", "Polygon"), F.transform(nested, as_line))
             .when(kind == "MultiPolygon", F.flatten(F.transform(deep, lambda poly: F.transform(poly, as_line)))))
    is_point = kind == "Point"
    return rows.select(kind.alias("geom_type"), F.when(is_point, F.get(point, F.lit(0))).alias("lon"),
                       F.when(is_point, F.get(point, F.lit(1))).alias("lat"), F.when(is_point, F.get(point, F.lit(2))).alias("alt"),
                       parts.alias("parts"), F.col("properties").alias("props"))


def only_points(df: DataFrame) -> DataFrame:
    """Point features; none at all is an error."""
    pts = df.filter(F.col("geom_type") == "Point")
    if pts.isEmpty():
        raise ValueError("point geometries are required")
    return pts


def load_roads(features: DataFrame) -> DataFrame:
    """Line features -> ``source_id, highway, maxspeed, name, coords``; one row per line part."""
    lines = features.filter(F.col("geom_type").isin("LineString", "MultiLineString"))
    base = F.col("source_id") if "source_id" in features.columns else F.pmod(F.xxhash64("parts"), F.lit((1 << 43) - 1))
    part = lines.select(base.cast("long").alias("_id"), F.col("props")["highway"].alias("highway"),
                        F.col("props")["maxspeed"].alias("maxspeed"), F.col("props")["name"].alias("name"),
                        F.posexplode("parts").alias("_p", "coords"))
    multi = F.when(F.col("_p") == 0, F.col("_id")).otherwise(F.pmod(F.xxhash64("_id", "_p"), F.lit((1 << 43) - 1)))
    return part.filter(F.size("coords") >= 2).select(multi.alias("source_id"), "highway", "maxspeed", "name", "coords")


def load_area_features(*features: DataFrame) -> DataFrame:
    """Polygon features of several files as ``area_id, rings``, closing vertices dropped."""
    merged = reduce(lambda a, b: a.unionByName(b), features)
    polys = merged.filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))

    def open_ring(r: Column) -> Column:
        closed = F.element_at(r, 1) == F.element_at(r, -1)
        return F.when(closed, F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)

    return polys.select(F.xxhash64("parts").alias("area_id"), F.transform("parts", open_ring).alias("rings"))


def osm_to_roads(elements: DataFrame, mode: str | None = None) -> DataFrame:
    """OSM nodes and ways -> road lines.

    ``elements``: ``type, id, lon, lat, nodes array<bigint>, tags map<string,string>``. Vertices follow
    the way's order, references without a node are skipped, ways with fewer than two vertices
    dropped. A way has at most 2 000 nodes, so its vertex list is bounded.
    """
    nodes = elements.filter("type = 'node'").select(F.col("id").alias("node_id"), "lon", "lat")
    ways = elements.filter("type = 'way'")
    if mode in LANDED_CLASSES:
        ways = ways.filter(F.col("tags")["highway"].isin(*LANDED_CLASSES[mode]))
    refs = ways.select("id", "tags", F.posexplode("nodes").alias("pos", "node_id"))
    placed = refs.join(nodes, "node_id").groupBy("id").agg(
        F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_v"))
    coords = F.transform("_v", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))

    def tag(k: str) -> Column:
        return F.coalesce(F.col("tags")[k], F.lit("")).alias(k)

    return placed.filter(F.size("_v") >= 2).select(F.col("id").alias("source_id"), tag("highway"), tag("maxspeed"), tag("name"), coords.alias("coords"))


# ---------------------------------------------------------------- tables


def merge_sources(sources: dict[str, DataFrame], exclude: tuple = ()) -> DataFrame:
    """One table from several datasets, each row naming its dataset; excluded ones stay out."""
    kept = [df.withColumn("source_dataset", F.lit(name)) for name, df in sources.items() if name not in exclude]
    if not kept:
        raise ValueError("no source datasets left")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def field_summary(df: DataFrame) -> DataFrame:
    """``name, kind`` with kind real, boolean or string; open properties are listed by their keys."""
    def kind(t: T.DataType) -> str:
        return "real" if isinstance(t, T.NumericType) else "boolean" if isinstance(t, T.BooleanType) else "string"

    rows = [(f.name, kind(f.dataType)) for f in df.schema.fields if f.name != "props"]
    fixed = df.sparkSession.createDataFrame(rows, "name string, kind string")
    if "props" not in df.columns:
        return fixed
    keys = df.select(F.explode(F.map_keys("props")).alias("name")).distinct()
    return fixed.unionByName(keys.withColumn("kind", F.lit("string")))
