"""Open-data GeoJSON to station, line-part and district tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch import schemas
from axlewatch.functions import exprs as X
from axlewatch.operators import network as N

_D = T.DoubleType()
_POINTS = T.ArrayType(T.ArrayType(_D))


# A feature that states its type first begins behind this text, so a file can be cut there and read by many tasks.
SEPARATOR = '"Feature"'
_NEXT = r'[,\s]*\{\s*"type"\s*:\s*$'


def _features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The features `f` of collections or newline-delimited files, and `ord`, their order in the files.

    Files are cut at features. Where one does not state its type first, files are parsed whole, one task each.
    A member `{"type": "Feature"` inside a feature's properties is not expected.
    """
    kind = schema["features"].dataType.elementType
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.ltrim(F.regexp_replace("value", "\ufeff", "")).alias("text"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("place")).alias("ord"))
    head = F.col("text").startswith("{")
    cut = F.col("text").rlike(_NEXT) | (~head & F.rtrim("text").rlike(r"[}\],]\s*$"))
    if raw.where((F.col("text") != "") & ~cut).isEmpty():
        body = F.concat(F.lit('{"type":"Feature"'), F.regexp_replace("text", _NEXT, ""))
        return raw.where((F.col("text") != "") & ~head).select("ord", F.from_json(body, kind).alias("f"))
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("place", "f")).select(
        F.struct("file", F.lit(0).cast("long").alias("block"), F.col("place").cast("long").alias("place")).alias("ord"), "f")


def _rounded(points: Column, digits: int) -> Column:
    return F.transform(F.filter(points, lambda p: F.size(p) >= 2), lambda p: F.array(
        X.round_even(p[0], digits), X.round_even(p[1], digits)))


def _nested(single: str, multi: str, shape: T.DataType) -> Column:
    """Coordinates of a single or multi geometry, always as the multi one."""
    text, kind = F.col("f.geometry.coordinates"), F.col("f.geometry.type")
    return F.when(kind == multi, F.from_json(text, T.ArrayType(shape))).when(
        kind == single, F.array(F.from_json(text, shape)))


def scan_stations(spark: SparkSession, path: str) -> DataFrame:
    """One row per point: line code, name, coordinates, project, kind, stage, directorate."""
    p, xy = "f.properties", F.col("f.geometry.coordinates")
    return _features(spark, path, schemas.STATIONS_GEOJSON).select(
        "ord", X.line_code(F.col(f"{p}.PROJE_ADI")).alias("line_id"),
        X.strip(F.coalesce(f"{p}.ISTASYON", F.lit(""))).alias("name"),
        X.round_even(F.get(xy, F.lit(0)), 6).alias("lon"), X.round_even(F.get(xy, F.lit(1)), 6).alias("lat"),
        F.col(f"{p}.PROJE_ADI").alias("project"), F.col(f"{p}.HAT_TURU").alias("kind"),
        F.col(f"{p}.PROJE_ASAMA").alias("stage"), F.col(f"{p}.MUDURLUK").alias("directorate"))


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line part of at least two points, of the drawn stages only."""
    p = "f.properties"
    rows = _features(spark, path, schemas.LINES_GEOJSON).where(
        F.col(f"{p}.PROJE_ASAMA").isin(N.DRAWN_STAGES))
    parts = rows.select(
        "ord", X.line_code(F.coalesce(f"{p}.PROJE_AD_KISA", f"{p}.PROJE_ADI")).alias("line_id"),
        F.col(f"{p}.UZUNLUK").alias("official_km"),
        F.posexplode(_nested("LineString", "MultiLineString", _POINTS)).alias("part", "raw"))
    points = parts.withColumn("points", _rounded(F.col("raw"), 5))
    return points.where(F.col("line_id").isNotNull() & (F.size("points") >= 2)).select(
        "line_id", F.struct("ord", "part").alias("part_no"), "points", "official_km")


def _polygons(part: Column) -> Column:
    """Polygons of one geometry, always as those of a multi-polygon; none for points and lines."""
    text, rings = part["coordinates"], T.ArrayType(_POINTS)
    return F.when(part["type"] == "MultiPolygon", F.from_json(text, T.ArrayType(rings))).when(
        part["type"] == "Polygon", F.array(F.from_json(text, rings))).otherwise(F.array().cast(T.ArrayType(rings)))


def scan_shapes(spark: SparkSession, path: str) -> DataFrame:
    """One row per district: its box over all points of its geometry, and its polygons.

    The geometry may be a collection. Rings of fewer than four points and polygons without rings drop out; the box
    is that of the whole geometry. A feature without any point has no box.
    """
    rows = _features(spark, path, schemas.DISTRICTS_GEOJSON).select(
        "ord", N.display_name(F.col("f.properties.shapeName")).alias("name"), F.col("f.geometry").alias("geometry"))
    parts = X.once(F.from_json("geometry", schemas.GEOMETRY), lambda one: F.coalesce(one["geometries"], F.array(F.struct(
        one["type"].alias("type"), one["coordinates"].alias("coordinates")))))
    outlines = F.transform(F.flatten(F.transform(parts, _polygons)), lambda polygon: F.filter(
        F.transform(polygon, lambda ring: _rounded(ring, 5)), lambda ring: F.size(ring) >= 4))
    # generated columns are computed once, whatever filters and projections follow; a filter on the box comes before the polygons
    boxed = rows.select("ord", "name", "geometry", F.inline(F.array(F.struct(
        X.shape_bbox(F.try_parse_json("geometry")).alias("box")))))
    return boxed.select("ord", "name", "box", F.inline(F.array(F.struct(
        F.filter(outlines, lambda polygon: F.size(polygon) > 0).alias("polygons")))))


def scan_districts(spark: SparkSession, path: str) -> DataFrame:
    """One row per ring (the first ring of a polygon is its outline), with the box of its whole district."""
    rows = scan_shapes(spark, path).select("ord", "name", "box", F.posexplode("polygons").alias("polygon", "rings"))
    return rows.select("ord", "name", "box", "polygon", F.posexplode("rings").alias("ring_no", "ring"))


def build_stations(points: DataFrame) -> DataFrame:
    """Stations of the network: in service, of the right operator and kind, first of each name.

    Their order along the line is the order in which the file lists them.
    """
    kept = N.exclude_type(
        N.exclude_operator(N.in_service(points.where("line_id is not null"))), order="ord")
    named = N.first_per_name(kept.withColumnRenamed("ord", "seq"))
    # a line's stations number a few dozen; their positions restart at 0 for the km of the line
    per_line = named.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "name", "lon", "lat", "project", "kind"))).alias("s"))
    dense = per_line.where(F.size("s") >= 2).select("line_id", F.posexplode("s").alias("seq", "p"))
    return N.cumulative_km(dense.select(
        "line_id", F.col("seq").cast("long").alias("seq"), "p.name", "p.lon", "p.lat", "p.project", "p.kind"))
