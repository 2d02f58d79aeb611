"""Lines, stations, linear referencing and geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.joins import IntervalIndex, first_match
from axlewatch.operators.segments import Timeline, running_sums, sized_broadcast, with_neighbours

# Fixed values of the network model.
IN_SERVICE_STAGE = "Mevcut"
DRAWN_STAGES = ["Mevcut", "Marmaray"]
IN_SERVICE_OVERRIDES = ["F4"]
EXCLUDED_DIRECTORATES = ["Ulaştırma Bakanlığı"]
EXCLUDED_TYPES = ["Teleferik"]
NAME_OVERRIDES = {"Prince Islands": "Adalar"}
EXTENT_MARGIN_DEG = 0.09
DEFECT_MIN_KM = 10.0
DEFECT_SHARE = 0.42
DEFECT_WIDTH_KM = 0.12
SEVERE_LINES = ["M4", "M1A"]
DEFAULT_COLOUR = "#8798b3"
LINE_COLOURS = {
    "M1A": "#e30613", "M1B": "#a11f6b", "M2": "#00a55b", "M3": "#00b0e6", "M4": "#e5007d",
    "M5": "#7b3f98", "M6": "#a9915c", "M7": "#e94f8b", "M8": "#00857d", "M9": "#f0b323",
    "M11": "#8c6239", "T1": "#005baa", "T2": "#8b1f2f", "T3": "#5f2d8c", "T4": "#f47b20",
    "T5": "#00693c", "F1": "#7a7a7a", "F2": "#7a7a7a", "F4": "#7a7a7a", "MARMARAY": "#0b6ab0",
}


def literal_map(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


# ---------------------------------------------------------------- selecting stations

def in_service(stations: DataFrame, overrides: list[str] = IN_SERVICE_OVERRIDES) -> DataFrame:
    """Stations in service by their stage, or by the override list of line codes."""
    open_now = F.coalesce(F.col("stage").contains(IN_SERVICE_STAGE), F.lit(False))
    return stations.where(open_now | F.col("line_id").isin(overrides))


def dominant_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the alphabetically first on ties."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("dominant"),
        F.max("n").alias("n"))


def exclude_operator(stations: DataFrame, excluded: list[str] = EXCLUDED_DIRECTORATES) -> DataFrame:
    """Drops lines whose dominant directorate is excluded."""
    dominant = dominant_value(stations, "line_id", "directorate")
    return stations.join(dominant.where(F.col("dominant").isin(excluded)), "line_id", "left_anti")


def exclude_type(stations: DataFrame, excluded: list[str] = EXCLUDED_TYPES, order: str = "seq") -> DataFrame:
    """Drops whole lines of an excluded kind; a line is of the kind of its first station."""
    kinds = stations.groupBy("line_id").agg(F.min_by("kind", order).alias("_kind"))
    return stations.join(kinds.where(F.col("_kind").isin(excluded)), "line_id", "left_anti")


def first_per_name(stations: DataFrame) -> DataFrame:
    """Non-empty station names, the first occurrence per line."""
    others = [c for c in stations.columns if c not in ("line_id", "name", "seq")]
    first = stations.where(F.length("name") > 0).groupBy("line_id", "name").agg(
        F.min(F.struct("seq", *others)).alias("s"))
    return first.select("line_id", "name", "s.*")


# ---------------------------------------------------------------- along a line

def _by_station(stations: DataFrame, block: int) -> Timeline:
    """Timeline over the dense `seq` of each line, cut only when some line exceeds `block`."""
    longest = stations.agg(F.max("seq").alias("seq")).first()["seq"] or 0
    cut = longest >= block
    seg = F.floor(F.col("seq") / block) if cut else F.lit(0)
    rows = stations.withColumn("seg", seg.cast("long")).withColumn("hot", F.lit(cut))
    return Timeline(rows, ("line_id",), ("seq",), segmented=cut)


def segments(stations: DataFrame, block: int = 4096) -> DataFrame:
    """Consecutive station pairs (a, b) of each line."""
    here = stations.withColumn("a", F.struct(*[c for c in stations.columns if c != "line_id"]))
    out = with_neighbours(_by_station(here, block), "a", "seq", "_before", "b").rows
    return out.where(F.col("b").isNotNull()).select("line_id", "seq", "a", "b")


def _leg_km() -> Column:
    return X.haversine_km(*[F.col(c) for c in ("a.lon", "a.lat", "b.lon", "b.lat")])


def neighbour_distances(stations: DataFrame, block: int = 4096) -> DataFrame:
    """Distance of each station to the next one of its line."""
    return segments(stations, block).select(
        "line_id", "seq", F.col("a.name").alias("name"), F.col("b.name").alias("next_name"),
        _leg_km().alias("leg_km"))


def cumulative_km(stations: DataFrame, block: int = 4096) -> DataFrame:
    """Adds km, the running distance along the line (`seq` is dense per line), and km_exact, not rounded."""
    here = stations.withColumn("b", F.struct("lon", "lat"))
    line = _by_station(here, block)
    legs = with_neighbours(line, "b", "seq", "a", "_after")
    legs = legs.rows.withColumn("_leg", F.coalesce(_leg_km(), F.lit(0.0)))
    if line.segmented:
        out = running_sums(legs, ["line_id"], "seq", {"_km": "_leg"}, block)
    else:
        out = legs.withColumn("_km", F.sum("_leg").over(line.upto()))
    return out.select(*stations.columns, F.round("_km", 3).alias("km"), F.col("_km").alias("km_exact"))


def line_totals(stations: DataFrame) -> DataFrame:
    """Per line: stations, length (rounded once, from km_exact where it is given) and its two terminals."""
    last, km = F.col("seq"), "km_exact" if "km_exact" in stations.columns else "km"
    return stations.groupBy("line_id").agg(
        F.count("*").alias("station_count"), F.round(F.max_by(km, last), 2).alias("length_km"),
        X.between_text(F.min_by("name", last), F.max_by("name", last)).alias("short_name"))


def locate_on_line(rows: DataFrame, stations: DataFrame, km: str = "track_km") -> DataFrame:
    """Adds the enclosing stations a, b and the interpolated position of a km along a line.

    The first enclosing segment counts; before the first or after the last station the position
    is that station's.
    """
    legs = segments(stations)
    index = IntervalIndex(legs, "line_id", F.col("a.km"), F.col("b.km"), F.struct("seq", "a", "b"))
    ends = stations.groupBy("line_id").agg(*[
        fn(F.struct("name", "lat", "lon", "km"), "seq").alias(n)
        for fn, n in ((F.min_by, "_start"), (F.max_by, "_end"))])
    at = F.col(km)
    share = F.when(F.col("_leg.b.km") > F.col("_leg.a.km"),
                   (at - F.col("_leg.a.km")) / (F.col("_leg.b.km") - F.col("_leg.a.km"))).otherwise(0.0)
    between = lambda c: X.interpolate(F.col(f"_leg.a.{c}"), F.col(f"_leg.b.{c}"), share)
    outside = F.when(at <= F.col("_start.km"), F.col("_start")).when(
        F.col("_leg").isNull(), F.col("_end"))
    position = lambda c: F.when(outside.isNotNull(), outside[c]).otherwise(between(c))
    return (
        index.attach(rows, at, "_legs")
        .join(sized_broadcast(ends), "line_id", "left")
        .withColumn("_leg", first_match(
            "_legs", lambda g: (g["a"]["km"] <= at) & (at <= g["b"]["km"])))
        .withColumn("station_a", F.coalesce("_leg.a.name", "_start.name"))
        .withColumn("station_b", F.coalesce("_leg.b.name", "_end.name"))
        .withColumn("located_lat", position("lat"))
        .withColumn("located_lon", position("lon"))
        .drop("_legs", "_leg", "_start", "_end")
    )


def defect_placement(stations: DataFrame, min_km: float = DEFECT_MIN_KM,
                     share: float = DEFECT_SHARE, width_km: float = DEFECT_WIDTH_KM,
                     severe_lines: list[str] = SEVERE_LINES) -> DataFrame:
    """One defect at `share` of each line of at least `min_km`, between its two stations."""
    lines = (
        line_totals(stations).where(F.col("length_km") >= min_km)
        .select("line_id", F.round(F.col("length_km") * share, 3).alias("km")))
    placed = locate_on_line(lines, stations, "km")
    return placed.select(
        "line_id", "km", X.defect_id(F.col("line_id"), F.col("km")).alias("defect_id"),
        F.lit(width_km).alias("width_km"),
        F.when(F.col("line_id").isin(severe_lines), "severe").otherwise("moderate").alias("kind"),
        X.between_text(F.col("station_a"), F.col("station_b")).alias("between_text"),
        F.round("located_lat", 6).alias("lat"), F.round("located_lon", 6).alias("lon"),
        F.lit(0).alias("ord"),
    )


# ---------------------------------------------------------------- assembly

def drawings(line_parts: DataFrame) -> DataFrame:
    """Drawing of each line and its longest official length, from line geometry parts."""
    return line_parts.groupBy("line_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part_no", "points"))),
                    lambda p: p["points"]).alias("drawing"),
        F.count("*").alias("parts"), F.sum(F.size("points")).alias("vertices"),
        F.max("official_km").alias("official_length_km"))


def line_assembly(stations: DataFrame, line_parts: DataFrame, min_stations: int = 2) -> DataFrame:
    """One row per line: totals, kind, colour, official length, drawing.

    `stations` carries line_id, seq, name, km, kind, project; geometry of unknown lines drops out.
    """
    meta = stations.groupBy("line_id").agg(
        F.min_by("project", "seq").alias("name"), F.min_by("kind", "seq").alias("kind"))
    known = line_parts.join(meta.select("line_id"), "line_id", "left_semi")
    return (
        line_totals(stations).where(F.col("station_count") >= min_stations)
        .join(meta, "line_id").join(drawings(known), "line_id", "left")
        .withColumn("colour", F.coalesce(
            literal_map(LINE_COLOURS, F.col("line_id")), F.lit(DEFAULT_COLOUR)))
    )


def lines_sorted(lines: DataFrame) -> DataFrame:
    return lines.orderBy(F.length("line_id"), "line_id")


# ---------------------------------------------------------------- geography

def network_extent(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))


def bbox_intersects(shapes: DataFrame, extent: DataFrame, ring: str = "ring",
                    margin: float = EXTENT_MARGIN_DEG) -> DataFrame:
    """Shapes whose bounding box meets the network's, widened by `margin` degrees.

    A column `box` (of a whole feature) decides where there is one, so all rings of a kept feature stay;
    otherwise each ring's own box does.
    """
    edge = lambda c: extent.select(c).scalar()
    box = shapes if "box" in shapes.columns else shapes.withColumn("box", X.ring_bbox(F.col(ring)))
    return box.where(
        F.col("box").isNotNull()
        & (F.col("box.max_lon") >= edge("min_lon") - margin)
        & (F.col("box.min_lon") <= edge("max_lon") + margin)
        & (F.col("box.max_lat") >= edge("min_lat") - margin)
        & (F.col("box.min_lat") <= edge("max_lat") + margin))


def display_name(name: Column) -> Column:
    return F.coalesce(literal_map(NAME_OVERRIDES, name), name)
