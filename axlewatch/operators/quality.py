"""Data-quality rules: one row per rule with rows checked and rows in violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import sized_broadcast, with_neighbours
from axlewatch.schemas import CLASSES, FEATURES, LABELS, SEVERITIES

# Accepted ranges.
STATION_BOX = (28.3, 40.7, 29.7, 41.5)
STATIONARY_RANGE = (0.05, 0.6)
MAX_DEFECTS = 12
LENGTH_SLACK = 1.25


def _report(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Aggregates `rule -> (checked, violations)` in one pass and turns them into rows."""
    row = [F.struct(F.lit(n).alias("rule"), c.cast("long").alias("checked"), v.cast("long").alias("violations"))
           for n, (c, v) in rules.items()]
    return df.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def _bad(ok: Column) -> Column:
    """Rows for which `ok` is false or unknown."""
    return F.count_if(~F.coalesce(ok, F.lit(False)))


def telemetry_rules(df: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    n, col = F.count("*"), F.col
    share = F.avg(X.is_stationary(col("speed_kmh")).cast("double"))
    no_null = lambda cs: reduce(lambda a, b: a & b, [col(c).isNotNull() for c in cs])
    return _report(df, {
        "DQ3 no nulls": (n, _bad(no_null([*FEATURES, *LABELS]))),
        "DQ7 known fault class": (n, _bad(col("fault_type").isin(classes))),
        "DQ7 known severity": (n, _bad(col("fault_severity").isin(SEVERITIES))),
        "DQ8 normal has no severity": (
            n, F.count_if((col("fault_type") == "normal") & (col("fault_severity") != "none"))),
        "DQ9 speed in range": (n, _bad(col("speed_kmh").between(0, 120))),
        "DQ9 km not negative": (n, _bad(col("track_km") >= 0)),
        "DQ9 load positive": (n, _bad(col("load_ton") > 0)),
        "DQ10 stationary share": (
            F.lit(1), F.when((share > STATIONARY_RANGE[0]) & (share < STATIONARY_RANGE[1]), 0).otherwise(1)),
        "DQ12 context not null": (n, _bad(no_null(["line_id", "train_id", "next_station", "at_station"]))),
    })


def split_rules(split: DataFrame, label: str = "fault_type") -> DataFrame:
    """Train ends before test starts, and both parts hold every class."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    late = F.max(F.when(train, F.col("timestamp"))) >= F.min(F.when(test, F.col("timestamp")))
    order = _report(split, {
        "DQ4 train before test": (F.count("*"), F.when(late, 1).otherwise(0))})
    per_class = split.groupBy(label).agg(F.count_if(train).alias("train"), F.count_if(test).alias("test"))
    both = _report(per_class, {
        "DQ5 classes in both parts": (F.count("*"), F.count_if((F.col("train") == 0) | (F.col("test") == 0)))})
    return order.unionByName(both)


def key_rules(stream: DataFrame, key: DataFrame) -> DataFrame:
    """Answer-key ids are unique and equal to the stream's."""
    tagged = stream.select("sample_id", F.lit(1).alias("s"), F.lit(0).alias("k")).unionByName(
        key.select("sample_id", F.lit(0).alias("s"), F.lit(1).alias("k")))
    per_id = tagged.groupBy("sample_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
    return _report(per_id, {
        "DQ6 key unique": (F.count("*"), F.count_if(F.col("k") > 1)),
        "DQ6 key equals stream": (
            F.count("*"), F.count_if((F.col("s") == 0) != (F.col("k") == 0)))})


def train_rules(df: DataFrame) -> DataFrame:
    """Axles of one train share km and speed at each instant."""
    moments = df.groupBy("train_id", "timestamp").agg(*[
        fn(c).alias(f"{n}_{c}") for c in ("track_km", "speed_kmh") for n, fn in (("lo", F.min), ("hi", F.max))])
    differs = (F.col("lo_track_km") != F.col("hi_track_km")) | (
        F.col("lo_speed_kmh") != F.col("hi_speed_kmh"))
    return _report(moments, {"DQ11 one position per train": (F.count("*"), F.count_if(differs))})


def tick_rules(ticked: DataFrame) -> DataFrame:
    """Every tick holds every axle."""
    axles = ticked.agg(F.countDistinct("axle_key")).scalar()
    ticks = ticked.groupBy("tick").agg(F.countDistinct("axle_key").alias("axles"))
    ticks = ticks.withColumn("want", axles)
    return _report(ticks, {
        "DQ18 every axle in every tick": (F.count("*"), F.count_if(F.col("axles") < F.col("want")))})


def network_rules(stations: DataFrame, defects: DataFrame, official: DataFrame) -> DataFrame:
    """Stations in the box, km rising from 0, names unique; line lengths; defects on their lines.

    `official` has line_id and official_length_km.
    """
    from axlewatch.operators.network import _by_station, line_totals
    col = F.col
    lo_x, lo_y, hi_x, hi_y = STATION_BOX
    line = with_neighbours(_by_station(stations, 4096), "km", "seq", "before", "after").rows
    rises = F.when(col("before").isNull(), col("km") == 0).otherwise(col("km") >= col("before"))
    station = _report(line, {
        "DQ14 stations in box": (
            F.count("*"), _bad(col("lon").between(lo_x, hi_x) & col("lat").between(lo_y, hi_y))),
        "DQ14 km rises from 0": (F.count("*"), _bad(rises))})
    names = _report(stations.groupBy("line_id", "name").agg(F.count("*").alias("n")), {
        "DQ14 names unique": (F.count("*"), F.count_if(col("n") > 1))})
    totals = line_totals(stations)
    length = _report(totals.join(official, "line_id"), {
        "DQ15 length plausible": (
            F.count_if(col("station_count") >= 5),
            F.count_if((col("station_count") >= 5)
                       & (col("length_km") > col("official_length_km") * LENGTH_SLACK)))})
    return reduce(DataFrame.unionByName, [station, names, length, defect_rules(stations, defects, totals)])


def defect_rules(stations: DataFrame, defects: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Defects lie on their line between two of its stations, one per line and few in all."""
    from axlewatch.operators.network import line_totals
    col = F.col
    totals = line_totals(stations) if totals is None else totals
    known = sized_broadcast(stations.select("line_id", "name"))
    ends = F.split("between_text", " – ")
    named = (
        defects.select("line_id", "defect_id", "km", F.explode(ends).alias("name"))
        .join(known.withColumn("found", F.lit(1)), ["line_id", "name"], "left")
        .groupBy("line_id", "defect_id", "km").agg(F.count("found").alias("found")))
    inside = _report(named.join(totals, "line_id", "left"), {
        "DQ16 defect inside its line": (F.count("*"), _bad(col("km").between(0, col("length_km")))),
        "DQ16 defect between real stations": (F.count("*"), F.count_if(col("found") < 2))})
    per_line = _report(defects.groupBy("line_id").agg(F.count("*").alias("n")), {
        "DQ16 one defect per line": (F.count("*"), F.count_if(col("n") > 1)),
        "DQ16 few defects": (F.lit(1), F.when(F.sum("n") > MAX_DEFECTS, 1).otherwise(0))})
    return inside.unionByName(per_line)


def ring_rules(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    b = X.ring_bbox(F.col("ring"))
    inside = (b["min_lon"] >= box[0]) & (b["min_lat"] >= box[1]) & (
        b["max_lon"] <= box[2]) & (b["max_lat"] <= box[3])
    return _report(rings, {
        "DQ17 rings have 4 points": (F.count("*"), _bad(F.size("ring") >= 4)),
        "DQ17 rings in box": (F.count("*"), _bad(inside))})


def schema_rules(train: DataFrame, test: DataFrame, stream: DataFrame) -> DataFrame:
    """Rules that only look at schemas (no row is read)."""
    numeric = {"double", "float", "int", "bigint"}
    types = dict(train.dtypes)
    found = [
        ("DQ1 same columns", len(train.columns), len(set(train.columns) ^ set(test.columns))),
        ("DQ2 features numeric", len(FEATURES), sum(types.get(c) not in numeric for c in FEATURES)),
        ("DQ13 stream without labels", len(stream.columns), sum(c in LABELS for c in stream.columns)),
    ]
    return train.sparkSession.createDataFrame(found, "rule string, checked long, violations long")
