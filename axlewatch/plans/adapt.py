"""Telemetry, predictions, stations, defects and geography derived from the given tables.

`events` plays the sensor stream (one user = one axle), `supplier` the stations, `customer` the
districts. The mapping is a pure projection, so every table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import Timeline
from axlewatch.operators.windows import Clock

CLASSES = ["bearing_fault", "normal", "rail_crack"]
ANOMALY_LIMIT = 0.9
GRID_SECONDS = 3600.0      # `events` come about once an hour and axle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry_columns(events: DataFrame) -> DataFrame:
    """Telemetry rows of `events` (works on a batch and on a stream)."""
    k = F.get_json_object("props", "$.k").cast("long")
    user, value = F.col("user_id"), F.col("value")
    base = events.select(
        F.col("event_id").alias("sample_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("L"), F.floor(user / 32).cast("string")).alias("line_id"),
        F.concat(F.lit("T"), F.floor(user / 4).cast("string")).alias("train_id"),
        F.concat(F.lit("V"), (F.floor(user % 4 / 2) + 1).cast("string")).alias("wagon_id"),
        F.concat(F.lit("A"), (user % 2 + 1).cast("string")).alias("axle_id"),
        k.alias("k"), value.alias("value"),
        (value - F.floor(value / 100) * 100).alias("track_km"),
        (F.greatest(k - 20, F.lit(0)) * 1.5).alias("speed_kmh"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("e1"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("e2"),
    )
    speed, e1, e2, kk, v = (F.col(c) for c in ("speed_kmh", "e1", "e2", "k", "value"))
    pred = F.when(e1 == 1, "bearing_fault").when(e2 == 1, "rail_crack").otherwise("normal")
    return base.select(
        "sample_id", "timestamp", "line_id", "train_id", "wagon_id", "axle_id",
        "track_km", "speed_kmh", (kk % 20 + 20.0).alias("load_ton"),
        F.when(kk % 17 != 0, 40.8 + kk / 1000.0).alias("lat"),
        F.when(kk % 17 != 0, 28.5 + kk / 1000.0).alias("lon"),
        F.concat(F.lit("S"), (kk % 20).cast("string")).alias("next_station"),
        X.is_stationary(speed).alias("at_station"),
        (0.02 + speed / 2000).alias("vib_x_rms_g"), (0.02 + kk / 1000.0).alias("vib_y_rms_g"),
        (0.03 + v / 10000).alias("vib_z_rms_g"), (0.06 + e2 * 0.5 + kk / 1000.0).alias("vib_peak_g"),
        (3.0 + e1 * 4 + kk % 10 / 10.0).alias("vib_kurtosis"),
        (2.8 + kk % 7 / 10.0).alias("vib_crest_factor"),
        (2.0 + e1 * 900 + speed / 50).alias("vib_dom_freq_hz"),
        (0.008 + e2 * 0.1 + kk / 5000.0).alias("acoustic_rms"),
        (500.0 + e2 * 1000 + kk).alias("acoustic_peak_freq_hz"),
        (35.0 + e1 * 20 + kk / 10.0).alias("axle_box_temp_c"), (40.0 + kk % 30).alias("brake_temp_c"),
        (55.0 + v / 50).alias("motor_temp_c"), (24.0 + kk % 5 / 10.0).alias("ambient_temp_c"),
        (40.0 + 0.55 * speed + kk % 9).alias("motor_current_a"), (750.0 - kk % 11).alias("motor_voltage_v"),
        (45.0 + kk % 13).alias("humidity_pct"),
        F.when(F.col("sample_id") % 10 == 0, "normal").when(F.col("sample_id") % 10 == 1, "rail_crack")
        .otherwise(pred).alias("fault_type"),
        F.when(F.col("sample_id") % 8 == 0, "none")
        .otherwise(X.severity_bucket(F.least(v / 150, F.lit(1.0)))).alias("fault_severity"),
        pred.alias("pred"), (0.8 + kk / 500.0).alias("conf"), (v / 150).alias("level"),
        (F.abs(v - 50) / 100).alias("anomaly_error"),
    )


def prediction_columns(telemetry: DataFrame) -> DataFrame:
    """Adds what a model would say about each row."""
    rest = (1 - F.col("conf")) / 2
    probs = F.array(*[F.when(F.col("pred") == c, F.col("conf")).otherwise(rest) for c in CLASSES])
    return (
        telemetry.withColumn("axle_key", X.axle_key())
        .withColumn("probs", probs)
        .withColumn("entropy", X.normalized_entropy(F.col("probs"), len(CLASSES)))
        .withColumn("uncertain", X.is_uncertain(F.col("entropy")))
        .withColumn("severity", X.severity_bucket(F.least(F.col("level"), F.lit(1.0))))
        .withColumn("anomaly", F.col("anomaly_error") > ANOMALY_LIMIT)
        .withColumn("anomaly_score", X.anomaly_score(F.col("anomaly_error"), F.lit(ANOMALY_LIMIT)))
        .withColumn("unknown_anomaly", X.unknown_anomaly(
            F.col("anomaly_error"), F.lit(ANOMALY_LIMIT), F.col("pred")))
    )


MODEL_OUTPUT = ["pred", "conf", "level", "anomaly_error"]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled telemetry, without model output."""
    return telemetry_columns(table(spark, sf_dir, "events")).drop(*MODEL_OUTPUT)


def telemetry_timeline(spark: SparkSession, sf_dir: str) -> Timeline:
    df = telemetry(spark, sf_dir).withColumn("axle_key", X.axle_key())
    return Timeline.of(df, ["axle_key"], "timestamp", ["timestamp", "sample_id"])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_columns(telemetry_columns(table(spark, sf_dir, "events")))


def prediction_timeline(spark: SparkSession, sf_dir: str, given: Clock | None = None) -> Timeline:
    """Predictions with `tick`, the common clock of all axles."""
    rows = ticked_predictions(spark, sf_dir, given)
    return Timeline.of(rows, ["axle_key"], "timestamp", ["timestamp", "sample_id"])


def clock(spark: SparkSession, sf_dir: str) -> Clock:
    """Starts with the first reading of the table."""
    times = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("timestamp"))
    return Clock.of(times, GRID_SECONDS)


def ticked_predictions(spark: SparkSession, sf_dir: str, given: Clock | None = None) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("tick", (given or clock(spark, sf_dir)).tick())


def answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("sample_id", "fault_type", "fault_severity")


def station_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered stations of each line: 20 suppliers make a line."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L"), F.floor(key / 20).cast("string")).alias("line_id"),
        (key % 20).alias("seq"), F.col("s_name").alias("name"),
        (40.8 + key * 37 % 60 / 1000.0).alias("lat"), (28.5 + key * 53 % 100 / 1000.0).alias("lon"),
        F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("directorate"),
    )


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed ring of five points per customer."""
    key = F.col("c_custkey")
    lon, lat = 28.0 + key * 131 % 1500 / 1000.0, 40.5 + key * 89 % 900 / 1000.0
    size = 0.002 + key % 5 / 500.0
    corner = lambda dx, dy: F.array(lon + dx * size, lat + dy * size)
    flat = key % 5 == 0
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"),
        F.array(corner(0, 0), corner(1, 0), corner(1, F.when(flat, 0).otherwise(2)),
                corner(0, F.when(flat, 0).otherwise(1)), corner(0, 0)).alias("ring"),
    )


def track_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many defects per line: one per part, on a grid so that places repeat, from a metre to sixteen km wide."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("L"), (key % 5).cast("string")).alias("line_id"), F.concat(F.lit("P"), key.cast("string")).alias("defect_id"),
        (key * 37 % 400 / 4.0).alias("km"), (F.pow(F.lit(2.0), (key * 13 % 15).cast("double")) / 1024).alias("width_km"),
        F.when(key % 3 == 0, "severe").otherwise("mild").alias("kind"), F.col("p_name").alias("between_text"),
        (key * 7919 % 100_003).alias("ord"))
