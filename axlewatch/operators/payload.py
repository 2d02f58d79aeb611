"""The documents published per tick.

A tick of the whole fleet has no size bound, so axles are published per train (a few axles), the
fleet as one row of counters per tick, and the most urgent alarms as their own bounded list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.operators.alarms import event_columns, is_event, is_faulty
from axlewatch.schemas import CLASSES, FEATURES
from axlewatch.session import checkpointed


def axle_document(states: DataFrame):
    """Struct of one axle: state, prediction, sensors and null-safe position.

    `ready` tells whether there is a prediction, `fill` how many rows the window holds. `fill`, `sev_conf` and
    `sev_probs` are NULL where the states lack them.
    """
    kinds = {"fill": "long", "sev_conf": "double", "sev_probs": "array<double>"}
    given = {c: F.col(c).cast(t) if c in states.columns else F.lit(None).cast(t) for c, t in kinds.items()}
    return F.struct(
        F.col("axle_key").alias("axle"), "line_id", "train_id", "wagon_id", "axle_id",
        "pred", F.round("conf", 4).alias("conf"),
        F.transform("probs", lambda p: F.round(p, 4)).alias("probs"), "severity",
        F.col("pred").isNotNull().alias("ready"), given["fill"].alias("fill"), F.round(given["sev_conf"], 4).alias("sev_conf"),
        F.transform(given["sev_probs"], lambda p: F.round(p, 4)).alias("sev_probs"),
        F.round("entropy", 4).alias("entropy"), "uncertain", "settled", "stable", "dwell_s",
        "priority", "priority_level", "anomaly", F.round("anomaly_score", 4).alias("anomaly_score"),
        "unknown_anomaly",
        F.struct(*[F.round(c, 4).alias(c) for c in FEATURES]).alias("sensors"), position().alias("position"))


def position():
    return F.struct(
        "lat", "lon", F.col("track_km").alias("km"), F.col("next_station").alias("station"),
        F.coalesce("at_station", F.lit(False)).alias("at_station"))


def train_documents(states: DataFrame) -> DataFrame:
    """One JSON document per tick and train: its axles, and the events of the tick, in axle order."""
    rows = states.withColumn("_axle", axle_document(states)).withColumn(
        "_event", F.when(is_event(), F.struct(*event_columns())))
    grouped = rows.groupBy("tick", "line_id", "train_id").agg(
        F.min("timestamp").alias("timestamp"), F.sort_array(F.collect_list("_axle")).alias("axles"),
        F.sort_array(F.collect_list("_event")).alias("new_events"))
    body = F.struct("tick", "timestamp", "line_id", "train_id", "axles", "new_events")
    return grouped.select("tick", "line_id", "train_id", F.to_json(body).alias("document"))


def tick_summary(states: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """One row per tick: counters, predictions by class, and how far the run has come.

    `total_ticks` counts from tick 0 to the last one of the table, on which `finished` is true.
    """
    counters = F.create_map(*[x for c in classes for x in (F.lit(c), F.count_if(F.col("pred") == c))])
    ticks = checkpointed(states.groupBy("tick").agg(
        F.count("*").alias("axles"), F.count_if("uncertain").alias("uncertain"),
        F.count_if("unknown_anomaly").alias("unknown_anomalies"),
        F.count_if(is_faulty()).alias("active_alarms"), F.count_if(is_event()).alias("new_events"),
        counters.alias("class_counts")))
    last = ticks.agg(F.max("tick")).scalar()
    return ticks.withColumn("total_ticks", last + 1).withColumn("finished", F.col("tick") == last)
