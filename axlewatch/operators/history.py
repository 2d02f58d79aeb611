"""Questions to the alarm history (tables `alarms` and `runs`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.session import checkpointed


def _alarms(alarms: DataFrame) -> DataFrame:
    return alarms.where(F.col("kind") == "alarm")


def _mean_duration() -> Column:
    return F.round(F.avg("prior_duration_s"), 1).alias("avg_prior_s")


def alarms_by_axle(alarms: DataFrame, size: int = 15) -> DataFrame:
    """Axles with most alarms. The duration is that of the state *before* each alarm."""
    return (
        _alarms(alarms).groupBy("axle", "line_id")
        .agg(F.count("*").alias("alarm_count"), F.count_if(F.col("severity") == "severe").alias("severe_count"),
             _mean_duration(), F.max("recorded_at").alias("last_alarm"))
        .orderBy(F.desc("alarm_count"), "axle", "line_id").limit(size)
    )


def alarms_by_line(alarms: DataFrame) -> DataFrame:
    return (
        _alarms(alarms).where(F.col("line_id").isNotNull())
        # counting per axle first keeps a busy line off one task
        .groupBy("line_id", "axle").agg(F.count("*").alias("n"))
        .groupBy("line_id").agg(F.sum("n").alias("alarm_count"), F.count("*").alias("axle_count"))
        .orderBy(F.desc("alarm_count"), "line_id")
    )


def alarms_by_class(alarms: DataFrame) -> DataFrame:
    return (
        _alarms(alarms).groupBy(F.col("new").alias("class"))
        .agg(F.count("*").alias("alarm_count"), _mean_duration())
        .orderBy(F.desc("alarm_count"), "class")
    )


def recurring_defects(alarms: DataFrame) -> DataFrame:
    """Detections per fixed defect. Every event kind counts."""
    return (
        alarms.where(F.col("defect_id").isNotNull()).groupBy("defect_id", "axle")
        .agg(F.count("*").alias("n"), F.min("recorded_at").alias("lo"), F.max("recorded_at").alias("hi"))
        .groupBy("defect_id")
        .agg(F.sum("n").alias("detections"), F.count("*").alias("axle_count"),
             F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))
        .orderBy(F.desc("detections"), "defect_id")
    )


def runs_with_alarm_count(runs: DataFrame, alarms: DataFrame, size: int = 10) -> DataFrame:
    """Newest runs with their alarm count, 0 when they had none."""
    newest = runs.orderBy(F.desc("id")).limit(size)
    counts = _alarms(alarms).groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("n"))
    return (newest.join(counts, "id", "left")
            .withColumn("alarm_count", F.coalesce("n", F.lit(0))).drop("n").orderBy(F.desc("id")))


def history_totals(alarms: DataFrame, runs: DataFrame) -> DataFrame:
    total = runs.agg(F.count("*")).scalar()
    return _alarms(alarms).agg(F.count("*").alias("total_alarms")).withColumn("run_count", total)


def last_alarms(alarms: DataFrame, size: int = 50) -> DataFrame:
    """Newest alarms first: of the newest run, in the order of the run (ids repeat between runs)."""
    return _alarms(alarms).orderBy(*map(F.desc, ("run_id", "tick", "axle", "id"))).limit(size)


def line_share(by_line: DataFrame) -> DataFrame:
    """Alarm count relative to the busiest line. `by_line` has one row per line and is stored."""
    by_line = checkpointed(by_line)
    top = by_line.agg(F.greatest(F.lit(1), F.max("alarm_count"))).scalar()
    return by_line.withColumn("share", F.col("alarm_count") / top)


def history_summary(alarms: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """All frames of the history panel."""
    return {
        "totals": history_totals(alarms, runs),
        "axles": alarms_by_axle(alarms),
        "lines": alarms_by_line(alarms),
        "classes": alarms_by_class(alarms),
        "defects": recurring_defects(alarms),
        "runs": runs_with_alarm_count(runs, alarms),
        "last_alarms": last_alarms(alarms, 30),
    }
