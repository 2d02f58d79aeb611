"""Alarm-history queries over the stored shape of the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axlewatch.operators import history as H
from axlewatch.plans import adapt
from axlewatch.plans.alarm_queries import alarm_table, linked
from axlewatch.plans.registry import query
from axlewatch.session import checkpointed, shared_folder
from axlewatch.sources import files


def runs(spark, d):
    """One run per line."""
    rows = adapt.predictions(spark, d)
    return rows.groupBy("line_id").agg(
        F.min("timestamp").alias("started"), F.countDistinct("axle_key").alias("axle_count"),
    ).select(F.substring("line_id", 2, 10).cast("long").alias("id"), "started", "axle_count")


@query("scan_history", needs="alarms", sql="SELECT * FROM alarms")
def scan_history(spark, d):
    return alarm_table(spark, d, with_defects=True)


@query("stored_alarms", needs="linked", sql="""
SELECT CAST(7 AS BIGINT) AS run_id, sample_id AS id, "timestamp" AS sim_time, tick, axle, line_id, prior, new, severity, conf, station, kind,
  prior_duration_s, priority, defect_id FROM linked""")
def stored_alarms(spark, d):
    """Events through the sink in four batches, one of them twice, compacted when three had come; each shows once."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    events, write = checkpointed(linked(spark, d)), files.alarm_writer(path, 7)
    batch = F.col("sample_id") % 4
    for number in (0, 1, 2):
        write(events.where(batch == number), number)
    files.compact_alarms(spark, path, 7)
    for number in (2, 3):
        write(events.where(batch == number), number)
    return files.scan_history(spark, path)["alarms"].drop("recorded_at", "actual")


@query("alarms_by_axle", needs="alarms", sql="""
SELECT axle, line_id, count(*) AS alarm_count, count(*) FILTER (WHERE severity='severe') AS severe_count,
  round(avg(prior_duration_s), 1) AS avg_prior_s, max(recorded_at) AS last_alarm
FROM alarms WHERE kind='alarm' GROUP BY axle, line_id
ORDER BY alarm_count DESC, axle, line_id LIMIT 15""")
def alarms_by_axle(spark, d):
    return H.alarms_by_axle(alarm_table(spark, d))


@query("alarms_by_line", needs="alarms", sql="""
SELECT line_id, count(*) AS alarm_count, count(DISTINCT axle) AS axle_count
FROM alarms WHERE kind='alarm' AND line_id IS NOT NULL GROUP BY line_id""")
def alarms_by_line(spark, d):
    return H.alarms_by_line(alarm_table(spark, d))


@query("alarms_by_class", needs="alarms", sql="""
SELECT new AS class, count(*) AS alarm_count, round(avg(prior_duration_s), 1) AS avg_prior_s
FROM alarms WHERE kind='alarm' GROUP BY new""")
def alarms_by_class(spark, d):
    return H.alarms_by_class(alarm_table(spark, d))


@query("recurring_defects", needs="alarms", sql="""
SELECT defect_id, count(*) AS detections, count(DISTINCT axle) AS axle_count,
  min(recorded_at) AS first_seen, max(recorded_at) AS last_seen
FROM alarms WHERE defect_id IS NOT NULL GROUP BY defect_id""")
def recurring_defects(spark, d):
    return H.recurring_defects(alarm_table(spark, d, with_defects=True))


@query("history_totals", needs="alarms runs", sql="""
SELECT (SELECT count(*) FROM alarms WHERE kind='alarm') AS total_alarms, (SELECT count(*) FROM runs) AS run_count""")
def history_totals(spark, d):
    return H.history_totals(alarm_table(spark, d), runs(spark, d))


@query("runs_with_alarm_count", needs="alarms runs", sql="""
SELECT r.id, r.started, r.axle_count,
  (SELECT count(*) FROM alarms a WHERE a.run_id=r.id AND a.kind='alarm') AS alarm_count
FROM runs r ORDER BY r.id DESC LIMIT 10""")
def runs_with_alarm_count(spark, d):
    return H.runs_with_alarm_count(runs(spark, d), alarm_table(spark, d))


@query("last_alarms", needs="alarms", sql="""
SELECT id, recorded_at, axle, line_id, new, severity FROM alarms WHERE kind='alarm'
ORDER BY run_id DESC, tick DESC, axle DESC, id DESC LIMIT 50""")
def last_alarms(spark, d):
    return H.last_alarms(alarm_table(spark, d)).select(
        "id", "recorded_at", "axle", "line_id", "new", "severity")


@query("line_share", needs="alarms", sql="""
WITH c AS (SELECT line_id, count(*) AS alarm_count, count(DISTINCT axle) AS axle_count
  FROM alarms WHERE kind='alarm' AND line_id IS NOT NULL GROUP BY line_id)
SELECT *, alarm_count/CAST(greatest(1, max(alarm_count) OVER ()) AS DOUBLE) AS share FROM c""")
def line_share(spark, d):
    return H.line_share(H.alarms_by_line(alarm_table(spark, d)))
