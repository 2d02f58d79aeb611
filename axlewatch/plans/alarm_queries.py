"""Alarm queries: hysteresis, events, priority, defect links, status boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.operators import alarms as A
from axlewatch.operators import network as N
from axlewatch.operators.segments import Timeline
from axlewatch.plans import adapt
from axlewatch.plans.common_sql import level, priority
from axlewatch.plans.registry import query
from axlewatch.session import checkpointed

DEFECT_WIDTH_KM = 2.5


def states(spark: SparkSession, d: str) -> DataFrame:
    clock = adapt.clock(spark, d)
    return A.alarm_states(adapt.prediction_timeline(spark, d, clock), start_us=clock.start_us).rows


def events(spark: SparkSession, d: str) -> DataFrame:
    return A.alarm_events(states(spark, d))


def stations(spark: SparkSession, d: str) -> DataFrame:
    """The built network: computed once and stored, as every reader of it expects."""
    return checkpointed(N.cumulative_km(adapt.station_points(spark, d)))


def defects(spark: SparkSession, d: str) -> DataFrame:
    """The placed defects, stored like the network."""
    return checkpointed(N.defect_placement(stations(spark, d), width_km=DEFECT_WIDTH_KM))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return A.link_defects(events(spark, d), defects(spark, d))


def alarm_table(spark: SparkSession, d: str, with_defects: bool = False) -> DataFrame:
    """The events in the shape of the stored history; defects are linked where a question needs them."""
    rows = linked(spark, d) if with_defects else events(spark, d)
    return rows.select(
        F.col("sample_id").alias("id"), F.substring("line_id", 2, 10).cast("long").alias("run_id"),
        F.col("timestamp").alias("recorded_at"), "tick", "axle", "line_id", "prior", "new", "severity",
        "conf", "station", "kind", "prior_duration_s", "priority", *(["defect_id"] if with_defects else []))


@query("hysteresis", needs="h4", sql="""
SELECT sample_id, axle_key, tick, candidate, settled, prior_settled, stable, changed FROM h4""")
def hysteresis(spark, d):
    return states(spark, d).select(
        "sample_id", "axle_key", "tick", "candidate", "settled", "prior_settled", "stable", "changed")


@query("dwell_seconds", needs="h5",
       sql="SELECT sample_id, axle_key, settled, dwell_s, prior_duration_s FROM h5")
def dwell_seconds(spark, d):
    return states(spark, d).select("sample_id", "axle_key", "settled", "dwell_s", "prior_duration_s")


@query("alarm_events", needs="ev", sql="SELECT * FROM ev")
def alarm_events(spark, d):
    return events(spark, d)


@query("alarm_priority", needs="states", sql="""
SELECT sample_id, axle_key, settled, severity, conf, priority, priority_level FROM states
WHERE priority IS NOT NULL""")
def alarm_priority(spark, d):
    return states(spark, d).where("priority is not null").select(
        "sample_id", "axle_key", "settled", "severity", "conf", "priority", "priority_level")


@query("priority_level", needs="pred", sql=f"""
SELECT sample_id, {priority('severity', 'CAST(tick*2 AS DOUBLE)', 'conf')} AS score,
  {level(priority('severity', 'CAST(tick*2 AS DOUBLE)', 'conf'))} AS priority_level FROM pred""")
def priority_level(spark, d):
    from axlewatch.functions import exprs as X
    score = X.alarm_priority(F.col("severity"), F.col("tick") * 2.0, F.col("conf"))
    return adapt.ticked_predictions(spark, d).select("sample_id", score.alias("score")).withColumn(
        "priority_level", X.priority_level(F.col("score")))


@query("faulty_filter", needs="states", sql="""
SELECT sample_id, axle_key, tick, settled FROM states WHERE settled IS NOT NULL AND settled <> 'normal'""")
def faulty_filter(spark, d):
    return states(spark, d).where(A.is_faulty()).select("sample_id", "axle_key", "tick", "settled")


@query("nearest_defect", needs="tele defects", sql="""
SELECT t.sample_id, t.line_id, t.track_km, d.defect_id, d.between_text AS defect_between,
  abs(d.km - t.track_km) AS defect_distance
FROM tele t LEFT JOIN defects d ON t.line_id=d.line_id AND abs(d.km - t.track_km) <= d.width_km + 0.8""")
def nearest_defect(spark, d):
    rows = adapt.telemetry(spark, d).select("sample_id", "line_id", "track_km")
    return A.nearest_defect(rows, defects(spark, d)).select(
        "sample_id", "line_id", "track_km", "defect_id", "defect_between", "defect_distance")


@query("nearest_of_many", needs="tele track_defects", sql="""
WITH near AS (SELECT t.sample_id, min((abs(d.km - t.track_km), d.ord)) AS best FROM tele t JOIN track_defects d USING (line_id) GROUP BY t.sample_id)
SELECT t.sample_id, t.line_id, t.track_km, d.defect_id, d.between_text AS defect_between, abs(d.km - t.track_km) AS defect_distance
FROM tele t LEFT JOIN near n ON n.sample_id=t.sample_id LEFT JOIN track_defects d ON d.line_id=t.line_id
  AND d.ord = n.best[2] AND abs(d.km - t.track_km) = n.best[1] AND abs(d.km - t.track_km) <= d.width_km + 0.8""")
def nearest_of_many(spark, d):
    """Overlapping defects of all widths, several at one place."""
    rows = adapt.telemetry(spark, d).select("sample_id", "line_id", "track_km")
    return A.nearest_defect(rows, adapt.track_defects(spark, d)).select(
        "sample_id", "line_id", "track_km", "defect_id", "defect_between", "defect_distance")


@query("repeats_of_many", needs="ev track_defects", sql="""
WITH near AS (SELECT e.sample_id, min((abs(d.km - e.track_km), d.ord)) AS best FROM ev e JOIN track_defects d USING (line_id) GROUP BY e.sample_id)
SELECT e.sample_id, e.tick, e.axle, d.defect_id, row_number() OVER (PARTITION BY d.defect_id ORDER BY e.tick, e.axle, e.sample_id) AS repeat_no
FROM ev e JOIN near n ON n.sample_id=e.sample_id JOIN track_defects d ON d.line_id=e.line_id
  AND d.ord = n.best[2] AND abs(d.km - e.track_km) = n.best[1] AND abs(d.km - e.track_km) <= d.width_km + 0.8
WHERE e.new = 'rail_crack'""")
def repeats_of_many(spark, d):
    found = checkpointed(A.link_defects(events(spark, d), adapt.track_defects(spark, d)))
    return A.defect_repeats(found).select("sample_id", "tick", "axle", "defect_id", "repeat_no")


@query("defect_linked_events", needs="linked", sql="""
SELECT sample_id, axle, tick, new, defect_id, defect_between FROM linked""")
def defect_linked_events(spark, d):
    return linked(spark, d).select("sample_id", "axle", "tick", "new", "defect_id", "defect_between")


@query("defect_repeat_no", needs="linked", sql="""
SELECT sample_id, defect_id, tick, axle,
  row_number() OVER (PARTITION BY defect_id ORDER BY tick, axle, sample_id) AS repeat_no
FROM linked WHERE defect_id IS NOT NULL""")
def defect_repeat_no(spark, d):
    return A.defect_repeats(checkpointed(linked(spark, d))).select("sample_id", "defect_id", "tick", "axle", "repeat_no")


@query("defect_detection_counts", needs="linked", sql="""
SELECT defect_id, count(*) AS detections, min(defect_between) AS between_text FROM linked
WHERE defect_id IS NOT NULL GROUP BY defect_id""")
def defect_detection_counts(spark, d):
    return A.defect_detection_counts(linked(spark, d), defects(spark, d))


@query("defect_name_lookup", needs="linked defects", sql="""
SELECT l.sample_id, l.axle, l.defect_id, d.between_text, d.lat, d.lon
FROM linked l LEFT JOIN defects d ON l.defect_id=d.defect_id""")
def defect_name_lookup(spark, d):
    known = defects(spark, d).select("defect_id", "between_text", "lat", "lon")
    return linked(spark, d).select("sample_id", "axle", "defect_id").join(known, "defect_id", "left")


@query("top_alarms_per_tick", needs="states", sql="""
SELECT tick, axle_key, sample_id, line_id, settled, severity, round(conf,4) AS conf, priority, priority_level, dwell_s,
  next_station AS station, row_number() OVER (PARTITION BY tick ORDER BY priority DESC, axle_key, sample_id) AS place
FROM states WHERE priority IS NOT NULL
QUALIFY place <= 12""")
def top_alarms_per_tick(spark, d):
    return A.top_alarms_per_tick(states(spark, d))


@query("recent_events", needs="ev", sql="""
SELECT sample_id, tick, axle, prior, new, kind FROM ev ORDER BY tick DESC, axle DESC, sample_id DESC LIMIT 200""")
def recent_events(spark, d):
    return A.recent_events(events(spark, d)).select("sample_id", "tick", "axle", "prior", "new", "kind")


@query("active_alarm_count", needs="states", sql="""
SELECT tick, count(*) FILTER (WHERE settled <> 'normal') AS active_alarms FROM states GROUP BY tick""")
def active_alarm_count(spark, d):
    return A.active_alarm_count(states(spark, d))


@query("alarm_duration", needs="ev", sql="""
SELECT sample_id, axle, new, tick, (epoch_us(nxt) - epoch_us("timestamp"))/CAST(1e6 AS DOUBLE) AS alarm_s FROM (
  SELECT *, lead("timestamp") OVER (PARTITION BY axle ORDER BY "timestamp", sample_id) AS nxt FROM ev) WHERE kind='alarm'""")
def alarm_duration(spark, d):
    # events are few and read twice (to find busy axles, and to pair them)
    line = Timeline.of(checkpointed(events(spark, d)), ["axle"], "timestamp", ["timestamp", "sample_id"])
    return A.alarm_duration(line)


@query("train_status", needs="states", sql="""
SELECT tick, train_id, count(*) AS axles, count(*) FILTER (WHERE settled <> 'normal') AS faulty,
  min_by(settled, (axle_key, sample_id)) FILTER (WHERE settled <> 'normal') AS shown_class
FROM states WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY tick, train_id""")
def train_status(spark, d):
    return A.train_status(states(spark, d))


@query("line_status", needs="states", sql="""
SELECT tick, coalesce(line_id,'?') AS line, count(*) AS axles, count(*) FILTER (WHERE settled <> 'normal') AS faulty,
  min_by(train_id, (axle_key, sample_id)) AS train_id, min_by(next_station, (axle_key, sample_id)) AS station,
  min_by(track_km, (axle_key, sample_id)) AS km, min_by(at_station, (axle_key, sample_id)) AS at_station
FROM states GROUP BY tick, coalesce(line_id,'?')""")
def line_status(spark, d):
    return A.line_status(states(spark, d))


@query("top_anomalies", needs="pred", sql="""
SELECT sample_id, axle_key, line_id, anomaly_score, anomaly_error FROM pred WHERE anomaly
ORDER BY anomaly_score DESC, anomaly_error DESC, sample_id LIMIT 10""")
def top_anomalies(spark, d):
    return A.top_anomalies(adapt.predictions(spark, d))
