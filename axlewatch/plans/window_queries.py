"""Window, tick and motion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from axlewatch.operators import windows as W
from axlewatch.operators.alarms import alarm_states
from axlewatch.operators.segments import with_ordinal
from axlewatch.plans import adapt
from axlewatch.plans.alarm_queries import states
from axlewatch.plans.registry import query

def _item():
    return F.struct("track_km", "speed_kmh", "vib_kurtosis")


def _show(window: str):
    """The whole window as text, in exact integers."""
    whole = lambda c: F.floor(c + 0.5).cast("string")
    return F.array_join(F.transform(window, lambda x: F.concat_ws(
        ":", whole(x["track_km"] * 100), whole(x["speed_kmh"] * 10), whole(x["vib_kurtosis"] * 10))), "|")


# t: one row per reading with its position, the series length and the window as text
SHOWN = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq,
    count(*) OVER (PARTITION BY axle_key) AS n,
    CAST(floor(track_km*100+0.5) AS BIGINT) || ':' || CAST(floor(speed_kmh*10+0.5) AS BIGINT) || ':' ||
    CAST(floor(vib_kurtosis*10+0.5) AS BIGINT) AS item FROM tele),
t AS (SELECT *, array_to_string(list(item) OVER (PARTITION BY axle_key ORDER BY seq
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), '|') AS shown FROM p)
"""


def line(spark, d):
    return adapt.telemetry_timeline(spark, d)


@query("sliding_sequences", needs="tele", sql=SHOWN + """
SELECT sample_id, axle_key, seq, fault_type, fault_severity, shown FROM t
WHERE seq >= 9 AND (seq - 9) % 2 = 0""")
def sliding_sequences(spark, d):
    return W.sliding_sequences(line(spark, d), _item()).rows.select(
        "sample_id", "axle_key", "seq", "fault_type", "fault_severity", _show("window").alias("shown"))


@query("fit_val_split", needs="tele", sql=SHOWN + """
, c AS (SELECT *, CAST(floor(n*CAST(0.85 AS DOUBLE)) AS BIGINT) AS cut FROM t),
f AS (SELECT *, CASE WHEN seq < cut THEN 'fit' ELSE 'val' END AS part,
  seq - CASE WHEN seq < cut THEN 0 ELSE cut END - 9 AS first FROM c)
SELECT sample_id, axle_key, part, shown FROM f WHERE first >= 0 AND first % 2 = 0""")
def fit_val_split(spark, d):
    return W.fit_val_split(line(spark, d), _item()).rows.select(
        "sample_id", "axle_key", "part", _show("window").alias("shown"))


@query("rolling_window_state", needs="tele", sql=SHOWN + """
SELECT sample_id, axle_key, least(seq+1, 10) AS fill, seq >= 9 AS ready, shown FROM t""")
def rolling_window_state(spark, d):
    return W.rolling_window_state(line(spark, d), _item()).rows.select(
        "sample_id", "axle_key", "fill", "ready", _show("window").alias("shown"))


@query("tick_index", needs="tele", sql="""
SELECT "timestamp", dense_rank() OVER (ORDER BY "timestamp") - 1 AS tick
FROM (SELECT DISTINCT "timestamp" FROM tele)""")
def tick_index(spark, d):
    return W.tick_index(adapt.telemetry(spark, d))


@query("ticked_readings", needs="tele", sql="""
SELECT sample_id, axle_key, dense_rank() OVER (ORDER BY "timestamp") - 1 AS tick FROM tele""")
def ticked_readings(spark, d):
    rows = adapt.predictions(spark, d).select("sample_id", "axle_key", "timestamp")
    return W.with_tick(rows).select("sample_id", "axle_key", "tick")


@query("tick_windows", needs="tele", sql="""
SELECT make_timestamp(epoch_us("timestamp")//2000000*2000000) AS window_start, count(*) AS readings,
  count(DISTINCT axle_key) AS axles FROM tele GROUP BY 1""")
def tick_windows(spark, d):
    return W.tick_windows(adapt.predictions(spark, d))


@query("last_tick_flag", needs="pred", sql="""
SELECT tick, readings, tick + 1 >= max(tick) OVER () + 1 AS finished
FROM (SELECT tick, count(*) AS readings FROM pred GROUP BY tick)""")
def last_tick_flag(spark, d):
    ticks = adapt.ticked_predictions(spark, d).groupBy("tick").agg(F.count("*").alias("readings"))
    return W.last_tick_flag(ticks)


@query("recent_series", needs="pred", sql="""
SELECT sample_id, axle_key, tick, track_km, speed_kmh, pred,
  row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp" DESC, sample_id DESC) AS age
FROM pred QUALIFY age <= 90""")
def recent_series(spark, d):
    rows = adapt.ticked_predictions(spark, d).select(
        "sample_id", "timestamp", "axle_key", "tick", "track_km", "speed_kmh", "pred")
    return W.recent_series(rows).drop("timestamp")


@query("minmax_series", needs="pred", sql="""
WITH r AS (SELECT sample_id, axle_key, tick, track_km, speed_kmh,
  row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp" DESC, sample_id DESC) AS age FROM pred QUALIFY age <= 90)
SELECT sample_id, axle_key, tick,
  (track_km - min(track_km) OVER a)/(CASE WHEN max(track_km) OVER a = min(track_km) OVER a THEN 1.0
    ELSE max(track_km) OVER a - min(track_km) OVER a END) AS track_km_scaled,
  (speed_kmh - min(speed_kmh) OVER a)/(CASE WHEN max(speed_kmh) OVER a = min(speed_kmh) OVER a THEN 1.0
    ELSE max(speed_kmh) OVER a - min(speed_kmh) OVER a END) AS speed_kmh_scaled
FROM r WINDOW a AS (PARTITION BY axle_key)""")
def minmax_series(spark, d):
    rows = adapt.ticked_predictions(spark, d).select(
        "sample_id", "timestamp", "axle_key", "tick", "track_km", "speed_kmh")
    out = W.minmax_series(W.recent_series(rows), ["track_km", "speed_kmh"])
    return out.select("sample_id", "axle_key", "tick", "track_km_scaled", "speed_kmh_scaled")


def motion(spark, d):
    base = with_ordinal(line(spark, d))
    base = base.select("timestamp", "sample_id", "seq", "speed_kmh", "load_ton", "motor_current_a")
    return W.acceleration(base)


# a: acceleration per reading
ACCEL = """
WITH q AS (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM tele),
v AS (SELECT *, lag(speed_kmh) OVER (PARTITION BY axle_key ORDER BY seq)/CAST(3.6 AS DOUBLE) AS v0,
  speed_kmh/CAST(3.6 AS DOUBLE) AS v1,
  lead(speed_kmh) OVER (PARTITION BY axle_key ORDER BY seq)/CAST(3.6 AS DOUBLE) AS v2 FROM q),
a AS (SELECT *, CASE WHEN v0 IS NULL AND v2 IS NULL THEN 0.0 WHEN v0 IS NULL THEN (v2-v1)/2
  WHEN v2 IS NULL THEN (v1-v0)/2 ELSE (v2-v0)/4 END AS acceleration FROM v)
"""


@query("acceleration", needs="tele", sql=ACCEL + "SELECT sample_id, axle_key, acceleration FROM a")
def acceleration(spark, d):
    return motion(spark, d).rows.select("sample_id", "axle_key", "acceleration")


@query("brake_activity", needs="tele", sql=ACCEL + """
, b AS (SELECT *, greatest(0.0, least(1.0, -acceleration/CAST(1.1 AS DOUBLE))) AS brake_use FROM a)
SELECT sample_id, axle_key, brake_use, round(coalesce(exp(max(CASE WHEN brake_use > 0 THEN
  ln(brake_use) - seq*ln(CAST(0.88 AS DOUBLE)) END) OVER (PARTITION BY axle_key ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + seq*ln(CAST(0.88 AS DOUBLE))), 0.0), 8) AS brake_activity FROM b""")
def brake_activity(spark, d):
    return W.brake_activity(motion(spark, d)).rows.select(
        "sample_id", "axle_key", "brake_use", F.round("brake_activity", 8).alias("brake_activity"))


@query("current_residual", needs="tele", sql=ACCEL + """
, e AS (SELECT *, 40.0 + CAST(95 AS DOUBLE)*greatest(acceleration,0)*(load_ton/30) + CAST(0.55 AS DOUBLE)*speed_kmh
  - CAST(25 AS DOUBLE)*greatest(-acceleration,0) AS expected FROM a)
SELECT sample_id, axle_key, round(expected, 6) AS expected, round(motor_current_a - expected, 6) AS residual,
  CASE WHEN expected <> 0 THEN round((motor_current_a - expected)/expected, 6) END AS ratio FROM e""")
def current_residual(spark, d):
    from axlewatch.functions import exprs as X
    expected = X.expected_current(F.col("speed_kmh"), F.col("load_ton"), F.col("acceleration"))
    rows = motion(spark, d).rows.withColumn("_expected", expected)
    residual = F.col("motor_current_a") - F.col("_expected")
    return rows.select(
        "sample_id", "axle_key", F.round("_expected", 6).alias("expected"),
        F.round(residual, 6).alias("residual"),
        F.when(F.col("_expected") != 0, F.round(residual / F.col("_expected"), 6)).alias("ratio"))


@query("tick_summary", needs="states", sql="""
SELECT tick, count(*) AS axles, count(*) FILTER (WHERE uncertain) AS uncertain,
  count(*) FILTER (WHERE unknown_anomaly) AS unknown_anomalies,
  count(*) FILTER (WHERE settled <> 'normal') AS active_alarms,
  count(*) FILTER (WHERE changed AND NOT (prior_settled IS NULL AND settled='normal')) AS new_events,
  count(*) FILTER (WHERE pred='bearing_fault') AS bearing_faults, count(*) FILTER (WHERE pred='normal') AS normals,
  count(*) FILTER (WHERE pred='motor_fault') AS motor_faults,
  (SELECT max(tick) FROM states) + 1 AS total_ticks, tick = (SELECT max(tick) FROM states) AS finished
FROM states GROUP BY tick""")
def tick_summary(spark, d):
    from axlewatch.operators.payload import tick_summary as build
    counts = {n: F.col("class_counts")[n[:-1] if n != "normals" else "normal"] for n in ("bearing_faults", "motor_faults", "normals")}
    return build(states(spark, d)).withColumns(counts).drop("class_counts")


@query("tick_payload", needs="states", sql="""
SELECT tick, line_id, train_id, count(*) AS axles, min(axle_key) AS first_axle,
  count(*) FILTER (WHERE settled <> 'normal') AS faulty, count(*) FILTER (WHERE uncertain) AS uncertain,
  round(sum(round(conf, 4)), 4) AS conf, round(sum(track_km), 4) AS km, count(lat) AS located,
  CAST(sum(least(seq + 1, 10)) AS BIGINT) AS fill, count(pred) AS ready, round(sum(round(level, 4)), 4) AS sev_conf,
  round(sum(round(level, 4) + round(conf, 4)), 4) AS sev_probs,
  count(*) FILTER (WHERE changed AND NOT (prior_settled IS NULL AND settled='normal')) AS new_events,
  count(*) FILTER (WHERE changed AND settled <> 'normal') AS new_alarms
FROM (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM states) GROUP BY tick, line_id, train_id""")
def tick_payload(spark, d):
    """The documents, read back from their JSON text."""
    from axlewatch.operators.payload import train_documents
    position = "struct<lat: double, km: double, station: string, at_station: boolean>"
    axle = ("struct<axle: string, settled: string, uncertain: boolean, conf: double, ready: boolean, fill: long, "
            f"sev_conf: double, sev_probs: array<double>, position: {position}>")
    event = "struct<axle: string, kind: string>"
    read = F.from_json("document", f"tick long, line_id string, train_id string, axles array<{axle}>, new_events array<{event}>")
    clock = adapt.clock(spark, d)
    line = with_ordinal(adapt.prediction_timeline(spark, d, clock), "seq")
    rows = alarm_states(line, start_us=clock.start_us).rows.withColumns({
        "fill": F.least(F.col("seq") + 1, F.lit(10)), "sev_conf": F.col("level"), "sev_probs": F.array("level", "conf")})
    one = train_documents(rows).select(read.alias("d")).select(
        "d.tick", "d.line_id", "d.train_id", F.size("d.new_events").alias("events"),
        F.size(F.filter("d.new_events", lambda e: e["kind"] == "alarm")).alias("alarms"), F.explode("d.axles").alias("a"))
    return one.groupBy("tick", "line_id", "train_id").agg(
        F.count("*").alias("axles"), F.min("a.axle").alias("first_axle"),
        F.count_if(F.coalesce(F.col("a.settled") != "normal", F.lit(False))).alias("faulty"),
        F.count_if("a.uncertain").alias("uncertain"), F.round(F.sum("a.conf"), 4).alias("conf"),
        F.round(F.sum("a.position.km"), 4).alias("km"), F.count("a.position.lat").alias("located"),
        F.sum("a.fill").alias("fill"), F.count_if("a.ready").alias("ready"), F.round(F.sum("a.sev_conf"), 4).alias("sev_conf"),
        F.round(F.sum(F.col("a.sev_probs")[0] + F.col("a.sev_probs")[1]), 4).alias("sev_probs"),
        F.max("events").cast("long").alias("new_events"), F.max("alarms").cast("long").alias("new_alarms"))
