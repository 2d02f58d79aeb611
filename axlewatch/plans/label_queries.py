"""Scan, projection, split, label and set queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators import labels as L
from axlewatch.plans import adapt
from axlewatch.plans.registry import query
from axlewatch.schemas import ANSWER_KEY, FEATURES, LABELS, STREAM, TELEMETRY
from axlewatch.session import shared_folder
from axlewatch.sources import files

_TELE = ", ".join(f'"{f.name}"' for f in TELEMETRY.fields)
_STREAM = ", ".join(f'"{f.name}"' for f in STREAM.fields)
_KEY = ", ".join(f'"{f.name}"' for f in ANSWER_KEY.fields)


@query("scan_telemetry", needs="tele", sql=f"SELECT {_TELE} FROM tele")
def scan_telemetry(spark, d):
    """Written as CSV with a header, and read back by the reader."""
    path = f"{shared_folder(spark)}/telemetry-{uuid.uuid4().hex}"
    adapt.telemetry(spark, d).select(*TELEMETRY.names).write.options(**files.CSV).csv(path)
    return files.scan_telemetry(spark, path)


@query("scan_answer_key", needs="tele", sql="SELECT sample_id, fault_type, fault_severity FROM tele")
def scan_answer_key(spark, d):
    """The key that the sink writes apart from the stream, read back by the reader."""
    path = f"{shared_folder(spark)}/key-{uuid.uuid4().hex}"
    files.write_stream_and_key(adapt.telemetry(spark, d), path, "csv")
    return files.scan_answer_key(spark, f"{path}/key").select("sample_id", "fault_type", "fault_severity")


@query("axle_key", needs="tele", sql="SELECT sample_id, train_id, wagon_id, axle_id, axle_key FROM tele")
def axle_key(spark, d):
    return adapt.telemetry(spark, d).select(
        "sample_id", "train_id", "wagon_id", "axle_id", X.axle_key().alias("axle_key"))


@query("feature_projection", needs="tele",
       sql=f"SELECT sample_id, {', '.join(FEATURES)} FROM tele")
def feature_projection(spark, d):
    return adapt.telemetry(spark, d).select("sample_id", *FEATURES)


@query("drop_labels", needs="tele", sql=f"SELECT {_STREAM} FROM tele")
def drop_labels(spark, d):
    return L.require_unlabelled(L.drop_labels(adapt.telemetry(spark, d)))


@query("answer_key_projection", needs="tele", sql=f"SELECT {_KEY} FROM tele")
def answer_key_projection(spark, d):
    return L.answer_key(adapt.telemetry(spark, d))


@query("assign_sample_id", needs="tele", sql="""
SELECT "timestamp", train_id, wagon_id, axle_id,
  row_number() OVER (ORDER BY "timestamp", train_id, wagon_id, axle_id) - 1 AS sample_id FROM tele""")
def assign_sample_id(spark, d):
    order = ["timestamp", "train_id", "wagon_id", "axle_id"]
    return L.assign_sample_id(adapt.telemetry(spark, d).select(*order), order)


@query("scan_ranked", needs="tele", sql="""
WITH b AS (SELECT min(epoch_us("timestamp")) + (max(epoch_us("timestamp")) - min(epoch_us("timestamp")) + 2000000)*CAST(0.8 AS DOUBLE) AS cut FROM tele)
SELECT "timestamp", train_id, wagon_id, axle_id, CASE WHEN epoch_us("timestamp") < cut THEN 'train' ELSE 'test' END AS part,
  row_number() OVER (ORDER BY "timestamp", train_id, wagon_id, axle_id) - 1 AS place FROM tele, b""")
def scan_ranked(spark, d):
    """The split table written once in order; places come from file offsets on reading."""
    order = ["timestamp", "train_id", "wagon_id", "axle_id"]
    path = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    files.write_ranked(L.chronological_split(adapt.telemetry(spark, d).select(*order)), order, path)
    return files.scan_ranked(spark, path, "place")


@query("chronological_split", sql="""
WITH b AS (SELECT min(epoch_us(l_shipdate)) + (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)) + 2000000)*CAST(0.8 AS DOUBLE) AS cut
  FROM lineitem)
SELECT CASE WHEN epoch_us(l_shipdate) < cut THEN 'train' ELSE 'test' END AS part, count(*) AS readings,
  min(l_shipdate) AS first_time, max(l_shipdate) AS last_time FROM lineitem, b GROUP BY 1""")
def chronological_split(spark, d):
    rows = adapt.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("timestamp"))
    return L.chronological_split(rows).groupBy("part").agg(
        F.count("*").alias("readings"), F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"))


@query("round_floats", needs="tele",
       sql=f"SELECT sample_id, {', '.join(f'round_even({c}*10000, 0)/CAST(10000 AS DOUBLE) AS {c}' for c in FEATURES)} FROM tele")
def round_floats(spark, d):
    return L.round_floats(adapt.telemetry(spark, d).select("sample_id", *FEATURES))


@query("normal_only", needs="tele", sql="""
SELECT sample_id, axle_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq
  FROM tele) WHERE seq >= 9 AND (seq - 9) % 2 = 0 AND fault_type='normal'""")
def normal_only(spark, d):
    from axlewatch.operators.windows import sliding_sequences
    line = adapt.telemetry_timeline(spark, d)
    rows = sliding_sequences(line, F.col("track_km")).rows
    return rows.where("fault_type = 'normal'").select("sample_id", "axle_key", "seq")


@query("stationary_flag", needs="tele", sql="""
SELECT sample_id, speed_kmh, speed_kmh < 0.5 AS stationary FROM tele""")
def stationary_flag(spark, d):
    return adapt.telemetry(spark, d).select(
        "sample_id", "speed_kmh", X.is_stationary(F.col("speed_kmh")).alias("stationary"))


@query("position_struct", needs="tele", sql="""
SELECT sample_id, lat, lon, track_km AS km, next_station AS station, coalesce(at_station, false) AS at_station FROM tele""")
def position_struct(spark, d):
    from axlewatch.operators.payload import position
    rows = adapt.telemetry(spark, d).select("sample_id", position().alias("position"))
    return rows.select("sample_id", "position.*")


def _split(spark, d):
    return L.chronological_split(adapt.telemetry(spark, d))


# s: telemetry with its chronological part
SPLIT = """
WITH b AS (SELECT min(epoch_us("timestamp")) + (max(epoch_us("timestamp")) - min(epoch_us("timestamp")) + 2000000)*CAST(0.8 AS DOUBLE) AS cut FROM tele),
s AS (SELECT tele.*, CASE WHEN epoch_us("timestamp") < cut THEN 'train' ELSE 'test' END AS part FROM tele, b)
"""


@query("train_test_split", needs="tele", sql=SPLIT + "SELECT sample_id, axle_key, part FROM s")
def train_test_split(spark, d):
    return _split(spark, d).select("sample_id", X.axle_key().alias("axle_key"), "part")


@query("label_distribution", needs="tele", sql=SPLIT + """
, u AS (SELECT part, fault_type, fault_severity FROM s UNION ALL SELECT 'all', fault_type, fault_severity FROM s)
SELECT part, 'fault_type' AS label, fault_type AS value, count(*) AS readings FROM u GROUP BY ALL
UNION ALL SELECT part, 'fault_severity', fault_severity, count(*) FROM u GROUP BY ALL""")
def label_distribution(spark, d):
    return L.label_distribution(_split(spark, d))


@query("profile_ranges", needs="tele", sql=f"""
SELECT count(*) AS readings, count(*) FILTER (WHERE lat IS NULL) + count(*) FILTER (WHERE lon IS NULL) AS nulls,
  min("timestamp") AS first_time, max("timestamp") AS last_time, min(speed_kmh) AS min_speed,
  max(speed_kmh) AS max_speed, count(*) FILTER (WHERE speed_kmh < 0.5)/CAST(count(*) AS DOUBLE) AS stationary_share FROM tele""")
def profile_ranges(spark, d):
    return L.profile_ranges(adapt.telemetry(spark, d))


@query("distinct_counts", needs="tele", sql="""
SELECT count(DISTINCT "timestamp") AS ticks, count(DISTINCT axle_key) AS axles, count(DISTINCT line_id) AS lines FROM tele""")
def distinct_counts(spark, d):
    return L.distinct_counts(
        adapt.predictions(spark, d), ticks="timestamp", axles="axle_key", lines="line_id")


@query("label_union", needs="answered", sql="""
SELECT actual AS label FROM answered UNION SELECT pred FROM answered""")
def label_union(spark, d):
    return L.label_union(adapt.predictions(spark, d), "fault_type", "pred")


@query("set_difference", sql="""
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def set_difference(spark, d):
    """Documents without a label."""
    return L.set_difference(adapt.table(spark, d, "documents").select("doc_id"),
                            adapt.table(spark, d, "labels").select("doc_id"))


@query("lines_without_trains", needs="tele stations0", sql="""
SELECT DISTINCT line_id FROM stations0 EXCEPT SELECT line_id FROM tele""")
def lines_without_trains(spark, d):
    return L.set_difference(adapt.station_points(spark, d).select("line_id"),
                            adapt.telemetry(spark, d).select("line_id"))


@query("missing_classes", sql="""
WITH b AS (SELECT min(epoch_us(l_shipdate)) + (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate)) + 2000000)*CAST(0.8 AS DOUBLE) AS cut FROM lineitem),
s AS (SELECT 'M'||CAST(date_trunc('month', l_shipdate) AS DATE) AS fault_type,
  CASE WHEN epoch_us(l_shipdate) < cut THEN 'train' ELSE 'test' END AS part FROM lineitem, b)
SELECT DISTINCT fault_type, p AS missing_in FROM s, (SELECT unnest(['train','test']) AS p)
WHERE (fault_type, p) NOT IN (SELECT (fault_type, part) FROM s)""")
def missing_classes(spark, d):
    """Shipping months play the classes, so both parts lack some."""
    rows = adapt.table(spark, d, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("M"), F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd")).alias("fault_type"))
    return L.missing_classes(L.chronological_split(rows))


@query("set_equality", sql="""
SELECT count(*) FILTER (WHERE r.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_right,
  count(*) FILTER (WHERE r.doc_id IS NULL OR l.doc_id IS NULL) = 0 AS equal
FROM (SELECT DISTINCT doc_id FROM documents) l FULL JOIN (SELECT DISTINCT doc_id FROM labels) r ON l.doc_id=r.doc_id""")
def set_equality(spark, d):
    return L.set_equality(adapt.table(spark, d, "documents"), adapt.table(spark, d, "labels"), "doc_id")


@query("concat_series", needs="tele", sql=SPLIT + "SELECT sample_id, axle_key, fault_type FROM s")
def concat_series(spark, d):
    both = _split(spark, d).withColumn("axle_key", X.axle_key()).select(
        "part", "sample_id", "axle_key", "fault_type")
    return L.concat_series(both.where("part = 'train'"), both.where("part = 'test'")).drop("part")


@query("order_telemetry", needs="tele", sql="""
SELECT sample_id, "timestamp", train_id, wagon_id, axle_id FROM tele ORDER BY "timestamp", train_id, wagon_id, axle_id""")
def order_telemetry(spark, d):
    order = ["timestamp", "train_id", "wagon_id", "axle_id"]
    return adapt.telemetry(spark, d).select("sample_id", *order).orderBy(*order)


@query("first_n_predictions", needs="answered", sql="""
SELECT sample_id, actual, pred, actual_severity, severity, CASE WHEN actual=pred THEN 'OK' ELSE 'X' END AS mark
FROM answered ORDER BY axle_key, "timestamp", sample_id LIMIT 20""")
def first_n_predictions(spark, d):
    """The first sequences in series order, with a mark for right and wrong."""
    rows = adapt.predictions(spark, d)
    return rows.orderBy("axle_key", "timestamp", "sample_id").limit(20).select(
        "sample_id", F.col("fault_type").alias("actual"), "pred",
        F.col("fault_severity").alias("actual_severity"), "severity",
        F.when(F.col("fault_type") == F.col("pred"), "OK").otherwise("X").alias("mark"))


@query("preview", needs="tele", sql="""
SELECT sample_id, train_id, "timestamp" FROM tele ORDER BY sample_id LIMIT 5""")
def preview(spark, d):
    """Head of the stream (five messages, as the topic listing shows)."""
    return adapt.telemetry(spark, d).select("sample_id", "train_id", "timestamp").orderBy("sample_id").limit(5)


@query("json_row", needs="tele", sql="""
SELECT train_id AS "key", sample_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS sent_at, track_km, at_station, next_station FROM tele""")
def json_row(spark, d):
    """Rows written as messages and read back."""
    from axlewatch.sources.kafka import decode_messages, encode_messages
    back = decode_messages(encode_messages(L.drop_labels(adapt.telemetry(spark, d))), keep=["key"])
    return back.select("key", "sample_id", X.iso_timestamp(F.col("timestamp")).alias("sent_at"),
                       "track_km", "at_station", "next_station")


@query("coerce_numeric", sql="""
SELECT event_id, try_cast(CASE WHEN event_id % 9 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number
FROM events""")
def coerce_numeric(spark, d):
    """Text that is a number becomes one; anything else becomes NULL."""
    from axlewatch.sources.kafka import coerce_numeric as coerce
    rows = adapt.table(spark, d, "events").select("event_id", F.when(
        F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")).alias("number"))
    return coerce(rows, ["number"])


# ---------------------------------------------------------------- scalar functions

@query("normalized_entropy", needs="pred", sql="SELECT sample_id, round(entropy, 9) AS entropy, uncertain FROM pred")
def normalized_entropy(spark, d):
    return adapt.predictions(spark, d).select("sample_id", F.round("entropy", 9).alias("entropy"), "uncertain")


@query("softmax_argmax", sql="""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT *, max(x) OVER (PARTITION BY vec_id) AS top FROM e)
SELECT vec_id, min(i) FILTER (WHERE x = top) - 1 AS best,
  round(1.0/sum(exp(CAST(x AS DOUBLE) - CAST(top AS DOUBLE))), 9) AS conf FROM m GROUP BY vec_id""")
def softmax_argmax(spark, d):
    probs = X.softmax(F.transform("embedding", lambda x: x.cast("double")))
    rows = adapt.table(spark, d, "embeddings").select("vec_id", probs.alias("probs"))
    return rows.select("vec_id", X.argmax(F.col("probs")).cast("long").alias("best"),
                       F.round(F.array_max("probs"), 9).alias("conf"))


@query("anomaly_score_norm", needs="pred", sql="""
SELECT sample_id, anomaly_error, anomaly_score, CASE WHEN anomaly_error - 0.5 > 0 THEN
  greatest(0.0, least(1.0, anomaly_error/(2*(anomaly_error - CAST(0.5 AS DOUBLE))))) ELSE 0.0 END AS against_moving FROM pred""")
def anomaly_score_norm(spark, d):
    err = F.col("anomaly_error")
    return adapt.predictions(spark, d).select(
        "sample_id", "anomaly_error", "anomaly_score", X.anomaly_score(err, err - 0.5).alias("against_moving"))


@query("unknown_anomaly", needs="pred", sql="SELECT sample_id, pred, anomaly, unknown_anomaly FROM pred")
def unknown_anomaly(spark, d):
    return adapt.predictions(spark, d).select("sample_id", "pred", "anomaly", "unknown_anomaly")


@query("severity_functions", needs="tele", sql="""
SELECT sample_id, CASE fault_severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 ELSE 0 END AS code,
  CASE WHEN (sample_id%40)/CAST(40 AS DOUBLE) < 0.5 THEN least(1.0, (sample_id%40)/CAST(40 AS DOUBLE)*2)
    ELSE greatest(0.0, 1 - ((sample_id%40)/CAST(40 AS DOUBLE) - 0.5)*2) END AS profile FROM tele""")
def severity_functions(spark, d):
    step = F.col("sample_id") % 40
    return adapt.telemetry(spark, d).select(
        "sample_id", X.severity_code(F.col("fault_severity")).cast("int").alias("code"),
        X.severity_profile(step.cast("double"), F.lit(0.0), F.lit(40.0)).alias("profile"))


@query("severity_bucket", needs="tele", sql="""
SELECT sample_id, level, CASE WHEN level < 0.15 THEN 'none' WHEN level < 0.45 THEN 'mild'
  WHEN level < 0.8 THEN 'moderate' ELSE 'severe' END AS bucket FROM tele""")
def severity_bucket(spark, d):
    return adapt.predictions(spark, d).select(
        "sample_id", "level", X.severity_bucket(F.col("level")).alias("bucket"))


@query("wheel_rotation_hz", needs="tele", sql="""
SELECT sample_id, round(greatest(speed_kmh,1)/3.6/(pi()*CAST(0.92 AS DOUBLE)), 9) AS rotation_hz FROM tele""")
def wheel_rotation_hz(spark, d):
    return adapt.telemetry(spark, d).select(
        "sample_id", F.round(X.wheel_rotation_hz(F.col("speed_kmh")), 9).alias("rotation_hz"))


@query("line_code", sql="""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'm'||(o_custkey%9)||'a Hattı' WHEN 1 THEN ' T'||(o_custkey%5)||' Tramvay'
  WHEN 2 THEN 'Halkalı Marmaray' WHEN 3 THEN 'Merkez Hattı' WHEN 4 THEN '' ELSE 'F'||(o_custkey%4) END AS project FROM orders)
SELECT o_orderkey, project, CASE WHEN regexp_matches(upper(split_part(trim(project),' ',1)), '^[MTF]')
    AND regexp_matches(split_part(trim(project),' ',1), '[0-9]') THEN upper(split_part(trim(project),' ',1))
  WHEN contains(upper(project), 'MARMARAY') THEN 'MARMARAY' END AS line_id FROM p""")
def line_code(spark, d):
    o = adapt.table(spark, d, "orders")
    kind, cust = F.col("o_orderkey") % 6, F.col("o_custkey")
    num = lambda n: (cust % n).cast("string")
    project = (
        F.when(kind == 0, F.concat(F.lit("m"), num(9), F.lit("a Hattı")))
        .when(kind == 1, F.concat(F.lit(" T"), num(5), F.lit(" Tramvay")))
        .when(kind == 2, "Halkalı Marmaray").when(kind == 3, "Merkez Hattı").when(kind == 4, "")
        .otherwise(F.concat(F.lit("F"), num(4))))
    return o.select("o_orderkey", project.alias("project")).withColumn(
        "line_id", X.line_code(F.col("project")))


@query("text_functions", needs="tele", sql="""
SELECT sample_id, strftime("timestamp", '%H:%M:%S') AS clock, strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS iso,
  trim('  '||next_station||' ') AS trimmed, line_id||'@'||printf('%.2f', track_km) AS place,
  train_id||' – '||wagon_id AS between_text FROM tele""")
def text_functions(spark, d):
    ts = F.col("timestamp")
    return adapt.telemetry(spark, d).select(
        "sample_id", X.clock_text(ts).alias("clock"), X.iso_timestamp(ts).alias("iso"),
        F.trim(F.concat(F.lit("  "), "next_station", F.lit(" "))).alias("trimmed"),
        X.defect_id(F.col("line_id"), F.col("track_km")).alias("place"),
        X.between_text(F.col("train_id"), F.col("wagon_id")).alias("between_text"))


@query("duration_text", needs="h5", sql="""
SELECT sample_id, dwell_s, CASE WHEN dwell_s < 60 THEN CAST(floor(dwell_s+0.5) AS BIGINT)||' sn'
  WHEN floor(dwell_s - floor(dwell_s/60)*60 + 0.5) = 0 THEN CAST(floor(dwell_s/60) AS BIGINT)||' dk'
  ELSE CAST(floor(dwell_s/60) AS BIGINT)||' dk '||CAST(floor(dwell_s - floor(dwell_s/60)*60 + 0.5) AS BIGINT)||' sn' END AS text
FROM h5""")
def duration_text(spark, d):
    from axlewatch.plans.alarm_queries import states
    return states(spark, d).select("sample_id", "dwell_s", X.duration_text(F.col("dwell_s")).alias("text"))


@query("reconstruction_error", sql="""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, round(avg(power(CAST(x AS DOUBLE) - round(CAST(x AS DOUBLE), 1), 2)), 9) AS error FROM e GROUP BY vec_id""")
def reconstruction_error(spark, d):
    """Error of each vector against its own one-digit rounding."""
    exact = F.transform("embedding", lambda x: x.cast("double"))
    rough = F.transform("embedding", lambda x: F.round(x.cast("double"), 1))
    return adapt.table(spark, d, "embeddings").select(
        "vec_id", F.round(X.reconstruction_error(exact, rough), 9).alias("error"))


assert set(LABELS) <= set(TELEMETRY.names)
