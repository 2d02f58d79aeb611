"""Model-data and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.operators import labels as L
from axlewatch.operators import models as M
from axlewatch.operators import quality as Q
from axlewatch.operators.segments import exact_percentile
from axlewatch.plans import adapt
from axlewatch.plans.alarm_queries import defects, stations
from axlewatch.plans.registry import query
from axlewatch.schemas import ENTROPY_LIMIT, FEATURES, SEVERITIES
from axlewatch.session import checkpointed


@query("scaler_fit", needs="tele", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 10) AS mean, round(CASE WHEN stddev_pop({c})=0 THEN 1.0 "
    f"ELSE stddev_pop({c}) END, 8) AS scale FROM tele" for c in FEATURES))
def scaler_fit(spark, d):
    fitted = M.scaler_fit(adapt.telemetry(spark, d))
    return fitted.select("feature", F.round("mean", 10).alias("mean"), F.round("scale", 8).alias("scale"))


@query("scale_features", needs="tele", sql="""
SELECT sample_id, round((speed_kmh - avg(speed_kmh) OVER ())/stddev_pop(speed_kmh) OVER (), 6) AS speed_scaled,
  round((track_km - avg(track_km) OVER ())/stddev_pop(track_km) OVER (), 6) AS km_scaled FROM tele""")
def scale_features(spark, d):
    rows = adapt.telemetry(spark, d)
    scaler = M.fit_scaler(rows, ["speed_kmh", "track_km"])
    return M.scale_features(rows, scaler).select(
        "sample_id", F.round(F.col("scaled")[0], 6).alias("speed_scaled"),
        F.round(F.col("scaled")[1], 6).alias("km_scaled"))


@query("label_codes", sql="""
SELECT source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT source FROM documents)""")
def label_codes(spark, d):
    return M.label_codes(adapt.table(spark, d, "documents"), "source")


@query("class_weights", sql="""
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
w AS (SELECT label, n, sqrt(sum(n) OVER ()/CAST(count(*) OVER ()*n AS DOUBLE)) AS w FROM c)
SELECT label, n, round(w/avg(w) OVER (), 9) AS weight FROM w""")
def class_weights(spark, d):
    out = M.class_weights(adapt.table(spark, d, "embeddings"), "label")
    return out.withColumn("weight", F.round("weight", 9))


@query("anomaly_threshold", needs="pred", sql="""
SELECT quantile_cont(anomaly_error, CAST(0.99 AS DOUBLE)) AS percentile FROM pred WHERE fault_type='normal'""")
def anomaly_threshold(spark, d):
    normal = adapt.predictions(spark, d).where("fault_type = 'normal'")
    return exact_percentile(normal, "anomaly_error", 0.99, ["sample_id"])


@query("anomaly_rates", needs="pred", sql="""
WITH c AS (SELECT fault_type AS class, count(*) AS windows,
  round(count(*) FILTER (WHERE anomaly)/CAST(count(*) AS DOUBLE), 6) AS rate FROM pred GROUP BY 1)
SELECT *, (SELECT rate FROM c WHERE class='normal') AS false_alarm_rate,
  (SELECT round(avg(rate), 6) FROM c WHERE class<>'normal') AS catch_rate FROM c""")
def anomaly_rates(spark, d):
    return M.anomaly_rates(adapt.predictions(spark, d), digits=6)


def windows(spark, d) -> tuple[DataFrame, M.Scaler]:
    line = adapt.telemetry_timeline(spark, d)
    scaler = M.fit_scaler(line.rows)
    return M.window_vectors(line, scaler), scaler


@query("window_vectors", needs="tele", sql=f"""
WITH s AS (SELECT sample_id, axle_key, fault_type, fault_severity, {' + '.join(f'({c} - avg({c}) OVER ())/stddev_pop({c}) OVER ()' for c in FEATURES)} AS total,
  row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM tele),
w AS (SELECT *, sum(total) OVER (PARTITION BY axle_key ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS vector_sum FROM s)
SELECT sample_id, fault_type, CASE fault_severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 ELSE 0 END AS severity_code,
  CAST(190 AS INTEGER) AS width, round(vector_sum, 5) AS vector_sum FROM w WHERE seq >= 9 AND (seq-9)%2=0""")
def window_vectors(spark, d):
    values = vector_to_array("features")
    return windows(spark, d)[0].select(
        "sample_id", "fault_type", F.col("severity_code").cast("int").alias("severity_code"),
        F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 5).alias("vector_sum"))


# scores follow from a fit, so their SQL forms state the rows scored and what must hold of every score
@query("score_models", needs="tele", sql="""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq,
  CAST(floor(count(*) OVER (PARTITION BY axle_key)*CAST(0.85 AS DOUBLE)) AS BIGINT) AS cut FROM tele)
SELECT sample_id, fault_type, true AS pred_is_best, true AS pred_is_known, true AS sums_to_one, true AS severity_is_best, true AS severity_sums_to_one,
  true AS entropy_in_range, true AS uncertain_by_entropy FROM t WHERE seq >= cut + 9 AND (seq - cut - 9) % 2 = 0""")
def score_models(spark, d):
    """Both classifiers fitted on the first part of each axle, scoring the rest."""
    line = adapt.telemetry_timeline(spark, d)
    scaler = M.fit_scaler(line.rows)
    both = M.stored_windows(M.window_vectors(line, scaler, split=True), "part")
    model = M.fit_fault_model(both.where("part = 'fit'"), scaler, max_iter=20)
    out = M.score_models(both.where("part = 'val'"), model)
    given = lambda names, label, probs: F.get(
        F.col(probs), F.array_position(F.array(*map(F.lit, names)), F.col(label)).cast("int") - 1)
    best = lambda names, label, conf, probs: F.coalesce((given(names, label, probs) == F.col(conf)) & (
        F.col(conf) == F.array_max(probs)) & (F.size(probs) == len(names)), F.lit(False))
    one = lambda probs: F.abs(F.aggregate(probs, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    return out.select(
        "sample_id", "fault_type", best(model.classes, "pred", "conf", "probs").alias("pred_is_best"),
        F.col("pred").isin(model.classes).alias("pred_is_known"),
        one("probs").alias("sums_to_one"), best(SEVERITIES, "severity", "sev_conf", "sev_probs").alias("severity_is_best"),
        one("sev_probs").alias("severity_sums_to_one"), F.col("entropy").between(0, 1 + 1e-12).alias("entropy_in_range"),
        (F.col("uncertain") == (F.col("entropy") > ENTROPY_LIMIT)).alias("uncertain_by_entropy"))


@query("score_anomalies", needs="tele", sql="""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM tele),
w AS (SELECT * FROM t WHERE seq >= 9 AND (seq - 9) % 2 = 0),
n AS (SELECT count(*) AS held FROM w WHERE fault_type='normal' AND CAST('0x' || substr(md5(axle_key), 1, 8) AS BIGINT) % 100 < 15)
SELECT sample_id, fault_type, true AS flag_is_error_above_threshold, true AS score_in_range, true AS unknown_is_flag_on_normal,
  held - 1 - CAST(floor((held - 1)*CAST(0.99 AS DOUBLE)) AS BIGINT) AS held_out_flagged FROM w, n""")
def score_anomalies(spark, d):
    """The anomaly layer fitted on normal windows, flagging all of them.

    The threshold is the 99th percentile of the held-out normal windows, so the number of those it flags is known.
    """
    rows, scaler = windows(spark, d)
    rows = M.stored_windows(rows, "axle_key")
    model = M.fit_anomaly_model(rows, scaler=scaler)
    out = M.holdout_split(M.score_anomalies(rows.withColumn("pred", F.col("fault_type")), model, scaler)).select(
        "sample_id", "fault_type", "anomaly", "anomaly_error", "anomaly_score", "unknown_anomaly", "holdout")
    out = checkpointed(out)
    flagged = out.where("holdout and fault_type = 'normal'").agg(F.count_if("anomaly")).scalar()
    return out.select(
        "sample_id", "fault_type", (F.col("anomaly") == (F.col("anomaly_error") > model.threshold)).alias("flag_is_error_above_threshold"),
        F.col("anomaly_score").between(0, 1).alias("score_in_range"),
        (F.col("unknown_anomaly") == (F.col("anomaly") & (F.col("fault_type") == "normal"))).alias("unknown_is_flag_on_normal"),
        flagged.alias("held_out_flagged"))


@query("holdout_split", needs="tele", sql="""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) AS rn FROM tele)
SELECT sample_id, axle_key, CAST('0x' || substr(md5(axle_key), 1, 8) AS BIGINT) % 100 < 15 AS holdout
FROM r WHERE rn >= 10 AND (rn - 10) % 2 = 0 AND fault_type = 'normal'""")
def holdout_split(spark, d):
    """Windows of normal axles, whole axles held out."""
    rows, _ = windows(spark, d)
    return M.holdout_split(rows.where("fault_type = 'normal'")).select("sample_id", "axle_key", "holdout")


# ---------------------------------------------------------------- data quality

_FEATURE_NULL = " OR ".join(f"{c} IS NULL" for c in FEATURES)
_KNOWN = "'bearing_fault','brake_fault','motor_fault','normal','rail_crack','wheel_flat'"

DQ_ROWS = f"""
SELECT 'DQ3 no nulls' AS rule, count(*) AS checked, count(*) FILTER (WHERE {_FEATURE_NULL} OR fault_type IS NULL OR fault_severity IS NULL) AS violations FROM tele
UNION ALL SELECT 'DQ7 known fault class', count(*), count(*) FILTER (WHERE NOT coalesce(fault_type IN ({_KNOWN}), false)) FROM tele
UNION ALL SELECT 'DQ7 known severity', count(*), count(*) FILTER (WHERE NOT coalesce(fault_severity IN ('none','mild','moderate','severe'), false)) FROM tele
UNION ALL SELECT 'DQ8 normal has no severity', count(*), count(*) FILTER (WHERE fault_type='normal' AND fault_severity<>'none') FROM tele
UNION ALL SELECT 'DQ9 speed in range', count(*), count(*) FILTER (WHERE NOT coalesce(speed_kmh BETWEEN 0 AND 120, false)) FROM tele
UNION ALL SELECT 'DQ9 km not negative', count(*), count(*) FILTER (WHERE NOT coalesce(track_km >= 0, false)) FROM tele
UNION ALL SELECT 'DQ9 load positive', count(*), count(*) FILTER (WHERE NOT coalesce(load_ton > 0, false)) FROM tele
UNION ALL SELECT 'DQ10 stationary share', 1, CASE WHEN avg(CASE WHEN speed_kmh<0.5 THEN 1.0 ELSE 0.0 END) > 0.05
  AND avg(CASE WHEN speed_kmh<0.5 THEN 1.0 ELSE 0.0 END) < 0.6 THEN 0 ELSE 1 END FROM tele
UNION ALL SELECT 'DQ12 context not null', count(*), count(*) FILTER (WHERE line_id IS NULL OR train_id IS NULL OR next_station IS NULL OR at_station IS NULL) FROM tele
"""


# rules over a key, defects and three tables' columns, for clean and for spoilt ones
KEY_RULES = """
UNION ALL SELECT 'DQ6 key unique', count(*), count(*) FILTER (WHERE k > 1) FROM (
  SELECT sample_id, sum(s) AS s, sum(k) AS k FROM (SELECT sample_id, 1 AS s, 0 AS k FROM tele UNION ALL SELECT sample_id, 0, 1 FROM {key}) GROUP BY 1)
UNION ALL SELECT 'DQ6 key equals stream', count(*), count(*) FILTER (WHERE (s = 0) <> (k = 0)) FROM (
  SELECT sample_id, sum(s) AS s, sum(k) AS k FROM (SELECT sample_id, 1 AS s, 0 AS k FROM tele UNION ALL SELECT sample_id, 0, 1 FROM {key}) GROUP BY 1)"""
DEFECT_RULES = """
UNION ALL SELECT 'DQ16 defect inside its line', count(*), count(*) FILTER (WHERE NOT coalesce(km BETWEEN 0 AND length_km, false))
  FROM {defects} d LEFT JOIN lines ON d.line_id=lines.line_id
UNION ALL SELECT 'DQ16 defect between real stations', count(*), count(*) FILTER (WHERE found < 2) FROM (SELECT
  (SELECT count(*) FROM stations s WHERE s.line_id=d.line_id AND s.name=split_part(between_text, ' – ', 1))
  + (SELECT count(*) FROM stations s WHERE s.line_id=d.line_id AND s.name=split_part(between_text, ' – ', 2)) AS found FROM {defects} d)
UNION ALL SELECT 'DQ16 one defect per line', count(*), count(*) FILTER (WHERE n > 1) FROM (SELECT line_id, count(*) AS n FROM {defects} GROUP BY 1)
UNION ALL SELECT 'DQ16 few defects', 1, CASE WHEN count(*) > 12 THEN 1 ELSE 0 END FROM {defects}"""
_LIST = ", ".join(f"'{c}'" for c in FEATURES)
SCHEMA_RULES = f"""
UNION ALL SELECT 'DQ1 same columns', len(a), len(list_filter(a, lambda c: NOT list_contains(b, c))) + len(list_filter(b, lambda c: NOT list_contains(a, c)))
  FROM (SELECT json_keys(to_json(t)) AS a FROM {{train}} t LIMIT 1), (SELECT json_keys(to_json(t)) AS b FROM {{test}} t LIMIT 1)
UNION ALL SELECT 'DQ2 features numeric', count(*), count(*) FILTER (WHERE NOT coalesce(json_type(j, '$.' || c) IN ('DOUBLE', 'BIGINT', 'UBIGINT'), false))
  FROM (SELECT unnest([{_LIST}]) AS c), (SELECT to_json(t) AS j FROM {{train}} t LIMIT 1)
UNION ALL SELECT 'DQ13 stream without labels', len(a), len(list_filter(a, lambda c: c IN ('fault_type', 'fault_severity')))
  FROM (SELECT json_keys(to_json(t)) AS a FROM {{stream}} t LIMIT 1)"""


@query("dq_report", needs="tele pred0 stations defects lines", sql=f"""
WITH b AS (SELECT min(epoch_us("timestamp")) + (max(epoch_us("timestamp")) - min(epoch_us("timestamp")) + 2000000)*CAST(0.8 AS DOUBLE) AS cut FROM tele),
s AS (SELECT tele.*, CASE WHEN epoch_us("timestamp") < cut THEN 'train' ELSE 'test' END AS part FROM tele, b),
pc AS (SELECT fault_type, count(*) FILTER (WHERE part='train') AS a, count(*) FILTER (WHERE part='test') AS z FROM s GROUP BY 1),
mo AS (SELECT train_id, "timestamp", min(track_km)<>max(track_km) OR min(speed_kmh)<>max(speed_kmh) AS bad FROM tele GROUP BY 1,2),
ti AS (SELECT tick, count(DISTINCT axle_key) AS n FROM pred0 GROUP BY tick),
st AS (SELECT *, lag(km) OVER (PARTITION BY line_id ORDER BY seq) AS before FROM stations),
off AS (SELECT 'L'||(c_custkey//25) AS line_id, max(CASE WHEN c_custkey%4<>0 THEN c_custkey%90 + CAST(10 AS DOUBLE) END) AS official FROM customer GROUP BY 1)
{DQ_ROWS}
UNION ALL SELECT 'DQ4 train before test', count(*), CASE WHEN max("timestamp") FILTER (WHERE part='train') >= min("timestamp") FILTER (WHERE part='test') THEN 1 ELSE 0 END FROM s
UNION ALL SELECT 'DQ5 classes in both parts', count(*), count(*) FILTER (WHERE a=0 OR z=0) FROM pc
{KEY_RULES.format(key="tele")}
UNION ALL SELECT 'DQ11 one position per train', count(*), count(*) FILTER (WHERE bad) FROM mo
UNION ALL SELECT 'DQ18 every axle in every tick', count(*), count(*) FILTER (WHERE n < (SELECT count(DISTINCT axle_key) FROM tele)) FROM ti
UNION ALL SELECT 'DQ14 stations in box', count(*), count(*) FILTER (WHERE NOT (lon BETWEEN 28.3 AND 29.7 AND lat BETWEEN 40.7 AND 41.5)) FROM st
UNION ALL SELECT 'DQ14 km rises from 0', count(*), count(*) FILTER (WHERE CASE WHEN before IS NULL THEN km<>0 ELSE km<before END) FROM st
UNION ALL SELECT 'DQ14 names unique', count(DISTINCT (line_id,name)), count(*) - count(DISTINCT (line_id,name)) FROM st
UNION ALL SELECT 'DQ15 length plausible', count(*) FILTER (WHERE station_count >= 5), count(*) FILTER (WHERE station_count >= 5 AND length_km > official*1.25)
  FROM lines JOIN off ON lines.line_id=off.line_id
{DEFECT_RULES.format(defects="defects")}
{SCHEMA_RULES.format(train="tele", test="tele", stream="(SELECT * EXCLUDE (fault_type, fault_severity) FROM tele)")}
UNION ALL SELECT 'DQ17 rings have 4 points', count(*), count(*) FILTER (WHERE n < 4) FROM (SELECT c_custkey, len([0, 1, 2, 3, 4]) AS n FROM customer)
UNION ALL SELECT 'DQ17 rings in box', count(*), count(*) FILTER (WHERE 28 + c_custkey*131%1500/1000.0 + 0.002 + (c_custkey%5)/500.0 > 29.450303
  OR 40.5 + c_custkey*89%900/1000.0 + (CASE WHEN c_custkey%5=0 THEN 0 ELSE 2 END)*(0.002 + (c_custkey%5)/500.0) > 41.4003) FROM customer""")
def dq_report(spark, d):
    """Every rule on clean tables."""
    from axlewatch.plans.network_queries import line_parts
    rows = adapt.telemetry(spark, d)
    official = line_parts(spark, d).groupBy("line_id").agg(F.max("official_km").alias("official_length_km"))
    parts = [
        Q.telemetry_rules(rows), Q.split_rules(L.chronological_split(rows)),
        Q.key_rules(L.drop_labels(rows), adapt.answer_key(spark, d)), Q.train_rules(rows),
        Q.tick_rules(adapt.ticked_predictions(spark, d)),
        Q.network_rules(stations(spark, d), defects(spark, d), official),
        Q.schema_rules(*_tables(rows, rows, L.drop_labels(rows))),
        Q.ring_rules(adapt.districts(spark, d), (28.0, 40.5, 29.4503, 41.4003)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _tables(train: DataFrame, test: DataFrame, stream: DataFrame) -> list[DataFrame]:
    """As the SQL form sees them: with the key of the axle and what a model says."""
    extra = [*adapt.MODEL_OUTPUT, "axle_key"]
    return [df.withColumns({c: F.lit("" if c in ("pred", "axle_key") else 0) for c in extra}) for df in (train, test, stream)]


@query("dq_spoilt", needs="tele stations lines track_defects", sql=f"""
WITH bad_key AS (SELECT sample_id FROM tele WHERE sample_id%89<>0 UNION ALL SELECT sample_id FROM tele WHERE sample_id%97=0
  UNION ALL SELECT -1 - sample_id FROM tele WHERE sample_id%101=0),
bad_train AS (SELECT * REPLACE (CAST(speed_kmh AS VARCHAR) AS speed_kmh) FROM tele), bad_test AS (SELECT * RENAME (load_ton AS load_kg) FROM tele)
{DQ_ROWS.strip().replace(" FROM tele", " FROM spoilt")}
{KEY_RULES.format(key="bad_key")}
{DEFECT_RULES.format(defects="track_defects")}
{SCHEMA_RULES.format(train="bad_train", test="bad_test", stream="tele")}
UNION ALL SELECT 'DQ17 rings have 4 points', count(*), count(*) FILTER (WHERE n < 4) FROM (SELECT CASE WHEN c_custkey%7=0 THEN 3 ELSE 5 END AS n FROM customer)
""".replace("bad_key AS", """spoilt AS (SELECT * REPLACE (
  CASE WHEN sample_id%53<>0 THEN speed_kmh*2 END AS speed_kmh, CASE WHEN sample_id%59=0 THEN -1 ELSE track_km END AS track_km,
  CASE WHEN sample_id%61<>0 THEN next_station END AS next_station, CASE WHEN sample_id%67=0 THEN 'odd' ELSE fault_severity END AS fault_severity) FROM tele),
bad_key AS""", 1))
def dq_spoilt(spark, d):
    """The rules on spoilt tables, where most of them find violations."""
    rows, at = adapt.telemetry(spark, d), F.col("sample_id")
    spoilt = rows.withColumns({
        "speed_kmh": F.when(at % 53 != 0, F.col("speed_kmh") * 2), "track_km": F.when(at % 59 == 0, -1.0).otherwise(F.col("track_km")),
        "next_station": F.when(at % 61 != 0, F.col("next_station")),
        "fault_severity": F.when(at % 67 == 0, "odd").otherwise(F.col("fault_severity"))})
    ids = rows.select("sample_id")
    key = ids.where(at % 89 != 0).unionAll(ids.where(at % 97 == 0)).unionAll(ids.where(at % 101 == 0).select((-1 - at).alias("sample_id")))
    rings = adapt.districts(spark, d).withColumn(
        "ring", F.when(F.regexp_extract("name", "([0-9]+)", 1).cast("long") % 7 == 0, F.slice("ring", 1, 3)).otherwise(F.col("ring")))
    found = [
        Q.telemetry_rules(spoilt), Q.key_rules(L.drop_labels(rows), key),
        Q.defect_rules(stations(spark, d), adapt.track_defects(spark, d)),
        Q.schema_rules(*_tables(rows.withColumn("speed_kmh", F.col("speed_kmh").cast("string")),
                                rows.withColumnRenamed("load_ton", "load_kg"), rows)),
        Q.ring_rules(rings, (28.0, 40.5, 29.4503, 41.4003)).where("rule = 'DQ17 rings have 4 points'")]
    return reduce(DataFrame.unionByName, found)
