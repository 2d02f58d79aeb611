"""The adapted tables and the alarm state machine in SQL, shared by the SQL forms of the queries."""

from __future__ import annotations

HYSTERESIS = 3


def bucket(x: str) -> str:
    return (f"CASE WHEN {x} < 0.15 THEN 'none' WHEN {x} < 0.45 THEN 'mild' "
            f"WHEN {x} < 0.8 THEN 'moderate' ELSE 'severe' END")


def severity_rank(x: str) -> str:
    return f"CASE {x} WHEN 'mild' THEN 1.0 WHEN 'moderate' THEN 2.0 WHEN 'severe' THEN 3.0 ELSE 0.0 END"


def priority(sev: str, seconds: str, conf: str) -> str:
    return (f"round(CAST(0.5 AS DOUBLE)*(CAST({severity_rank(sev)} AS DOUBLE)/3.0)"
            f" + CAST(0.3 AS DOUBLE)*least(({seconds})/CAST(120.0 AS DOUBLE), 1.0)"
            f" + CAST(0.2 AS DOUBLE)*{conf}, 4)")


def level(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} >= 0.7 THEN 'kritik' WHEN {x} >= 0.5 THEN 'yuksek' "
            f"WHEN {x} >= 0.3 THEN 'orta' ELSE 'dusuk' END")


def haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (f"2*6371.0088*asin(sqrt(power(sin((radians({lat2})-radians({lat1}))/2),2)"
            f" + cos(radians({lat1}))*cos(radians({lat2}))*power(sin(radians({lon2}-{lon1})/2),2)))")


def _p(cls: str) -> str:
    return f"CASE WHEN pred='{cls}' THEN conf ELSE (1-conf)/2 END"


def _nats(p: str) -> str:
    return f"least(greatest({p},1e-12),1.0)*ln(least(greatest({p},1e-12),1.0))"


D = "CAST({} AS DOUBLE)".format

# name -> (tables it reads, SQL)
TABLES: dict[str, tuple[list[str], str]] = {
    "raw": ([], """
SELECT event_id AS sample_id, ts AS "timestamp", user_id AS u, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CASE WHEN event_type='purchase' THEN 1 ELSE 0 END AS e1,
  CASE WHEN event_type='error' THEN 1 ELSE 0 END AS e2,
  CASE event_type WHEN 'purchase' THEN 'bearing_fault' WHEN 'error' THEN 'rail_crack' ELSE 'normal' END AS pred
FROM events"""),
    "tele": (["raw"], f"""
SELECT sample_id, "timestamp", 'L'||(u//32) AS line_id, 'T'||(u//4) AS train_id,
  'V'||((u%4)//2+1) AS wagon_id, 'A'||(u%2+1) AS axle_id,
  'T'||(u//4)||'/V'||((u%4)//2+1)||'-A'||(u%2+1) AS axle_key,
  value - floor(value/100)*100 AS track_km, greatest(k-20,0)*{D(1.5)} AS speed_kmh,
  k%20 + {D(20)} AS load_ton,
  CASE WHEN k%17<>0 THEN {D(40.8)} + k/{D(1000)} END AS lat,
  CASE WHEN k%17<>0 THEN {D(28.5)} + k/{D(1000)} END AS lon,
  'S'||(k%20) AS next_station, greatest(k-20,0)*{D(1.5)} < 0.5 AS at_station,
  {D(0.02)} + greatest(k-20,0)*{D(1.5)}/2000 AS vib_x_rms_g, {D(0.02)} + k/{D(1000)} AS vib_y_rms_g,
  {D(0.03)} + value/10000 AS vib_z_rms_g, {D(0.06)} + e2*{D(0.5)} + k/{D(1000)} AS vib_peak_g,
  {D(3)} + e1*4 + (k%10)/{D(10)} AS vib_kurtosis, {D(2.8)} + (k%7)/{D(10)} AS vib_crest_factor,
  {D(2)} + e1*900 + greatest(k-20,0)*{D(1.5)}/50 AS vib_dom_freq_hz,
  {D(0.008)} + e2*{D(0.1)} + k/{D(5000)} AS acoustic_rms, {D(500)} + e2*1000 + k AS acoustic_peak_freq_hz,
  {D(35)} + e1*20 + k/{D(10)} AS axle_box_temp_c, {D(40)} + k%30 AS brake_temp_c,
  {D(55)} + value/50 AS motor_temp_c, {D(24)} + (k%5)/{D(10)} AS ambient_temp_c,
  {D(40)} + {D(0.55)}*(greatest(k-20,0)*{D(1.5)}) + k%9 AS motor_current_a, {D(750)} - k%11 AS motor_voltage_v,
  {D(45)} + k%13 AS humidity_pct,
  CASE WHEN sample_id%10=0 THEN 'normal' WHEN sample_id%10=1 THEN 'rail_crack' ELSE pred END AS fault_type,
  CASE WHEN sample_id%8=0 THEN 'none' ELSE {bucket('least(value/150,1.0)')} END AS fault_severity,
  pred, {D(0.8)} + k/{D(500)} AS conf, value/150 AS level, abs(value-50)/100 AS anomaly_error
FROM raw"""),
    "pred0": (["tele"], f"""
SELECT *, {_p('bearing_fault')} AS p1, {_p('normal')} AS p2, {_p('rail_crack')} AS p3,
  {bucket('least(level,1.0)')} AS severity, anomaly_error > 0.9 AS anomaly,
  greatest(0.0, least(1.0, anomaly_error/(2*{D(0.9)}))) AS anomaly_score,
  anomaly_error > 0.9 AND pred='normal' AS unknown_anomaly,
  (epoch_us("timestamp") - min(epoch_us("timestamp")) OVER ()) // 3600000000 AS tick,
  min(epoch_us("timestamp")) OVER () AS start_us
FROM tele"""),
    "pred": (["pred0"], f"""
SELECT *, (0 - {_nats('p1')} - {_nats('p2')} - {_nats('p3')}) / ln({D(3)}) AS entropy,
  (0 - {_nats('p1')} - {_nats('p2')} - {_nats('p3')}) / ln({D(3)}) > 0.35 AS uncertain
FROM pred0"""),
    "h1": (["pred"], """
SELECT *, CASE WHEN NOT uncertain THEN pred END AS said,
  sum(CASE WHEN uncertain THEN 0 ELSE 1 END) OVER w AS cc,
  last_value(CASE WHEN NOT uncertain THEN pred END IGNORE NULLS) OVER
    (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp
FROM pred WINDOW w AS (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "h2": (["h1"], """
SELECT *, cc - coalesce(max(CASE WHEN said IS NOT NULL AND said IS DISTINCT FROM lp THEN cc-1 END) OVER
  (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cnt,
  coalesce(said, lp) AS candidate
FROM h1"""),
    "h3": (["h2"], f"""
SELECT *, cnt >= {HYSTERESIS} AS stable,
  last_value(CASE WHEN said IS NOT NULL AND cnt >= {HYSTERESIS} THEN said END IGNORE NULLS) OVER
    (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS settled
FROM h2"""),
    "h4": (["h3"], """
SELECT *, lag(settled) OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) AS prior_settled,
  settled IS DISTINCT FROM lag(settled) OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) AS changed
FROM h3"""),
    "h5": (["h4"], """
SELECT *, (epoch_us("timestamp") - coalesce(max(CASE WHEN changed THEN epoch_us("timestamp") END) OVER
    (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), start_us)
    + 50000) // 100000 / CAST(10 AS DOUBLE) AS dwell_s,
  (epoch_us("timestamp") - coalesce(max(CASE WHEN changed THEN epoch_us("timestamp") END) OVER
    (PARTITION BY axle_key ORDER BY "timestamp", sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_us)
    + 50000) // 100000 / CAST(10 AS DOUBLE) AS prior_duration_s
FROM h4"""),
    "states0": (["h5"], f"""
SELECT *, CASE WHEN settled <> 'normal' THEN {priority('severity', 'dwell_s', 'conf')} END AS priority FROM h5"""),
    "states": (["states0"], f"""
SELECT *, {level('priority')} AS priority_level FROM states0"""),
    "ev": (["states"], f"""
SELECT sample_id, "timestamp", tick, axle_key AS axle, line_id, train_id, prior_settled AS prior, settled AS new,
  round(conf,3) AS conf, severity, next_station AS station,
  CASE WHEN settled <> 'normal' THEN 'alarm' ELSE 'temizlendi' END AS kind, prior_duration_s,
  CASE WHEN settled <> 'normal' THEN {priority('severity', D(0), 'conf')} END AS priority, track_km
FROM states WHERE changed AND NOT (prior_settled IS NULL AND settled='normal')"""),
    "stations0": ([], f"""
SELECT 'L'||(s_suppkey//20) AS line_id, s_suppkey%20 AS seq, s_name AS name,
  {D(40.8)} + (s_suppkey*37%60)/{D(1000)} AS lat, {D(28.5)} + (s_suppkey*53%100)/{D(1000)} AS lon,
  'D'||s_nationkey AS directorate
FROM supplier"""),
    "legs0": (["stations0"], """
SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM stations0
WINDOW w AS (PARTITION BY line_id ORDER BY seq)"""),
    "stations": (["legs0"], f"""
SELECT line_id, seq, name, lat, lon, directorate,
  sum(coalesce({haversine('plon','plat','lon','lat')}, 0)) OVER (PARTITION BY line_id ORDER BY seq) AS km_exact,
  round(sum(coalesce({haversine('plon','plat','lon','lat')}, 0)) OVER (PARTITION BY line_id ORDER BY seq), 3) AS km
FROM legs0"""),
    "segs": (["stations"], """
SELECT line_id, seq, name AS a_name, lat AS a_lat, lon AS a_lon, km AS a_km,
  lead(name) OVER w AS b_name, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon, lead(km) OVER w AS b_km
FROM stations WINDOW w AS (PARTITION BY line_id ORDER BY seq)"""),
    "lines": (["stations"], """
SELECT line_id, count(*) AS station_count, round(max_by(km_exact, seq), 2) AS length_km,
  min_by(name, seq) || ' – ' || max_by(name, seq) AS short_name,
  min_by(name, seq) AS first_name, max_by(name, seq) AS last_name,
  min_by(lat, seq) AS first_lat, max_by(lat, seq) AS last_lat,
  min_by(lon, seq) AS first_lon, max_by(lon, seq) AS last_lon, min_by(km, seq) AS first_km
FROM stations GROUP BY line_id"""),
    "defects0": (["lines"], f"""
SELECT *, round(length_km*{D(0.42)}, 3) AS km FROM lines WHERE length_km >= 10"""),
    "defects1": (["defects0", "segs"], """
SELECT d.*, (SELECT min(s.seq) FROM segs s WHERE s.line_id=d.line_id AND s.a_km <= d.km AND d.km <= s.b_km) AS sseq
FROM defects0 d"""),
    "defects": (["defects1", "segs"], f"""
SELECT d.line_id, d.km, d.line_id||'@'||printf('%.2f', d.km) AS defect_id, {D(2.5)} AS width_km,
  CASE WHEN d.line_id IN ('M4','M1A') THEN 'severe' ELSE 'moderate' END AS kind,
  coalesce(s.a_name, d.first_name)||' – '||coalesce(s.b_name, d.last_name) AS between_text,
  round(CASE WHEN d.km <= d.first_km THEN d.first_lat WHEN s.seq IS NULL THEN d.last_lat
    WHEN s.b_km > s.a_km THEN s.a_lat + (s.b_lat-s.a_lat)*((d.km-s.a_km)/(s.b_km-s.a_km)) ELSE s.a_lat END, 6) AS lat,
  round(CASE WHEN d.km <= d.first_km THEN d.first_lon WHEN s.seq IS NULL THEN d.last_lon
    WHEN s.b_km > s.a_km THEN s.a_lon + (s.b_lon-s.a_lon)*((d.km-s.a_km)/(s.b_km-s.a_km)) ELSE s.a_lon END, 6) AS lon
FROM defects1 d LEFT JOIN segs s ON s.line_id=d.line_id AND s.seq=d.sseq"""),
    "track_defects": ([], f"""
SELECT 'L'||(p_partkey%5) AS line_id, 'P'||p_partkey AS defect_id, (p_partkey*37%400)/{D(4)} AS km,
  power({D(2)}, p_partkey*13%15)/1024 AS width_km, CASE WHEN p_partkey%3=0 THEN 'severe' ELSE 'mild' END AS kind,
  p_name AS between_text, p_partkey*7919%100003 AS ord
FROM part"""),
    "linked": (["ev", "defects"], """
SELECT e.*, d.defect_id, d.between_text AS defect_between
FROM ev e LEFT JOIN defects d ON e.line_id=d.line_id AND e.new='rail_crack'
  AND abs(d.km - e.track_km) <= d.width_km + 0.8"""),
    "alarms": (["linked"], """
SELECT sample_id AS id, CAST(substr(line_id, 2) AS BIGINT) AS run_id, "timestamp" AS recorded_at, tick, axle,
  line_id, prior, new, severity, conf, station, kind, prior_duration_s, priority, defect_id
FROM linked"""),
    "runs": (["tele"], """
SELECT CAST(substr(line_id, 2) AS BIGINT) AS id, min("timestamp") AS started,
  count(DISTINCT axle_key) AS axle_count FROM tele GROUP BY line_id"""),
    "scored": (["pred"], """
SELECT p.* EXCLUDE (pred), CASE WHEN sample_id % 50 = 7 THEN 'unknown' ELSE pred END AS pred,
  CASE WHEN sample_id % 60 = 11 THEN 'unknown' ELSE fault_type END AS actual, fault_severity AS actual_severity,
  sample_id % 50 <> 7 AND sample_id % 60 <> 11 AND fault_type = p.pred AS correct,
  fault_severity = severity AS severity_correct FROM pred p"""),
    "answered": (["pred"], """
SELECT *, fault_type AS actual, fault_severity AS actual_severity, fault_severity = severity AS severity_correct
FROM pred"""),
    "rings": ([], f"""
SELECT c_name AS name, {D(28)} + (c_custkey*131%1500)/{D(1000)} AS x, {D(40.5)} + (c_custkey*89%900)/{D(1000)} AS y,
  {D(0.002)} + (c_custkey%5)/{D(500)} AS s, CASE WHEN c_custkey%5=0 THEN 0 ELSE 2 END AS h2,
  CASE WHEN c_custkey%5=0 THEN 0 ELSE 1 END AS h1
FROM customer"""),
}


def closure(names: list[str]) -> list[str]:
    """`names` and everything they read, in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in out:
            for other in TABLES[name][0]:
                visit(other)
            out.append(name)
    for n in names:
        visit(n)
    return out
