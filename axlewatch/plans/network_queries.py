"""Network, linear-referencing, interval-join and geography queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators import joins as J
from axlewatch.operators import network as N
from axlewatch.operators.segments import with_ordinal
from axlewatch.plans import adapt
from axlewatch.plans.alarm_queries import defects, stations
from axlewatch.plans.common_sql import bucket, haversine
from axlewatch.plans.registry import query
from axlewatch.session import shared_folder, stored
from axlewatch.sources import files, geojson


@query("cumulative_km", needs="stations", sql="SELECT line_id, seq, name, km FROM stations")
def cumulative_km(spark, d):
    return N.cumulative_km(adapt.station_points(spark, d)).select("line_id", "seq", "name", "km")


@query("segments", needs="segs", sql="""
SELECT line_id, seq, a_name, b_name, a_km, b_km FROM segs WHERE b_name IS NOT NULL""")
def segments(spark, d):
    return N.segments(stations(spark, d)).select(
        "line_id", "seq", F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"),
        F.col("a.km").alias("a_km"), F.col("b.km").alias("b_km"))


@query("haversine_km", needs="segs", sql=f"""
SELECT line_id, seq, a_name AS name, b_name AS next_name, round({haversine('a_lon','a_lat','b_lon','b_lat')}, 9) AS leg_km
FROM segs WHERE b_name IS NOT NULL""")
def haversine_km(spark, d):
    return N.neighbour_distances(stations(spark, d)).withColumn("leg_km", F.round("leg_km", 9))


@query("first_per_name", sql="""
WITH p AS (SELECT 'L'||(p_partkey//200) AS line_id, p_partkey%200 AS seq, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS name FROM part)
SELECT line_id, name, min(seq) AS seq FROM p WHERE name <> '' GROUP BY line_id, name""")
def first_per_name(spark, d):
    key = F.col("p_partkey")
    rows = adapt.table(spark, d, "part").select(
        F.concat(F.lit("L"), F.floor(key / 200).cast("string")).alias("line_id"), (key % 200).alias("seq"),
        F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_name")).alias("name"))
    return N.first_per_name(rows).select("line_id", "name", "seq")


@query("line_totals", needs="lines", sql="SELECT line_id, station_count, length_km, short_name FROM lines")
def line_totals(spark, d):
    return N.line_totals(stations(spark, d))


@query("lines_sorted", needs="lines", sql="""
SELECT line_id, station_count, length_km, row_number() OVER (ORDER BY length(line_id), line_id) AS place FROM lines""")
def lines_sorted(spark, d):
    from axlewatch.operators.segments import global_rank
    rows = N.line_totals(stations(spark, d)).select("line_id", "station_count", "length_km",
                                                    F.length("line_id").alias("_len"))
    out = global_rank(rows, ["_len", "line_id"], "place")
    return N.lines_sorted(out.withColumn("place", F.col("place") + 1).drop("_len"))


@query("defect_placement", needs="defects", sql="SELECT * FROM defects")
def defect_placement(spark, d):
    return defects(spark, d).drop("ord")


@query("scan_defects", needs="defects", sql="SELECT defect_id, line_id, km, width_km FROM defects")
def scan_defects(spark, d):
    """The list stored as a JSON array (it is short: a defect per line), read back by the reader."""
    path = f"{shared_folder(spark)}/defects-{uuid.uuid4().hex}"
    item = F.struct(F.col("line_id").alias("hat"), "km", F.col("defect_id").alias("kusur_id"), F.col("width_km").alias("genislik_km"),
                    F.col("kind").alias("siddet"), F.col("between_text").alias("arasi"), "lat", "lon")
    defects(spark, d).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("value")).coalesce(1).write.text(path)
    return files.scan_defects(spark, path).select("defect_id", "line_id", "km", "width_km")


@query("locate_on_line", needs="tele segs lines", sql="""
WITH hit AS (SELECT t.sample_id, min(s.seq) AS seq FROM tele t JOIN segs s ON s.line_id=t.line_id
  AND s.a_km <= t.track_km AND t.track_km <= s.b_km GROUP BY t.sample_id)
SELECT t.sample_id, t.line_id, t.track_km, coalesce(s.a_name, l.first_name) AS station_a,
  coalesce(s.b_name, l.last_name) AS station_b,
  CASE WHEN t.track_km <= l.first_km THEN l.first_lat WHEN s.seq IS NULL THEN l.last_lat
    WHEN s.b_km > s.a_km THEN s.a_lat + (s.b_lat-s.a_lat)*((t.track_km-s.a_km)/(s.b_km-s.a_km)) ELSE s.a_lat END AS located_lat,
  CASE WHEN t.track_km <= l.first_km THEN l.first_lon WHEN s.seq IS NULL THEN l.last_lon
    WHEN s.b_km > s.a_km THEN s.a_lon + (s.b_lon-s.a_lon)*((t.track_km-s.a_km)/(s.b_km-s.a_km)) ELSE s.a_lon END AS located_lon
FROM tele t LEFT JOIN hit h ON h.sample_id=t.sample_id LEFT JOIN segs s ON s.line_id=t.line_id AND s.seq=h.seq
LEFT JOIN lines l ON l.line_id=t.line_id""")
def locate_on_line(spark, d):
    rows = adapt.telemetry(spark, d).select("sample_id", "line_id", "track_km")
    return N.locate_on_line(rows, stations(spark, d))


@query("defect_zone_join", needs="tele defects", sql="""
WITH z AS (SELECT t.sample_id, t.fault_type, t.speed_kmh, d.defect_id, d.kind FROM tele t LEFT JOIN defects d
  ON t.line_id=d.line_id AND abs(t.track_km-d.km) <= d.width_km AND t.speed_kmh > 5)
SELECT sample_id, defect_id AS zone_defect, CASE kind WHEN 'none' THEN 0.0 WHEN 'mild' THEN 0.3 WHEN 'moderate' THEN 0.6
    WHEN 'severe' THEN 1.0 END * least(speed_kmh/50, 1.0) AS zone_severity,
  CASE WHEN defect_id IS NOT NULL AND fault_type='normal' THEN 'rail_crack' ELSE fault_type END AS zone_label FROM z""")
def defect_zone_join(spark, d):
    rows = adapt.telemetry(spark, d).select("sample_id", "line_id", "track_km", "speed_kmh", "fault_type")
    return J.defect_zone_join(rows, defects(spark, d)).select(
        "sample_id", "zone_defect", "zone_severity", "zone_label")


@query("zone_of_many", needs="tele track_defects", sql="""
WITH hit AS (SELECT t.sample_id, min(d.ord) AS ord FROM tele t JOIN track_defects d ON t.line_id=d.line_id
  AND abs(t.track_km-d.km) <= d.width_km AND t.speed_kmh > 5 GROUP BY t.sample_id)
SELECT t.sample_id, d.defect_id AS zone_defect, CASE kind WHEN 'mild' THEN 0.3 WHEN 'severe' THEN 1.0 END * least(speed_kmh/50, 1.0) AS zone_severity,
  CASE WHEN d.defect_id IS NOT NULL AND fault_type='normal' THEN 'rail_crack' ELSE fault_type END AS zone_label
FROM tele t LEFT JOIN hit h ON h.sample_id=t.sample_id LEFT JOIN track_defects d ON d.line_id=t.line_id AND d.ord=h.ord""")
def zone_of_many(spark, d):
    """Overlapping zones: the first listed one counts."""
    rows = adapt.telemetry(spark, d).select("sample_id", "line_id", "track_km", "speed_kmh", "fault_type")
    return J.defect_zone_join(rows, adapt.track_defects(spark, d)).select(
        "sample_id", "zone_defect", "zone_severity", "zone_label")


def episodes(spark, d):
    """Fault episodes of axles: one per order."""
    user = F.floor(F.col("o_custkey") / 10)
    kind = F.when(F.col("o_orderstatus") == "P", "brake_fault").when(
        F.col("o_orderstatus") == "F", "motor_fault").otherwise("wheel_flat")
    return adapt.table(spark, d, "orders").select(
        F.concat(F.lit("T"), F.floor(user / 4).cast("string"), F.lit("/V"),
                 (F.floor(user % 4 / 2) + 1).cast("string"), F.lit("-A"),
                 (user % 2 + 1).cast("string")).alias("axle_key"),
        F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7 % 60).alias("start_step"),
        (5 + F.col("o_orderkey") % 10).alias("len_steps"), kind.alias("fault_type"))


def numbered(spark, d):
    """Places of the readings in their series, numbered once: the join reads them twice."""
    return stored(with_ordinal(adapt.telemetry_timeline(spark, d)).rows.select("sample_id", "axle_key", "seq"), "numbered")


@query("episode_label_join", needs="tele", sql=f"""
WITH p AS (SELECT sample_id, axle_key, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM tele),
ep AS (SELECT 'T'||(o_custkey//10//4)||'/V'||((o_custkey//10%4)//2+1)||'-A'||(o_custkey//10%2+1) AS axle_key, o_orderkey AS ord,
  o_orderkey*7%60 AS s, 5 + o_orderkey%10 AS n,
  CASE o_orderstatus WHEN 'P' THEN 'brake_fault' WHEN 'F' THEN 'motor_fault' ELSE 'wheel_flat' END AS kind FROM orders),
c AS (SELECT p.sample_id, p.axle_key, p.seq, min_by(ep.s, ord) AS s, min_by(ep.n, ord) AS n, min_by(ep.kind, ord) AS kind
  FROM p LEFT JOIN ep ON p.axle_key=ep.axle_key AND s <= seq AND seq < s+n GROUP BY ALL),
l AS (SELECT *, coalesce(CASE WHEN (seq-s)/CAST(n AS DOUBLE) < 0.5 THEN least(1.0, (seq-s)/CAST(n AS DOUBLE)*2)
  ELSE greatest(0.0, 1-((seq-s)/CAST(n AS DOUBLE)-0.5)*2) END, 0.0) AS lev FROM c)
SELECT sample_id, axle_key, lev AS episode_level, CASE WHEN lev > 0.1 THEN kind ELSE 'normal' END AS episode_label,
  {bucket('lev')} AS episode_severity FROM l""")
def episode_label_join(spark, d):
    return J.episode_label_join(numbered(spark, d), episodes(spark, d)).drop("seq")


@query("episodes_of_any_length", needs="tele", sql="""
WITH p AS (SELECT sample_id, axle_key, row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) - 1 AS seq FROM tele),
ep AS (SELECT 'T'||(o_custkey//10//4)||'/V'||((o_custkey//10%4)//2+1)||'-A'||(o_custkey//10%2+1) AS axle_key, o_orderkey*31%1000003 AS ord,
  o_orderkey*7%60 AS s, CAST(power(2, o_orderkey%21) AS BIGINT) AS n FROM orders)
SELECT p.sample_id, p.axle_key, min_by(ep.s, ord) AS start_step, min_by(ep.n, ord) AS len_steps
FROM p LEFT JOIN ep ON p.axle_key=ep.axle_key AND s <= seq AND seq < s+n GROUP BY ALL""")
def episodes_of_any_length(spark, d):
    """Overlapping episodes of one to a million steps; the first listed one covers a row."""
    long = episodes(spark, d).withColumns({
        "ord": F.col("ord") * 31 % 1_000_003, "len_steps": F.pow(F.lit(2.0), F.col("ord") % 21).cast("long")})
    return J.episode_label_join(numbered(spark, d), long, keep=True).select("sample_id", "axle_key", "start_step", "len_steps")


@query("axle_line_map", needs="tele", sql="""
SELECT axle_key, arg_min(line_id, sample_id) AS line_id FROM (SELECT * FROM tele QUALIFY
  row_number() OVER (PARTITION BY axle_key ORDER BY "timestamp", sample_id) = 1) GROUP BY axle_key""")
def axle_line_map(spark, d):
    return J.axle_line_map(adapt.predictions(spark, d))


# ---------------------------------------------------------------- selection and assembly

def raw_stations(spark, d):
    """Station points as the open data gives them: one per order, with stage, kind, directorate."""
    cust = F.col("o_custkey")
    return adapt.table(spark, d, "orders").select(
        F.concat(F.lit("L"), F.floor(cust / 50).cast("string")).alias("line_id"),
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("Station "), (cust % 50).cast("string")).alias("name"),
        F.when(F.col("o_orderstatus") == "O", "Mevcut Hat").when(
            F.col("o_orderstatus") == "F", "İnşaat Aşamasında").alias("stage"),
        F.when((F.floor(cust / 50) + F.col("o_orderkey") % 3) % 5 == 0, "Teleferik").otherwise("Metro").alias("kind"),
        F.substring("o_orderpriority", 1, 1).alias("directorate"))


RAW_STATIONS = """
WITH rs AS (SELECT 'L'||(o_custkey//50) AS line_id, o_orderkey AS seq, 'Station '||(o_custkey%50) AS name,
  CASE o_orderstatus WHEN 'O' THEN 'Mevcut Hat' WHEN 'F' THEN 'İnşaat Aşamasında' END AS stage,
  CASE WHEN (o_custkey//50 + o_orderkey%3)%5=0 THEN 'Teleferik' ELSE 'Metro' END AS kind, substr(o_orderpriority,1,1) AS directorate FROM orders),
cn AS (SELECT line_id, directorate, count(*) AS n FROM rs GROUP BY ALL),
dom AS (SELECT line_id, directorate AS dominant, n FROM cn QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY n DESC, directorate) = 1)
"""


@query("in_service_filter", sql=RAW_STATIONS + """
SELECT seq, line_id, stage FROM rs WHERE contains(stage, 'Mevcut') OR line_id IN ('L1')""")
def in_service_filter(spark, d):
    return N.in_service(raw_stations(spark, d), ["L1"]).select("seq", "line_id", "stage")


@query("dominant_value", sql=RAW_STATIONS + "SELECT line_id, dominant, n FROM dom")
def dominant_value(spark, d):
    return N.dominant_value(raw_stations(spark, d), "line_id", "directorate")


@query("exclude_operator", sql=RAW_STATIONS + """
SELECT rs.seq, rs.line_id, rs.directorate FROM rs WHERE line_id NOT IN (SELECT line_id FROM dom WHERE dominant = '1')""")
def exclude_operator(spark, d):
    return N.exclude_operator(raw_stations(spark, d), ["1"]).select("seq", "line_id", "directorate")


@query("exclude_type", sql=RAW_STATIONS + """
SELECT seq, line_id, kind FROM rs WHERE line_id NOT IN (SELECT line_id FROM rs GROUP BY line_id HAVING min_by(kind, seq) = 'Teleferik')""")
def exclude_type(spark, d):
    return N.exclude_type(raw_stations(spark, d)).select("seq", "line_id", "kind")


def line_parts(spark, d):
    """Geometry parts of lines: three points per part order; some lines have no stations."""
    c = F.col("c_custkey")
    return adapt.table(spark, d, "customer").select(
        F.concat(F.lit("L"), F.floor(c / 25).cast("string")).alias("line_id"), c.alias("part_no"),
        F.array(*[F.array(28.5 + (c + i) % 50 / 100.0, 40.8 + (c + i) % 30 / 100.0) for i in range(3)]).alias("points"),
        F.when(c % 4 != 0, c % 90 + 10.0).alias("official_km"))


@query("line_assembly", needs="lines", sql="""
WITH g AS (SELECT 'L'||(c_custkey//25) AS line_id, count(*) AS parts, CAST(sum(3) AS BIGINT) AS vertices,
  max(CASE WHEN c_custkey%4<>0 THEN c_custkey%90 + CAST(10 AS DOUBLE) END) AS official_length_km FROM customer GROUP BY 1)
SELECT l.line_id, l.station_count, l.length_km, l.short_name, 'Line '||l.line_id AS name,
  CASE WHEN CAST(substr(l.line_id,2) AS BIGINT)%3=0 THEN 'Tramvay' ELSE 'Metro' END AS kind,
  '#8798b3' AS colour, g.parts, g.vertices, g.official_length_km
FROM lines l LEFT JOIN g ON g.line_id=l.line_id WHERE l.station_count >= 2""")
def line_assembly(spark, d):
    known = stations(spark, d).withColumn("project", F.concat(F.lit("Line "), "line_id")).withColumn(
        "kind", F.when(F.substring("line_id", 2, 10).cast("long") % 3 == 0, "Tramvay").otherwise("Metro"))
    return N.line_assembly(known, line_parts(spark, d)).drop("drawing")


# ---------------------------------------------------------------- geography

RINGS = """
WITH ring AS (SELECT name, i, CASE i WHEN 1 THEN x WHEN 2 THEN x+1*s WHEN 3 THEN x+1*s ELSE x END AS px,
  CASE i WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN y+h2*s WHEN 4 THEN y+h1*s ELSE y END AS py
  FROM rings, (SELECT unnest([1,2,3,4,5]) AS i)),
box AS (SELECT name, min(px) AS min_lon, min(py) AS min_lat, max(px) AS max_lon, max(py) AS max_lat FROM ring GROUP BY name)
"""


@query("network_extent", needs="stations0", sql="""
SELECT min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM stations0""")
def network_extent(spark, d):
    return N.network_extent(adapt.station_points(spark, d))


@query("ring_bbox", needs="rings", sql=RINGS + "SELECT * FROM box")
def ring_bbox(spark, d):
    rows = adapt.districts(spark, d)
    return rows.select("name", X.ring_bbox(F.col("ring")).alias("box")).select("name", "box.*")


@query("bbox_intersects", needs="rings stations0", sql=RINGS + """
, e AS (SELECT min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM stations0)
SELECT name FROM box, e WHERE max_lon >= a - CAST(0.09 AS DOUBLE) AND min_lon <= c + CAST(0.09 AS DOUBLE)
  AND max_lat >= b - CAST(0.09 AS DOUBLE) AND min_lat <= d + CAST(0.09 AS DOUBLE)""")
def bbox_intersects(spark, d):
    extent = N.network_extent(adapt.station_points(spark, d))
    return N.bbox_intersects(adapt.districts(spark, d), extent).select("name")


def district_features(spark, d):
    """GeoJSON features, one per customer: polygons, multi-polygons with an island, collections with a point."""
    key, lit = F.col("c_custkey"), lambda text: F.lit(text)
    at = lambda x, y: F.concat(lit("["), (28 + key * 131 % 1500 / 1000 + x).cast("string"), lit(","),
                               (40.5 + key * 89 % 900 / 1000 + y).cast("string"), lit("]"))
    square = lambda x: F.concat(lit("[["), F.concat_ws(",", at(x, 0), at(x + 0.5, 0), at(x + 0.5, 0.25), at(x, 0)), lit("]]"))
    polygon = lambda x: F.concat(lit('{"type":"Polygon","coordinates":'), square(x), lit("}"))
    geometry = F.when(key % 3 == 0, polygon(0)).when(key % 3 == 1, F.concat(
        lit('{"type":"MultiPolygon","coordinates":['), square(0), lit(","), square(2), lit("]}"))).otherwise(F.concat(
            lit('{"type":"GeometryCollection","geometries":['), polygon(0), lit(',{"type":"Point","coordinates":'), at(-1, 1), lit("}]}")))
    return adapt.table(spark, d, "customer").select(F.concat(
        lit('{"type":"Feature","properties":{"shapeName":"'), F.col("c_name"), lit('"},"geometry":'), geometry, lit("}")).alias("value"))


SHAPES = """
WITH p AS (SELECT c_name AS name, c_custkey%3 AS k, CAST(28 AS DOUBLE) + (c_custkey*131%1500)/CAST(1000 AS DOUBLE) AS x,
  CAST(40.5 AS DOUBLE) + (c_custkey*89%900)/CAST(1000 AS DOUBLE) AS y FROM customer),
shape AS (SELECT name, k, CASE k WHEN 2 THEN x-1 ELSE x END AS min_lon, y AS min_lat, CASE k WHEN 1 THEN x+2.5 ELSE x+0.5 END AS max_lon,
  CASE k WHEN 2 THEN y+1 ELSE y+0.25 END AS max_lat, CASE k WHEN 1 THEN 2 ELSE 1 END AS polygons FROM p)
"""


def shapes(spark, d):
    """The features written as newline-delimited files, and read back by the parallel reader."""
    path = f"{shared_folder(spark)}/districts-{uuid.uuid4().hex}"
    district_features(spark, d).write.text(path)
    return geojson.scan_shapes(spark, path)


@query("shape_bbox", sql=SHAPES + """
SELECT name, round(min_lon, 6) AS min_lon, round(min_lat, 6) AS min_lat, round(max_lon, 6) AS max_lon, round(max_lat, 6) AS max_lat,
  CAST(polygons AS INTEGER) AS polygons FROM shape""")
def shape_bbox(spark, d):
    """One box per feature, whatever its nesting."""
    return shapes(spark, d).select(
        "name", *[F.round(f"box.{c}", 6).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")],
        F.size("polygons").alias("polygons"))


@query("write_geography", needs="stations0", sql=SHAPES + """
, e AS (SELECT min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM stations0)
SELECT name, CAST(4*polygons AS INTEGER) AS vertices FROM shape, e WHERE max_lon >= a - CAST(0.09 AS DOUBLE) AND min_lon <= c + CAST(0.09 AS DOUBLE)
  AND max_lat >= b - CAST(0.09 AS DOUBLE) AND min_lat <= d + CAST(0.09 AS DOUBLE)""")
def write_geography(spark, d):
    """Features near the network, stored whole and read back: an island of a kept feature stays."""
    path = f"{shared_folder(spark)}/geography-{uuid.uuid4().hex}"
    extent = N.network_extent(adapt.station_points(spark, d))
    files.write_geography(N.bbox_intersects(shapes(spark, d), extent), path)
    return files.scan_geography(spark, path).select("name", "vertices")


@query("polygon_centroid", needs="rings", sql=RINGS + """
, e AS (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM ring WINDOW w AS (PARTITION BY name ORDER BY i)),
t AS (SELECT name, sum(px*qy-qx*py) AS c2, sum((px+qx)*(px*qy-qx*py)) AS cx, sum((py+qy)*(px*qy-qx*py)) AS cy,
  avg(px) AS mx, avg(py) AS my FROM e GROUP BY name)
SELECT name, round(CASE WHEN abs(c2) < 1e-12 THEN mx ELSE cx/(3*c2) END, 4) AS lon,
  round(CASE WHEN abs(c2) < 1e-12 THEN my ELSE cy/(3*c2) END, 4) AS lat FROM t""")
def polygon_centroid(spark, d):
    rows = adapt.districts(spark, d).select("name", X.ring_centroid(F.col("ring")).alias("c"))
    return rows.select("name", F.round("c.lon", 4).alias("lon"), F.round("c.lat", 4).alias("lat"))


@query("vertex_totals", needs="rings", sql="""
SELECT count(*) AS districts, CAST(5*count(*) AS BIGINT) AS vertices FROM rings""")
def vertex_totals(spark, d):
    return adapt.districts(spark, d).agg(
        F.count("*").alias("districts"), F.sum(F.size("ring")).alias("vertices"))


@query("name_override", sql="""
SELECT n_nationkey, c.c_custkey, CASE n_name WHEN 'NATION_3' THEN 'Adalar' ELSE n_name END AS shown
FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey""")
def name_override(spark, d):
    both = adapt.table(spark, d, "customer").join(
        adapt.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    renamed = N.literal_map({"NATION_3": "Adalar"}, F.col("n_name"))
    return both.select("n_nationkey", "c_custkey", F.coalesce(renamed, "n_name").alias("shown"))
