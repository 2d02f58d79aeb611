"""Files, messages, GeoJSON, splits and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from axlewatch import schemas
from axlewatch.operators import labels as L
from axlewatch.operators import network as N
from axlewatch.operators import quality as Q
from axlewatch.sources import files, geojson, kafka


def telemetry(spark, n=40):
    base = spark.range(n)
    known = {
        "timestamp": F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 4) * 2),
        "line_id": F.lit("M4"), "train_id": F.lit("M4-01"), "next_station": F.lit("Göztepe"),
        "wagon_id": F.concat(F.lit("V"), (F.floor(F.col("id") % 4 / 2) + 1).cast("string")),
        "axle_id": F.concat(F.lit("A"), (F.col("id") % 2 + 1).cast("string")),
        "at_station": F.lit(False), "lat": F.lit(None).cast("double"),
        "fault_type": F.when(F.col("id") % 5 == 0, "wheel_flat").otherwise("normal"),
        "fault_severity": F.when(F.col("id") % 5 == 0, "mild").otherwise("none")}
    return base.select(*[
        known.get(f.name, F.floor(F.col("id") / 4) + 1.0).cast(f.dataType).alias(f.name)
        for f in schemas.TELEMETRY.fields])


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_csv_round_trip(spark, tmp_path):
    df = telemetry(spark)
    files.write_split_tables(L.chronological_split(df), f"{tmp_path}/csv", "csv")
    back = files.scan_telemetry(spark, f"{tmp_path}/csv/part=*")
    assert rows_of(back) == rows_of(df)
    train = spark.read.option("header", True).csv(f"{tmp_path}/csv/part=train").count()
    assert train == 32


def test_stream_carries_no_labels(spark, tmp_path):
    df = L.assign_sample_id(telemetry(spark), ["timestamp", "train_id", "wagon_id", "axle_id"])
    files.write_stream_and_key(df, str(tmp_path))
    stream = files.scan_stream_table(spark, f"{tmp_path}/stream", "parquet")
    key = files.scan_answer_key(spark, f"{tmp_path}/key", "parquet")
    assert not set(schemas.LABELS) & set(spark.read.parquet(f"{tmp_path}/stream").columns)
    same = L.set_equality(stream, key, "sample_id").first()
    assert same["equal"] and stream.count() == 40
    assert [r["sample_id"] for r in key.orderBy("sample_id").collect()] == list(range(40))
    with pytest.raises(ValueError):
        L.require_unlabelled(df)


def test_last_duplicate_key_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "sample_id long, fault_type string, n int")
    assert {r["sample_id"]: r["fault_type"] for r in files.last_per_id(df, "n").collect()} == {1: "b", 2: "c"}


def test_messages_round_trip_and_bad_values(spark):
    stream = L.drop_labels(L.assign_sample_id(telemetry(spark), ["timestamp", "wagon_id", "axle_id"]))
    stream = stream.select(*schemas.STREAM.names)
    messages = kafka.encode_messages(stream)
    assert messages.columns == ["key", "value"]
    assert rows_of(kafka.decode_messages(messages)) == rows_of(stream)
    bad = messages.limit(1).withColumn("value", F.regexp_replace("value", '"load_ton":[0-9.]+', '"load_ton":"n/a"'))
    row = kafka.decode_messages(bad).first()
    assert row["load_ton"] is None and row["sample_id"] is not None
    with pytest.raises(ValueError):
        kafka.encode_messages(telemetry(spark))


def test_missing_defect_file_is_empty(spark, tmp_path):
    assert files.scan_defects(spark, f"{tmp_path}/none.json").count() == 0
    item = {"hat": "M4", "km": 9.4, "genislik_km": 0.12, "siddet": "severe", "arasi": "A – B", "lat": 41.0, "lon": 29.0}
    (tmp_path / "d.json").write_text(json.dumps([item, {**item, "kusur_id": "M4@9.40"}]))
    got = files.scan_defects(spark, f"{tmp_path}/d.json").orderBy("ord").collect()
    assert [r["defect_id"] for r in got] == ["M4@9.4", "M4@9.40"]


def point(name, lon, lat, project, stage="Mevcut", kind="Metro", office="Metro"):
    return {"type": "Feature", "properties": {
        "PROJE_ADI": project, "PROJE_ASAMA": stage, "ISTASYON": name, "HAT_TURU": kind, "MUDURLUK": office},
        "geometry": {"type": "Point", "coordinates": [lon, lat]}}


@pytest.fixture
def network(spark, tmp_path):
    m4, m11, tf = "M4 Kadıköy - SGH Metro Hattı", "M11 Havalimanı", "TF1 Maçka"
    stations = [
        point(" Kadıköy ", 29.02331234, 40.99, m4), point("Ayrılık Çeşmesi", 29.03, 41.0, m4),
        point("Kadıköy", 29.0, 41.0, m4), point("", 29.1, 41.0, m4), point("Göztepe", 29.06, 41.02, m4),
        point("Later", 29.2, 41.0, m4, stage="İnşaat"), point("SGH", 29.3, 40.95, m4, office="Ulaştırma Bakanlığı"),
        point("H1", 28.8, 41.2, m11, office="Ulaştırma Bakanlığı"), point("H2", 28.9, 41.2, m11, office="Ulaştırma Bakanlığı"),
        point("Maçka", 29.0, 41.04, tf, kind="Teleferik"), point("Taşkışla", 29.01, 41.04, tf, kind="Teleferik"),
        point("Rumelihisarüstü", 29.05, 41.08, "F4 Füniküler", stage="İnşaat"), point("Aşiyan", 29.06, 41.08, "F4 Füniküler", stage="İnşaat"),
        point("No code", 29.0, 41.0, "Merkez Hattı")]
    geo = lambda kind, xy: {"type": kind, "coordinates": xy}
    lines = [
        {"properties": {"PROJE_ASAMA": "Mevcut", "PROJE_AD_KISA": "M4", "UZUNLUK": 26.5},
         "geometry": geo("MultiLineString", [[[29.0, 41.0], [29.123456, 41.0]], [[29.2, 41.0]]])},
        {"properties": {"PROJE_ASAMA": "Mevcut", "PROJE_ADI": "M4 uzatma", "UZUNLUK": 7.0},
         "geometry": geo("LineString", [[29.2, 41.0], [29.3, 41.0], [29.4, 41.0]])},
        {"properties": {"PROJE_ASAMA": "Plan", "PROJE_AD_KISA": "M4"}, "geometry": geo("LineString", [[0, 0], [1, 1]])},
        {"properties": {"PROJE_ASAMA": "Mevcut", "PROJE_AD_KISA": "M99"}, "geometry": geo("LineString", [[0, 0], [1, 1]])}]
    square = lambda x, y: [[x, y], [x + .1, y], [x + .1, y + .1], [x, y + .1], [x, y]]
    districts = [
        {"properties": {"shapeName": "Prince Islands"}, "geometry": geo("Polygon", [square(29.0, 40.9), [[0, 0], [1, 1]]])},
        {"properties": {"shapeName": "Far"}, "geometry": geo("MultiPolygon", [[square(33, 39)], [square(34, 39)]])}]
    for name, features in (("stations", stations), ("lines", lines), ("districts", districts)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"features": features}, ensure_ascii=False))
    return tmp_path


def test_network_from_geojson(spark, network, tmp_path):
    stations = geojson.build_stations(geojson.scan_stations(spark, f"{network}/stations.json"))
    got = {(r["line_id"], r["seq"]): r for r in stations.collect()}
    assert [got[("M4", i)]["name"] for i in range(4)] == ["Kadıköy", "Ayrılık Çeşmesi", "Göztepe", "SGH"]
    assert {k[0] for k in got} == {"M4", "F4"}
    assert got[("M4", 0)]["km"] == 0 and got[("M4", 0)]["lon"] == 29.023312
    kms = [got[("M4", i)]["km"] for i in range(4)]
    assert kms == sorted(kms)
    lines = N.line_assembly(stations, geojson.scan_lines(spark, f"{network}/lines.json"))
    m4 = {r["line_id"]: r for r in lines.collect()}["M4"]
    assert (m4["parts"], m4["vertices"], m4["official_length_km"]) == (2, 5, 26.5)
    assert m4["drawing"][0][1] == [29.12346, 41.0] and m4["colour"] == "#e5007d"
    assert m4["short_name"] == "Kadıköy – SGH" and m4["station_count"] == 4
    assert [r["line_id"] for r in N.lines_sorted(lines).collect()] == ["F4", "M4"]
    files.write_network(lines, stations, f"{tmp_path}/net")
    assert files.scan_network(spark, f"{tmp_path}/net")["stations"].count() == 6
    rings = geojson.scan_districts(spark, f"{network}/districts.json")
    assert rings.count() == 3
    near = N.bbox_intersects(rings, N.network_extent(stations))
    assert [r["name"] for r in near.collect()] == ["Adalar"]


def test_long_lines_are_cut_into_blocks(spark):
    rows = [("L", i, f"s{i}", 41.0 + i / 1000, 29.0 + (i * 7 % 13) / 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "line_id string, seq long, name string, lat double, lon double")
    a = {r["seq"]: r["km"] for r in N.cumulative_km(df, block=6).collect()}
    b = {r["seq"]: r["km"] for r in N.cumulative_km(df).collect()}
    assert a == b and a[0] == 0.0
    ka = N.cumulative_km(df).withColumn("km", F.col("seq") * 1.0)
    one = sorted((r["seq"], r["b"]["name"]) for r in N.segments(ka, block=6).collect())
    assert one == [(i, f"s{i + 1}") for i in range(49)]


def test_nearest_comes_before_the_distance_test(spark):
    """The nearest defect decides even when a farther, wider one would accept the row."""
    from axlewatch.operators.alarms import nearest_defect
    defects = spark.createDataFrame(
        [("M4", "near", 10.0, 0.1, "a", 1), ("M4", "wide", 12.0, 5.0, "b", 2), ("M4", "twin", 10.0, 9.0, "c", 3)],
        "line_id string, defect_id string, km double, width_km double, between_text string, ord int")
    rows = spark.createDataFrame(
        [(1, "M4", 10.5), (2, "M4", 10.95), (3, "M4", 16.0), (4, "M9", 10.0), (5, None, 10.0)],
        "id int, line_id string, track_km double")
    got = {r["id"]: r["defect_id"] for r in nearest_defect(rows, defects).collect()}
    assert got == {1: "near", 2: None, 3: "wide", 4: None, 5: None}


def test_quality_rules_find_planted_faults(spark):
    good = telemetry(spark)
    report = {r["rule"]: r["violations"] for r in Q.telemetry_rules(good).collect()}
    assert report["DQ3 no nulls"] == report["DQ8 normal has no severity"] == 0
    bad = good.withColumn("speed_kmh", F.lit(500.0)).withColumn("fault_type", F.lit("unheard"))
    report = {r["rule"]: r["violations"] for r in Q.telemetry_rules(bad).collect()}
    assert report["DQ9 speed in range"] == report["DQ7 known fault class"] == 40
    assert Q.train_rules(good).first()["violations"] == 0
    key = good.select(F.lit(1).cast("long").alias("sample_id")).limit(2)
    rules = {r["rule"]: r["violations"] for r in Q.key_rules(spark.range(3).withColumnRenamed("id", "sample_id"), key).collect()}
    assert rules == {"DQ6 key unique": 1, "DQ6 key equals stream": 2}
    schema = {r["rule"]: r["violations"] for r in Q.schema_rules(good, good, good).collect()}
    assert schema == {"DQ1 same columns": 0, "DQ2 features numeric": 0, "DQ13 stream without labels": 2}


def test_blind_mode_hides_rows_and_opens_at_the_end(spark):
    from axlewatch.operators import scoring as S
    rows = [(i, i // 2, "normal" if i % 3 else "rail_crack", "none", "normal", "none") for i in range(10)]
    df = spark.createDataFrame(rows, "sample_id long, tick long, pred string, severity string, fault_type string, fault_severity string")
    scored = S.score_against_key(df.drop("fault_type", "fault_severity"), df)
    assert not {"actual", "actual_severity", "correct"} & set(S.blind_rows(scored, True).columns)
    out = S.blind_metrics(S.running_metrics(scored, ["normal", "rail_crack"]), blind=True).orderBy("tick").collect()
    assert [r["accuracy"] is None for r in out] == [True] * 4 + [False]
    assert out[-1]["opened_at_end"] and not out[-1]["blind"] and out[0]["evaluated"] == 2
    seen = S.blind_metrics(S.running_metrics(scored, ["normal", "rail_crack"]), blind=False).collect()
    assert all(r["accuracy"] is not None for r in seen)


def test_unanswered_rows_are_not_evaluated(spark):
    from axlewatch.operators import scoring as S
    df = spark.createDataFrame([(1, "normal", "none"), (2, "normal", "none")], "sample_id long, pred string, severity string")
    key = spark.createDataFrame([(9, "normal", "none")], "sample_id long, fault_type string, fault_severity string")
    got = S.accuracy(S.score_against_key(df, key)).first()
    assert got["evaluated"] == 0 and got["accuracy"] is None


def test_messages_of_a_train_keep_their_order(spark):
    rows = [(i, f"T{i % 3}", (i * 7) % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "sample_id long, train_id string, s long").withColumn(
        "timestamp", F.timestamp_seconds("s")).repartition(5)
    placed = kafka.in_topic_order(df).withColumn("task", F.spark_partition_id()).collect()
    assert all(len({r["task"] for r in placed if r["train_id"] == t}) == 1 for t in ("T0", "T1", "T2"))
    for t in ("T0", "T1", "T2"):
        seen = [r["s"] for r in placed if r["train_id"] == t]
        assert seen == sorted(seen)


def test_ranked_table_numbers_rows_by_file_offsets(spark, tmp_path):
    """Places equal the sort order over many files, ties included, and stay the same on every reading."""
    order = ["timestamp", "train_id"]
    df = spark.range(2000).select(
        F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 500 * 2).alias("timestamp"),
        F.concat(F.lit("T"), (F.col("id") * 31 % 5).cast("string")).alias("train_id"), "id")
    split = L.chronological_split(df)
    files.write_ranked(split, order, f"{tmp_path}/t")
    got = files.scan_ranked(spark, f"{tmp_path}/t")
    rows = [tuple(r) for r in got.select("sample_id", *order, "part", "id").orderBy("sample_id").collect()]
    assert [r[0] for r in rows] == list(range(2000)) and sorted(r[4] for r in rows) == list(range(2000))
    assert [r[1:3] for r in rows] == sorted(r[1:3] for r in rows)
    assert [r[3] for r in rows] == sorted((r[3] for r in rows), reverse=True)
    test = files.scan_ranked(spark, f"{tmp_path}/t").where("part = 'test'")
    assert sorted((r["sample_id"], r["id"]) for r in test.collect()) == [(r[0], r[4]) for r in rows if r[3] == "test"]
    files.write_ranked(split.where("false"), order, f"{tmp_path}/none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")     # files read in pieces keep their row indexes
    try:
        again = files.scan_ranked(spark, f"{tmp_path}/t")
        assert sorted((r["sample_id"], r["id"]) for r in again.collect()) == [(r[0], r[4]) for r in rows]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_keeps_microseconds(spark, tmp_path):
    known = {"timestamp": F.timestamp_micros(F.lit(1_700_000_000_123_457)), "at_station": F.lit(True)}
    rows = spark.range(3).select(F.col("id").alias("sample_id"), *[
        known.get(f.name, F.lit("1").cast(f.dataType)).alias(f.name) for f in schemas.TELEMETRY.fields])
    files.write_stream_and_key(rows, str(tmp_path), "csv")
    for table in (files.scan_stream_table(spark, f"{tmp_path}/stream"), files.scan_answer_key(spark, f"{tmp_path}/key")):
        assert {r[0] for r in table.select(F.unix_micros("timestamp")).collect()} == {1_700_000_000_123_457}


def test_a_long_train_comes_from_several_tasks_in_order(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("T"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("train_id"),
        F.when(F.col("id") % 500 != 3, F.timestamp_seconds(1_700_000_000 + F.col("id") * 7919 % 1500)).alias("timestamp"), "id")
    slices = kafka.topic_slices(rows, task_rows=300)
    assert len(slices) >= 9
    sent = {}
    for part in slices:
        got = part.withColumn("task", F.spark_partition_id()).collect()
        assert sum(r["train_id"] == "hot" for r in got) <= 340
        assert len({r["task"] for r in got if r["train_id"] == "hot"}) == 1
        for r in got:       # rows of a task in their order
            sent.setdefault(r["train_id"], []).append((r["timestamp"], r["id"]))
    assert sorted(i for v in sent.values() for _, i in v) == list(range(3000))
    for times in ([t for t, _ in v if t] for v in sent.values()):
        assert times == sorted(times)
    assert len(kafka.topic_slices(rows, task_rows=3000)) == 1
