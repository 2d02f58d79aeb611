"""The chain from labelled telemetry to the alarm history."""

import shutil

from pyspark.sql import functions as F

from axlewatch import schemas
from axlewatch.operators import alarms as A
from axlewatch.operators.segments import Timeline
from axlewatch.plans import jobs

TICKS = 240


def labelled(spark):
    """Four axles of two trains; axle A2 runs hot in two stretches, one of them in the test part."""
    axle, tick = F.floor(F.col("id") / TICKS), F.col("id") % TICKS
    faulty = (axle % 2 == 1) & (tick.between(40, 110) | tick.between(205, 225))
    wave = lambda i: F.sin(F.col("id") * (i + 3) * 1.7)
    known = {
        "timestamp": F.timestamp_seconds(F.lit(1_700_000_000) + tick * 2), "line_id": F.lit("M4"),
        "train_id": F.concat(F.lit("M4-0"), (F.floor(axle / 2) + 1).cast("string")), "wagon_id": F.lit("V1"),
        "axle_id": F.concat(F.lit("A"), (axle % 2 + 1).cast("string")), "next_station": F.lit("Göztepe"),
        "at_station": F.lit(False), "lat": F.lit(41.0), "lon": F.lit(29.0), "track_km": tick / 10.0,
        "fault_type": F.when(faulty, "bearing_fault").otherwise("normal"),
        "fault_severity": F.when(faulty, "severe").otherwise("none"),
        "axle_box_temp_c": wave(1) + F.when(faulty, 9.0).otherwise(0.0),
        "vib_kurtosis": wave(2) + F.when(faulty, 7.0).otherwise(0.0)}
    return spark.range(4 * TICKS).select(*[
        known.get(f.name, wave(i)).cast(f.dataType).alias(f.name)
        for i, f in enumerate(schemas.TELEMETRY.fields)])


def test_from_telemetry_to_history(spark, tmp_path):
    path = str(tmp_path)
    jobs.prepare(labelled(spark), path)
    jobs.train(spark, path, max_iter=15)
    reports = jobs.evaluate(spark, path)
    got = reports["accuracy"].first()
    assert got["accuracy"] >= 0.9 and got["severity_accuracy"] >= 0.85
    assert got["evaluated"] == 4 * 20     # 48 test rows per axle give 20 windows
    # a repeated answer changes no count
    again = spark.read.parquet(f"{path}/key").limit(1)
    again.coalesce(1).write.mode("append").parquet(f"{path}/key")
    assert jobs.evaluate(spark, path)["accuracy"].first()["evaluated"] == 4 * 20
    jobs.score_stream(spark, path)
    table = spark.read.parquet(f"{path}/predictions/batch=*")
    assert table.count() == 4 * 39        # every row from the tenth on, the last ones too
    assert table.where("anomaly is null").count() == 0
    # again without new files
    ids = sorted(r["sample_id"] for r in table.select("sample_id").collect())
    assert jobs.score_stream(spark, path) == 0
    table = spark.read.parquet(f"{path}/predictions/batch=*")
    assert sorted(r["sample_id"] for r in table.select("sample_id").collect()) == ids
    place = spark.createDataFrame(
        [("M4", "M4@21.00", 21.0, 3.0, "A – B", 0), ("M4", "M4@22.00", 22.0, 3.0, "B – C", 1)],
        "line_id string, defect_id string, km double, width_km double, between_text string, ord long")
    first = jobs.replay_alarms(spark, path, defects=place)
    second = jobs.replay_alarms(spark, path, hysteresis=6, blind=True)
    silent = jobs.replay_alarms(spark, path, limit=0.0)
    assert (first.run_id, second.run_id, silent.run_id) == (1, 2, 3)
    history = jobs.files.scan_history(spark, f"{path}/history")
    store = history["alarms"]
    per_run = {r["run_id"]: r["count"] for r in store.groupBy("run_id").count().collect()}
    assert per_run[1] >= 2 and per_run.get(2, 0) <= per_run[1]
    assert 3 not in per_run               # with limit 0 everything is uncertain and nothing settles
    line = Timeline.of(table.withColumn("tick", F.lit(0)), ["axle_key"], "timestamp", ["timestamp", "sample_id"])
    want = A.alarm_events(A.alarm_states(line).rows).count()
    assert per_run[1] == want
    runs = {r["id"]: r for r in history["runs"].collect()}
    assert {r["late_rows"] for r in runs.values()} == {0}
    assert runs[1]["axle_count"] == 4 and runs[1]["line_count"] == 1 and runs[2]["blind"]
    assert store.where("run_id = 1 and actual is null").count() == 0
    assert store.where("run_id = 2 and actual is not null").count() == 0
    metrics = {(r["run_id"], r["tick"]): r for r in history["metrics"].collect()}
    assert metrics[1, 25]["accuracy"] > 0.8 and metrics[2, 25]["accuracy"] is None
    summary = jobs.ask_history(spark, path)
    assert summary["totals"].first()["run_count"] == 3
    assert {r["class"] for r in summary["classes"].collect()} == {"bearing_fault"}
    order = [(r["run_id"], r["tick"]) for r in summary["last_alarms"].collect()]
    assert order == sorted(order, reverse=True)


def test_a_nightly_stream_is_scored_in_parts(spark, tmp_path):
    """Files that come between two runs: the predictions are those of one run over all of them."""
    path = str(tmp_path)
    jobs.prepare(labelled(spark), path)
    jobs.train(spark, path, max_iter=5)
    shutil.copytree(f"{path}/stream", f"{path}/whole")
    whole = spark.read.parquet(f"{path}/whole")
    middle = whole.agg(F.percentile(F.unix_micros("timestamp"), 0.5)).first()[0]
    shutil.rmtree(f"{path}/stream")
    for part in (F.unix_micros("timestamp") <= middle, F.unix_micros("timestamp") > middle):
        whole.where(part).coalesce(1).write.mode("append").parquet(f"{path}/stream")
        jobs.score_stream(spark, path)
    rows = spark.read.parquet(f"{path}/predictions/batch=*")
    assert rows.count() == rows.select("sample_id").distinct().count() == 4 * 39


def test_the_chain_runs_without_an_anomaly_model_and_links_defects(spark, tmp_path):
    path = str(tmp_path)
    cracked = labelled(spark).replace("bearing_fault", "rail_crack", "fault_type")
    jobs.prepare(cracked, path)
    jobs.train(spark, path, max_iter=15)
    shutil.rmtree(f"{path}/model/anomaly")
    jobs.score_stream(spark, path)
    assert spark.read.parquet(f"{path}/predictions/batch=*").where("anomaly is not null").count() == 0
    place = spark.createDataFrame(
        [("M4", "M4@21.00", 21.0, 9.0, "A – B", 0)],
        "line_id string, defect_id string, km double, width_km double, between_text string, ord long")
    jobs.replay_alarms(spark, path, defects=place)
    found = jobs.ask_history(spark, path)["defects"].collect()
    assert [r["defect_id"] for r in found] == ["M4@21.00"]
