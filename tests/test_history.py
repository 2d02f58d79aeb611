"""Alarm-history questions on the published small cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from axlewatch import schemas
from axlewatch.operators import history as H
from axlewatch.sources import files

T0 = datetime(2024, 5, 1, 8)


def alarm(i, axle, new, severity="mild", seconds=10.0, kind="alarm", line="M4", defect=None, run=1):
    return (i, run, T0 + timedelta(seconds=i), T0, i, axle, line, "normal", new, severity, 0.9, "X", kind,
            seconds, 0.5, defect, None)


@pytest.fixture
def alarms(spark):
    rows = [alarm(i, "M4-01/V1-A1", "wheel_flat", seconds=10.0 * i) for i in (1, 2, 3)]
    rows.append(alarm(4, "M2-01/V1-A1", "motor_fault", "severe", 20.0, line="M2"))
    return spark.createDataFrame(rows, schemas.ALARMS)


def test_by_axle_line_class(spark, alarms):
    axles = H.alarms_by_axle(alarms).collect()
    assert [(r["axle"], r["alarm_count"], r["severe_count"], r["avg_prior_s"]) for r in axles] == [
        ("M4-01/V1-A1", 3, 0, 20.0), ("M2-01/V1-A1", 1, 1, 20.0)]
    assert {r["line_id"]: r["alarm_count"] for r in H.alarms_by_line(alarms).collect()} == {"M4": 3, "M2": 1}
    assert {r["class"]: r["alarm_count"] for r in H.alarms_by_class(alarms).collect()} == {
        "wheel_flat": 3, "motor_fault": 1}
    shares = {r["line_id"]: r["share"] for r in H.line_share(H.alarms_by_line(alarms)).collect()}
    assert shares["M4"] == 1.0


def test_cleared_events_are_no_alarms(spark):
    rows = [alarm(1, "a", "wheel_flat"), alarm(2, "a", "normal", kind="temizlendi")]
    df = spark.createDataFrame(rows, schemas.ALARMS)
    runs = spark.createDataFrame([(1, T0, "csv", False, 3, 4, 1), (2, T0, "csv", False, 3, 4, 1)], schemas.RUNS)
    assert H.history_totals(df, runs).first().asDict() == {"total_alarms": 1, "run_count": 2}
    assert [(r["id"], r["alarm_count"]) for r in H.runs_with_alarm_count(runs, df).collect()] == [(2, 0), (1, 1)]
    assert [r["id"] for r in H.last_alarms(df).collect()] == [1]
    assert set(H.history_summary(df, runs)) == {
        "totals", "axles", "lines", "classes", "defects", "runs", "last_alarms"}


def test_recurring_defects(spark):
    rows = [alarm(i, f"a{i % 2}", "rail_crack", defect="M4@9.45", kind="alarm" if i else "temizlendi")
            for i in range(3)]
    got = H.recurring_defects(spark.createDataFrame(rows, schemas.ALARMS)).first()
    assert (got["detections"], got["axle_count"]) == (3, 2)
    assert got["last_seen"] - got["first_seen"] == timedelta(seconds=2)


def test_store_is_idempotent_and_prunes_runs(spark, tmp_path):
    path = str(tmp_path)
    events = spark.createDataFrame(
        [(7, T0, 3, "a", "M4", "T", "normal", "rail_crack", 0.9, "mild", "X", "alarm", 6.0, 0.4, 1.0)],
        "sample_id long, timestamp timestamp, tick long, axle string, line_id string, train_id string, "
        "prior string, new string, conf double, severity string, station string, kind string, "
        "prior_duration_s double, priority double, track_km double")
    for run in (1, 2):
        files.append_run(spark, path, run, "csv", False, 3, 4, 1)
        for _ in range(2):      # a retried batch replaces itself
            files.alarm_writer(path, run)(events, 0)
    store = files.scan_history(spark, path)
    assert store["alarms"].count() == 2 and store["runs"].count() == 2
    one = store["alarms"].where(F.col("run_id") == 2)
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    counts = H.runs_with_alarm_count(store["runs"], store["alarms"]).collect()
    assert [r["alarm_count"] for r in counts] == [1, 1]


def test_metric_snapshots_are_stored(spark, tmp_path):
    from axlewatch.operators import scoring as S
    metrics = spark.range(60).select(
        F.col("id").alias("tick"), F.col("id").alias("evaluated"), F.lit(0.9).alias("accuracy"),
        F.when(F.col("id") > 0, 0.8).alias("severity_accuracy"), F.lit(0.7).alias("macro_f1"))
    active = spark.createDataFrame([(25, 4)], "tick long, active_alarms long")
    files.metric_writer(str(tmp_path), 3)(S.metric_rows(S.metric_snapshots(metrics), active), 0)
    got = files.scan_history(spark, str(tmp_path))["metrics"].orderBy("tick").collect()
    assert [(r["run_id"], r["tick"], r["active_alarms"]) for r in got] == [(3, 0, 0), (3, 25, 4), (3, 50, 0)]
    assert got[0]["severity_accuracy"] is None


def test_batches_end_as_few_files_and_show_once(spark, tmp_path):
    path, run = str(tmp_path), 5
    schema = ("sample_id long, timestamp timestamp, tick long, axle string, line_id string, train_id string, "
              "prior string, new string, conf double, severity string, station string, kind string, "
              "prior_duration_s double, priority double, track_km double")
    write = files.alarm_writer(path, run)
    batch = lambda *ids: spark.createDataFrame(
        [(i, T0, i, f"a{i}", "M4", "T", "normal", "rail_crack", 0.9, "mild", "X", "alarm", 6.0, 0.4, 1.0) for i in ids], schema)
    shown = lambda: sorted(r["id"] for r in files.scan_alarms(spark, path).collect())
    parts = lambda: sorted(p.name for p in (tmp_path / "alarms" / f"run_id={run}").iterdir())
    assert shown() == []
    files.compact_alarms(spark, path, run)          # nothing to do yet
    for n in range(5):
        write(batch(2 * n, 2 * n + 1), n)
    write(batch(99), -1)                            # what a bounded replay still holds
    reader = files.scan_alarms(spark, path)
    files.compact_alarms(spark, path, run)
    assert "batch=0-4" in parts() and "batch=3" in parts()
    assert reader.count() == 11 and shown() == [*range(10), 99]
    write(batch(8, 9), 4)                           # a retried batch that the range already holds
    write(batch(10), 5)
    write(batch(), 6)
    assert shown() == [*range(11), 99]
    # a range that was not finished does not count
    (tmp_path / "alarms" / f"run_id={run}" / "batch=0-6").mkdir()
    assert shown() == [*range(11), 99]
    files.compact_alarms(spark, path, run)
    assert shown() == [*range(11), 99]
    files.compact_alarms(spark, path, run)
    assert parts() == ["batch=-1", "batch=0-6"]
    assert len(list((tmp_path / "alarms" / f"run_id={run}" / "batch=0-6").glob("*.parquet"))) == 1
    files.alarm_writer(path, 6)(batch(1), 0)        # another run has its own batches
    assert shown() == [0, 1, 1, *range(2, 11), 99]
