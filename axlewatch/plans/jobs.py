"""The whole chain as jobs: prepare, train, score, replay, ask the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators import alarms as A
from axlewatch.operators import history as H
from axlewatch.operators import labels as L
from axlewatch.operators import models as M
from axlewatch.operators import scoring as S
from axlewatch.operators.segments import Timeline
from axlewatch.operators.windows import Clock
from axlewatch.schemas import ENTROPY_LIMIT, HYSTERESIS
from axlewatch.session import checkpointed
from axlewatch.sources import files
from axlewatch.streaming import live

ORDER = ["timestamp", "train_id", "wagon_id", "axle_id"]


def timeline(rows: DataFrame) -> Timeline:
    return Timeline.of(rows.withColumn("axle_key", X.axle_key()), ["axle_key"], "timestamp",
                       ["timestamp", "sample_id"])


def prepare(telemetry: DataFrame, path: str) -> None:
    """Chronological split; the test part becomes an unlabelled stream and a separate answer key.

    Each output is written once: sample ids are places in the sorted split table, added on reading.
    """
    files.write_ranked(L.chronological_split(telemetry), ORDER, f"{path}/split")
    files.write_stream_and_key(part(telemetry.sparkSession, path, "test"), path)


def part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The `train` or `test` part of the split table, with sample ids."""
    return files.scan_ranked(spark, f"{path}/split").where(F.col("part") == name).drop("part")


def train(spark: SparkSession, path: str, max_iter: int = 50) -> tuple[M.FaultModel, M.AnomalyModel]:
    """Fits both classifiers and the anomaly layer on the train part, and saves them."""
    line = timeline(part(spark, path, "train"))
    scaler = M.fit_scaler(line.rows)
    split = M.stored_windows(M.window_vectors(line, scaler, split=True), "part")
    fault = M.fit_fault_model(split.where("part = 'fit'"), scaler, max_iter)
    anomaly = M.fit_anomaly_model(M.stored_windows(M.window_vectors(line, scaler), "axle_key"), scaler=scaler)
    fault.save(spark, f"{path}/model/fault")
    anomaly.save(spark, f"{path}/model/anomaly")
    return fault, anomaly


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """The stored key with one row per sample."""
    key = files.scan_answer_key(spark, f"{path}/key", "parquet")
    return files.last_per_id(key, F.struct("timestamp", "fault_type", "fault_severity"))


def evaluate(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Reports on the test part with the saved models."""
    model = M.FaultModel.load(spark, f"{path}/model/fault")
    windows = M.window_vectors(timeline(part(spark, path, "test")), model.scaler)
    out = M.score_models(windows, model)
    scored = S.score_against_key(out.drop("fault_type", "fault_severity"), answer_key(spark, path))
    # the few columns every report reads, scored once
    scored = checkpointed(scored.select(
        "sample_id", "actual", "pred", "evaluated", "correct", "severity_correct"))
    reports = {
        "accuracy": S.accuracy(scored), "report": S.classification_report(scored, model.classes),
        "matrix": S.confusion_matrix(scored, model.classes)}
    files.write_reports(reports["matrix"], reports["report"], f"{path}/results")
    return reports


def score_stream(spark: SparkSession, path: str, delay: str = "10 seconds", batch_bytes: int = 512 << 20) -> int:
    """Unlabelled stream -> windows -> predictions and anomaly columns, into the table `predictions`.

    May be run again when files have come: it goes on where it was. Without a saved anomaly model the anomaly
    columns are NULL. Gives the number of rows that came too late.
    """
    model = M.FaultModel.load(spark, f"{path}/model/fault")
    place = f"{path}/model/anomaly"
    anomaly = M.AnomalyModel.load(spark, place) if files.exists(spark, place) else None
    rows = live.scan_stream(spark, f"{path}/stream", bytes_per_batch=batch_bytes).withColumn("axle_key", X.axle_key())

    def scored(rows: DataFrame) -> DataFrame:
        windows = live.stream_windows(
            rows, model.scaler.item(), model.window, delay, ["line_id", "train_id", "next_station", "track_km"])
        out = M.score_models(M.vectors_of(windows.where("ready"), model), model)
        return M.score_anomalies(out, anomaly, model.scaler).drop("features")

    return live.replay(rows, scored, live.append_to(f"{path}/predictions"), f"{path}/state/score")


def replay_alarms(spark: SparkSession, path: str, hysteresis: int = HYSTERESIS,
                  limit: float = ENTROPY_LIMIT, delay: str = "10 seconds", blind: bool = False,
                  defects: DataFrame | None = None, batch_bytes: int = 512 << 20) -> live.Run:
    """Predictions -> alarm events and metric snapshots, into the history under a new run.

    Events near a defect are linked to it and numbered and, unless the run is blind, carry the actual class. The
    run's clock starts with the first reading of the stream, not with the first full window. The number of rows
    that came too late is stored with the run.
    """
    table = spark.read.parquet(f"{path}/predictions/batch=*")
    stream = spark.read.parquet(f"{path}/stream")
    clock = Clock.of(stream)
    sizes = stream.agg(F.countDistinct(X.axle_key()).alias("axles"), F.countDistinct("line_id").alias("lines")).first()
    run = live.open_run(spark, f"{path}/history", "parquet", blind, hysteresis, sizes["axles"], sizes["lines"])
    key = answer_key(spark, path)
    sure = X.is_uncertain(F.col("entropy"), limit)

    def events(rows: DataFrame) -> DataFrame:
        states = live.stream_alarm_states(rows.withColumn("uncertain", sure), hysteresis, delay, clock)
        out = A.alarm_events(states)
        if defects is not None:
            out = live.stream_repeats(live.stream_defects(out, defects), clock, delay)
        if not blind:
            out = out.join(key.select("sample_id", F.col("fault_type").alias("actual")), "sample_id", "left")
        return out

    source = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", batch_bytes).parquet(
        f"{path}/predictions/batch=*")
    late = live.replay(source, events, files.alarm_writer(run.store, run.run_id), run.checkpoint)
    files.append_late(spark, run.store, run.run_id, late)
    files.compact_alarms(spark, run.store, run.run_id)
    # snapshots of the running metrics, from the stored predictions
    rows = table.withColumns({"uncertain": sure, "tick": clock.tick()})
    line = Timeline.of(rows, ["axle_key"], "timestamp", ["timestamp", "sample_id"])
    active = A.active_alarm_count(A.alarm_states(line, hysteresis, clock.start_us).rows)
    model = M.FaultModel.load(spark, f"{path}/model/fault")
    metrics = S.blind_metrics(S.running_metrics(S.score_against_key(rows, key), model.classes), blind)
    files.metric_writer(run.store, run.run_id)(S.metric_rows(S.metric_snapshots(metrics), active), 0)
    return run


def ask_history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    store = files.scan_history(spark, f"{path}/history")
    return H.history_summary(store["alarms"], store["runs"])
