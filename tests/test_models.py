"""Models on separable telemetry: the published test floors hold."""

import pytest
from pyspark.sql import functions as F

from axlewatch.operators import models as M
from axlewatch.operators import scoring as S
from axlewatch.operators.segments import Timeline
from axlewatch.plans.catalog import QUERIES
from axlewatch.schemas import FEATURES

TICKS, AXLES = 200, 12


@pytest.fixture(scope="module")
def line(spark):
    """Axles that are normal, then faulty in one of two ways, with deterministic wobble."""
    axle, tick = F.floor(F.col("id") / TICKS), F.col("id") % TICKS
    fault = F.when((tick % 100 < 60) | (axle % 3 == 0), "normal").when(
        axle % 3 == 1, "bearing_fault").otherwise("motor_fault")
    wobble = lambda i: F.sin(F.col("id") * (i + 3) * 1.7)
    lift = {"vib_kurtosis": ("bearing_fault", 5.0), "axle_box_temp_c": ("bearing_fault", 8.0),
            "motor_temp_c": ("motor_fault", 8.0), "motor_voltage_v": ("motor_fault", -6.0)}
    feature = lambda i, c: (wobble(i) + F.when(
        F.col("fault_type") == lift[c][0], lift[c][1]).otherwise(0.0)) if c in lift else wobble(i)
    base = spark.range(TICKS * AXLES).select(
        F.col("id").alias("sample_id"), "id", F.concat(F.lit("x"), axle.cast("string")).alias("axle_key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + tick * 2).alias("timestamp"), fault.alias("fault_type"))
    df = base.select(
        "*", F.when(F.col("fault_type") == "normal", "none").otherwise("severe").alias("fault_severity"),
        *[feature(i, c).alias(c) for i, c in enumerate(FEATURES)]).drop("id")
    return Timeline.of(df, ["axle_key"], "timestamp", ["timestamp", "sample_id"])


def test_classifiers_reach_the_floors_and_reload(spark, line, tmp_path):
    scaler = M.fit_scaler(line.rows)
    both = M.window_vectors(line, scaler, split=True)
    model = M.fit_fault_model(both.where("part = 'fit'"), scaler, max_iter=20)
    assert model.classes == ["bearing_fault", "motor_fault", "normal"]
    curve = M.training_curve(model)
    assert curve[-1] < curve[0]
    model.save(spark, str(tmp_path))
    again = M.FaultModel.load(spark, str(tmp_path))
    assert M.training_curve(again) == curve and again.scaler == scaler
    val = both.where("part = 'val'")
    out = M.score_models(val, model).select("sample_id", "pred", "conf", "probs", "severity", "sev_probs",
                                            "fault_type", "fault_severity", "uncertain").cache()
    assert all(len(r["probs"]) == 3 and len(r["sev_probs"]) == 4 and abs(sum(r["probs"]) - 1) < 1e-6
               for r in out.limit(20).collect())
    scored = S.score_against_key(out.drop("fault_type", "fault_severity"), out)
    got = S.accuracy(scored).first()
    assert got["accuracy"] >= 0.90 and got["severity_accuracy"] >= 0.85
    same = M.score_models(val, again).join(out.select("sample_id", F.col("pred").alias("p")), "sample_id")
    assert same.where("pred <> p").count() == 0


def test_anomaly_layer(spark, line, tmp_path):
    scaler = M.fit_scaler(line.rows.where("fault_type = 'normal'"))
    windows = M.window_vectors(line, scaler)
    fitted = M.fit_anomaly_model(windows, scaler=scaler)
    fitted.save(spark, str(tmp_path))
    model = M.AnomalyModel.load(spark, str(tmp_path))
    assert (model.threshold, model.scaler, model.window, model.width, model.share) == (
        fitted.threshold, scaler, 10, 16, 0.99)
    assert model.classes == ["bearing_fault", "motor_fault", "normal"]
    # windows of another scaler are seen through the model's own
    other = M.fit_scaler(line.rows)
    moved = M.score_anomalies(M.window_vectors(line, other).withColumn("pred", F.lit("normal")), model, other)
    own = M.score_anomalies(windows.withColumn("pred", F.lit("normal")), model, scaler)
    far = moved.select("sample_id", F.col("anomaly_error").alias("e")).join(own, "sample_id").where(
        F.abs(F.col("e") - F.col("anomaly_error")) > 1e-9)
    assert other != scaler and far.count() == 0
    scored = M.score_anomalies(windows.withColumn("pred", F.lit("normal")), model)
    rates = {r["class"]: r for r in M.anomaly_rates(scored).collect()}
    assert rates["normal"]["rate"] < 0.10
    assert rates["normal"]["catch_rate"] - rates["normal"]["false_alarm_rate"] > 0.3
    top = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert 0 <= top[0] <= top[1] <= 1
    none = M.score_anomalies(windows, None)
    assert none.where("anomaly_error is not null or anomaly is not null").count() == 0


def test_reconstruction_error_equals_a_built_reconstruction(spark, line):
    import numpy as np
    windows = M.window_vectors(line, M.fit_scaler(line.rows))
    model = M.fit_anomaly_model(windows)
    rows = M._with_error(windows, model.components).limit(20).collect()
    p = model.components.pc.toArray()
    for r in rows:
        x = r["features"].toArray()
        assert np.isclose(r["anomaly_error"], ((x - p @ (p.T @ x)) ** 2).mean())


def test_scaler_and_weights(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "a"), (5.0, 5.0, "b")], "x double, y double, c string")
    s = M.fit_scaler(df, ["x", "y"])
    assert s.mean == [3.0, 5.0] and abs(s.scale[0] - (8 / 3) ** 0.5) < 1e-12 and s.scale[1] == 1.0
    w = {r["c"]: r["weight"] for r in M.class_weights(df, "c", ["a", "b", "z"]).collect()}
    raw = [(3 / 4) ** 0.5, (3 / 2) ** 0.5, 1.0]
    assert all(abs(w[k] - v / (sum(raw) / 3)) < 1e-12 for k, v in zip("abz", raw))
    assert [tuple(r) for r in M.label_codes(df, "c").collect()] == [(0, "a"), (1, "b")]


def test_codes_and_weights_from_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [tuple(r) for r in M.label_codes(df, "c").orderBy("code").collect()] == [(0, "a"), (1, "b")]
    assert M.label_codes(df.where("false"), "c").collect() == []
    known = df.where("c is not null")
    counts = known.groupBy("c").agg(F.count("*").alias("rows")).withColumnRenamed("rows", "k")
    shown = lambda w: sorted(map(tuple, w.collect()))
    assert shown(M.class_weights(counts, "c", counted="k")) == shown(M.class_weights(known, "c"))


@pytest.mark.parametrize("name,fit", [("score_models", "fit_fault_model"), ("score_anomalies", "fit_anomaly_model")])
def test_windows_of_a_fit_are_built_once(spark, tmp_path, monkeypatch, name, fit):
    n, kinds = F.col("id"), F.array(*map(F.lit, ["view", "purchase", "error", "click"]))
    spark.range(80 * 30).select(
        n.alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + n * 60).alias("ts"), (n % 30).alias("user_id"),
        F.get(kinds, (n * 7 % 11 % 4).cast("int")).alias("event_type"), (n * 37 % 200 + n % 7 / 7).alias("value"),
        F.concat(F.lit('{"k": '), (n * 13 % 97).cast("string"), F.lit("}")).alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    real, seen = getattr(M, fit), []
    monkeypatch.setattr(M, fit, lambda windows, *a, **k: (seen.append(windows), real(windows, *a, **k))[1])
    out = QUERIES[name](spark, str(tmp_path))
    # 68 rows of an axle train and 12 are left, which give two windows; anomalies take all 36
    assert out.count() == {"score_models": 30 * 2, "score_anomalies": 30 * 36}[name]
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "windowspecdefinition" not in text(seen[0]) and "windowspecdefinition" not in text(out)
