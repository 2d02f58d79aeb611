"""Segmented timelines against plain sequential models, with one axle holding most rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from axlewatch.operators import alarms as A
from axlewatch.operators import windows as W
from axlewatch.operators.segments import (
    Timeline, exact_percentile, global_rank, hot_series, running_sums, with_ordinal,
)

START = datetime(2024, 1, 1)
CLASSES = ["normal", "bearing_fault", "rail_crack"]


def make_rows(seed, axles=4, hot=300, cold=5):
    rng = random.Random(seed)
    rows, i = [], 0
    for a in range(axles):
        at = START + timedelta(seconds=rng.randrange(5000))
        pred = "normal"
        for _ in range(hot if a == 0 else cold + a * 9):
            # bursts, gaps and equal time stamps
            at += timedelta(seconds=rng.choice([0, 2, 2, 2, 60, 7200]))
            if rng.random() < 0.3:
                pred = rng.choice(CLASSES)
            rows.append((i, f"x{a}", at, pred, rng.random() < 0.35, round(rng.random(), 3),
                         rng.choice(["none", "mild", "moderate", "severe"]), float(rng.randrange(0, 80))))
            i += 1
    rng.shuffle(rows)
    return rows


SCHEMA = ("sample_id long, axle_key string, timestamp timestamp, pred string, uncertain boolean, "
          "conf double, severity string, speed_kmh double")


def series(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def timeline(spark, rows, limit):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("track_km", F.col("speed_kmh"))
    return Timeline.of(df, ["axle_key"], "timestamp", ["timestamp", "sample_id"], limit)


def sequential_alarms(rows, n):
    """The alarm state machine, one row after the other."""
    out, start = {}, min(r[2] for r in rows)
    age = lambda a, b: int((a - b) / timedelta(microseconds=100_000) + 0.5) / 10
    for _, line in series(rows).items():
        candidate, run, settled, since = None, 0, None, start
        for r in line:
            if not r[4]:
                run = run + 1 if r[3] == candidate else 1
                candidate = r[3]
            prior, prior_s = settled, age(r[2], since)
            changed = run >= n and candidate != settled
            if changed:
                settled, since = candidate, r[2]
            out[r[0]] = (candidate, settled, prior, run >= n, changed, age(r[2], since), prior_s)
    return out


@pytest.mark.parametrize("seed,limit,n", [(1, 7, 3), (2, 20, 1), (3, 3, 5), (4, 10**6, 3)])
def test_alarm_states_equal_the_state_machine(spark, seed, limit, n):
    rows = make_rows(seed)
    line = timeline(spark, rows, limit)
    assert line.segmented == (limit < 1000)
    got = {
        r["sample_id"]: tuple(r)[1:] for r in A.alarm_states(line, n).rows.select(
            "sample_id", "candidate", "settled", "prior_settled", "stable", "changed",
            "dwell_s", "prior_duration_s").collect()}
    assert got == sequential_alarms(rows, n)


def test_hot_series_are_cut_and_cold_ones_are_not(spark):
    rows = make_rows(5)
    line = timeline(spark, rows, 50)
    counts = line.rows.groupBy("axle_key", "seg").count().collect()
    cold = [r for r in counts if r["axle_key"] != "x0"]
    assert len(cold) == 3 and {r["seg"] for r in cold} == {0}
    assert len(counts) > 6
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["axle_key"] for r in hot_series(df, ["axle_key"], "timestamp", 50).collect()] == ["x0"]


@pytest.mark.parametrize("limit", [5, 10**6])
def test_sequences_and_split(spark, limit):
    rows = make_rows(6)
    line = timeline(spark, rows, limit)
    item = F.col("speed_kmh")
    got = {r["sample_id"]: r["window"] for r in W.sliding_sequences(line, item).rows.collect()}
    parts = {r["sample_id"]: (r["part"], r["window"]) for r in W.fit_val_split(line, item).rows.collect()}
    want, want_parts = {}, {}
    for _, rs in series(rows).items():
        speeds = [r[7] for r in rs]
        for s in range(0, len(rs) - 9, 2):
            want[rs[s + 9][0]] = speeds[s:s + 10]
        cut = int(len(rs) * 0.85)
        for name, lo, hi in (("fit", 0, cut), ("val", cut, len(rs))):
            for s in range(lo, hi - 9, 2):
                want_parts[rs[s + 9][0]] = (name, speeds[s:s + 10])
    assert got == want
    assert parts == want_parts


@pytest.mark.parametrize("limit", [5, 10**6])
def test_motion_features(spark, limit):
    rows = make_rows(7)
    line = W.brake_activity(W.acceleration(with_ordinal(timeline(spark, rows, limit))))
    got = {r["sample_id"]: (r["acceleration"], r["brake_activity"]) for r in line.rows.collect()}
    for _, rs in series(rows).items():
        v = [r[7] / 3.6 for r in rs]
        last, peak = len(v) - 1, 0.0
        for i, r in enumerate(rs):
            lo, hi = max(i - 1, 0), min(i + 1, last)
            accel = (v[hi] - v[lo]) / (2.0 * (hi - lo)) if hi > lo else 0.0
            peak = max(min(max(-accel / 1.1, 0.0), 1.0), peak * 0.88)
            a, b = got[r[0]]
            assert math.isclose(a, accel, abs_tol=1e-9)
            assert math.isclose(b, peak, rel_tol=1e-9, abs_tol=1e-12)


def test_window_counts_of_the_published_split(spark):
    """1,500 ticks per axle: 1,200 train rows give 506 and 86 windows, 300 test rows give 146."""
    base = spark.range(1500).select(
        F.col("id").alias("sample_id"), F.lit("a").alias("axle_key"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 2).alias("timestamp"),
        F.col("id").cast("double").alias("v"))
    order = ["timestamp", "sample_id"]
    train = Timeline.of(base.where("sample_id < 1200"), ["axle_key"], "timestamp", order, 100)
    test = Timeline.of(base.where("sample_id >= 1200"), ["axle_key"], "timestamp", order, 100)
    parts = {r["part"]: r["count"] for r in
             W.fit_val_split(train, F.col("v")).rows.groupBy("part").count().collect()}
    assert parts == {"fit": 506, "val": 86}
    assert W.sliding_sequences(test, F.col("v")).rows.count() == 146


def test_global_rank_and_percentile(spark):
    rng = random.Random(8)
    values = [(i, float(rng.choice([1, 1, 1, 2, 5, rng.random()]))) for i in range(500)]
    df = spark.createDataFrame(values, "id long, v double").repartition(7)
    got = {r["id"]: r["rank"] for r in global_rank(df, ["v", "id"], "rank").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in values))}
    import numpy as np
    p = exact_percentile(df, "v", 0.99, ["id"]).first()["percentile"]
    assert math.isclose(p, float(np.percentile([v for _, v in values], 99.0)), rel_tol=1e-12)


def test_running_sums_in_blocks(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") * 3).alias("v"))
    out = running_sums(df, ["k"], "t", {"s": "v"}, block=7).collect()
    assert all(r["s"] == 3 * r["t"] * (r["t"] + 1) // 2 for r in out)


def test_repeat_numbers_do_not_depend_on_blocks(spark):
    rows = [(i, f"a{i % 5}", i // 5, "d1" if i % 3 else "d2") for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, axle string, tick long, defect_id string")
    one = {r["sample_id"]: r["repeat_no"] for r in A.defect_repeats(df, block=2).collect()}
    all_ = {r["sample_id"]: r["repeat_no"] for r in A.defect_repeats(df).collect()}
    assert one == all_ and max(one.values()) == 40
