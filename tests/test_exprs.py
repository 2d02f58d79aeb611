"""Scalar functions against the published small cases."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_entropy(spark):
    assert value(spark, X.normalized_entropy(doubles(1, 0, 0, 0, 0, 0))) < 1e-6
    assert abs(value(spark, X.normalized_entropy(doubles(*[1 / 6] * 6))) - 1) < 1e-9


def test_uncertainty_is_strict(spark):
    assert value(spark, X.is_uncertain(F.lit(0.35))) is False
    assert value(spark, X.is_uncertain(F.lit(0.0), 0.0)) is False
    assert value(spark, X.is_uncertain(F.lit(0.3501))) is True


def test_priority(spark):
    score = lambda sev, s: value(spark, X.alarm_priority(F.lit(sev), F.lit(float(s)), F.lit(0.9)))
    low, long, heavy = score("mild", 0), score("mild", 120), score("severe", 120)
    assert 0 <= low < long < heavy <= 1
    assert score("severe", 600) == heavy
    assert score("no such severity", 0) == score("none", 0) == 0.18
    assert value(spark, X.priority_level(F.lit(heavy))) == "kritik"
    for limit, name in ((0.1, "dusuk"), (0.3, "orta"), (0.5, "yuksek"), (0.7, "kritik")):
        assert value(spark, X.priority_level(F.lit(limit))) == name


def test_anomaly_score(spark):
    for error, limit, want in ((0, .5, 0), (.5, .5, .5), (100, .5, 1), (.1, 0, 0)):
        assert value(spark, X.anomaly_score(F.lit(float(error)), F.lit(float(limit)))) == want


def test_haversine(spark):
    km = value(spark, X.haversine_km(*[F.lit(v) for v in (29.0257, 40.9903, 29.0154, 41.0255)]))
    assert 3.0 < km < 4.5


def test_line_codes(spark):
    names = ["M4 Kadıköy - SGH Metro Hattı", "T1 Kabataş", "m1a Yenikapı", "Marmaray Hattı", "Teleferik", "", None]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in df.select(X.line_code(F.col("p"))).collect()]
    assert got == ["M4", "T1", "M1A", "MARMARAY", None, None, None]


def test_severity(spark):
    for level, name in ((0.1499, "none"), (0.15, "mild"), (0.45, "moderate"), (0.8, "severe")):
        assert value(spark, X.severity_bucket(F.lit(level))) == name
    df = spark.createDataFrame([("none",), ("severe",), ("odd",), (None,)], "s string")
    assert [r[0] for r in df.select(X.severity_code(F.col("s"))).collect()] == [0, 3, 0, 0]
    profile = [value(spark, X.severity_profile(F.lit(float(s)), F.lit(10.0), F.lit(20.0))) for s in (10, 20, 25, 30)]
    assert profile == [0.0, 1.0, 0.5, 0.0]


def test_texts(spark):
    for seconds, text in ((45, "45 sn"), (60, "1 dk"), (130, "2 dk 10 sn")):
        assert value(spark, X.duration_text(F.lit(float(seconds)))) == text
    assert value(spark, X.defect_id(F.lit("M4"), F.lit(42.055))) == f"M4@{42.055:.2f}"
    assert value(spark, X.defect_id(F.lit("M4"), F.lit(1234.5))) == "M4@1234.50"


def test_softmax_and_argmax(spark):
    probs = value(spark, X.softmax(doubles(1000, 1001, 1001)))
    assert abs(sum(probs) - 1) < 1e-12 and probs[1] == probs[2]
    assert value(spark, X.argmax(doubles(1, 3, 3))) == 1


def test_ring(spark):
    square = F.array(*[doubles(*p) for p in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])
    c = value(spark, X.ring_centroid(square))
    assert (round(c["lon"], 9), round(c["lat"], 9)) == (1, 1)
    line = F.array(*[doubles(*p) for p in ((0, 0), (3, 0), (0, 0))])
    assert value(spark, X.ring_centroid(line))["lon"] == 1
    assert value(spark, X.ring_bbox(square))["max_lat"] == 2
    assert value(spark, X.ring_bbox(F.array().cast("array<array<double>>"))) is None


def test_rounding_follows_the_binary_value(spark):
    import numpy as np
    xs = [0.04325, 0.12345, 2.5e-5, 1.00005, 118.49995]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(X.round_even(F.col("x"), 4)).collect()]
    assert got == [float(v) for v in np.round(np.array(xs), 4)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=2, max_size=6))
def test_entropy_is_between_0_and_1(spark_for_hypothesis, weights):
    probs = [w / sum(weights) for w in weights]
    got = value(spark_for_hypothesis, X.normalized_entropy(doubles(*probs)))
    want = -sum(p * math.log(p) for p in probs) / math.log(len(probs))
    assert -1e-12 <= got <= 1 + 1e-9 and abs(got - want) < 1e-9
