"""Scalar expressions of the condition-monitoring model, as Column -> Column functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from axlewatch.schemas import ENTROPY_LIMIT, FEATURES, SEVERITIES

# Physical and scoring constants.
EARTH_RADIUS_KM = 6371.0088
WHEEL_DIAMETER_M = 0.92
STATIONARY_KMH = 0.5
BRAKE_MS2 = 1.1
PRIORITY_WEIGHTS = {"severity": 0.5, "duration": 0.3, "confidence": 0.2}
DURATION_SATURATION_S = 120.0
PRIORITY_LEVELS = [(0.70, "kritik"), (0.50, "yuksek"), (0.30, "orta")]
SEVERITY_LIMITS = [(0.15, "none"), (0.45, "mild"), (0.8, "moderate")]
DEFECT_LEVEL = {"none": 0.0, "mild": 0.3, "moderate": 0.6, "severe": 1.0}


def _ladder(value: Column, steps: list[tuple[float, str]], test, otherwise: str) -> Column:
    out = F
    for limit, name in steps:
        out = out.when(test(value, limit), name)
    return out.otherwise(otherwise)


# ---------------------------------------------------------------- identity and text

def axle_key(train="train_id", wagon="wagon_id", axle="axle_id") -> Column:
    return F.concat(F.col(train), F.lit("/"), F.col(wagon), F.lit("-"), F.col(axle))


def feature_vector() -> Column:
    return F.array(*FEATURES)


def between_text(first: Column, second: Column) -> Column:
    return F.concat_ws(" – ", first, second)


def defect_id(line: Column, km: Column) -> Column:
    # a format pattern rounds the exact binary value, where %.2f rounds its decimal text
    return F.concat(line, F.lit("@"), F.call_function("format_number", km, F.lit("0.00")))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_code(project: Column) -> Column:
    """Leading code of a project name (`M4 …` -> `M4`), MARMARAY, or NULL."""
    first = F.upper(F.split(strip(project), r"(?U)\s+")[0])
    return (
        F.when(first.rlike(r"^[MTF]") & first.rlike(r"[0-9]"), first)
        .when(F.upper(project).contains("MARMARAY"), "MARMARAY")
    )


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def duration_text(seconds: Column) -> Column:
    """`45 sn`, `2 dk`, `2 dk 10 sn`."""
    whole = lambda c: F.floor(c + 0.5).cast("string")
    minutes = F.floor(seconds / 60).cast("string")
    rest = seconds - F.floor(seconds / 60) * 60
    return (
        F.when(seconds < 60, F.concat(whole(seconds), F.lit(" sn")))
        .when(F.floor(rest + 0.5) == 0, F.concat(minutes, F.lit(" dk")))
        .otherwise(F.concat(minutes, F.lit(" dk "), whole(rest), F.lit(" sn")))
    )


# ---------------------------------------------------------------- predictions

def bind(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def softmax(logits: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    shares = lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s))
    return bind(F.array_max(logits), lambda top: bind(
        F.transform(logits, lambda x: F.exp(x - top)), shares))


def argmax(values: Column) -> Column:
    """0-based index of the first largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def normalized_entropy(probs: Column, classes: int | None = None) -> Column:
    """Shannon entropy over ln(k): 0 for a certain prediction, 1 for a uniform one.

    With the number of classes given, the sum is written out and compiles into the stage.
    """
    def add(total: Column, p: Column) -> Column:
        p = F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))
        return total - p * F.ln(p)

    if classes is None:
        return F.aggregate(probs, F.lit(0.0), add) / F.ln(F.size(probs).cast("double"))
    nats = F.lit(0.0)
    for i in range(classes):
        nats = add(nats, F.get(probs, F.lit(i)))
    return nats / math.log(classes)


def is_uncertain(entropy: Column, limit: float = ENTROPY_LIMIT) -> Column:
    return entropy > limit


def severity_code(severity: Column) -> Column:
    """Rank of the severity, 0 for an unknown or missing one."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.greatest(F.coalesce(F.array_position(names, severity), F.lit(1)) - 1, F.lit(0))


def severity_bucket(level: Column) -> Column:
    return _ladder(level, SEVERITY_LIMITS, lambda v, lim: v < lim, "severe")


def severity_profile(step: Column, start: Column, length: Column) -> Column:
    """Triangle over a fault episode: 0 at the start, 1 half way, 0 at the end."""
    part = (step - start) / length
    return F.when(part < 0.5, F.least(F.lit(1.0), part * 2)).otherwise(
        F.greatest(F.lit(0.0), 1 - (part - 0.5) * 2))


def alarm_priority(severity: Column, seconds: Column, conf: Column) -> Column:
    w = PRIORITY_WEIGHTS
    return F.round(
        w["severity"] * (severity_code(severity) / 3.0)
        + w["duration"] * F.least(seconds / DURATION_SATURATION_S, F.lit(1.0))
        + w["confidence"] * conf, 4)


def priority_level(score: Column) -> Column:
    return F.when(score.isNull(), F.lit(None).cast("string")).otherwise(
        _ladder(score, PRIORITY_LEVELS, lambda v, lim: v >= lim, "dusuk"))


# ---------------------------------------------------------------- anomaly layer

def reconstruction_error(actual: Column, rebuilt: Column) -> Column:
    squares = F.zip_with(actual, rebuilt, lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x) / F.size(actual)


def anomaly_score(error: Column, threshold: Column) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), error / (2 * threshold)))
    return F.when(threshold > 0, clipped).otherwise(0.0)


def unknown_anomaly(error: Column, threshold: Column, pred: Column) -> Column:
    return (error > threshold) & (pred == "normal")


# ---------------------------------------------------------------- rounding

def round_even(value: Column, digits: int) -> Column:
    """Rounds the scaled binary value half to even, as the stored telemetry was rounded."""
    return F.rint(value * 10.0 ** digits) / 10.0 ** digits


# ---------------------------------------------------------------- vehicle physics

def is_stationary(speed_kmh: Column) -> Column:
    return speed_kmh < STATIONARY_KMH


def expected_current(speed_kmh: Column, load_ton: Column, accel: Column) -> Column:
    """Current a healthy traction motor draws at this operating point."""
    push, brake = F.greatest(accel, F.lit(0.0)), F.greatest(-accel, F.lit(0.0))
    return 40.0 + 95.0 * push * (load_ton / 30.0) + 0.55 * speed_kmh - 25.0 * brake


def wheel_rotation_hz(speed_kmh: Column) -> Column:
    return F.greatest(speed_kmh, F.lit(1.0)) / 3.6 / (math.pi * WHEEL_DIAMETER_M)


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def defect_severity(kind: Column, speed_kmh: Column) -> Column:
    """Severity of driving over a defect of this kind at this speed."""
    level = F.lit(None).cast("double")
    for name, value in DEFECT_LEVEL.items():
        level = F.when(kind == name, value).otherwise(level)
    return level * F.least(speed_kmh / 50.0, F.lit(1.0))


# ---------------------------------------------------------------- geometry

def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2))
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def ring_bbox(points: Column) -> Column:
    """Bounding box of an array of [lon, lat] points; NULL when it is empty."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    box = F.struct(
        F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"),
        F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"))
    return F.when(F.size(points) > 0, box)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shape_points(geometry: Column, levels: int = 16) -> Column:
    """All [lon, lat] points of a GeoJSON geometry (a VARIANT), whatever its nesting.

    Each step goes one level down: into arrays, `coordinates` and `geometries`. A geometry nested deeper than
    `levels` is an error.
    """
    x = lambda v, path, kind: F.try_variant_get(v, path, kind)
    at = lambda v, path: once(x(v, f"{path}[0]", "double"), lambda lon: F.when(
        lon.isNotNull(), F.array(lon, x(v, f"{path}[1]", "double"))))
    none = F.array().cast("array<variant>")
    # a point geometry's own coordinates are the point
    point = lambda v: F.coalesce(at(v, "$"), at(v, "$.coordinates"))
    below = lambda v: F.coalesce(
        x(v, "$", "array<variant>"), x(v, "$.coordinates", "array<variant>"), x(v, "$.geometries", "array<variant>"), none)
    start = F.struct(F.array(geometry).cast("array<variant>").alias("level"), F.array().cast("array<array<double>>").alias("points"))
    seen = lambda acc: F.transform(acc["level"], lambda v: F.struct(v.alias("v"), point(v).alias("p")))
    step = lambda acc, _: once(seen(acc), lambda nodes: F.struct(
        F.flatten(F.transform(F.filter(nodes, lambda n: n["p"].isNull()), lambda n: below(n["v"]))).alias("level"),
        F.concat(acc["points"], F.transform(F.filter(nodes, lambda n: n["p"].isNotNull()), lambda n: n["p"])).alias("points")))
    deep = F.raise_error(F.lit("geometry nests too deep")).cast("array<array<double>>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, step, lambda walked: F.when(
        F.size(F.filter(walked["level"], lambda v: x(v, "$", "array<variant>").isNotNull())) > 0, deep).otherwise(
            walked["points"]))


def shape_bbox(geometry: Column) -> Column:
    """Bounding box of a GeoJSON geometry of any kind; NULL when it has no point."""
    return once(shape_points(geometry), ring_bbox)


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centroid of a closed ring, mean of its points when it has no area."""
    edges = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda p, q: F.struct(
            (p[0] * q[1] - q[0] * p[1]).alias("c"), (p[0] + q[0]).alias("x"),
            (p[1] + q[1]).alias("y")))
    total = lambda fn: F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + fn(e))
    mean = lambda i: (
        F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[i]) / F.size(ring))
    area2 = total(lambda e: e["c"])
    flat = F.abs(area2) < 1e-12
    return F.struct(
        F.when(flat, mean(0)).otherwise(total(lambda e: e["x"] * e["c"]) / (3 * area2)).alias("lon"),
        F.when(flat, mean(1)).otherwise(total(lambda e: e["y"] * e["c"]) / (3 * area2)).alias("lat"),
    )
