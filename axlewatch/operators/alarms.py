"""From raw predictions to alarms: hysteresis, dwell time, change events, priority, defects.

States follow each axle in the order of its Timeline; durations are differences of timestamps, and `tick`
is the common clock of all axles (`windows.Clock`). An axle's state (candidate, count, settled class)
crosses segment borders as carries, so one axle may be arbitrarily long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.joins import HAIR_KM, IntervalIndex, first_match
from axlewatch.operators.segments import SegmentWindows, Timeline, with_neighbours
from axlewatch.operators.windows import Clock
from axlewatch.schemas import HYSTERESIS

NORMAL = "normal"
REACH_BLOCK_KM = 16.0    # a line with very many defects is cut into such stretches to find neighbours


def settle(line: Timeline, hysteresis: int = HYSTERESIS) -> Timeline:
    """Adds candidate, settled, prior_settled, stable and changed.

    A class settles after `hysteresis` certain rows in a row; uncertain rows neither advance nor
    reset the count.
    """
    upto, before = line.upto(), line.before()
    certain = F.col("pred").isNotNull() & ~F.col("uncertain")
    said = F.last("_said", ignorenulls=True)
    runs = line.with_rows(
        line.rows
        .withColumn("_said", F.when(certain, F.col("pred")))
        .withColumn("_cc", F.sum(F.when(certain, 1).otherwise(0)).over(upto))
        .withColumn("_was", said.over(before))
        .withColumn("_now", said.over(upto))
        # certain rows before the current run; NULL in the run that may go on from the past
        .withColumn("_base", F.max(F.when(
            certain & (F.col("_said") != F.col("_was")), F.col("_cc") - 1)).over(upto))
        .withColumn("_len", F.col("_cc") - F.coalesce("_base", F.lit(0)))
    )
    tick = F.struct(*line.order)    # the place in the series; a tick may hold several readings
    inner = F.col("_said").isNotNull() & F.col("_base").isNotNull() & (F.col("_len") >= hysteresis)
    aggregates = {
        "_first_class": F.min_by("_said", F.when(certain, tick)),
        "_last_class": F.max_by("_said", F.when(certain, tick)),
        "_certain": F.max("_cc"),
        "_last_base": F.max("_base"),
        "_head": F.max(F.when(F.col("_base").isNull(), F.col("_cc"))),
        "_inner_settled": F.max_by("_said", F.when(inner, tick)),
    }

    def derive(s: DataFrame, w: SegmentWindows) -> DataFrame:
        head_goes_on = F.col("_first_class") == F.col("_cand_in")
        tail = F.col("_certain") - F.coalesce("_last_base", F.lit(0))
        restarts = (F.col("_certain") > 0) & (
            F.col("_last_base").isNotNull() | ~F.col("_first_class").eqNullSafe(F.col("_cand_in")))
        return (
            s.withColumn("_cand_in", F.last("_last_class", ignorenulls=True).over(w.before()))
            .withColumn("_sum", F.sum(tail).over(w.upto()))
            .withColumn("_from", F.last(
                F.when(restarts, F.col("_sum") - tail), ignorenulls=True).over(w.upto()))
            .withColumn("_count_in", F.coalesce(
                F.lag(F.col("_sum") - F.coalesce("_from", F.lit(0))).over(w.ordered()), F.lit(0)))
            .withColumn("_head_full", F.coalesce("_head", F.lit(0))
                        + F.when(head_goes_on, F.col("_count_in")).otherwise(0))
            .withColumn("_settles", F.coalesce("_inner_settled", F.when(
                (F.col("_certain") > 0) & (F.col("_head_full") >= hysteresis), F.col("_first_class"))))
            .withColumn("_settled_in", F.last("_settles", ignorenulls=True).over(w.before()))
        )

    out = runs.carry(
        aggregates, derive, {"_cand_in": "string", "_count_in": "long", "_settled_in": "string"})
    from_past = F.col("_base").isNull() & (
        F.col("_now").isNull() | (F.col("_now") == F.col("_cand_in")))
    settles = F.last(F.when(F.col("_said").isNotNull() & F.col("stable"), F.col("_said")),
                     ignorenulls=True)
    rows = (
        out.rows
        .withColumn("candidate", F.coalesce("_now", "_cand_in"))
        .withColumn("stable", F.col("_len") + F.when(
            from_past, F.coalesce("_count_in", F.lit(0))).otherwise(0) >= hysteresis)
        .withColumn("settled", F.coalesce(settles.over(upto), F.col("_settled_in")))
        .withColumn("prior_settled", F.coalesce(settles.over(before), F.col("_settled_in")))
        .withColumn("changed", ~F.col("settled").eqNullSafe(F.col("prior_settled")))
    )
    return out.with_rows(rows.drop(
        "_said", "_cc", "_was", "_now", "_base", "_len", "_cand_in", "_count_in", "_settled_in"))


def seconds(micros):
    """Seconds to one decimal, rounded half up on whole microseconds."""
    return F.floor((micros + 50_000) / 100_000) / 10


def dwell(line: Timeline, start_us: int | None = None) -> Timeline:
    """Adds dwell_s (age of the settled state) and prior_duration_s (age of the one before).

    Both are differences of timestamps; before anything has settled they count from the start of the
    run (by default the first reading of all axles).
    """
    start_us = Clock.of(line.rows).start_us if start_us is None else start_us
    now = F.unix_micros("timestamp")
    mark = F.when(F.col("changed"), now)
    out = line.carry(
        {"_mark": F.max(mark)},
        lambda s, w: s.withColumn("_since_in", F.max("_mark").over(w.before())), {"_since_in": "long"})
    since = lambda w: F.coalesce(F.max(mark).over(w), F.col("_since_in"), F.lit(start_us))
    rows = (
        out.rows
        .withColumn("dwell_s", seconds(now - since(line.upto())))
        .withColumn("prior_duration_s", seconds(now - since(line.before())))
    )
    return out.with_rows(rows.drop("_since_in"))


def alarm_states(line: Timeline, hysteresis: int = HYSTERESIS,
                 start_us: int | None = None) -> Timeline:
    """Settled state, dwell time and current priority of every row."""
    out = dwell(settle(line, hysteresis), start_us)
    score = F.when(
        is_faulty(), X.alarm_priority(F.col("severity"), F.col("dwell_s"), F.col("conf")))
    return out.with_rows(
        out.rows.withColumn("priority", score)
        .withColumn("priority_level", X.priority_level(F.col("priority"))))


def is_faulty():
    return F.coalesce(F.col("settled") != NORMAL, F.lit(False))


def alarm_events(states: DataFrame) -> DataFrame:
    """One row per change of the settled class, except a first settling to normal.

    `prior_duration_s` is the duration of the *prior* state; priority counts no duration.
    """
    return states.where(is_event()).select(*event_columns(), "track_km")


def is_event() -> Column:
    return F.expr("changed and not (prior_settled is null and settled = 'normal')")


def event_columns() -> list[Column]:
    alarm = F.col("settled") != NORMAL
    return [
        F.col("sample_id"), F.col("timestamp"), F.col("tick"), F.col("axle_key").alias("axle"), F.col("line_id"), F.col("train_id"),
        F.col("prior_settled").alias("prior"), F.col("settled").alias("new"),
        F.round("conf", 3).alias("conf"), F.col("severity"), F.col("next_station").alias("station"),
        F.when(alarm, "alarm").otherwise("temizlendi").alias("kind"),
        F.col("prior_duration_s"),
        F.when(alarm, X.alarm_priority(F.col("severity"), F.lit(0.0), F.col("conf"))).alias("priority"),
    ]


def defect_reaches(defects: DataFrame, slack_km: float, block: int = 4096) -> DataFrame:
    """The stretch of its line on which a defect is the nearest one and within tolerance: low, high, item.

    The item holds the neighbours on either side, so that the nearest can be told exactly.
    """
    # of defects at one place only the first listed can be the nearest
    first = (
        defects.groupBy("line_id", "km").agg(F.min(F.struct("ord", "defect_id", "width_km", "between_text")).alias("_d"))
        .select("line_id", "km", "_d.*").withColumn("_here", F.struct("km", "ord")))
    most = first.groupBy("line_id").count().agg(F.max("count")).first()[0] or 0
    cut = most >= block
    span = F.floor(F.col("km") / REACH_BLOCK_KM).cast("long") if cut else F.lit(0).cast("long")
    line = Timeline(first.withColumn("seg", span).withColumn("hot", F.lit(cut)), ("line_id",), ("km",), segmented=cut)
    out = with_neighbours(line, "_here", "km", "_before", "_after").rows
    tolerance = F.col("width_km") + slack_km
    return out.select(
        "line_id",
        (F.greatest(F.col("km") - tolerance, (F.col("km") + F.col("_before.km")) / 2) - HAIR_KM).alias("low"),
        (F.least(F.col("km") + tolerance, (F.col("km") + F.col("_after.km")) / 2) + HAIR_KM).alias("high"),
        F.struct("ord", "defect_id", "km", "width_km", "between_text", "_before", "_after").alias("item"))


def nearest_defect(rows: DataFrame, defects: DataFrame, slack_km: float = 0.8) -> DataFrame:
    """Defect nearest by |km| on the row's line (first listed on ties), then the distance test.

    Each defect is looked up only on the stretch where it is the nearest, so a row meets one defect, at a border two,
    however many a line has and however wide they are.
    `defects` has line_id, defect_id, km, width_km, between_text, ord.
    """
    reaches = IntervalIndex(
        defect_reaches(defects, slack_km), "line_id", F.col("low"), F.col("high"), F.col("item"))
    away = lambda km: F.abs(km - F.col("track_km"))

    def wins(d: Column, other: Column) -> Column:
        mine, theirs = away(d["km"]), away(other["km"])
        return other.isNull() | (mine < theirs) | ((mine == theirs) & (d["ord"] < other["ord"]))

    hit = first_match("_defects", lambda d: (
        (away(d["km"]) <= d["width_km"] + slack_km) & wins(d, d["_before"]) & wins(d, d["_after"])))
    return (
        reaches.attach(rows, F.col("track_km"), "_defects")
        .withColumn("_hit", hit)
        .withColumn("defect_id", F.col("_hit.defect_id"))
        .withColumn("defect_between", F.col("_hit.between_text"))
        .withColumn("defect_distance", away(F.col("_hit.km")))
        .drop("_defects", "_hit")
    )


def link_defects(events: DataFrame, defects: DataFrame) -> DataFrame:
    """Links rail-crack events to fixed defects and leaves other events unlinked."""
    linked = nearest_defect(events, defects)
    crack = F.col("new") == "rail_crack"
    for c in ("defect_id", "defect_between"):
        linked = linked.withColumn(c, F.when(crack, F.col(c)))
    return linked.drop("defect_distance")


def defect_repeats(linked: DataFrame, block: int = 4096) -> DataFrame:
    """n-th detection of its defect, in (tick, axle) order.

    Counted in two levels (blocks of ticks, then inside a block), so a defect that collects a
    third of all events is no single task.
    """
    found = linked.where(F.col("defect_id").isNotNull()).withColumn("_b", F.floor(F.col("tick") / block))
    earlier = Window.partitionBy("defect_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        found.groupBy("defect_id", "_b").agg(F.count("*").alias("_n"))
        .select("defect_id", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"))
    )
    inside = Window.partitionBy("defect_id", "_b").orderBy("tick", "axle", "sample_id")
    return (
        found.join(starts, ["defect_id", "_b"])
        .withColumn("repeat_no", (F.row_number().over(inside) + F.col("_at")).cast("long"))
        .drop("_b", "_at")
    )


def defect_detection_counts(linked: DataFrame, defects: DataFrame) -> DataFrame:
    """Detections per defect with the text of the defect, most detected first."""
    counts = linked.where(F.col("defect_id").isNotNull()).groupBy("defect_id").agg(
        F.count("*").alias("detections"))
    names = defects.select("defect_id", "between_text")
    return counts.join(names, "defect_id", "left").orderBy(F.desc("detections"), "defect_id")


def top_alarms_per_tick(states: DataFrame, size: int = 12) -> DataFrame:
    """The `size` most urgent faulty axles of each tick (ties in axle order)."""
    place = Window.partitionBy("tick").orderBy(F.desc("priority"), "axle_key", "sample_id")
    return (
        states.where(F.col("priority").isNotNull())
        .select("tick", "axle_key", "sample_id", "line_id", "settled", "severity", F.round("conf", 4).alias("conf"),
                "priority", "priority_level", "dwell_s", F.col("next_station").alias("station"))
        # rank <= n right above the window lets Spark cut each tick before the shuffle
        .withColumn("place", F.row_number().over(place)).where(F.col("place") <= size)
        .withColumn("place", F.col("place").cast("long"))
    )


def recent_events(events: DataFrame, size: int = 200) -> DataFrame:
    """Newest events first."""
    return events.orderBy(F.desc("tick"), F.desc("axle"), F.desc("sample_id")).limit(size)


def active_alarm_count(states: DataFrame) -> DataFrame:
    return states.groupBy("tick").agg(F.count_if(is_faulty()).alias("active_alarms"))


def alarm_duration(events: Timeline) -> DataFrame:
    """Seconds from each alarm to the next event of the same axle (NULL while it lasts).

    `events` is a timeline of events, in order of time.
    """
    out = with_neighbours(events, "timestamp", "timestamp", "_before", "_after").rows
    seconds = (F.unix_micros("_after") - F.unix_micros("timestamp")) / 1e6
    return out.where("kind = 'alarm'").select(
        "sample_id", "axle", "new", "tick", seconds.alias("alarm_s"))


def train_status(states: DataFrame) -> DataFrame:
    """Per tick and train with a known position: axles, faulty axles, class of the first faulty."""
    return (
        states.where("lat is not null and lon is not null")
        .groupBy("tick", "train_id")
        .agg(F.count("*").alias("axles"), F.count_if(is_faulty()).alias("faulty"),
             F.min_by("settled", F.when(is_faulty(), F.struct("axle_key", "sample_id"))).alias("shown_class"))
    )


def line_status(states: DataFrame) -> DataFrame:
    """Per tick and line (`?` when unknown): axles, faulty axles, position of the lead axle."""
    lead = lambda c: F.min_by(c, F.struct("axle_key", "sample_id"))
    return (
        states.withColumn("line", F.coalesce("line_id", F.lit("?")))
        .groupBy("tick", "line")
        .agg(F.count("*").alias("axles"), F.count_if(is_faulty()).alias("faulty"),
             lead("train_id").alias("train_id"), lead("next_station").alias("station"),
             lead("track_km").alias("km"), lead("at_station").alias("at_station"))
    )


def top_anomalies(rows: DataFrame, size: int = 10) -> DataFrame:
    return (
        rows.where("anomaly")
        .select("sample_id", "axle_key", "line_id", "anomaly_score", "anomaly_error")
        .orderBy(F.desc("anomaly_score"), F.desc("anomaly_error"), "sample_id").limit(size)
    )
