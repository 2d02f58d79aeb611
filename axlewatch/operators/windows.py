"""Count-based windows, ticks and motion features over axle timelines."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import (
    SegmentWindows, Timeline, global_rank, with_neighbours, with_ordinal, with_tail,
)
from axlewatch.schemas import TICK_SECONDS, WINDOW_ROWS, WINDOW_STRIDE
from axlewatch.session import checkpointed

BRAKE_DECAY = 0.88  # fixed value: share of the brake activity left after one step
FIT_SHARE = 0.85    # fixed value: first part of a series that trains


@dataclass(frozen=True)
class Clock:
    """The common tick of all axles: whole grid steps since the start of the run."""

    start_us: int
    grid_seconds: float = TICK_SECONDS

    @staticmethod
    def of(df: DataFrame, grid_seconds: float = TICK_SECONDS, ts: str = "timestamp") -> Clock:
        """A clock that starts with the first reading (reads the time column once)."""
        first = df.agg(F.min(F.unix_micros(ts))).first()[0]
        return Clock(first or 0, grid_seconds)

    @property
    def step_us(self) -> int:
        return round(self.grid_seconds * 1e6)

    def tick(self, ts: str = "timestamp"):
        return F.floor((F.unix_micros(ts) - self.start_us) / (self.grid_seconds * 1e6)).cast("long")


def rolling_window_state(line: Timeline, item, size: int = WINDOW_ROWS) -> Timeline:
    """Stride-1 buffer of the last `size` rows with its fill level; ready once it is full."""
    out = with_tail(with_ordinal(line), item, size, "seq", "window")
    rows = out.rows.withColumn("fill", F.least(F.col("seq") + 1, F.lit(size)))
    return out.with_rows(rows.withColumn("ready", F.col("fill") == size))


def sliding_sequences(line: Timeline, item, size: int = WINDOW_ROWS,
                      stride: int = WINDOW_STRIDE) -> Timeline:
    """Windows starting at rows 0, stride, 2*stride, … of each series; labels are the last row's."""
    out = with_tail(with_ordinal(line), item, size, "seq", "window")
    first = F.col("seq") - (size - 1)
    return out.with_rows(out.rows.where((first >= 0) & (first % stride == 0)))


def fit_val_split(line: Timeline, item, size: int = WINDOW_ROWS, stride: int = WINDOW_STRIDE,
                  share: float = FIT_SHARE) -> Timeline:
    """Sequences of the first int(n*share) rows (`fit`) and of the rest (`val`), none across.

    Positions restart in each part, so a full window of a part never reaches into the other.
    """
    out = with_tail(with_ordinal(line, "seq", total="_rows"), item, size, "seq", "window")
    cut = F.floor(F.col("_rows") * share)
    rows = (
        out.rows.withColumn("part", F.when(F.col("seq") < cut, "fit").otherwise("val"))
        .withColumn("_first", F.col("seq") - F.when(F.col("part") == "val", cut).otherwise(0)
                    - (size - 1))
    )
    kept = rows.where((F.col("_first") >= 0) & (F.col("_first") % stride == 0))
    return out.with_rows(kept.drop("_rows", "_first"))


def tick_index(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """0-based dense rank of the timestamps, as a table `ts -> tick`."""
    return global_rank(df.select(ts).distinct(), [ts], "tick")


def with_tick(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.join(tick_index(df, ts), ts)


def tick_windows(df: DataFrame, ts: str = "timestamp", length: str = "2 seconds") -> DataFrame:
    """Rows per tumbling event-time window."""
    return df.groupBy(F.window(ts, length).start.alias("window_start")).agg(
        F.count("*").alias("readings"), F.countDistinct("axle_key").alias("axles"))


def last_tick_flag(ticks: DataFrame) -> DataFrame:
    """Marks the last tick of a table with one row per tick (stored, as it is read twice)."""
    ticks = checkpointed(ticks)
    last = ticks.agg(F.max("tick")).scalar()
    return ticks.withColumn("finished", F.col("tick") + 1 >= last + 1)


def recent_series(df: DataFrame, size: int = 90) -> DataFrame:
    """Last `size` rows of each axle."""
    newest = Window.partitionBy("axle_key").orderBy(F.desc("timestamp"), F.desc("sample_id"))
    return (df.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= size)
            .withColumn("age", F.col("age").cast("long")))


def minmax_series(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min-max scales each column over the rows of its axle; a zero range counts as 1.

    Meant for the bounded output of `recent_series`.
    """
    axle = Window.partitionBy("axle_key")
    for c in columns:
        low, high = F.min(c).over(axle), F.max(c).over(axle)
        span = F.when(high == low, 1.0).otherwise(high - low)
        df = df.withColumn(f"{c}_scaled", (F.col(c) - low) / span)
    return df


def acceleration(line: Timeline, tick_seconds: float = TICK_SECONDS) -> Timeline:
    """Derivative of the speed in m/s²: central differences, one-sided at both ends."""
    out = with_neighbours(line, "speed_kmh", "seq", "_v0", "_v2")
    v0, v1, v2 = (F.col(c) / 3.6 for c in ("_v0", "speed_kmh", "_v2"))
    accel = (
        F.when(F.col("_v0").isNull() & F.col("_v2").isNull(), 0.0)
        .when(F.col("_v0").isNull(), (v2 - v1) / tick_seconds)
        .when(F.col("_v2").isNull(), (v1 - v0) / tick_seconds)
        .otherwise((v2 - v0) / (2 * tick_seconds))
    )
    return out.with_rows(out.rows.withColumn("acceleration", accel).drop("_v0", "_v2"))


def brake_activity(line: Timeline, decay: float = BRAKE_DECAY) -> Timeline:
    """Brake use clipped to 0..1 and a peak that decays by `decay` per row.

    peak(i) = max over j <= i of use(j) * decay^(i-j); in logs a running maximum, per segment,
    plus the decayed peak of the segments before.
    """
    step = math.log(decay)
    use = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -F.col("acceleration") / X.BRAKE_MS2))
    base = line.with_rows(
        line.rows.withColumn("brake_use", use)
        .withColumn("_i", F.row_number().over(line.local()))
        .withColumn("_log", F.max(F.when(
            F.col("brake_use") > 0, F.ln("brake_use") - F.col("_i") * step)).over(line.upto())))
    def derive(s: DataFrame, w: SegmentWindows) -> DataFrame:
        start = F.coalesce(F.sum("_rows").over(w.before()), F.lit(0))
        return (s.withColumn("_start", start)
                .withColumn("_past", F.max(F.col("_peak") - F.col("_start") * step).over(w.before())
                            + F.col("_start") * step))

    out = base.carry({"_rows": F.max("_i"), "_peak": F.max("_log")}, derive, {"_past": "double"})
    peak = F.exp(F.greatest("_log", "_past") + F.col("_i") * step)
    rows = out.rows.withColumn("brake_activity", F.coalesce(peak, F.lit(0.0)))
    return out.with_rows(rows.drop("_i", "_log", "_past"))
