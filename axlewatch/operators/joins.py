"""Interval, range and lookup joins between telemetry and its dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import sized
from axlewatch.session import checkpointed, stored

SLOW_KMH = 5.0        # fixed value: slower passes do not trigger a defect
HAIR_KM = 1e-6        # widens what is looked up against rounding
LABEL_LEVEL = 0.1     # fixed value: an episode labels a row above this severity


def first_match(items: str | Column, test) -> Column:
    """The least array element that passes `test` (items begin with their place in the list), NULL when none does."""
    return F.array_min(F.filter(items, test))


class IntervalIndex:
    """Closed intervals by key, each listed at the power-of-two level of its length in at most two buckets.

    A point looks up one bucket per level that occurs, so neither a long interval nor a hot key makes a row
    read more than the intervals around it, and no row is multiplied. Levels are few (a factor of a million
    between the shortest and the longest makes 21), their numbers are collected; lengths below 2^-10 share one.
    """

    SHORTEST = -10

    def __init__(self, intervals: DataFrame, key: str, low: Column, high: Column, item: Column) -> None:
        self.key = key
        length = F.greatest(high.cast("double") - low.cast("double"), F.lit(2.0 ** self.SHORTEST))
        width = F.pow(F.lit(2.0), F.col("_level"))
        buckets = F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))
        listed = (
            intervals.where(low <= high)
            .select(key, low.cast("double").alias("_low"), high.cast("double").alias("_high"), item.alias("_item"),
                    F.ceil(F.log2(length)).cast("int").alias("_level"))
            .select(key, "_level", F.explode(buckets).alias("_bucket"), "_item")
            .groupBy(key, "_level", "_bucket").agg(F.collect_list("_item").alias("_items")))
        self.table, self.small = sized(listed, F.size("_items"))
        if not self.small:
            self.table = checkpointed(self.table)       # read once per level
        self.levels = sorted(r["_level"] for r in self.table.select("_level").distinct().collect())
        self.kind = self.table.schema["_items"].dataType

    def attach(self, rows: DataFrame, at: Column, name: str) -> DataFrame:
        """Adds `name`: the items of the buckets that hold the point `at`, in no order."""
        parts, helpers = [], []
        for n, level in enumerate(self.levels):
            bucket, items = f"_bucket{n}", f"_items{n}"
            part = self.table.where(F.col("_level") == level).select(
                self.key, F.col("_bucket").alias(bucket), F.col("_items").alias(items))
            rows = rows.withColumn(bucket, F.floor(at.cast("double") / F.lit(2.0 ** level))).join(
                F.broadcast(part) if self.small else part, [self.key, bucket], "left")
            parts.append(F.coalesce(F.col(items), F.array().cast(self.kind)))
            helpers += [bucket, items]
        return rows.withColumn(name, F.concat(*parts) if parts else F.array().cast(self.kind)).drop(*helpers)


class FirstCover:
    """The least item among the closed intervals of whole steps that hold a step.

    Steps lie in blocks of 128, these in blocks of 128 blocks, and so on. An interval is listed in the blocks of its first
    and its last step; the blocks between them are steps of the next level. In a block only the least of the items that
    cover the same steps is kept, and none behind a lesser one that covers all of its steps, so a block's list is bounded
    however many intervals there are. A row reads one block per level that occurs and carries no list on: only the least
    item so far. Intervals are cut to the steps from `first` to `last`, those that rows have, so levels are few.
    """

    BITS = 7

    def __init__(self, intervals: DataFrame, key: str, low: Column, high: Column, item: Column,
                 first: int | None, last: int | None) -> None:
        self.key = key
        self.kind = intervals.select(item.alias("i")).schema["i"].dataType
        self.levels: list[int] = []
        if first is None:
            return
        cut = intervals.where(F.col(key).isNotNull()).select(
            key, F.ceil(low).cast("long").alias("_from"), F.floor(high).cast("long").alias("_upto"), item.alias("_item")).where(
                (F.col("_from") <= F.col("_upto")) & (F.col("_from") <= last) & (F.col("_upto") >= first)).select(
            key, "_item", F.greatest("_from", F.lit(first)).alias("_low0"), F.least("_upto", F.lit(last)).alias("_high0"))
        block = lambda c: F.shiftright(c, self.BITS)
        place = lambda c: F.col(c).bitwiseAND(F.lit(2 ** self.BITS - 1)).cast("int")
        entries, level = [], 0
        while True:
            low_, high_ = f"_low{level}", f"_high{level}"
            one = block(low_) == block(high_)
            entry = lambda b, x, y: F.struct(
                F.lit(level).alias("_level"), b.alias("_block"), x.alias("_from"), y.alias("_upto"))
            entries += [
                F.when(F.col(low_) <= F.col(high_), entry(
                    block(low_), place(low_), F.when(one, place(high_)).otherwise(F.lit(2 ** self.BITS - 1)))),
                F.when(block(low_) < block(high_), entry(block(high_), F.lit(0), place(high_)))]
            first, last = (first >> self.BITS) + 1, (last >> self.BITS) - 1
            if first > last:
                break
            level += 1
            cut = cut.withColumns({f"_low{level}": block(low_) + 1, f"_high{level}": block(high_) - 1})
        listed = (
            cut.select(key, F.explode(F.array_compact(F.array(*entries))).alias("_at"), "_item").select(key, "_at.*", "_item")
            .groupBy(key, "_level", "_block", "_from", "_upto").agg(F.min("_item").alias("_item"))
            .groupBy(key, "_level", "_block").agg(F.sort_array(F.collect_list(F.struct("_item", "_from", "_upto"))).alias("_items")))
        kind = listed.schema["_items"].dataType
        covered = lambda kept, x: F.exists(kept, lambda y: (y["_from"] <= x["_from"]) & (x["_upto"] <= y["_upto"]))
        listed = listed.withColumn("_items", F.aggregate(
            "_items", F.array().cast(kind), lambda kept, x: F.when(covered(kept, x), kept).otherwise(F.concat(kept, F.array(x)))))
        self.table, self.small = sized(stored(listed, "cover"), F.size("_items"))     # read once per level
        self.levels = sorted(r["_level"] for r in self.table.select("_level").distinct().collect())

    def attach(self, rows: DataFrame, at: Column, name: str) -> DataFrame:
        """Adds `name`: the least item that holds the whole step `at`, NULL where none does."""
        out = rows.withColumn(name, F.lit(None).cast(self.kind))
        step = F.floor(at).cast("long")
        for level in self.levels:
            part = self.table.where(F.col("_level") == level).select(self.key, "_block", "_items")
            unit = F.shiftright(step, self.BITS * level)
            out = out.withColumn("_block", F.shiftright(unit, self.BITS)).join(
                F.broadcast(part) if self.small else part, [self.key, "_block"], "left")
            place = unit.bitwiseAND(F.lit(2 ** self.BITS - 1))
            found = F.get(F.filter("_items", lambda x: (x["_from"] <= place) & (place <= x["_upto"])), F.lit(0))
            out = out.withColumn(name, F.least(F.col(name), found["_item"])).drop("_block", "_items")
        return out


def defect_zone_join(rows: DataFrame, defects: DataFrame) -> DataFrame:
    """First defect whose zone holds the row (|km| within width, moving): severity and label.

    The label becomes rail_crack only for an otherwise normal row.
    """
    # a hair wider than the zone; the test itself is exact
    reach = F.col("width_km") + HAIR_KM
    zones = IntervalIndex(defects, "line_id", F.col("km") - reach, F.col("km") + reach,
                          F.struct("ord", "defect_id", "km", "width_km", "kind"))
    hit = first_match("_defects", lambda d: (
        F.abs(F.col("track_km") - d["km"]) <= d["width_km"]) & (F.col("speed_kmh") > SLOW_KMH))
    takes = F.col("_hit").isNotNull() & (F.col("fault_type") == "normal")
    return (
        zones.attach(rows, F.col("track_km"), "_defects")
        .withColumn("_hit", hit)
        .withColumn("zone_defect", F.col("_hit.defect_id"))
        .withColumn("zone_severity", X.defect_severity(F.col("_hit.kind"), F.col("speed_kmh")))
        .withColumn("zone_label", F.when(takes, "rail_crack").otherwise(F.col("fault_type")))
        .drop("_defects", "_hit")
    )


def episode_label_join(rows: DataFrame, episodes: DataFrame, step: str = "seq", keep: bool = False) -> DataFrame:
    """Labels each row with the first listed episode of its axle that covers its step.

    `episodes` has axle_key, ord, start_step, len_steps, fault_type, all in whole steps; `keep` adds the episode's start
    and length. `rows` are read twice, first for their span of steps.
    """
    at = F.col(step)
    span = rows.agg(F.floor(F.min(at)).cast("long").alias("first"), F.floor(F.max(at)).cast("long").alias("last")).first()
    index = FirstCover(
        episodes, "axle_key", F.col("start_step"), F.ceil(F.col("start_step") + F.col("len_steps")) - 1,
        F.struct("ord", "start_step", "len_steps", "fault_type"), span["first"], span["last"])
    level = X.severity_profile(at, F.col("_e.start_step"), F.col("_e.len_steps"))
    kept = {c: F.col(f"_e.{c}") for c in ("start_step", "len_steps")} if keep else {}
    return (
        index.attach(rows, at, "_e")
        .withColumn("episode_level", F.coalesce(level, F.lit(0.0)))
        .withColumn("episode_label", F.when(
            F.col("episode_level") > LABEL_LEVEL, F.col("_e.fault_type")).otherwise("normal"))
        .withColumn("episode_severity", X.severity_bucket(F.col("episode_level")))
        .withColumns(kept)
        .drop("_e")
    )


def axle_line_map(df: DataFrame) -> DataFrame:
    """Line of the first row of each axle."""
    return df.groupBy("axle_key").agg(
        F.min_by("line_id", F.struct("timestamp", "sample_id")).alias("line_id"))
