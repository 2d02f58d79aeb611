"""Ordered computations over time series whose longest series does not fit one task.

A plain `Window.partitionBy(axle)` sends the whole history of an axle to one task. Here each long
("hot") series is cut into time segments, window functions run per (key, segment), and what a
segment must know about its past arrives as a *carry*: a few values per segment, aggregated from
the earlier segments of the same key. Series below the limit keep a single segment and need no
carry, so the extra work is in proportion to the hot rows.

Rows are shuffled once, by (key, segment). The carry join uses the same keys, so it adds neither
an exchange nor a sort on the row side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from axlewatch.session import broadcast_rows, checkpointed, segment_rows

HOUR_US = 3_600_000_000


def hot_series(df: DataFrame, key: list[str], ts: str, limit: int,
               granule_us: int = HOUR_US) -> DataFrame:
    """One row per key with more than `limit` rows: time origin and segment length.

    The length follows the densest granule, so a segment holds at most about `limit` rows. At most
    rows/limit keys qualify, which bounds the table.
    """
    granule = F.floor(F.unix_micros(ts) / granule_us)
    density = df.groupBy(*key, granule.alias("_g")).agg(F.count("*").alias("_n"))
    return (
        density.groupBy(*key)
        .agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_peak"), F.min("_g").alias("_first"))
        .where(F.col("_rows") > limit)
        .select(
            *key,
            (F.col("_first") * granule_us).alias("_origin"),
            F.greatest(F.lit(1), F.floor(F.lit(float(granule_us)) * limit / F.col("_peak")))
            .cast("long").alias("_span"))
    )


@dataclass(frozen=True)
class Timeline:
    """Rows with a segment number (`seg`) and the flag `hot` of their series.

    All windows use the same partitioning and order, so a chain of operators shuffles and sorts
    its rows once. The `order` columns must therefore stay among the rows.
    """

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    segmented: bool = True

    @staticmethod
    def of(df: DataFrame, key: list[str], ts: str, order: list[str],
           limit: int | None = None, hot: DataFrame | None = None) -> Timeline:
        """Cuts the series of `df`. Finding the hot ones reads the key and time columns once.

        That pass runs here; pass a stored `hot` table (see `hot_series`) to skip it.
        """
        if hot is None:
            hot = checkpointed(hot_series(df, key, ts, limit or segment_rows(df.sparkSession)))
        if hot.isEmpty():
            rows = df.withColumn("seg", F.lit(0).cast("long")).withColumn("hot", F.lit(False))
            return Timeline(rows, tuple(key), tuple(order), segmented=False)
        seg = F.floor((F.unix_micros(ts) - F.col("_origin")) / F.col("_span"))
        rows = (
            # proven bound: at most (all rows / limit) series are hot
            df.join(F.broadcast(hot), key, "left")
            .withColumn("seg", F.coalesce(seg, F.lit(0)).cast("long"))
            .withColumn("hot", F.col("_origin").isNotNull())
            .drop("_origin", "_span")
        )
        return Timeline(rows, tuple(key), tuple(order))

    def with_rows(self, rows: DataFrame) -> Timeline:
        return replace(self, rows=rows)

    def select(self, *columns: str | Column) -> Timeline:
        return self.with_rows(self.rows.select(*self.key, "seg", "hot", *columns))

    def local(self) -> WindowSpec:
        return Window.partitionBy(*self.key, "seg").orderBy(*self.order)

    def upto(self) -> WindowSpec:
        return self.local().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def before(self) -> WindowSpec:
        return self.local().rowsBetween(Window.unboundedPreceding, -1)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.key, "seg")

    def carry(self, aggregates: Mapping[str, Column],
              derive: Callable[[DataFrame, SegmentWindows], DataFrame],
              columns: Mapping[str, str], rows: DataFrame | None = None) -> Timeline:
        """Join `columns` (name -> type), derived from per-segment aggregates, to the rows.

        Only hot series are aggregated. The carries (one row per hot segment) are checkpointed: a
        chain of carries then stays a chain, where nested plans would double with every step.
        """
        if not self.segmented:
            return self.with_rows(self.rows.withColumns(
                {c: F.lit(None).cast(t) for c, t in columns.items()}))
        keys = [*self.key, "seg"]
        source = self.rows.where("hot") if rows is None else rows
        summary = source.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        carried = derive(summary, SegmentWindows(self.key)).select(
            *keys, *[F.col(c).cast(t) for c, t in columns.items()])
        return self.with_rows(self.rows.join(checkpointed(carried), keys, "left"))


@dataclass(frozen=True)
class SegmentWindows:
    """Windows over the segments of one key (one row per segment)."""

    key: tuple[str, ...]

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy("seg")

    def before(self, segments: int | None = None) -> WindowSpec:
        first = Window.unboundedPreceding if segments is None else -segments
        return self.ordered().rowsBetween(first, -1)

    def upto(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.key)


def with_ordinal(line: Timeline, name: str = "seq", total: str | None = None) -> Timeline:
    """0-based position of each row in its series, and optionally the length of the series."""
    def derive(summary: DataFrame, w: SegmentWindows) -> DataFrame:
        out = summary.withColumn("_off", F.coalesce(F.sum("_n").over(w.before()), F.lit(0)))
        return out.withColumn("_total", F.sum("_n").over(w.whole())) if total else out

    carried = {"_off": "long", "_total": "long"} if total else {"_off": "long"}
    out = line.carry({"_n": F.count("*")}, derive, carried)
    rows = out.rows.withColumn(
        name, F.row_number().over(line.local()) - 1 + F.coalesce("_off", F.lit(0)))
    if total:
        rows = rows.withColumn(total, F.coalesce("_total", F.count("*").over(line.whole())))
    return out.with_rows(rows.withColumn(name, F.col(name).cast("long")).drop(*carried))


def with_neighbours(line: Timeline, value: str, seq: str, before: str, after: str) -> Timeline:
    """`value` of the previous and the next row of the series."""
    kind = line.rows.schema[value].dataType.simpleString()
    out = line.carry(
        {"_first": F.min_by(value, seq), "_last": F.max_by(value, seq)},
        lambda s, w: s.withColumn("_prev", F.lag("_last").over(w.ordered()))
        .withColumn("_next", F.lead("_first").over(w.ordered())),
        {"_prev": kind, "_next": kind})
    rows = (
        out.rows
        .withColumn(before, F.coalesce(F.lag(value).over(line.local()), F.col("_prev")))
        .withColumn(after, F.coalesce(F.lead(value).over(line.local()), F.col("_next")))
    )
    return out.with_rows(rows.drop("_prev", "_next"))


def with_tail(line: Timeline, item: Column, size: int, seq: str, name: str) -> Timeline:
    """Array of the last `size` items (oldest first) up to and including each row."""
    keep = size - 1
    frame = line.local().rowsBetween(-keep, 0)
    if not line.segmented and not line.rows.select(item.alias("v")).schema["v"].nullable:
        return line.with_rows(line.rows.withColumn(name, F.collect_list(item).over(frame)))
    # inside a struct, so that collecting keeps missing items
    picked = line.rows.withColumn("_item", F.struct(F.col(seq).alias("_o"), item.alias("v")))
    ranked = (
        picked.where("hot")
        .withColumn("_r", F.row_number().over(
            Window.partitionBy(*line.key, "seg").orderBy(F.col(seq).desc())))
        .where(F.col("_r") <= keep)
    )
    kind = picked.schema["_item"].dataType.simpleString()
    out = line.with_rows(picked).carry(
        {"_tail": F.sort_array(F.collect_list("_item"))},
        # every segment has a row, so the last `keep` segments always suffice
        lambda s, w: s.withColumn(
            "_past", F.flatten(F.collect_list("_tail").over(w.before(keep)))),
        {"_past": f"array<{kind}>"}, rows=ranked)
    near = F.collect_list("_item").over(frame)
    joined = F.when(
        F.col("_past").isNotNull() & (F.size("_near") < size), F.concat("_past", "_near")
    ).otherwise(F.col("_near"))
    last = F.slice("_all", F.greatest(F.size("_all") - keep, F.lit(1)), size)
    rows = (
        out.rows.withColumn("_near", near)
        .withColumn("_all", joined)
        .withColumn(name, F.transform(last, lambda x: x["v"]))
    )
    return out.with_rows(rows.drop("_item", "_past", "_near", "_all"))


# ---------------------------------------------------------------- whole-table order

def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based dense position of every row in the total order of `order`.

    Rows are range-partitioned by the whole order, so ties on its first column spread too. The
    sorted rows are checkpointed, because positions must survive a lost executor unchanged; only
    one count per partition is summed up afterwards.
    """
    placed = checkpointed(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    return (
        # proven bound: one row per partition
        placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_at"))
        .drop("_id", "_part", "_at")
    )


def running_sums(df: DataFrame, keys: list[str], at: str, sums: Mapping[str, str],
                 block: int = 4096) -> DataFrame:
    """Running sums along the integer column `at`, in two levels.

    Blocks of `block` positions are summed first; only those block totals are ordered per key.
    """
    blocks = df.withColumn("_b", F.floor(F.col(at) / block))
    totals = blocks.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = (Window.partitionBy(*keys, "_b").orderBy(at)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = blocks.join(starts, [*keys, "_b"])
    for n, c in sums.items():
        joined = joined.withColumn(n, F.sum(c).over(inside) + F.col(f"_s_{n}"))
    return joined.drop("_b", *[f"_s_{n}" for n in sums])


def exact_percentile(df: DataFrame, value: str, share: float, tie: list[str],
                     accuracy: int = 100_000) -> DataFrame:
    """Percentile with linear interpolation (one row, column `percentile`).

    A sketch brackets the wanted position; only the rows inside the bracket are ranked, after the
    rows below it are counted. `tie` are identity columns that spread rows of equal value.
    """
    rows = df.select(value, *tie).where(F.col(value).isNotNull())
    margin = 2.0 / accuracy
    ends = [max(share - margin, 0.0), min(share + margin, 1.0)]
    around = rows.agg(
        F.count("*").alias("n"),
        F.percentile_approx(value, ends, accuracy).alias("ends")).first()
    if not around["n"]:
        return rows.agg(F.max(value).cast("double").alias("percentile"))
    spot = (around["n"] - 1) * share
    low, high = around["ends"]
    seen = rows.agg(
        F.count_if(F.col(value) < low).alias("below"), F.count_if(F.col(value) <= high).alias("upto")).first()
    below = seen["below"]
    if below > math.floor(spot) or seen["upto"] <= math.ceil(spot):
        below, near = 0, rows       # the sketch missed: rank everything
    else:
        near = rows.where(F.col(value).between(low, high))
    ranked = global_rank(near, [value, *tie], "_rank").where(
        F.col("_rank").isin(math.floor(spot) - below, math.ceil(spot) - below))
    part = spot - math.floor(spot)
    return ranked.agg((F.min(value) + (F.max(value) - F.min(value)) * part).alias("percentile"))


# ---------------------------------------------------------------- small tables

def sized(dim: DataFrame, items: Column | None = None, limit: int | None = None) -> tuple[DataFrame, bool]:
    """`dim` stored, and whether it is small.

    Small means at most `limit` rows, and at most `limit` array elements in all where `items`
    counts those of a row. The check keeps no more than limit + 1 rows.
    """
    limit = limit or broadcast_rows(dim.sparkSession)
    head = checkpointed(dim.limit(limit + 1))
    size = head.agg(F.count("*").alias("n"), F.sum(F.lit(1) if items is None else items).alias("items")).first()
    small = max(size["n"], size["items"] or 0) <= limit
    return (head if small else dim), small


def sized_broadcast(dim: DataFrame, items: Column | None = None, limit: int | None = None) -> DataFrame:
    """Broadcast `dim` if it is small enough, else leave the join to Spark.

    Beyond the limit Spark joins by shuffle, and splits skewed keys. A small table is computed only once.
    """
    table, small = sized(dim, items, limit)
    return F.broadcast(table) if small else table