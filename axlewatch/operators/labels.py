"""Splits, sample ids, answer keys, label profiles and set checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.functions import exprs as X
from axlewatch.operators.segments import global_rank
from axlewatch.schemas import ID_COLUMNS, LABELS, TICK_SECONDS

SPLIT_SHARE = 0.8  # fixed value: share of the time span that trains


def assign_sample_id(df: DataFrame, order: list[str], name: str = "sample_id") -> DataFrame:
    """0-based dense id in the total order of `order`."""
    return global_rank(df, order, name)


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABELS)


def require_unlabelled(df: DataFrame) -> DataFrame:
    found = [c for c in LABELS if c in df.columns]
    if found:
        raise ValueError(f"stream data must carry no label columns, found {found}")
    return df


def answer_key(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in ID_COLUMNS if c in df.columns], *LABELS)


def stream_and_key(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return require_unlabelled(drop_labels(df)), answer_key(df)


def chronological_split(df: DataFrame, ts: str = "timestamp", share: float = SPLIT_SHARE,
                        step_seconds: float = TICK_SECONDS) -> DataFrame:
    """Adds part = train (before start + share of the duration) or test.

    The duration counts every step, the last one included, so it is one step longer than the span.
    """
    us = F.unix_micros(ts)
    step = int(step_seconds * 1_000_000)
    cut = df.agg((F.min(us) + (F.max(us) - F.min(us) + step) * share).alias("cut")).scalar()
    return df.withColumn("part", F.when(us < cut, "train").otherwise("test"))


def round_floats(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[X.round_even(F.col(c), digits).alias(c) if c in doubles else c for c in df.columns])


def label_distribution(split: DataFrame) -> DataFrame:
    """Counts of both labels overall and per part, in one pass."""
    label = F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in LABELS])).alias("l")
    parts = F.explode(F.array(F.lit("all"), F.col("part"))).alias("part")
    # counting (part, labels) first leaves a few rows to fan out
    small = split.groupBy("part", *LABELS).agg(F.count("*").alias("n"))
    return (
        small.select(label, "part", "n").select("l.*", parts, "n")
        .groupBy("part", "label", "value").agg(F.sum("n").alias("readings"))
    )


def profile_ranges(df: DataFrame) -> DataFrame:
    nulls = reduce(lambda a, b: a + b, [
        F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(
        F.count("*").alias("readings"), nulls.alias("nulls"),
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.min("speed_kmh").alias("min_speed"), F.max("speed_kmh").alias("max_speed"),
        F.avg(X.is_stationary(F.col("speed_kmh")).cast("double")).alias("stationary_share"),
    )


def distinct_counts(df: DataFrame, approximate: bool = False, **columns: str) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(n) for n, c in columns.items()])


def label_union(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct labels of all columns together."""
    return df.select(F.explode(F.array(*columns)).alias("label")).distinct().orderBy("label")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that `right` lacks."""
    return left.distinct().join(right.distinct(), left.columns, "left_anti")


def missing_classes(split: DataFrame, label: str = "fault_type") -> DataFrame:
    """Classes of the whole table that a part lacks."""
    seen = split.groupBy(label).agg(*[
        F.count_if(F.col("part") == p).alias(p) for p in ("train", "test")])
    lacking: list[Column] = [F.when(F.col(p) == 0, F.lit(p)) for p in ("train", "test")]
    return seen.select(label, F.explode(F.array_compact(F.array(*lacking))).alias("missing_in"))


def set_equality(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """One row: ids only on the left, only on the right, and whether the sets are equal."""
    tagged = left.select(column, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(column, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy(column).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.agg(
        F.count_if(F.col("_r") == 0).alias("only_left"),
        F.count_if(F.col("_l") == 0).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def concat_series(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
