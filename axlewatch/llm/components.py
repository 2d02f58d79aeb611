"""Connected components over links held in Spark."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.session import checkpointed

PART_ROWS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b): the label is the smallest node of its component.

    Links are few beside the rows they come from, so the tables keep one partition per `PART_ROWS`
    links; with more links there are more partitions. Each round takes the smallest label among a node and its neighbours, then the label's own label,
    so long chains shrink by half. Nothing but the number of changed labels reaches the driver.
    """
    parts = math.ceil(links.count() / PART_ROWS) + 1
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                        .where("a <> b").distinct().coalesce(parts))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("low"))
                          .select(F.col("a").alias("node"), F.least("a", "low").alias("label")).coalesce(parts))
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a")
                .agg(F.min("label").alias("low")).withColumnRenamed("a", "node"))
        step = (labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "low").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = checkpointed(step.join(jump, "label", "left").select(
            "node", "old", F.coalesce(F.least("label", "far"), "label").alias("label")).coalesce(parts))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
