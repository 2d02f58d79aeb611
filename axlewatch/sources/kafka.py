"""Kafka messages: key = train_id, value = JSON of the stream row with an ISO timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.operators.labels import require_unlabelled
from axlewatch.schemas import STREAM

TASK_ROWS = 1_000_000
ISO = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def encode_messages(stream: DataFrame) -> DataFrame:
    """Message rows (key, value). Rows with labels are refused."""
    body = require_unlabelled(stream).withColumn(
        "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return body.select(F.col("train_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def decode_messages(messages: DataFrame, schema: T.StructType = STREAM,
                    keep: list[str] | None = None) -> DataFrame:
    """Stream rows of messages. A field that is not of its type becomes NULL, its row stays."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    row = F.from_json(F.col("value").cast("string"), text).alias("_row")
    parsed = messages.select(*[F.col(c).cast("string").alias(c) for c in keep or []], row)
    typed = [
        F.to_timestamp(f"_row.{f.name}", ISO).alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.col(f"_row.{f.name}").try_cast(f.dataType).alias(f.name)
        for f in schema.fields]
    return parsed.select(*(keep or []), *typed)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to number, value by value; what is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def in_topic_order(stream: DataFrame) -> DataFrame:
    """Rows of a train in one task, in time order, as the topic is to hold them."""
    return stream.repartition("train_id").sortWithinPartitions("timestamp")


def topic_slices(stream: DataFrame, task_rows: int = TASK_ROWS) -> list[DataFrame]:
    """The stream cut by time into slices, to be written one after the other.

    Inside a slice a train is in one task; only trains of more than `task_rows` rows make cuts, and all of them together
    have about `task_rows` rows in a slice. Rows of one instant are never cut apart; those without a time come first.
    """
    hot = stream.groupBy("train_id").agg(F.count("*").alias("n")).where(F.col("n") > task_rows)
    total = hot.agg(F.sum("n")).first()[0] or 0
    count = -(-total // task_rows)
    if count < 2:
        return [in_topic_order(stream)]
    at = F.unix_micros("timestamp")
    shares = [i / count for i in range(1, count)]
    long = stream.join(hot.select("train_id"), "train_id", "left_semi")
    found = long.agg(F.percentile_approx(at, shares, max(10_000, 20 * count))).first()[0] or []
    cuts = [F.timestamp_micros(F.lit(c)) for c in sorted(set(found))]
    time = F.col("timestamp")
    bounds = list(zip([None, *cuts], [*cuts, None]))
    slices = []
    for low, high in bounds:
        inside = F.lit(True) if low is None else time >= low
        inside = inside if high is None else inside & (time < high)
        slices.append(in_topic_order(stream.where(inside | time.isNull() if low is None else inside)))
    return slices


def write_topic(stream: DataFrame, servers: str, topic: str, ordered: bool = True, task_rows: int = TASK_ROWS) -> None:
    """Sends every row, keyed by train; ordered, no task holds much more than `task_rows` rows of long trains.

    Readers put rows in event-time order themselves, so a large backfill may go unordered, and
    then without a shuffle.
    """
    for rows in topic_slices(stream, task_rows) if ordered else [stream]:
        (encode_messages(rows).write.format("kafka")
         .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def read_topic(spark: SparkSession, servers: str, topic: str, streaming: bool = False) -> DataFrame:
    """The topic from its earliest offset: all there is now (batch), or as a stream."""
    reader = spark.readStream if streaming else spark.read
    raw = (reader.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", "earliest"))
    return decode_messages(raw.load())
