"""Session settings the package relies on, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SEGMENT_ROWS_CONF = "axlewatch.segment.rows"
BROADCAST_ROWS_CONF = "axlewatch.broadcast.rows"


def build_session(app: str = "axlewatch", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables that every executor can reach.

    It is the one named by `spark.checkpoint.dir`. Only a local session without one gets its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="axlewatch-checkpoint-")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once into the shared folder, as columns, and read from there by every later pass."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segment_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SEGMENT_ROWS_CONF, "1000000"))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, "200000"))
