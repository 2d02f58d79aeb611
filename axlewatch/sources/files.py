"""File sources and sinks. Every reader has an explicit schema."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch import schemas
from axlewatch.operators.labels import stream_and_key
from axlewatch.session import checkpointed

# the default of CSV writing would cut times to milliseconds
CSV = {"header": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
LATE = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("late_rows", T.LongType())])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def _or_empty(spark: SparkSession, schema: T.StructType,
              load: Callable[[DataFrameReader], DataFrame]) -> DataFrame:
    """The table, or an empty one while nothing has been stored."""
    try:
        return load(spark.read.schema(schema))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- sources

def scan_telemetry(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, schemas.TELEMETRY, fmt)


def scan_stream_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, schemas.STREAM, fmt)


def scan_answer_key(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, schemas.ANSWER_KEY, fmt)


def last_per_id(key: DataFrame, order: str | Column, name: str = "sample_id") -> DataFrame:
    """Answer key with one row per id; of duplicates the one latest in `order` wins."""
    rest = [c for c in key.columns if c != name]
    return key.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("r")).select(name, "r.*")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def claim(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false if another has created it before."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(place)


def scan_defects(spark: SparkSession, path: str) -> DataFrame:
    """The defect list (a JSON array), or an empty table when there is no file."""
    raw = _or_empty(spark, schemas.DEFECTS, lambda r: r.option("multiLine", True).json(path))
    return raw.select(
        F.col("hat").alias("line_id"), "km",
        F.coalesce("kusur_id", F.concat("hat", F.lit("@"), F.col("km").cast("string"))).alias("defect_id"),
        F.coalesce("genislik_km", F.lit(0.12)).alias("width_km"), F.col("siddet").alias("kind"),
        F.col("arasi").alias("between_text"), "lat", "lon",
        # position in the list, which breaks ties of equal distance
        F.monotonically_increasing_id().alias("ord"))


def scan_history(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The stored alarms, runs and metrics. A filter on run_id reads only that run's folder."""
    tables = (("runs", schemas.RUNS), ("metrics", schemas.METRICS))
    out = {
        name: _or_empty(spark, schema, lambda r, n=name: r.parquet(f"{path}/{n}")).select(*schema.names)
        for name, schema in tables}
    out["alarms"] = scan_alarms(spark, path)
    late = _or_empty(spark, LATE, lambda r: r.parquet(f"{path}/late")).groupBy(F.col("run_id").alias("id")).agg(
        F.sum("late_rows").alias("late_rows"))
    out["runs"] = out["runs"].join(late, "id", "left")
    return out


def _batches(spark: SparkSession, path: str, run: str = "*") -> list[tuple[str, int, int, str]]:
    """(run, first, last, folder) of each folder of alarms that is wholly written: a batch, or a range of batches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/alarms/run_id={run}/batch=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    out = []
    for status in found:
        folder = status.getPath().getParent()
        ends = re.fullmatch(r"batch=(-?\d+)(?:-(\d+))?", folder.getName())
        if ends:
            first = int(ends[1])
            out.append((folder.getParent().getName(), first, int(ends[2] or first), folder.toString()))
    return out


def _shown(batches: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Those that no wider range of the same run holds; so every batch shows once."""
    out, reach = [], {}
    for run, first, last, folder in sorted(batches, key=lambda b: (b[0], b[1], -b[2])):
        if last > reach.get(run, -2):
            out.append((run, first, last, folder))
            reach[run] = last
    return out


def scan_alarms(spark: SparkSession, path: str) -> DataFrame:
    """Stored alarms of all runs, from compacted ranges and from the batches that no range holds yet."""
    folders = [b[3] for b in _shown(_batches(spark, path))]
    if not folders:
        return spark.createDataFrame([], schemas.ALARMS)
    return spark.read.schema(schemas.ALARMS).option("basePath", f"{path}/alarms").parquet(*folders).select(*schemas.ALARMS.names)


def compact_alarms(spark: SparkSession, path: str, run_id: int, file_bytes: int = 128 << 20) -> None:
    """Rewrites the batches of a run as one range of a few files; may run beside the stream and its readers.

    A reader takes a range once it is wholly written and passes over the folders that it holds, a batch written
    again after a failure too. What a range replaced is deleted by the next compaction, so a reader that has listed
    the old folders can finish. The provisional batch -1 stays as it is.
    """
    every = _batches(spark, path, str(run_id))
    shown = _shown(every)
    fs = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for batch in set(every) - set(shown):
        old = path_of(batch[3])
        fs(old).delete(old, True)
    kept = [b for b in shown if b[1] >= 0]
    if len(kept) < 2:
        return
    size = sum(fs(path_of(b[3])).getContentSummary(path_of(b[3])).getLength() for b in kept)
    fields = T.StructType([f for f in schemas.ALARMS.fields if f.name != "run_id"])
    rows = spark.read.schema(fields).parquet(*[b[3] for b in kept])
    (rows.repartition(1 + size // file_bytes, "axle", "tick").write.mode("overwrite")
     .parquet(f"{path}/alarms/run_id={run_id}/batch={kept[0][1]}-{kept[-1][2]}"))


def scan_network(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("lines", "stations")}


# ---------------------------------------------------------------- sinks

def write_split_tables(split: DataFrame, path: str, fmt: str = "parquet") -> None:
    """All rows, partitioned by `part` (train or test)."""
    writer = split.write.mode("overwrite").partitionBy("part").format(fmt)
    (writer.options(**CSV) if fmt == "csv" else writer).save(path)


def write_ranked(split: DataFrame, order: list[str], path: str) -> None:
    """The table sorted in `order`, partitioned by `part`, written once; `scan_ranked` numbers its rows.

    Each part must be a stretch of the order, as in a chronological split.
    """
    (split.repartitionByRange(*order).sortWithinPartitions("part", *order)
     .write.mode("overwrite").partitionBy("part").parquet(path))


def scan_ranked(spark: SparkSession, path: str, name: str = "sample_id", parts: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """A table of `write_ranked` with `name`, the 0-based place of each row in the order of the whole table.

    The place is the row's index in its file plus the rows of earlier files, so it needs no copy and no sort, and
    is the same on every reading. `parts` lists the parts in the order in which they follow each other.
    """
    table = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    task = F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)-", 1).cast("long")
    sizes = table.groupBy(file.alias("_file"), task.alias("_task"), "part").agg(F.count("*").alias("_n"))
    turn = F.array_position(F.array(*map(F.lit, parts)), F.col("part"))
    earlier = Window.orderBy(turn, "_task").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    starts = checkpointed(sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at")))
    rows = table.withColumns({"_file": file, "_row": F.col("_metadata.row_index")})
    return rows.join(F.broadcast(starts), "_file").withColumn(name, F.col("_row") + F.col("_at")).drop("_file", "_row", "_at")


def write_stream_and_key(labelled: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The unlabelled stream and, apart from it, the answer key."""
    for name, frame in zip(("stream", "key"), stream_and_key(labelled)):
        writer = frame.write.mode("overwrite").format(fmt)
        (writer.options(**CSV) if fmt == "csv" else writer).save(f"{path}/{name}")


def append_run(spark: SparkSession, path: str, run_id: int, source: str, blind: bool, hysteresis: int,
               axle_count: int, line_count: int) -> None:
    """One row per run, written when it is opened (and on every restart)."""
    row = spark.createDataFrame(
        [(run_id, None, source, blind, hysteresis, axle_count, line_count)], schemas.RUNS)
    row.withColumn("started", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/runs")


def append_late(spark: SparkSession, path: str, run_id: int, rows: int) -> None:
    """The rows of a replay that came behind the watermark; `scan_history` adds them up per run."""
    spark.createDataFrame([(run_id, rows)], LATE).coalesce(1).write.mode("append").parquet(f"{path}/late")


def alarm_rows(events: DataFrame, run_id: int) -> DataFrame:
    """Events in the stored shape, with the run and the wall-clock time."""
    given = set(events.columns)
    optional = {c: (F.col(c) if c in given else F.lit(None).cast("string")) for c in ("defect_id", "actual")}
    return events.select(
        F.col("sample_id").alias("id"), F.lit(run_id).cast("long").alias("run_id"),
        F.current_timestamp().alias("recorded_at"), F.col("timestamp").alias("sim_time"), "tick", "axle",
        "line_id", "prior", "new", "severity", "conf", "station", "kind", "prior_duration_s", "priority",
        *[c.alias(n) for n, c in optional.items()])


def alarm_writer(path: str, run_id: int):
    """foreachBatch sink of events: one folder per run and batch, so a retried batch replaces itself.

    `compact_alarms` turns the folders into a few files.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = alarm_rows(batch, run_id).drop("run_id")
        rows.write.mode("overwrite").parquet(f"{path}/alarms/run_id={run_id}/batch={batch_id}")
    return write


def metric_writer(path: str, run_id: int):
    """foreachBatch sink of metric snapshots (tick, evaluated, accuracy, … , active_alarms)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.col("tick").alias("id"), F.current_timestamp().alias("recorded_at"), "tick", "evaluated",
            "accuracy", "severity_accuracy", "macro_f1", "active_alarms")
        rows.write.mode("overwrite").parquet(f"{path}/metrics/run_id={run_id}/batch={batch_id}")
    return write


def write_reports(matrix: DataFrame, report: DataFrame, path: str) -> None:
    """Confusion matrix as CSV and report as JSON (a row per class)."""
    matrix.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/confusion_matrix")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def write_network(lines: DataFrame, stations: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").parquet(f"{path}/lines")
    stations.write.mode("overwrite").parquet(f"{path}/stations")


def write_geography(shapes: DataFrame, path: str) -> None:
    """Districts drawn behind the network: name, box, polygons and the number of their vertices."""
    vertices = F.aggregate(F.flatten("polygons"), F.lit(0), lambda n, ring: n + F.size(ring))
    drawn = shapes.where(F.size("polygons") > 0)
    drawn.select("ord", "name", "box", "polygons", vertices.alias("vertices")).write.mode("overwrite").parquet(f"{path}/geography")


def scan_geography(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/geography")
