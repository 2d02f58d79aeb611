"""Small helpers the text operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The batch's texts; a missing one is empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def texts_in_turn(column: pa.Array, step: int = 256) -> Iterator[str]:
    """The texts of a column (a missing one is empty), of which few are held as Python strings at a time."""
    for start in range(0, len(column), step):
        for text in column.slice(start, step).to_pylist():
            yield text or ""


def arrow_rows(df: DataFrame, work: Callable[[list], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """Runs `work` on the rows (as lists of columns) of every Arrow batch; it gives tuples of `schema`."""
    columns = df.columns

    def run(batches):
        for batch in batches:
            rows = work([batch.column(i).to_pylist() for i in range(len(columns))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=t) for c, t in zip(zip(*rows), types, strict=True)]
                if rows else [pa.array([], type=t) for t in types], names=names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names, types = arrow.names, arrow.types
    return df.mapInArrow(run, schema)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, after which freed memory goes back to the system.

    Python workers outlive their tasks, and what idle ones hold counts against the executor.
    """
    def outer(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # only some C libraries have it
        if trim is not None:
            trim(0)

    return outer


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: compressed, and read column by column."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def same(a: Column, b: Column) -> Column:
    """Equality that holds between two nulls."""
    return a.eqNullSafe(b)


def row_key(*columns: str) -> Column:
    """A key that only equal rows share (but for a 64-bit collision)."""
    return F.xxhash64(*columns)
