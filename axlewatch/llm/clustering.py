"""Centroid clustering over a vector-approximation file, exact to the last integer.

Each vector is kept twice: whole, and as one cell number per dimension. A round reads the cells alone. Tables of
(dimension, cell, centroid), one with the least and one with the largest squared difference, add up to an interval that holds
the distance to each centroid; where one interval ends before all others begin, the vector is assigned unseen. Whole
vectors are fetched, by a join on their keys, where intervals overlap and where the cluster changed: only the
latter move the sums of a cluster, which are carried from round to round, so centroids stay exact.

All arithmetic is in whole numbers, so results do not depend on how rows are dealt. What reaches the driver are
sums per cluster and dimension.

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part;
components beyond 2^27 after scaling are held at that bound, so that distances fit a long; with fewer vectors than
clusters there are as many clusters as vectors; repeated rows count each, as starts too; rows without id come
last among the starts; an inertia beyond a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import stored

LARGEST = 2 ** 27
SENT_ROWS = 20_000      # at most so many rows are broadcast; more are joined by shuffle
SPREAD = 3.0        # inner cells reach so many deviations from the mean; the outer ones hold the rest


# ---------------------------------------------------------------- cells

@dataclass
class Cells:
    """For each dimension the first value of every inner cell, and the least and largest value of every cell."""

    inner: np.ndarray       # (dimensions, cells - 1)
    least: np.ndarray       # (dimensions, cells)
    most: np.ndarray

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, bits: int) -> Cells:
        steps = np.linspace(-SPREAD, SPREAD, 2 ** bits - 1)
        inner = np.ceil(mean[:, None] + deviation[:, None] * steps[None]).astype(np.int64)
        return Cells(inner, np.column_stack([low, inner]), np.column_stack([inner - 1, high]))

    def number(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(edges, column, side="right") for edges, column in zip(self.inner, x.T)]).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, centroid): the least and the largest squared difference."""
        to_least = self.least[:, :, None] - centroids.T[:, None, :]
        to_most = self.most[:, :, None] - centroids.T[:, None, :]
        near = np.maximum(np.maximum(to_least, -to_most), 0)
        return near ** 2, np.maximum(np.abs(to_least), np.abs(to_most)) ** 2


def candidates(cells: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest: those whose interval begins before the first one ends."""
    least = np.zeros((len(cells), near.shape[2]), dtype=np.int64)
    most = np.zeros_like(least)
    for d in range(cells.shape[1]):
        least += near[d][cells[:, d]]
        most += far[d][cells[:, d]]
    return least <= most.min(axis=1)[:, None]


def distances(x: np.ndarray, centroids: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Squared distances to the centroids asked for, the largest long elsewhere."""
    out = np.full(asked.shape, np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        at = np.flatnonzero(asked[:, c])
        out[at, c] = ((x[at] - centroid) ** 2).sum(axis=1)
    return out


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def sent(df: DataFrame) -> DataFrame:
    """Broadcast if counted as small; `df` reads a stored table."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix.astype(np.uint8)], pa.binary())


# ---------------------------------------------------------------- passes

def integer_vectors(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    fine = F.forall("entries", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform("entries", lambda c: F.floor(F.greatest(
        F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * scale))).cast("int"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.transform("embedding", lambda c: c.cast("double")).alias("entries"))
            .where(F.col("entries").isNotNull() & (F.size("entries") == dimensions) & fine)
            .select("vec_id", held.alias("x")))


def fit_cells(rows: DataFrame, dimensions: int, bits: int) -> Cells | None:
    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column(0), dimensions)
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dimensions), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0)),
                     pa.array(x.sum(axis=0).astype(float)), pa.array((x.astype(float) ** 2).sum(axis=0)),
                     pa.array(np.full(dimensions, len(x)))], names=["d", "low", "high", "s", "ss", "n"])

    found = (rows.select("x").mapInArrow(run, "d int, low long, high long, s double, ss double, n long").groupBy("d")
             .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
                  F.sum("n").alias("n")).orderBy("d").toPandas())
    if not len(found):
        return None
    mean = (found["s"] / found["n"]).to_numpy()
    deviation = np.sqrt(np.maximum((found["ss"] / found["n"]).to_numpy() - mean ** 2, 0))
    return Cells.of(found["low"].to_numpy(), found["high"].to_numpy(), mean, deviation, bits)


def compressed(rows: DataFrame, cells: Cells, dimensions: int) -> DataFrame:
    """(key, vec_id, cells, x), stored; a reader of the cells alone reads one byte per dimension."""
    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column(2), dimensions)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), packed(cells.number(x)), batch.column(2)], names=["key", "vec_id", "cells", "x"])

    # the key is written with the row, so it cannot move when an executor is lost
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "x")
    return stored(keyed.mapInArrow(run, "key long, vec_id long, cells binary, x array<int>"))


def judged(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """(key, cells, old, new, maybe): the cluster where the intervals settle it, else -1 and the candidates."""
    near, far = cells.tables(centroids)

    def run(batches):
        for batch in batches:
            key, numbers, old = batch.column(0), batch.column(1), batch.column(2)
            if not len(key):
                continue
            may = candidates(bytes_of(numbers, near.shape[0]), near, far)
            open_ = may.sum(axis=1) > 1
            new = np.where(open_, -1, may.argmax(axis=1))
            maybe = pa.array([row.tobytes() if o else None for row, o in zip(may.astype(np.uint8), open_)], pa.binary())
            yield pa.RecordBatch.from_arrays([key, numbers, old, pa.array(new, pa.int32()), maybe],
                                             names=["key", "cells", "old", "new", "maybe"])

    return stored(state.mapInArrow(run, "key long, cells binary, old int, new int, maybe binary"))


def fetched(file: DataFrame, asked: DataFrame, centroids: np.ndarray) -> DataFrame:
    """What the whole vectors of `asked` tell: (key, cluster) where intervals overlapped, and, with a null key,
    (cluster, place, value): what moves between clusters adds to their sums (place -1: to their counts)."""
    k, dimensions = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dimensions), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            key = batch.column(0)
            if not len(key):
                continue
            old, new = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (1, 2))
            x, open_ = matrix_of(batch.column(4), dimensions), np.flatnonzero(new < 0)
            if len(open_):
                may = bytes_of(batch.column(3).take(pa.array(open_)), k) > 0
                new[open_] = distances(x[open_], centroids, may).argmin(axis=1)     # the first of equals
                yield rows_of(key.take(pa.array(open_)), new[open_], np.zeros(len(open_)), np.zeros(len(open_)))
            moved = old != new
            for clusters, sign in ((new, 1), (old, -1)):
                at = np.flatnonzero(moved & (clusters >= 0))
                np.add.at(sums, clusters[at], sign * x[at])
                np.add.at(counts, clusters[at], sign)
        c, d = np.nonzero(sums)
        yield rows_of(pa.nulls(len(c), pa.int64()), c, d, sums[c, d])
        c = np.flatnonzero(counts)
        yield rows_of(pa.nulls(len(c), pa.int64()), c, np.full(len(c), -1), counts[c])

    def rows_of(key, cluster, place, value):
        return pa.RecordBatch.from_arrays(
            [key, pa.array(cluster, pa.int32()), pa.array(place.astype(np.int32)), pa.array(value.astype(np.int64))],
            names=["key", "cluster", "place", "value"])

    whole = file.select("key", "x").join(sent(asked.select("key", "old", "new", "maybe")), "key")
    return stored(whole.select("key", "old", "new", "maybe", "x").mapInArrow(run, "key long, cluster int, place int, value long"))


def assigned(file: DataFrame, state: DataFrame, cells: Cells, centroids: np.ndarray, moving: bool) -> tuple[DataFrame, DataFrame]:
    """(the state with every vector's cluster as `old`, the changes of the sums); fetches what is needed for them."""
    seen = judged(state, cells, centroids)
    told = fetched(file, seen.where(((F.col("new") != F.col("old")) & F.lit(moving)) | (F.col("new") < 0)), centroids)
    settled = told.where("key is not null").select("key", "cluster")
    after = seen.join(sent(settled), "key", "left").select(
        "key", "cells", F.coalesce("cluster", "new").alias("old"))
    return after, told.where("key is null").groupBy("cluster", "place").agg(F.sum("value").alias("value"))


# ---------------------------------------------------------------- the operator

def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256,
                    bits: int = 8, salt: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of (vec_id, embedding) after `rounds` of Lloyd's method.

    `bits`, at most 8, sets the cells of a dimension; it changes what is fetched, never the result.
    """
    rows = integer_vectors(vectors, dimensions, scale)
    cells = fit_cells(rows, dimensions, bits)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if cells is None:
        return vectors.sparkSession.createDataFrame([], schema)
    file = compressed(rows, cells, dimensions)
    start = (file.select("key", "x", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("hash"))
             .orderBy(F.asc_nulls_last("hash"), "x", "key").limit(clusters).collect())
    centroids = np.array([row["x"] for row in start], dtype=np.int64)
    sums, counts = [[0] * dimensions for _ in start], [0] * len(start)
    state = file.select("key", "cells", F.lit(-1).alias("old"))
    for _ in range(rounds):
        state, changes = assigned(file, state, cells, centroids, moving=True)
        for row in changes.collect():
            if row["place"] < 0:
                counts[row["cluster"]] += row["value"]
            else:
                sums[row["cluster"]][row["place"]] += row["value"]
        centroids = np.array([[s // n for s in total] if n else centroid
                              for total, n, centroid in zip(sums, counts, centroids.tolist())], dtype=np.int64)
    state, _ = assigned(file, state, cells, centroids, moving=False)

    def measure(batches):
        for batch in batches:
            if len(batch):
                x, cluster = matrix_of(batch.column(2), dimensions), batch.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(((x - centroids[cluster]) ** 2).sum(axis=1))],
                                                 names=["vec_id", "cluster", "distance"])

    # distances are part of the result, so here every vector is read
    near = stored(file.select("key", "vec_id", "x").join(state.select("key", F.col("old").alias("cluster")), "key")
                  .select("vec_id", "cluster", "x").mapInArrow(measure, "vec_id long, cluster int, distance long"))
    inertia = {row["cluster"]: int(row["s"]) for row in
               near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda v: v if v < 2 ** 63 else None
    known = vectors.sparkSession.createDataFrame(
        [(c, fits(s), fits(sum(inertia.values())), centroids[c].tolist()) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return near.join(F.broadcast(known), "cluster").select(*[f.split()[0] for f in schema.split(", ")])   # `clusters` rows


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """The clusters, with centroids as a digest."""
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string"))), 256)
    return cluster_vectors(vectors).withColumn("centroid_sha256", digest).drop("centroid")
