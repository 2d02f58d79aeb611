"""Sharding by histogram sort: shards are ranges of one sorted order, with nearly equal bytes.

Rows are ordered by (hash of the text, doc_id, place), so equal texts stand together and every row has a
place of its own. Splitters are found without sorting: a round counts, in every partition, the exact bytes
and rows below each candidate boundary, Spark adds the counts up, and only the interval that holds a target
is probed again. Probes divide the hash first; where one text is too heavy for a boundary beside it, they
divide the ids of its copies, then their places. A splitter is done when the bytes below it are within
`tolerance` of a shard, or when a single row is left in its interval. Then rows move once.

A shard is cut into pieces of about `piece_bytes`, found as splitters in the same rounds, so no task holds a whole shard;
slots continue from piece to piece by the counted rows.

Defined results: a null text has no bytes and stands with the empty ones; a null id stands before all others; repeated rows are rows
of their own; a row larger than a shard leaves its neighbours empty; an empty table gives no rows; all columns of
the table come back inside `row`, so no name can clash.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import stored

LEVELS = ("k0", "k1", "k2")
LOWEST, HIGHEST = -(2 ** 63), 2 ** 63 - 1
MOST_PIECES, MOST_PROBES = 1 << 16, 1 << 20     # held on the driver, whatever the number of rows


class Splitter:
    """One boundary: rows with a key below it belong left. `prefix` fixes the levels already settled."""

    def __init__(self, target: float, spans: list[tuple[int, int]], total: int, rows: int):
        self.target, self.spans = target, spans         # spans: least value and first value beyond, by level
        self.prefix: tuple[int, ...] = ()
        self.low, self.high = spans[0]                  # the boundary at this level lies in (low, high]
        self.below, self.upto = 0, total                # bytes below low and below high
        self.rows_below, self.rows_upto = 0, rows
        self.key: tuple[int, ...] | None = None

    def probes(self, count: int) -> list[int]:
        width = self.high - self.low
        steps = min(count, width - 1)
        return [self.low + width * i // (steps + 1) for i in range(1, steps + 1)]

    def settle(self, value: int, below: int, rows: int) -> None:
        key = (*self.prefix, value)
        while key[-1] > HIGHEST and len(key) > 1:       # past the last value of a level: the next one of the level above
            key = (*key[:-2], key[-2] + 1)
        self.key = key if key[-1] <= HIGHEST else (HIGHEST,) * 3
        self.below, self.rows_below = below, rows

    def narrow(self, probes: list[int], below: list[int], rows: list[int], slack: float) -> None:
        """Takes the counts at the probes; ends, or goes on inside the interval that holds the target."""
        edges = [self.low, *probes, self.high]
        sums = [self.below, *below, self.upto]
        counts = [self.rows_below, *rows, self.rows_upto]
        best = min(range(len(edges)), key=lambda i: abs(sums[i] - self.target))
        at = max(i for i in range(len(edges) - 1) if sums[i] <= self.target)
        single = counts[at + 1] - counts[at] <= 1
        if abs(sums[best] - self.target) <= slack or single:
            self.settle(edges[best], sums[best], counts[best])
            return
        self.low, self.high = edges[at], edges[at + 1]
        self.below, self.upto = sums[at], sums[at + 1]
        self.rows_below, self.rows_upto = counts[at], counts[at + 1]
        if self.high - self.low == 1:       # one value holds the target: divide its rows by the next level
            self.prefix = (*self.prefix, self.low)
            self.low, self.high = self.spans[len(self.prefix)]


def matching(columns: list[np.ndarray], prefix: tuple[int, ...]) -> np.ndarray:
    mask = np.ones(len(columns[0]), dtype=bool)
    for column, value in zip(columns, prefix):
        mask &= column == value
    return mask


def count_between(keys: DataFrame, asked: dict[tuple[int, ...], list[int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(prefix number, place) -> (bytes, rows) between neighbouring walls of each prefix, over all rows."""
    def run(batches):
        sums = [np.zeros((2, len(walls) + 1), dtype=np.int64) for walls in asked.values()]
        walls = [np.array(w, dtype=np.int64) for w in asked.values()]
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            for total, wall, prefix in zip(sums, walls, asked):
                mask = matching(columns, prefix)
                place = np.searchsorted(wall, columns[len(prefix)][mask], side="right")
                # a batch's bytes are far below 2^53, so the doubles are exact
                total[0] += np.bincount(place, weights=sizes[mask], minlength=total.shape[1]).astype(np.int64)
                total[1] += np.bincount(place, minlength=total.shape[1])
        for q, total in enumerate(sums):
            at = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), q), pa.int32()), pa.array(at, pa.int32()), pa.array(total[0][at]), pa.array(total[1][at])],
                names=["q", "place", "bytes", "rows"])

    found = (keys.select(*LEVELS, "size").mapInArrow(run, "q int, place int, bytes long, rows long")
             .groupBy("q", "place").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect())
    return {(row["q"], row["place"]): (row["bytes"], row["rows"]) for row in found}


def find_splitters(keys: DataFrame, splitters: list[Splitter], slack: float, probes: int) -> None:
    """Refines the boundaries round by round until each is near enough to its byte target."""
    while open_ := [s for s in splitters if s.key is None]:
        each = min(probes, max(15, MOST_PROBES // len(open_)))
        # splitters that still share an interval share its probes; intervals of one prefix share one search
        sharing = Counter((s.prefix, s.low, s.high) for s in open_)
        asked: dict[tuple[int, ...], set[int]] = {}
        for s in open_:
            inner = s.probes(each * sharing[s.prefix, s.low, s.high])
            asked.setdefault(s.prefix, set()).update(w for w in (s.low, *inner, s.high) if w <= HIGHEST)
        walls = {prefix: sorted(found) for prefix, found in asked.items()}
        between = count_between(keys, walls)
        number = {prefix: q for q, prefix in enumerate(walls)}
        for s in open_:
            wall = walls[s.prefix]
            first, last = bisect_left(wall, s.low), bisect_left(wall, s.high)
            counted = [between.get((number[s.prefix], place), (0, 0)) for place in range(first + 1, last)]
            below = list(accumulate((b for b, _ in counted), initial=s.below))[1:]
            count = list(accumulate((r for _, r in counted), initial=s.rows_below))[1:]
            s.narrow(wall[first + 1:last], below, count, slack)


def piece_of(keys: list[tuple[int, ...]]) -> Column:
    """The number of boundaries at or below a row's key."""
    walls = np.array([key + (LOWEST,) * (3 - len(key)) for key in keys], dtype=np.int64).reshape(-1, 3)
    order = np.lexsort(walls.T[::-1])
    walls = walls[order]

    @F.pandas_udf("int")
    def place(k0: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
        first, second, third = k0.to_numpy(), k1.to_numpy(), k2.to_numpy()
        low = np.searchsorted(walls[:, 0], first, side="left")
        high = np.searchsorted(walls[:, 0], first, side="right")
        out = low.copy()
        for start in np.unique(low[high > low]):        # texts that boundaries cut: as many as boundaries at most
            at = np.flatnonzero((low == start) & (high > low))
            for _, w1, w2 in walls[start:high[at[0]]]:
                out[at] += (second[at] > w1) | ((second[at] == w1) & (third[at] >= w2))
        return pd.Series(out.astype(np.int32))

    return place(*LEVELS)


def shard_rows(df: DataFrame, shards: int = 8, size: Column | None = None, group: Column | None = None,
               ident: Column | None = None, tolerance: float = 1e-4, piece_bytes: int = 1 << 27, probes: int = 255) -> DataFrame:
    """(row, size, shard, slot) for every row: `row` holds the row's columns, slots run from 0 in each shard.

    `size` is a row's weight (bytes of the text plus one), `group` the long that keeps equal rows together
    (a hash of the text) and `ident` the long that orders them (doc_id). The driver holds the splitters: one for
    each `piece_bytes`, and at most MOST_PIECES, beyond which pieces grow.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1 if size is None else size
    group = F.xxhash64(text) if group is None else group
    ident = F.col("doc_id").cast("long") if ident is None else ident
    # places must not move when an executor is lost, so they are stored with the rows
    whole = stored(df.select(F.struct("*").alias("row"), group.alias("k0"), F.coalesce(ident, F.lit(LOWEST)).alias("k1"),
                             F.monotonically_increasing_id().alias("k2"), size.alias("size")))
    keys = whole.select(*LEVELS, "size")
    seen = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows"),
                    *[f(k).alias(f"{f.__name__}_{k}") for k in LEVELS for f in (F.min, F.max)]).first()
    total, rows = seen["bytes"], seen["rows"]
    each = max(1, math.ceil(min(total / piece_bytes, MOST_PIECES) / shards))
    pieces = shards * each
    slack = min(tolerance * total / shards, total / pieces / 8)
    cuts = []
    if rows:
        spans = [(seen[f"min_{k}"], seen[f"max_{k}"] + 1) for k in LEVELS]
        cuts = [Splitter(total * i / pieces, spans, total, rows) for i in range(1, pieces)]
        find_splitters(keys, cuts, slack, probes)
    starts = [0, *(s.rows_below for s in cuts)]
    # rows of its shard before each piece; one row per piece
    before = df.sparkSession.createDataFrame([(p, start - starts[p - p % each]) for p, start in enumerate(starts)],
                                             "piece int, before long")
    moved = (whole.withColumn("piece", piece_of([s.key for s in cuts]))
             .repartitionById(pieces, F.col("piece")).sortWithinPartitions(*LEVELS)
             .withColumn("inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    return moved.join(F.broadcast(before), "piece").select(
        "row", "size", F.floor(F.col("piece") / each).cast("int").alias("shard"),
        (F.col("before") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8) -> None:
    """The documents in order of their slots, a folder per shard."""
    shard_rows(docs, shards).select("shard", "slot", "row.*").write.partitionBy("shard").parquet(folder)


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Places of (doc_id, text) with the size and CRC-32 of the text."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shard_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shards).select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
