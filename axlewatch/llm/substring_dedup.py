"""Removal of long repeated passages by recompression.

A document is a string of word symbols. Rounds replace it by shorter and shorter strings: one kind of
round names maximal runs of a symbol, the other names pairs whose left symbol falls in one half of
the alphabet and whose right symbol falls in the other. A name is a hash of what it stands for, so
every task of a round names alike and the naming is global without an exchange. What happens inside a
stretch of words depends on that stretch alone but for a few symbols at its ends, which are given up
on both sides in every round. So equal windows keep equal interior symbols, wherever they stand.

Each window is anchored at the longest interior symbol of the last round that left it any. Spark
counts anchors: a window whose anchor occurs once is unique. If all occurrences of an anchor have the
same surroundings (its span: every word of every window it anchors), all its windows are repeated.
Otherwise spans that recur are repeated, and the windows of each distinct span are hashed whole and
counted one by one. Nothing is sampled, capped or missed.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has no words; equal rows repeat
each other; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import row_key, stored
from axlewatch.llm.near_dedup import FACTORS, FILTER_BITS, WordHashes, in_filter, key_filter, mixed

ROUNDS = ("run", "pair", "pair", "run", "pair", "pair", "pair")
CHUNK_WORDS = 100_000
BASE = 0x5851F42D4C957F2D      # odd, so it has an inverse modulo 2^64
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


# ---------------------------------------------------------------- one chunk of documents

class Powers:
    """Powers of the base and of its inverse, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate(
                [np.ones(1, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
        return self.up, self.down


def stretch_hashes(words: np.ndarray, powers: Powers):
    """A function (from, to) -> hash of those words, independent of where they stand."""
    up, down = powers.of(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:len(words)])])
    return lambda a, b: mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * FACTORS[4])


def longest(lengths: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each range [left, right) of symbols its longest, ties by name, then the leftmost."""
    rank = (lengths.astype(np.uint64) << np.uint64(56)) | (names >> np.uint64(8))
    best = np.empty(len(left), np.int64)
    level = np.frexp((right - left).astype(np.float64))[1] - 1
    table, width = np.arange(len(rank)), 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        a, b = table[left[at]], table[right[at] - width]
        best[at] = np.where(rank[b] > rank[a], b, a)
        if len(table) > width:
            a, b = table[:-width], table[width:]
            table, width = np.where(rank[b] > rank[a], b, a), 2 * width
        else:
            break
    return best


def anchors(words: np.ndarray, opens: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For documents laid end to end (`opens`: first word of each, and the end): every window's anchor.

    Gives arrays (first word of the window, name of the anchor, first word of the anchor).
    """
    sizes = np.diff(opens)
    counts = np.maximum(sizes - window + 1, 0)
    place = np.repeat(opens[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    name, start = words, np.arange(len(words))
    begins = np.zeros(len(words) + 1, dtype=bool)
    begins[opens] = True
    begins = begins[:-1]
    left, right = place, place + window
    out = []

    def settle(which: np.ndarray) -> None:
        lengths = np.minimum(np.diff(np.append(start, len(words))), 255)
        chosen = longest(lengths, name, left[which], right[which])
        out.append((place[which], name[chosen], start[chosen]))

    for round_, kind in enumerate(ROUNDS):
        if not len(place):
            break
        if kind == "run":
            heads = np.concatenate([[True], (name[1:] != name[:-1]) | begins[1:]])
            at = np.flatnonzero(heads)
            times = np.diff(np.append(at, len(name))).astype(np.uint64)
            fresh = np.where(times > 1, mixed(name[at] * FACTORS[0] + times * FACTORS[1]), name[at])
            index = np.cumsum(heads) - 1
            # the runs at both ends may go on outside the window
            low, high = index[left] + 1, index[right - 1]
        else:
            opening = (mixed(name + np.uint64(round_ + 1) * FACTORS[2]) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(name), dtype=bool)
            joins[:-1] = opening[:-1] & ~opening[1:] & ~begins[1:]
            heads = np.ones(len(name), dtype=bool)
            heads[1:] = ~joins[:-1]
            at = np.flatnonzero(heads)
            follow = name[np.minimum(at + 1, len(name) - 1)]
            fresh = np.where(joins[at], mixed(name[at] * FACTORS[0] + follow * FACTORS[1] + FACTORS[3]), name[at])
            index = np.cumsum(heads) - 1
            # a closing symbol at the left end and an opening one at the right end may pair up outside
            low, high = left + ~opening[left], right - opening[right - 1]
            gone = low >= high
            low, high = index[np.minimum(low, len(name) - 1)], index[np.maximum(high - 1, 0)] + 1
            high[gone] = low[gone]
        gone = low >= high
        if gone.any():
            settle(gone)
        stay = ~gone
        place, left, right = place[stay], low[stay], high[stay]
        name, start, begins = fresh, start[at], begins[at]
    if len(place):
        settle(np.ones(len(place), dtype=bool))
    order = np.argsort(np.concatenate([o[0] for o in out]), kind="stable") if out else np.empty(0, np.int64)
    return tuple(np.concatenate([o[i] for o in out])[order] if out else np.empty(0, np.int64) for i in range(3))


def anchor_rows(words: np.ndarray, opens: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Neighbouring windows of one anchor as one row: (document, name, span hash, first window, last window)."""
    place, name, start = anchors(words, opens, window)
    if not len(place):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (start[1:] != start[:-1]) | (np.diff(place) != 1)])
    at = np.flatnonzero(new)
    first, last = place[at], place[np.append(at[1:], len(place)) - 1]
    span = mixed(stretch_hashes(words, powers)(first, last + window)
                 + (start[at] - first).astype(np.uint64) * FACTORS[0])
    doc = np.searchsorted(opens, first, side="right") - 1
    return doc, name[at].view(np.int64), span.view(np.int64), first - opens[doc], last - opens[doc]


def chunks(texts: list, hashes: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, word hashes, document bounds) for stretches of texts."""
    parts, first, size = [], 0, 0
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        size += len(words)
        if size >= CHUNK_WORDS or i + 1 == len(texts):
            yield first, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            parts, first, size = [], i + 1, 0


def slices(batches, rows: int = 1000):
    """The batches in smaller ones, so that little of them is held as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


# ---------------------------------------------------------------- rounds over all documents

def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(row_key("doc_id", "text").alias("row"), "doc_id", "text")


def anchor_table(rows: DataFrame, window: int, names: DataFrame | None = None) -> DataFrame:
    """One row per anchor; with `names`, of all others only those that slip through a bitmap of fixed size."""
    bits = FILTER_BITS + 3
    seen = None if names is None else rows.sparkSession.sparkContext.broadcast(key_filter(names, bits))

    def run(batches):
        hashes, powers = WordHashes(), Powers()
        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for base, words, opens in chunks(batch.column(1).to_pylist(), hashes):
                doc, name, span, first, last = anchor_rows(words, opens, window, powers)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(keys[base + doc]), pa.array(name), pa.array(span),
                     pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    names=["row", "name", "span", "first", "last"])
                yield out if seen is None else out.filter(pa.array(in_filter(seen.value, out.column(1), bits)))

    return rows.select("row", "text").mapInArrow(run, "row long, name long, span long, first int, last int")


def only_keys(rows: DataFrame, keys: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose key may be (or surely is not) among `keys`, by a bitmap of fixed size; rows stay in place."""
    seen = rows.sparkSession.sparkContext.broadcast(key_filter(keys))
    at = rows.columns.index("row")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(seen.value, batch.column(at)) == inside))

    return rows.mapInArrow(run, rows.schema)


def window_table(rows: DataFrame, unsure: DataFrame, window: int) -> DataFrame:
    """(name, whole, row, first): whole windows of the anchors that differ in their surroundings."""

    def run(batches):
        hashes, powers = WordHashes(), Powers()
        for batch in slices(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            ends = batch.column(2).offsets.to_numpy()
            name, first, last = (f.to_numpy() for f in batch.column(2).flatten().flatten())
            ends = ends - ends[0]
            for base, words, opens in chunks(batch.column(1).to_pylist(), hashes):
                some = slice(ends[base], ends[base + len(opens) - 1])
                counts = last[some].astype(np.int64) - first[some] + 1
                spot = np.repeat(np.arange(len(counts)), counts)
                at = first[some][spot] + np.arange(len(spot)) - (np.cumsum(counts) - counts)[spot]
                doc = np.repeat(np.arange(len(opens) - 1), np.diff(ends[base:base + len(opens)]))[spot]
                whole = stretch_hashes(words, powers)(opens[doc] + at, opens[doc] + at + window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[some][spot]), pa.array(whole.view(np.int64)), pa.array(keys[base + doc]),
                     pa.array(at, pa.int32())], names=["name", "whole", "row", "first"])

    spots = (unsure.select("row", F.struct("name", "first", "last").alias("spot")).distinct()
             .groupBy("row").agg(F.collect_list("spot").alias("spots")))
    return (only_keys(rows.select("row", "text"), spots.select("row")).join(spots, "row")
            .select("row", "text", "spots").mapInArrow(run, "name long, whole long, row long, first int"))


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """(row, spans): per document the runs of windows (first, last) that also start elsewhere.

    Of an anchor with several spans, a span that recurs is repeated as a whole. One occurrence of
    each distinct span has its windows hashed: a window under two spans is repeated, too.
    """
    shared = stored(
        anchor_table(rows, window).groupBy("name")
        .agg(F.count("*").alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
        .where("n > 1").select("name", (F.col("low") != F.col("high")).alias("unsure")))
    table = anchor_table(rows, window, shared.select("name"))
    found = stored(table.join(shared, "name").select(
        "row", "first", "last", *[F.when(F.col("unsure"), F.col(c)).alias(c) for c in ("name", "span")]))
    sure, unsure = found.where("name is null").select("row", "first", "last"), found.where("name is not null")
    place = F.struct("row", "first")
    spans = unsure.groupBy("name", "span").agg(F.count("*").alias("n"), F.min(place).alias("shown"))
    marked = stored(unsure.join(spans, ["name", "span"]).select(
        "row", "name", "first", "last", (F.col("n") > 1).alias("again"), (place == F.col("shown")).alias("shown")))
    windows = stored(window_table(rows, marked.where("shown").select("row", "name", "first", "last"), window))
    twice = windows.groupBy("name", "whole").agg(F.count("*").alias("n")).where("n > 1").select("name", "whole")
    more = windows.join(twice, ["name", "whole"]).select("row", "first", F.col("first").alias("last"))
    return (sure.unionByName(marked.where("again").select("row", "first", "last")).unionByName(more).distinct()
            .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))


def without(words: list[bytes], spans: list[tuple[int, int]], window: int) -> list[bytes]:
    out, past = [], 0
    for first, last in spans:
        out += words[past:max(past, first)]
        past = max(past, last + window)
    return out + words[past:]


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Per row of (doc_id, text): doc_id, words, words removed, and the text of the kept words."""
    rows = keyed(docs)
    spans = stored(repeated_windows(rows, window))

    def run(batches):
        for batch in slices(batches):
            sizes, removed, kept = [], [], []
            marks = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            for text, spots in zip(batch.column(1).to_pylist(), marks, strict=True):
                words = (text or "").encode().split()
                left = without(words, [(s["first"], s["last"]) for s in spots or []], window)
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    # most documents need no join: a bitmap says which surely have no repeats
    clean = only_keys(rows, spans.select("row"), inside=False).select("doc_id", "text").mapInArrow(run, schema)
    marked = (only_keys(rows, spans.select("row")).join(spans, "row", "left")
              .select("doc_id", "text", "spans").mapInArrow(run, schema))
    return clean.unionByName(marked)


def repeats_digest(docs: DataFrame, window: int = 35) -> DataFrame:
    return remove_repeats(docs, window).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
