"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are n-grams (4, 6 and 8 bytes of the text, A-Z in lower case), by presence. They are held
exactly, as 64-bit integers, so a text never seems to have a kept feature that it lacks. The log-count
ratio of a feature compares the share of toxic and of clean training documents that have it. The
features with the clearest ratios are kept, scaled by it, and weighted by a logistic regression.
Training sees at most `train_docs` labelled documents (those with the smallest hash of their id).
Scoring looks up the kept features in every whole text; the model has a fixed size. Presence grows with
length, so a text longer than nine of ten training documents is scored in windows of that length that
overlap by half, and has the score of its most toxic window: neither does a long clean text fill up with features, nor does a long
text hide a toxic part.

Defined results: a null or empty text has no features and gets the bias; equal rows get equal scores;
an empty table gives no rows; without both classes in the labels every score is the prior; other
columns are ignored. Ids, languages and sources are never inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import arrow_rows, lean, texts_in_turn
from axlewatch.session import checkpointed

LENGTHS = (4, 6, 8)
LONGEST = 0.9       # share of the training documents that one window covers whole
CHUNK = 1 << 19     # bytes looked up at a time
FILTER_BITS = 18    # size of the filter before the exact lookup
OPEN_GRAMS, HELD_GRAMS = 1 << 19, 1 << 20       # n-grams a training task holds: unmerged, and merged
SPREADER = np.uint64(0x9E3779B97F4A7C15)
SCORED = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Model:
    kept: np.ndarray        # the kept n-grams, sorted
    weights: np.ndarray     # per feature, ratio and regression weight in one
    bias: float
    window: int             # bytes scored together, an even number


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Per n-gram length, the n-gram at each position as an integer.

    No byte of UTF-8 is 255, so the high bytes that mark the shorter lengths never occur in a longer one.
    """
    one = data.astype(np.uint64)
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    six = four[:-2] << np.uint64(16) | two[4:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    return [four | np.uint64(0xFFFFFFFF00000000), six | np.uint64(0xFFFF000000000000), eight]


def folded(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode().lower(), dtype=np.uint8)


def chunks(data: np.ndarray):
    """(start, n-grams that begin there or later) of each chunk."""
    for start in range(0, max(1, len(data)), CHUNK):
        for found in grams(data[start:start + CHUNK + LENGTHS[-1] - 1]):
            yield start, found[:CHUNK]


def features(text: str) -> np.ndarray:
    """The distinct n-grams of a text."""
    return np.unique(np.concatenate([np.unique(found) for _, found in chunks(folded(text))]))


def filter_of(kept: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[kept * SPREADER >> np.uint64(64 - FILTER_BITS)] = True
    return seen


def kept_features(text: str, kept: np.ndarray, likely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, number of the kept feature there) of a text."""
    places, numbers = [], []
    for start, found in chunks(folded(text)):
        at = np.flatnonzero(likely[found * SPREADER >> np.uint64(64 - FILTER_BITS)])
        number = np.minimum(np.searchsorted(kept, found[at]), len(kept) - 1)
        same = kept[number] == found[at]
        places.append(at[same] + start)
        numbers.append(number[same])
    return np.concatenate(places), np.concatenate(numbers)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """(text, toxic) of the labelled documents that are not held out, at most `train_docs` ids of them."""
    chosen = (labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    # the chosen labels are few by construction, so the texts stay where they are
    return (docs.select("doc_id", F.col("text").cast("string").alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("text", "toxic"))


def feature_ratios(rows: DataFrame) -> DataFrame:
    """Per n-gram: number of toxic and of clean documents that have it."""

    def merged(parts: list[tuple]) -> tuple:
        grams_ = np.concatenate([p[0] for p in parts])
        order = np.argsort(grams_)
        grams_ = grams_[order]
        first = np.flatnonzero(np.concatenate([[True], grams_[1:] != grams_[:-1]])[:len(grams_)])
        return (grams_[first], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], first) if len(first)
                                 else np.empty(0, np.int32) for k in (1, 2)))

    def run(batches):
        total, open_, size = [], [], 0
        for batch in batches:
            for text, toxic in zip(texts_in_turn(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = features(text)
                hit = np.full(len(found), int(toxic > 0), np.int32)
                open_.append((found, hit, 1 - hit))
                size += len(found)
                if size > OPEN_GRAMS:
                    total, open_, size = [merged(total + open_)], [], 0
                    # a task's table is bounded: what it has counted so far goes on to the shuffle
                    if len(total[0][0]) > HELD_GRAMS:
                        yield counted(total[0])
                        total = []
        if total or open_:
            yield counted(merged(total + open_))

    def counted(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())],
                                          names=["gram", "toxic", "clean"])

    return (rows.mapInArrow(lean(run), "gram long, toxic long, clean long")
            .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def logistic(design: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, strength: float = 0.3,
             steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on the scaled features of each document, by accelerated descent."""
    row = np.repeat(np.arange(len(design)), [len(d) for d in design])
    col = np.concatenate(design) if design else np.empty(0, np.int64)
    value = ratio[col]
    n, k = len(y), len(ratio)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w, bias = np.zeros(k), float(np.log(share / (1 - share)))
    # a power iteration bounds the curvature
    v = np.ones(k) / max(1.0, np.sqrt(k))
    size = 1.0
    for _ in range(15):
        u = np.bincount(col, value * np.bincount(row, value * v[col], n)[row], k)
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    step = 1.0 / (0.25 * size + strength + 0.25 * n)
    look_w, look_b, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * look_w[col], n) + look_b, -50, 50)))
        grad = p - y
        fresh_w = look_w - step * (np.bincount(col, value * grad[row], k) + strength * look_w)
        fresh_b = look_b - step * grad.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look_w = fresh_w + (t - 1) / s * (fresh_w - w)
        look_b = fresh_b + (t - 1) / s * (fresh_b - bias)
        w, bias, t = fresh_w, fresh_b, s
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 20000, kept: int = 2048) -> Model:
    rows = checkpointed(training_rows(docs, labels, train_docs))
    length = F.octet_length(F.coalesce("text", F.lit("")))
    total = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean"),
                     F.percentile(length, LONGEST).alias("length")).first()
    toxic, clean = total["toxic"], total["clean"]
    none = Model(np.empty(0, np.uint64), np.zeros(0), -4.0 if not toxic else 0.0 if clean else 4.0, 2)
    if not toxic or not clean:
        return none
    ratio = (F.log((F.col("toxic") + 1) / F.lit(toxic + 2)) - F.log((F.col("clean") + 1) / F.lit(clean + 2)))
    spread = F.sqrt(1 / (F.col("toxic") + 1) + 1 / (F.col("clean") + 1))
    best = (feature_ratios(rows).withColumn("ratio", ratio).withColumn("clear", F.abs(F.col("ratio")) / spread)
            .orderBy(F.desc("clear"), "gram").limit(kept).select("gram", "ratio").collect())
    grams_ = np.array([r["gram"] for r in best], dtype=np.int64).view(np.uint64)
    order = np.argsort(grams_)
    grams_, ratios = grams_[order], np.array([r["ratio"] for r in best])[order]
    likely = filter_of(grams_)

    def work(columns):
        return [(np.unique(kept_features(text or "", grams_, likely)[1]).tolist(), int(toxic > 0))
                for text, toxic in zip(*columns, strict=True)]

    seen = sorted((tuple(r["found"]), r["toxic"]) for r in
                  arrow_rows(rows, work, "found array<int>, toxic int").collect())
    w, bias = logistic([np.array(f, dtype=np.int64) for f, _ in seen], np.array([t for _, t in seen], float), ratios)
    return Model(grams_, w * ratios, bias, 2 * max(1, math.ceil(total["length"] / 2 + 1)))


def score(text: str, model: Model, likely: np.ndarray | None = None) -> float:
    """The score of a text, or of its most toxic window."""
    total = model.bias
    if len(model.weights):
        place, number = kept_features(text, model.kept, filter_of(model.kept) if likely is None else likely)
        half = model.window // 2
        last = int(len(text.encode()) + 1) // half     # the half window of the last byte, spaces around included
        if last < 2:
            total += float(model.weights[np.unique(number)].sum())
        else:
            # each feature once in each of the windows (block - 1, block) and (block, block + 1)
            pair = np.concatenate([place // half, place // half - 1])
            twice = np.concatenate([number, number])
            inside = (pair >= 0) & (pair < last)
            seen = np.unique(pair[inside] * len(model.kept) + twice[inside])
            sums = np.bincount(seen // len(model.kept), model.weights[seen % len(model.kept)], last)
            total += float(sums.max())
    return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_docs: int = 20000) -> DataFrame:
    """Score of every whole text of (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))

    def work(columns):
        out, likely = [], filter_of(model.value.kept)
        for doc, held, text in zip(*columns, strict=True):
            s = score(text or "", model.value, likely)
            out.append((doc, held, s, int(s >= threshold)))
        return out

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"),
                                  F.col("text").cast("string")), work, SCORED)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_docs: int = 20000) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_docs))
    column = docs.columns.index("text")

    def run(batches):
        likely = filter_of(model.value.kept)
        for batch in batches:
            keep = [score(t, model.value, likely) < threshold for t in texts_in_turn(batch.column(column))]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
