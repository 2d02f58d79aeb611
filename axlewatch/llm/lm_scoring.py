"""Cross-entropy difference of two n-gram models over one vocabulary.

Tokens are the bytes of the UTF-8 text, so both models share a vocabulary of 256 symbols (and a start
sign) that is closed at any corpus size. The background model counts the n-grams of every document,
the target model those of the documents labelled as good; both have the same order and the same
smoothing (each order leans on the next lower one by `lean` pseudo-counts, down to the uniform
distribution). A document's score is its mean loss under the target less its mean loss under the background, in bits
per token: the lower, the more it reads like the target.

The models grow with the corpus and are never sent around whole. Documents are dealt into chunks of
about `chunk_bytes`; a chunk states the n-grams it holds with their counts, Spark sums them, computes
every probability by joins, and hands each chunk the losses of just its own n-grams.

Defined results: a null or empty text has no tokens and null losses; equal rows get equal scores and
count as often as they occur; without good labels the target is uniform; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.llm.base import stored


ORDER = 5
BLOCK = 1 << 20     # n-grams handled at a time
COUNTED = "chunk int, gram long, n_all long, n_target long"
SCORED = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


def grams_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ending at every byte of the texts laid end to end, and the texts' bounds."""
    parts = [(t or "").encode() for t in texts]
    start = bytes(ORDER - 1)
    data = np.frombuffer(b"".join(x for p in parts for x in (start, p)), np.uint8).astype(np.uint64)
    bounds = np.cumsum([0, *map(len, parts)])
    if len(data) < ORDER:
        return np.empty(0, np.uint64), bounds
    gram = data[:len(data) - ORDER + 1].copy()
    for k in range(1, ORDER):
        gram = gram << np.uint64(8) | data[k:len(data) - ORDER + 1 + k]
    # drop what ends in the start signs of the next text
    ends = np.cumsum([len(p) + ORDER - 1 for p in parts])
    keep = np.ones(len(data), dtype=bool)
    for k in range(ORDER - 1):
        keep[np.concatenate([[0], ends[:-1]]) + k] = False
    return gram[keep[ORDER - 1:]], bounds


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("chunk", chunk_of(chunks))


def chunk_of(chunks: int):
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(chunks)).cast("int")


def stretches(texts: list) -> Iterator[tuple[int, list]]:
    """(number of the first text, texts) for stretches of about BLOCK characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK or i + 1 == len(texts):
            yield first, texts[first:i + 1]
            first, size = i + 1, 0


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names with their summed counts."""
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    names, at = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
    return names, np.bincount(at, np.concatenate([c for _, c in parts]), len(names)).astype(np.int64)


def count_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
    """Distinct n-grams of a chunk with their counts in all documents and in the target's."""
    good = set(right.column("doc_id").to_pylist())
    ids, every, target = left.column("doc_id").to_pylist(), [], []
    for first, texts in stretches(left.column("text").to_pylist()):
        gram, bounds = grams_of(texts)
        inside = np.repeat([i in good for i in ids[first:first + len(texts)]], np.diff(bounds))
        every.append(np.unique(gram, return_counts=True))
        target.append(np.unique(gram[inside.astype(bool)], return_counts=True))
        if len(every) > 8:
            every, target = [summed(every)], [summed(target)]
    (names, n_all), (some, n_some) = summed(every), summed(target)
    n_target = np.zeros(len(names), np.int64)
    n_target[np.searchsorted(names, some)] = n_some
    chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
    return pa.table({"chunk": pa.array(np.full(len(names), chunk, np.int32)), "gram": pa.array(names.view(np.int64)),
                     "n_all": pa.array(n_all), "n_target": pa.array(n_target)})


def gram_losses(counts: DataFrame, lean: float) -> DataFrame:
    """(gram, target, background): bits each model spends on the last byte of every n-gram."""
    levels = [counts.groupBy("gram").agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target"))]
    for k in range(ORDER - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        levels.append(levels[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"))
                      .agg(F.sum("n_all").alias("n_all"), F.sum("n_target").alias("n_target")))
    known = None
    for k, level in enumerate(reversed(levels), 1):
        # at most 256 n-grams share a context
        context = Window.partitionBy(F.shiftright("gram", 8))
        level = level.withColumns({f"h_{m}": F.sum(f"n_{m}").over(context) for m in ("all", "target")})
        lower = {m: F.lit(1 / 256) for m in ("all", "target")}
        if known is not None:
            level = level.withColumn("low", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(
                known.select(F.col("gram").alias("low"), F.col("p_all").alias("l_all"),
                             F.col("p_target").alias("l_target")), "low")
            lower = {m: F.col(f"l_{m}") for m in ("all", "target")}
        known = level.select("gram", *[
            ((F.col(f"n_{m}") + lean * lower[m]) / (F.col(f"h_{m}") + lean)).alias(f"p_{m}") for m in ("all", "target")])
    return known.select("gram", (-F.log2("p_target")).alias("target"), (-F.log2("p_all")).alias("background"))


def score_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
    """Mean losses of the documents of a chunk, by the losses of its n-grams."""
    names = right.column("gram").to_numpy()
    by = np.argsort(names)
    names = names[by]
    losses = [right.column(m).to_numpy()[by] for m in ("target", "background")]
    sizes = np.zeros(left.num_rows, np.int64)
    totals = [np.zeros(left.num_rows) for _ in losses]
    for first, texts in stretches(left.column("text").to_pylist()):
        gram, bounds = grams_of(texts)
        sizes[first:first + len(texts)] = np.diff(bounds)
        doc = first + np.repeat(np.arange(len(texts)), np.diff(bounds))
        for start in range(0, len(gram), BLOCK):
            part = gram[start:start + BLOCK]
            # sorted needles are found several times as fast
            key = np.sort(part << np.uint64(20) | np.arange(len(part), dtype=np.uint64))
            at = np.searchsorted(names, (key >> np.uint64(20)).view(np.int64))
            owner = doc[start + (key & np.uint64(BLOCK - 1)).view(np.int64)]
            for total, loss in zip(totals, losses):
                total += np.bincount(owner, loss[at], len(total))
    none, n = sizes == 0, np.maximum(sizes, 1)
    target, background, score = (
        pa.array(t / n, mask=none) for t in (totals[0], totals[1], totals[0] - totals[1]))
    return pa.table({"doc_id": left.column("doc_id").combine_chunks(), "n_tokens": pa.array(sizes),
                     "ce_target": target, "ce_background": background, "score": score})


def score_language(docs: DataFrame, target_ids: DataFrame, chunk_bytes: int = 16_000_000, lean: float = 4.0) -> DataFrame:
    """Losses and their difference for every whole text of (doc_id, text); `target_ids` (doc_id) names the target."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = int(total // chunk_bytes) + 1
    rows = chunked(docs, chunks)
    good = (target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
            .withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")))
    counts = stored(rows.groupBy("chunk").cogroup(good.groupBy("chunk")).applyInArrow(count_chunk, COUNTED))
    losses = counts.select("chunk", "gram").join(gram_losses(counts, lean), "gram")
    return rows.groupBy("chunk").cogroup(losses.groupBy("chunk")).applyInArrow(score_chunk, SCORED)
