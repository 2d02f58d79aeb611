"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

Documents become token ids; only those longer than a sequence are cut. The histogram of piece
lengths (one count per possible length, however large the corpus) is all the planner sees. It
enumerates patterns of up to three length bins that fill a sequence, fits their repeat counts to the
histogram by non-negative least squares, rounds them, and packs what is left by best fit, first into
the gaps of the patterns. The plan says, per length, which run of ranks goes to which run of
sequences, so Spark places every piece by its rank among the pieces of its length.

Defined results: a null or empty text is the single id that ends a document; equal rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.llm.base import lean
from axlewatch.session import checkpointed

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
SPECIAL = "<|endoftext|>"
BLANK = re.compile(r"\s{100000}")      # the fast encoder's pattern backtracks on such runs until its stack is full


def vocabulary_files() -> tuple[str, str]:
    """The public byte-level vocabulary: as a `tokenizers` file, and the same one as ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(files: tuple[str, str] | None = None):
    """text -> ids (uint32). The ranks give the ids of the `tokenizers` file about four times as fast.

    A text that spells the special token goes through `tokenizers` itself, which gives it its id, and so does
    one with a very long run of white space, which the fast encoder cannot read.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    spec, ranks_file = files or vocabulary_files()
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain: list = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text and not BLANK.search(text):
            return np.asarray(fast.encode_ordinary(text), dtype="<u4")
        if not plain:
            plain.append(Tokenizer.from_file(spec))
        return np.asarray(plain[0].encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def token_pieces(docs: DataFrame, max_length: int = 2048, files: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece of (doc_id, text): its place in the document, length and checksum of its ids."""

    def run(batches):
        encode = encoder(files)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc, text in zip(ids, texts, strict=True):
                tokens = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                cuts = [0, *range(len(tokens) % max_length or max_length, len(tokens) + 1, max_length)]
                rows += [(doc, i, a, b - a, zlib.crc32(tokens[a:b].tobytes()))
                         for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


# ---------------------------------------------------------------- the plan, on the histogram alone

def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    gram, target = a.T @ a, a.T @ b
    floor = 1e-9 * max(1.0, np.abs(target).max(initial=0))
    for _ in range(rounds):
        slope = target - gram @ x
        slope[passive] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= floor:
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            trial = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if trial.min() > 0:
                x[:] = 0
                x[at] = trial
                break
            low = trial <= 0
            ratio = x[at][low] / np.maximum(x[at][low] - trial[low], 1e-300)
            x[at] += ratio.min() * (trial - x[at])
            passive[at[(x[at] <= 1e-12) & low]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def bin_patterns(bins: int) -> list[tuple[int, ...]]:
    """Every non-increasing pattern of up to three bins (in units) that fills a sequence exactly."""
    two = [(a, bins - a) for a in range((bins + 1) // 2, bins)]
    three = [(a, b, bins - a - b) for a in range(1, bins) for b in range(1, a + 1) if 1 <= bins - a - b <= b]
    return [(bins,), *two, *three]


class Spaces:
    """Open sequences by the room left in them: room -> stack of [pattern, how many]."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.open: dict[int, list[list]] = {}

    def add(self, room: int, pattern: tuple[int, ...], count: int) -> None:
        if count > 0:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append([pattern, count])

    def place(self, length: int, count: int) -> int:
        """Puts pieces of a length where least room is left; returns how many found none."""
        while count and (i := bisect_left(self.rooms, length)) < len(self.rooms):
            room = self.rooms[i]
            pattern, there = stack = self.open[room][-1]
            used = min(count, there)
            stack[1] -= used
            if not stack[1]:
                self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.rooms.pop(i)
            self.add(room - length, (*pattern, length), used)
            count -= used
        return count


def packing_plan(histogram: np.ndarray, max_length: int = 2048, unit: int = 16) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a sequence, number of such sequences) for counts by length (index = length)."""
    left = np.array(histogram, dtype=np.int64)
    spaces = Spaces()
    spaces.add(0, (max_length,), int(left[max_length]))
    left[max_length] = 0
    bins = -(-max_length // unit)
    of_bin = np.zeros(bins + 1, dtype=np.int64)
    np.add.at(of_bin, -(-np.arange(max_length + 1) // unit), left)
    patterns = bin_patterns(bins) if max_length % unit == 0 else []
    if patterns and of_bin.sum():
        matrix = np.zeros((bins, len(patterns)))
        for j, pattern in enumerate(patterns):
            for b in pattern:
                matrix[b - 1, j] += 1
        # short pieces fill gaps later, so a misfit there costs less
        weight = np.where(np.arange(1, bins + 1) * unit < max_length // 8, 0.1, 1.0)
        scale = float(of_bin.max())
        repeats = np.rint(nnls(matrix * weight[:, None], of_bin[1:] / scale * weight) * scale).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            need = np.bincount(np.array(patterns[j]), minlength=bins + 1)
            count = min(int(repeats[j]), *(int(of_bin[b] // need[b]) for b in set(patterns[j])))
            of_bin -= count * need
            while count > 0:    # the longest pieces of each bin, as runs of equal lengths
                lengths, taken = [], {}
                for b in patterns[j]:
                    length = b * unit
                    while left[length] - taken.get(length, 0) <= 0:
                        length -= 1
                    taken[length] = taken.get(length, 0) + 1
                    lengths.append(length)
                run = min(count, *(int(left[v]) // k for v, k in taken.items()))
                for v, k in taken.items():
                    left[v] -= run * k
                spaces.add(max_length - sum(lengths), tuple(lengths), run)
                count -= run
    for length in range(max_length, 0, -1):
        count = spaces.place(length, int(left[length]))
        if count:
            each = max_length // length
            spaces.add(max_length - each * length, (length,) * each, count // each)
            rest = count % each
            if rest:
                spaces.add(max_length - rest * length, (length,) * rest, 1)
    return [(tuple(p), n) for room in spaces.rooms for p, n in spaces.open[room]]


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, offset): where runs of ranks go."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in plan:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


# ---------------------------------------------------------------- the operator

def pack_sequences(docs: DataFrame, max_length: int = 2048, files: tuple[str, str] | None = None,
                   salts: int = 256) -> DataFrame:
    """Packs (doc_id, text) into sequences; one row per piece with its sequence and offset.

    Ranks within a length are counted per (length, salt), so that a length which many documents
    share is split over `salts` groups. The driver holds max_length * salts counts at most.
    """
    spark = docs.sparkSession
    pieces = checkpointed(token_pieces(docs, max_length, files).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = np.zeros((max_length + 1, salts), dtype=np.int64)
    for row in pieces.groupBy("length", "salt").count().toLocalIterator():
        counts[row["length"], row["salt"]] = row["count"]
    slots = slots_of(packing_plan(counts.sum(axis=1), max_length))
    before = np.cumsum(counts, axis=1) - counts
    shared = spark.sparkContext.broadcast((slots, before))
    ranked = pieces.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1)

    def place(batches):
        slots, before = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                                  for c in ("length", "salt", "rank"))
            rank = rank + before[length, salt]
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                run = slots[int(value)]
                found = run[np.searchsorted(run[:, 0], rank[at], side="right") - 1]
                sequence[at] = found[:, 1] + rank[at] - found[:, 0]
                offset[at] = found[:, 2]
            kept = [batch.column(batch.schema.get_field_index(c))
                    for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), PACKED)
