"""Benchmark decontamination: pigeonhole pieces, then bit-parallel edit distance.

Texts are compared as lower-case words joined by one space. An item of m characters may differ by k
edits; cut into k + 1 pieces, at least one piece survives any k edits unchanged. One automaton finds
all pieces of a block of items in every whole document, and around each hit Myers' bit-parallel
algorithm gives the exact edit distance of the best match.

The different texts of the items are handled in blocks of about `block_chars` characters (one block
unless the benchmark is large); documents are scanned once per block. Only a block travels to the
executors; the ids of its texts are joined to what was found.

Defined results: a null or empty text, or one without letters or digits, matches nothing; such items
match nothing; an item whose budget is below one edit must occur as whole words; repeated items are
reported under each id once, repeated documents each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import arrow_rows
from axlewatch.operators.segments import sized_broadcast

NOT_WORD = re.compile(r"[\W_]+")
WIDE_SIGN = re.compile(r"[^\w\x00-\x7f]")
SIGNS_TO_SPACE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
MATCHED = "doc_id long, item_key binary, distance int, budget int"


@dataclass
class Item:
    ids: list
    text: str
    budget: int
    letters: dict[str, int]     # character -> bits of its places

    @classmethod
    def of(cls, ids: list, text: str, rate: float) -> Item:
        letters: dict[str, int] = {}
        for i, c in enumerate(text):
            letters[c] = letters.get(c, 0) | 1 << i
        return cls(ids, text, int(rate * len(text)), letters)

    def pieces(self) -> list[tuple[int, str]]:
        if not self.budget:
            return [(1, f" {self.text} ")]
        n, m = self.budget + 1, len(self.text)
        cuts = [i * m // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def distance(self, window: str) -> int:
        """Smallest edit distance of the item to any part of the window (Myers 1999)."""
        m = len(self.text)
        full, top, get = (1 << m) - 1, 1 << (m - 1), self.letters.get
        plus, minus, score, best = full, 0, m, m
        for c in window:
            x = get(c, 0) | minus
            d = (((x & plus) + plus) ^ plus) | x
            down, up = plus & d, minus | (full & ~(plus | d))
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up = up << 1 & full
            minus = up & d
            plus = down << 1 & full | (full & ~(up | d))
        return best


def plain(text: str | None) -> str:
    text = (text or "").lower()
    if WIDE_SIGN.search(text):
        return NOT_WORD.sub(" ", text).strip()
    return b" ".join(text.encode().translate(SIGNS_TO_SPACE).split()).decode()


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, rows: list[tuple], rate: float) -> None:
        import ahocorasick
        by_text: dict[str, list] = {}
        for item, text in rows:
            if words := plain(text):
                by_text.setdefault(words, []).append(item)
        self.items = [Item.of(ids, text, rate) for text, ids in by_text.items()]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for at, piece in item.pieces():
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None, any_one: bool = False) -> dict[int, int]:
        """Item -> smallest distance, for the items within their budget."""
        words = f" {plain(text)} "
        found: dict[int, int] = {}
        if len(words) < 3 or not self.items:
            return found
        begun: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(words):
            for i, at in where:
                begun.setdefault(i, []).append(last - size + 1 - at)
        for i, starts in begun.items():
            item = self.items[i]
            if not item.budget:
                found[i] = 0
            else:
                # hits of one occurrence start within the budget of each other
                starts.sort()
                reach, low = len(item.text) + item.budget, starts[0]
                for n, start in enumerate(starts):
                    if n + 1 == len(starts) or starts[n + 1] > start + item.budget:
                        d = item.distance(words[max(0, low - item.budget):start + reach])
                        if d <= min(item.budget, found.get(i, item.budget)):
                            found[i] = d
                        low = starts[n + 1] if n + 1 < len(starts) else low
            if any_one and found:
                break
        return found


def item_texts(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, text): a key for each text."""
    text = F.col("text").cast("string")
    return benchmark.where(text.isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.unhex(F.md5(text)).alias("item_key"), text.alias("text"))


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The different texts of the benchmark, as (key, text), in blocks of about `block_chars` characters each."""
    rows = item_texts(benchmark).groupBy("item_key").agg(F.first("text").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    number = F.pmod(F.xxhash64("item_key"), F.lit(blocks))
    for i in range(blocks):
        yield [(bytes(k), t) for k, t in (rows.where(number == i) if blocks > 1 else rows).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_chars: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that holds an item within its error budget."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(columns, shared=shared, kept=[]):
            if not kept:
                kept.append(Matcher(shared.value, rate))
            matcher, found = kept[0], []
            for doc, text in zip(*columns, strict=True):
                for i, d in matcher.matches(text).items():
                    found += [(doc, key, d, matcher.items[i].budget) for key in matcher.items[i].ids]
            return found

        part = arrow_rows(rows, work, MATCHED)
        out = part if out is None else out.unionByName(part)
    ids = item_texts(benchmark).select("item_id", "item_key").distinct()
    return out.join(sized_broadcast(ids), "item_key").select("doc_id", "item_id", "distance", "budget")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_chars: int = 1_000_000) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    column, schema = docs.columns.index("text"), docs.schema
    for block in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                keep = [not matcher.matches(t, any_one=True) for t in batch.column(column).to_pylist()]
                yield batch.filter(pa.array(keep, type=pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
