"""Near-duplicate groups by circulant MinHash.

A document is its set of distinct five-word shingles. Two permutations of a 32-bit universe make the
whole signature: one shuffles the shingles once, the other is circularly shifted by k for coordinate
k. Bands of the signature propose links, full shingle sets confirm them, and connected components
give the groups.

Equal sets become one class first, so copies never meet each other. In a bucket of a band every class
is compared with two centres, which is linear however large the bucket; confirmed links then form
components. Buckets that still hold several components are finished exactly: classes outside a
bucket's largest component are compared with all others, as pairs if they are few, else block by block
inside tasks that see two blocks of bounded size and pass on only links that join components.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; fewer than five words are one
shingle; a null or empty text has no shingles, is its own component and is kept; equal rows share a
component; a row without an id joins its group but is never its smallest id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axlewatch.llm.base import lean, row_key, stored, texts_in_turn
from axlewatch.llm.components import connected_components

SHINGLE = 5
ROWS, BANDS = 4, 32
FEW = 4             # so many classes outside the largest component meet all others as pairs
BLOCK_ITEMS = 500_000   # shingles of a block of classes that a task compares with another block
BLOCK_CLASSES = 4_000   # classes of such a block at most, on average
FILTER_BITS = 23    # size of the key filter; full filters only stop saving work
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """word -> 64-bit hash; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(29))


def shingles(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode().lower().split()
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(ids) == 0:
        return ids
    if len(ids) < SHINGLE:
        return mixed((ids * FACTORS[:len(ids)]).sum(keepdims=True) + np.uint64(len(ids)))
    total = ids[:len(ids) - SHINGLE + 1] * FACTORS[0]
    for k in range(1, SHINGLE):
        total += ids[k:len(ids) - SHINGLE + 1 + k] * FACTORS[k]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Coordinate k is the smallest pi((sigma(x) + k) mod 2^32) over the shingles x."""
    x = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)      # sigma
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    shift = np.arange(ROWS * BANDS, dtype=np.uint32)[:, None]
    low = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(x), 1024):
        v = x[None, start:start + 1024] + shift                 # the circular shift
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)                              # pi
        v ^= v >> np.uint32(12)
        v *= np.uint32(0x297A2D39)
        v ^= v >> np.uint32(15)
        np.minimum(low, v.min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed(parts @ FACTORS[:ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * FACTORS[4]).view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): its key, class (hash of its set), set size and band keys."""

    def run(batches):
        import xxhash
        hashes = WordHashes()
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in texts_in_turn(batch.column(2)):
                found = shingles(text, hashes)
                nodes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sizes.append(len(found))
                keys.append(band_keys(signature(found)) if len(found) else np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64()))],
                names=["doc_id", "row", "node", "n_shingles", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", row_key("doc_id", "text").alias("row"), "text").mapInArrow(
        lean(run), "doc_id long, row long, node binary, n_shingles long, bands array<long>")


# ---------------------------------------------------------------- sets of the classes in question

def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap (as bytes) of fixed size that holds every key of the one-column frame."""

    def run(batches):
        seen = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            seen[filter_slots(batch.column(0), bits)] = True
        packed = np.packbits(seen).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed[at])], names=["at", "bits"])

    words = keys.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    packed = np.zeros((1 << bits) // 64, dtype=np.int64)
    for row in words.toLocalIterator():
        packed[row["at"]] = row["bits"]
    return packed.view(np.uint8)


def in_filter(seen: np.ndarray, keys: pa.Array, bits: int = FILTER_BITS) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    at = filter_slots(keys, bits)
    return ((seen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def filter_slots(keys: pa.Array, bits: int) -> np.ndarray:
    return (keys.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def class_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(node, items) for the classes of `need` (node, row), each from one of its rows."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(key_filter(need.select("row")))

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_filter(seen.value, batch.column(0))))

    def run(batches):
        import xxhash
        hashes = WordHashes()
        for batch in batches:
            nodes, items = [], []
            for node, text in zip(batch.column(0).to_pylist(), texts_in_turn(batch.column(1)), strict=True):
                found = shingles(text, hashes)
                if xxhash.xxh3_128_digest(found.tobytes()) == node:
                    nodes.append(node)
                    items.append(found.view(np.int64))
            offsets = np.cumsum([0, *map(len, items)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(items) if items else [], pa.int64()))],
                names=["node", "items"])

    rows = docs.select(row_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(likely, "row long, text string")
    # equal rows share a key, so one of them is enough
    return (rows.join(need, "row").select("node", "text").mapInArrow(lean(run), "node binary, items array<long>")
            .dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return (pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("right")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("items").alias("left")), "a")
            .select("a", "b", "left", "right").mapInArrow(lean(run), "a binary, b binary"))


def similar_size(small: str, large: str, percent: int = 75):
    return 100 * F.least(small, large) >= percent * F.greatest(small, large)


# ---------------------------------------------------------------- links

def star_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Each class of a bucket with its two centres."""
    both = members.join(centres, "key").select(
        "node", "n", F.explode(F.array("low", "high")).alias("centre"))
    return (both.where((F.col("node") != F.col("centre.node")) & similar_size("n", "centre.n"))
            .select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct())


def open_links(docs: DataFrame, classes: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame,
               percent: int = 75) -> DataFrame:
    """Links that the centres have not settled: of one bucket, of different components, of similar size.

    Classes that met no centre of similar size are not in `sets` yet; theirs are fetched here.
    """
    named = (members.join(labels, "node", "left")
             .select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    parts = named.groupBy("key", "label").agg(F.count("*").alias("size"), F.sum("n").alias("items"))
    buckets = (parts.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("size").alias("total"), F.sum("items").alias("items"),
        F.max(F.struct("size", "label", "items")).alias("main"))
        .where((F.col("parts") > 1) & (F.col("total") > 2))
        .select("key", F.col("main.label").alias("main"), "total", (F.col("total") - F.col("main.size")).alias("rest"), "items",
                (F.col("items") - F.col("main.items")).alias("rest_items")))
    rows = stored(named.join(buckets, "key"))
    few = rows.where(F.col("rest") <= FEW)
    outside = few.where(F.col("label") != F.col("main")).select(
        "key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("label").alias("label2"))
    direct = (few.join(outside, "key").where((F.col("label") != F.col("label2")) & similar_size("n", "n2", percent))
              .select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
    direct, many = stored(direct), rows.where(F.col("rest") > FEW)
    need = (direct.select(F.explode(F.array("a", "b")).alias("node")).unionByName(many.select("node")).distinct()
            .join(sets.select("node"), "node", "left_anti").join(classes.select("node", "row"), "node"))
    sets = sets.unionByName(stored(class_sets(docs, stored(need))))
    return confirmed(direct, sets, percent).unionByName(block_links(many, sets, percent))


def block_links(rows: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Links between the classes outside a bucket's largest component and all others of the bucket.

    Both sides come in blocks of about BLOCK_ITEMS shingles and BLOCK_CLASSES classes at most, and a
    task compares one block with one block. Of the links it finds, it passes on those that join components not yet joined by it.
    """
    def blocks(items: str, classes: str):
        return F.ceil(F.greatest(F.col(items) / BLOCK_ITEMS, F.col(classes) / BLOCK_CLASSES)).cast("int")

    def place(items: str, classes: str, salt: int):
        return F.pmod(F.xxhash64("node", F.lit(salt)), blocks(items, classes)).cast("int")

    held = rows.join(sets.withColumnRenamed("items", "items_of"), "node").withColumns(
        {"i": place("items", "total", 1), "j": place("rest_items", "rest", 2)})
    left = held.select("key", "node", "label", "items_of", "i", F.explode(
        F.sequence(F.lit(0), blocks("rest_items", "rest") - 1)).alias("j"))
    right = held.where(F.col("label") != F.col("main")).select("key", "node", "label", "items_of", "j", F.explode(
        F.sequence(F.lit(0), blocks("items", "total") - 1)).alias("i")).toDF("key2", "node2", "label2", "items2", "j2", "i2")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = compare_blocks(*(t.column(c).to_pylist() for t, c in ((a, "node"), (a, "label"), (b, "node2"), (b, "label2"))),
                               a.column("items_of").combine_chunks(), b.column("items2").combine_chunks(), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key2", "i2", "j2")).applyInArrow(compare, "a binary, b binary")


def compare_blocks(nodes: list, labels: list, nodes2: list, labels2: list, items, items2, percent: int) -> list[tuple]:
    if not nodes or not nodes2:
        return []
    sizes, sizes2 = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in (items, items2))
    owner, owner2 = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes2)), sizes2)
    flat, flat2 = items.flatten().to_numpy(), items2.flatten().to_numpy()
    both = np.intersect1d(flat, flat2)      # only these can be common
    # a class with less than its share of these has no link here
    held, held2 = (np.flatnonzero(100 * np.bincount(who[np.isin(values, both)], minlength=len(n)) >= percent * n)
                   for values, who, n in ((flat, owner, sizes), (flat2, owner2, sizes2)))
    if not len(held) or not len(held2):
        return []
    row, row2 = np.full(len(sizes), -1), np.full(len(sizes2), -1)
    row[held], row2[held2] = np.arange(len(held)), np.arange(len(held2))
    common = np.zeros((len(held2), len(held)), dtype=np.float32)
    for start in range(0, len(both), 2048):
        part = both[start:start + 2048]
        pair = []
        for values, who, n in ((flat, row[owner], len(held)), (flat2, row2[owner2], len(held2))):
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = (part[at] == values) & (who >= 0)
            grid = np.zeros((n, len(part)), dtype=np.float32)
            grid[who[hit], at[hit]] = 1
            pair.append(grid)
        common += pair[1] @ pair[0].T
    # 100 * common >= percent * (size2 + size - common), in whole numbers, some rows at a time
    links_at = []
    for start in range(0, len(held2), 64):
        some = common[start:start + 64].astype(np.int64)
        near = (100 + percent) * some >= percent * (sizes2[held2[start:start + 64], None] + sizes[None, held])
        links_at += [(held2[start + i], held[j]) for i, j in np.argwhere(near)]
    top: dict = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    links = []
    for i, j in links_at:
        x, y = root(labels2[i]), root(labels[j])
        if x != y:
            top[max(x, y)] = min(x, y)
            links.append((min(nodes2[i], nodes[j]), max(nodes2[i], nodes[j])))
    return links


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Per row of (doc_id, text): row key, set size, group (the component's smallest class) and component_id."""
    rows = stored(described(docs))
    classes = rows.where("n_shingles > 0").dropDuplicates(["node"])
    bands = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    one = F.struct("node", "n")
    centres = (bands.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high"))
               .where(F.col("low") != F.col("high")))
    members = stored(bands.join(centres.select("key"), "key"))
    pairs = stored(star_pairs(members, members.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high"))))
    need = (pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            .join(classes.select("node", "row"), "node"))
    sets = stored(class_sets(docs, need))
    links = stored(confirmed(pairs, sets, percent))
    labels = connected_components(links)
    more = open_links(docs, classes, members, labels, sets, percent)
    # these few links join whole components
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    joins = connected_components(stored(
        more.join(of_a, "a", "left").join(of_b, "b", "left")
        .select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()))
    joins = joins.select(F.col("node").alias("part"), F.col("label").alias("whole"))
    # ids of a component, first per class and then per group, so that no step sees all copies at once
    lone = F.coalesce("node", F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    classes = rows.groupBy(lone.alias("class")).agg(F.min("doc_id").alias("low"))
    classes = (classes.join(labels.withColumnRenamed("node", "class"), "class", "left")
               .select("class", "low", F.coalesce("label", "class").alias("part")))
    classes = stored(classes.join(joins, "part", "left").select("class", "low", F.coalesce("whole", "part").alias("group")))
    lows = classes.groupBy("group").agg(F.min("low").alias("component_id"))
    classes = classes.join(lows, "group").select("class", "group", "component_id")
    return (rows.select("doc_id", "row", "n_shingles", lone.alias("class")).join(classes, "class", "left")
            .select("doc_id", "row", "n_shingles", "group", "component_id"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Set size, component and whether the row is its component's first, per row of (doc_id, text)."""
    return grouped(docs, percent).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest id (any, if none has one)."""
    found = grouped(docs, percent)
    # at most the copies of one id are left of a group here
    first = stored(found.where("component_id is null or doc_id = component_id").groupBy("group")
                         .agg(F.min("row").alias("row_kept"), F.count("*").alias("rows")).select("row_kept", "rows"))
    # no column of the documents is renamed: the key is computed in the join condition
    key = row_key(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    kept = docs.join(first, key == F.col("row_kept"), "left_semi")
    repeated = first.where("rows > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])
