"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Nearness is the inner product. With one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M of
a shard, the largest inner product is the smallest Euclidean distance, so the graph is built in a
metric space: greedy searches propose neighbours of each vector, and a candidate is dropped where a
kept one is closer to it by the factor `spread` (relaxed distance pruning), which keeps edges diverse.
A query runs a beam search on every shard; what the beam holds is scored again in double precision on
the vectors as given.

Equal vectors are one graph node with their smallest ids (as many as a result can hold), so copies
neither crowd a beam nor a task. Shards hold vectors whose norms differ by less than a tenth, so that no
large norm flattens the others' distances; they hold `shard_rows` on average at most, and the beams
grow with the root of a shard. Queries meet shards in blocks, so a task sees one shard and one
block, however large the table is.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part;
vectors of different lengths never meet; a repeated row counts once; rows of the query's id are never its
neighbours; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axlewatch.operators.segments import sized_broadcast
from axlewatch.session import checkpointed

DEGREE, SLACK = 24, 48          # out-edges after pruning, and before it
BUILD_BEAM, SEARCH_BEAM = 48, 192
BEAM_ROWS = 6_400               # shards above this size have wider beams
NORM_BANDS = 8                  # per power of two
SPREAD = 1.2
AT_ONCE, STEP = 128, 4          # searches run together; nodes each expands in a step
ENTRIES = 8
NODES = "part int, node int, entry boolean, vec_ids array<long>, vector array<double>, edges array<int>"
NEAR = "query_id long, query_hash long, vec_id long, score double"


# ---------------------------------------------------------------- one shard

def padded(table: np.ndarray, value: float) -> np.ndarray:
    """The rows and one more, the place of missing edges."""
    return np.vstack([table, np.full((1, table.shape[1]), value, table.dtype)])


def wide(beam: int, n: int) -> int:
    """A beam for a shard of n nodes: as given up to BEAM_ROWS, beyond it in proportion to the root."""
    return max(beam, int(np.ceil(beam * np.sqrt(n / BEAM_ROWS))))


def beam_search(points: np.ndarray, norms: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray,
                beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes found for each query, nearest first: (node or -1, squared distance).

    `points`, their squared `norms` and `edges` are padded by one row.
    """
    n, q = len(points) - 1, len(queries)
    seen = np.zeros((q, n + 1), dtype=bool)
    seen[:, n] = True       # the place of missing edges
    ids = np.full((q, beam), n)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)
    fresh = np.broadcast_to(entries, (q, len(entries)))
    rows = np.arange(q)[:, None]
    while True:
        far = norms[fresh] - 2 * np.matmul(points[fresh], queries[:, :, None])[:, :, 0]
        order = np.argsort(fresh, axis=1, kind="stable")
        ranked = np.take_along_axis(fresh, order, axis=1)
        twice = np.zeros(fresh.shape, dtype=bool)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
        far[seen[rows, fresh] | twice] = np.inf
        seen[rows, fresh] = True
        all_ids = np.concatenate([ids, fresh], axis=1)
        all_dist = np.concatenate([dist, far], axis=1)
        all_done = np.concatenate([done, np.isinf(far)], axis=1)
        best = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_dist, all_done))
        next_ = np.argsort(done, axis=1, kind="stable")[:, :STEP]
        open_ = ~np.take_along_axis(done, next_, axis=1)
        if not open_.any():
            return np.where(np.isinf(dist), -1, ids), dist
        np.put_along_axis(done, next_, True, axis=1)
        at = np.where(open_, np.take_along_axis(ids, next_, axis=1), n)
        fresh = edges[at].reshape(q, -1)
        fresh = np.where(fresh < 0, n, fresh)


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray) -> np.ndarray:
    """At most DEGREE diverse out-edges for each node from its proposals (-1: none); `points` are padded."""
    n = len(points) - 1
    proposed = np.sort(np.where((proposed < 0) | (proposed == nodes[:, None]), n, proposed), axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = n
    near = points[proposed]
    away = ((near - points[nodes][:, None, :]) ** 2).sum(axis=2)
    away[proposed == n] = np.inf
    norms = np.einsum("bij,bij->bi", near, near)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(near, near.transpose(0, 2, 1))
    kept = np.full((len(nodes), DEGREE), -1)
    rows = np.arange(len(nodes))
    for k in range(DEGREE):
        pick = away.argmin(axis=1)
        alive = np.isfinite(away[rows, pick])
        if not alive.any():
            break
        kept[alive, k] = proposed[rows, pick][alive]
        covered = SPREAD * SPREAD * between[rows, pick] <= away
        covered[rows, pick] = True
        away[covered & alive[:, None]] = np.inf
    return kept


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) over float32 points."""
    n, rng = len(points), np.random.default_rng(seed)
    edges = np.full((n + 1, SLACK), -1)
    middle = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    entries = np.unique(np.append(rng.choice(n, min(n, ENTRIES), replace=False), middle))
    if n > 1:
        some = rng.integers(0, n - 1, (n, min(8, n - 1)))
        edges[:n, :some.shape[1]] = some + (some >= np.arange(n)[:, None])
    order, beam = rng.permutation(n), wide(BUILD_BEAM, n)
    points, norms = padded(points, 0), np.append(np.einsum("ij,ij->i", points, points), np.float32(0))
    for start in range(0, n, AT_ONCE):
        nodes = order[start:start + AT_ONCE]
        found, _ = beam_search(points, norms, edges, entries, points[nodes], beam)
        kept = robust_prune(points, nodes, np.concatenate([found, edges[nodes]], axis=1))
        edges[nodes] = -1
        edges[nodes, :DEGREE] = kept
        # the way back; a node whose slots are full is pruned again
        source, target = np.repeat(nodes, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        new = np.concatenate([[True], target[1:] != target[:-1]]) if len(target) else np.empty(0, bool)
        first = np.flatnonzero(new)
        turn = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        slot = (edges[target] >= 0).sum(axis=1) + turn
        known = (edges[target] == source[:, None]).any(axis=1)
        fits = (slot < SLACK) & ~known
        edges[target[fits], slot[fits]] = source[fits]
        over = np.unique(target[(slot >= SLACK) & ~known])
        for part in range(0, len(over), AT_ONCE):
            full = over[part:part + AT_ONCE]
            extra = [source[(target == t) & ~fits] for t in full]
            more = np.full((len(full), max(map(len, extra))), -1)
            for i, e in enumerate(extra):
                more[i, :len(e)] = e
            kept = robust_prune(points, full, np.concatenate([edges[full], more], axis=1))
            edges[full] = -1
            edges[full, :DEGREE] = kept
        # slots stay packed to the left
        ragged = np.unique(np.append(nodes, target))
        rank = np.argsort(edges[ragged] < 0, axis=1, kind="stable")
        edges[ragged] = np.take_along_axis(edges[ragged], rank, axis=1)
    return edges[:n], entries


def lifted(vectors: np.ndarray) -> np.ndarray:
    """The points whose distance order is that of the inner product, as float32."""
    vectors = vectors / np.abs(vectors).max()
    norms = np.einsum("ij,ij->i", vectors, vectors)
    scale = 1.0 / np.sqrt(norms.max())
    return np.column_stack([vectors * scale, np.sqrt(np.maximum(0, 1 - norms * scale * scale))]).astype(np.float32)


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("hash", kind="stable").reset_index(drop=True)
    edges, entries = build_graph(lifted(np.stack(rows["vector"].to_numpy())))
    return pd.DataFrame({
        "part": rows["part"], "node": np.arange(len(rows)), "entry": np.isin(np.arange(len(rows)), entries),
        "vec_ids": rows["vec_ids"], "vector": rows["vector"], "edges": [e[e >= 0] for e in edges]})


def search_shard(graph: pd.DataFrame, queries: pd.DataFrame, top: int, beam: int) -> Iterator[tuple]:
    """(query id, query hash, vec_id, score) of the nearest rows of a shard, at most `top` for each query."""
    graph = graph.sort_values("node")
    vectors = np.stack(graph["vector"].to_numpy())
    edges = np.full((len(graph) + 1, SLACK), -1)
    for i, e in enumerate(graph["edges"]):
        edges[i, :len(e)] = e
    points, members = padded(lifted(vectors), 0), list(graph["vec_ids"])
    norms, beam = np.einsum("ij,ij->i", points, points), max(wide(beam, len(graph)), top + 1)
    entries = np.flatnonzero(graph["entry"].to_numpy())
    asked = np.stack(queries["vector"].to_numpy())
    # scaling a query changes no order
    flat = asked / np.abs(asked).max(axis=1, keepdims=True)
    flat = np.column_stack([flat / np.linalg.norm(flat, axis=1, keepdims=True), np.zeros(len(flat))]).astype(np.float32)
    ids, hashes = queries["query_id"].to_numpy(), queries["query_hash"].to_numpy()
    for start in range(0, len(asked), AT_ONCE):
        found, _ = beam_search(points, norms, edges, entries, flat[start:start + AT_ONCE], beam)
        for i, nodes in enumerate(found, start):
            nodes = nodes[nodes >= 0]
            scores = (vectors[nodes] * asked[i]).sum(axis=1)
            best = sorted((-s, v) for s, node in zip(scores, nodes) for v in members[node] if v != ids[i])[:top]
            yield from ((ids[i], hashes[i], v, -s) for s, v in best)


# ---------------------------------------------------------------- the operator

def nearest_neighbours(vectors: DataFrame, every: int = 20, top: int = 20, shard_rows: int = 20_000,
                       least_shards: int = 8, block_rows: int = 20_000, beam: int = SEARCH_BEAM) -> DataFrame:
    """The `top` nearest rows of (vec_id, embedding) for each row whose id is divisible by `every`."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
            .where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine
                   & F.exists("vector", lambda x: x != 0))
            .withColumn("hash", F.xxhash64("vector")).dropDuplicates(["vec_id", "hash", "vector"]))
    top_entry = F.array_max(F.transform("vector", F.abs))
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))
    rows = (rows.withColumn("top", top_entry)
            .withColumns({"size": F.size("vector"), "band": F.floor(NORM_BANDS * (F.log2("top") + F.log2(squares) / 2)).cast("int")})
            .drop("top"))
    rows = checkpointed(rows)
    # of equal vectors no result can hold more than the smallest ids (and the query's own)
    copies = (rows.withColumn("rank", F.row_number().over(Window.partitionBy("hash", "vector").orderBy("vec_id")))
              .where(F.col("rank") <= top + 1).groupBy("hash", "vector", "size", "band")
              .agg(F.sort_array(F.collect_list("vec_id")).alias("vec_ids")))
    # one row per length and band of norms
    bands = rows.groupBy("size", "band").agg(
        F.count("*").alias("all"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect()
    each = min(shard_rows, max(1, -(-sum(b["all"] for b in bands) // least_shards)))
    blocks = max(1, -(-sum(b["asked"] for b in bands) // block_rows))
    # parts are numbered band after band
    places, of_size, parts = {}, {}, 0
    for b in sorted(bands):
        shards = -(-b["all"] // each)
        places[b["size"], b["band"]] = (parts, shards)
        of_size.setdefault(b["size"], []).extend(range(parts, parts + shards))
        parts += shards
    place = rows.sparkSession.createDataFrame(
        [(*k, *v) for k, v in places.items()], "size int, band int, first int, shards int")
    part = (F.col("first") + F.pmod(F.xxhash64("hash"), F.col("shards"))).cast("int")
    graph = checkpointed(copies.join(sized_broadcast(place), ["size", "band"]).withColumn("part", part)
                         .select("part", "hash", "vector", "vec_ids").groupBy("part").applyInPandas(
        lambda pdf: build_shard(pdf), NODES))
    meets = rows.sparkSession.createDataFrame(list(of_size.items()), "size int, parts array<int>")
    asked = rows.where(F.col("vec_id") % every == 0).join(sized_broadcast(meets), "size").select(
        F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"), "vector",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode("parts").alias("part"))
    spread = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(search_shard(left, right, top, beam)) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "query_hash", "vec_id", "score"])

    near = spread.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(search, NEAR)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
