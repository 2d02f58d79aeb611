"""Whitening, sharding and centroid clustering against plain computations."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from axlewatch.llm import clustering, sharding, whitening

VECTORS = "vec_id long, embedding array<double>, component int, x string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], VECTORS).repartition(5)


# ---------------------------------------------------------------- spectrum

@pytest.mark.parametrize("size,seed", [(1, 0), (2, 1), (7, 2), (40, 3)])
def test_inertia_counts_negative_eigenvalues(size, seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        a = rng.standard_normal((size, size))
        a = a + a.T
        if size > 2:
            a[0, 0] = a[1, 1] = 0.0     # needs a two by two pivot
        assert whitening.negative_pivots(a) == (np.linalg.eigvalsh(a) < 0).sum()
    assert whitening.negative_pivots(np.zeros((size, size))) == 0


def test_leading_components_are_those_of_the_dense_solver():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((200, 30)) * np.linspace(1, 5, 30)
    v = np.cov(a.T)
    values, vectors = whitening.leading(v, 8)
    wanted, basis = np.linalg.eigh(v)
    assert np.allclose(values, wanted[::-1][:8], rtol=1e-13)
    assert np.allclose(np.abs(vectors @ basis[:, ::-1][:, :8]), np.eye(8), atol=1e-10)


def test_equal_and_zero_eigenvalues():
    values, vectors = whitening.leading(np.diag([5.0, 5.0, 5.0, 2.0, 0.0, 0.0]), 8)
    assert np.allclose(values, [5, 5, 5, 2]) and np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-12)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))
    values, vectors = whitening.leading(q @ np.diag([9.0] * 5 + [9 - 1e-9] + [1.0] * 6) @ q.T, 8)
    assert np.allclose(values, [9] * 6 + [1, 1]) and np.allclose(vectors @ vectors.T, np.eye(8), atol=1e-7)


def plain_whitening(rows, count=8):
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    return c @ basis[:, ::-1][:, :count] / np.sqrt(values[::-1][:count]), ((n * x - sums) ** 2).sum(axis=1), values[::-1]


def test_whitened_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(12) * np.linspace(0.1, 1, 12)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1])]
    odd = [(400, None), (401, [1.0] * 11 + [float("nan")]), (402, [None] + [0.5] * 11), (403, [float("inf")] * 12), (404, [])]
    found = whitening.whiten(vectors_of(spark, rows + odd)).toPandas()
    wanted, deviation, values = plain_whitening(rows)
    assert len(found) == len(rows) * 8 and found["n"].unique() == [len(rows)]
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iat[0] < 1e-10
    for number, part in found.groupby("component"):
        part = part.groupby("vec_id").first()
        for i, (vec_id, _) in enumerate(rows):
            assert part.loc[vec_id, "deviation"] == deviation[i]
        got, want = part["whitened"].to_numpy(), wanted[:301, number - 1]
        assert np.allclose(got, want, atol=1e-9) or np.allclose(got, -want, atol=1e-9)
        assert np.allclose(part["explained"], values[number - 1] / values.sum(), rtol=1e-9)


def test_lengths_huge_entries_and_constant_vectors(spark):
    rng = np.random.default_rng(8)
    rows = ([(i, rng.standard_normal(3).tolist()) for i in range(50)] + [(100 + i, rng.standard_normal(2).tolist()) for i in range(40)]
            + [(200, [1.0]), (201, [1.0]), (None, rng.standard_normal(2).tolist())] + [(300 + i, [1e200, float(i), 0.0, 0.0]) for i in range(4)])
    found = whitening.whiten(vectors_of(spark, rows)).toPandas()
    sizes = found.groupby("vec_id", dropna=False).size()
    assert set(sizes.loc[0:49]) == {3} and set(sizes.loc[100:139]) == {2} and 200 not in sizes.index
    assert found[found["vec_id"].isna()]["n"].tolist() == [41, 41]
    assert set(sizes.loc[300:303]) == {1}       # only one dimension varies
    huge = [(i, [(-1) ** i * 1e200, 1.0]) for i in range(6)]
    found = whitening.whiten(vectors_of(spark, huge)).toPandas()
    assert found["deviation"].isna().all() and np.allclose(np.abs(found["whitened"]), 1)
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [0.5, 0.25])])).count() == 0


# ---------------------------------------------------------------- shards

def shards_of(spark, texts, **options):
    df = spark.createDataFrame(texts, "doc_id long, text string, shard int, slot string, k0 int").repartition(6)
    return sharding.shard_rows(df, **options).select("row.doc_id", "row.text", "size", "shard", "slot").toPandas()


def is_whole(found, texts):
    assert len(found) == len(texts)
    assert sorted(found["text"].fillna("<null>")) == sorted(t[1] if t[1] is not None else "<null>" for t in texts)
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


@pytest.mark.parametrize("options", [{}, {"probes": 3}, {"piece_bytes": 500}, {"shards": 3, "piece_bytes": 2000, "probes": 1}])
def test_shards_are_even_and_keep_copies_together(spark, options):
    rng = random.Random(3)
    texts = [(rng.choice([None, i, 5]), "".join(rng.choices("abcé ", k=rng.randrange(1, 200))), 1, "s", 2) for i in range(600)]
    texts += [(10_000 + i % 3, "small group", 1, "s", 2) for i in range(7)]
    found = shards_of(spark, texts, **options)
    is_whole(found, texts)
    assert (found["size"] == [len(t.encode()) + 1 for t in found["text"]]).all()
    sums = found.groupby("shard")["size"].sum()
    assert len(sums) == options.get("shards", 8) and sums.max() - sums.min() <= 2 * found["size"].max()
    assert found[found["text"] == "small group"]["shard"].nunique() <= 2
    # every shard is a range: at most one text is cut by each boundary
    assert (found.groupby("text")["shard"].nunique() > 1).sum() <= len(sums) - 1


def test_a_hot_text_is_divided_by_id_and_place(spark):
    texts = [(7, "the same row again", 1, "s", 2)] * 500 + [(i, "the same text, other ids", 1, "s", 2) for i in range(300)]
    texts += [(None, None, 1, "s", 2), (None, "", 1, "s", 2), (1, "x" * 50, 1, "s", 2)] * 20
    for options in ({}, {"piece_bytes": 300}):
        found = shards_of(spark, texts, **options)
        is_whole(found, texts)
        sums = found.groupby("shard")["size"].sum()
        assert len(sums) == 8 and sums.max() - sums.min() <= 2 * found["size"].max()
        ids = found[found["text"] == "the same text, other ids"].sort_values(["shard", "slot"])["doc_id"]
        assert ids.is_monotonic_increasing      # inside a text, ids stay in order


def test_shards_of_few_none_and_huge_rows(spark):
    assert len(shards_of(spark, [])) == 0
    found = shards_of(spark, [(1, "one", 1, "s", 2)])
    assert found["slot"].tolist() == [0] and found["shard"].between(0, 7).all()
    texts = [(i, "y" * (100_000 if i == 4 else 10), 1, "s", 2) for i in range(9)]
    is_whole(shards_of(spark, texts), texts)


def test_digest_and_files(spark, odd_documents, tmp_path):
    found = sharding.shard_digest(odd_documents).toPandas()
    assert list(found.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = [r["text"] or "" for r in odd_documents.collect()]
    assert sorted(zip(found["size"], found["text_crc32"])) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    assert found["grown_shard"].isna().all() and set(found["law"]) == {"bytes"}
    sharding.write_shards(odd_documents.select("doc_id", "text"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["text"] or "" for r in back.collect()) == sorted(texts)


# ---------------------------------------------------------------- clusters

def plain_clusters(rows, clusters, rounds, dimensions):
    x = np.array([[max(-2 ** 27, min(2 ** 27, math.floor(256 * c))) for c in v] for _, v in rows], dtype=object)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(),
                                                    x[i].tolist()))[:clusters]
    centroids = [x[i].tolist() for i in order]
    for number in range(rounds + 1):
        away = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
        near = [min(range(len(centroids)), key=lambda c, row=row: (row[c], c)) for row in away]
        if number < rounds:
            for c in range(len(centroids)):
                own = [v for v, n in zip(x, near) if n == c]
                if own:
                    centroids[c] = [sum(v[d] for v in own) // len(own) for d in range(dimensions)]
    return near, [row[n] for row, n in zip(away, near)], centroids


@pytest.mark.parametrize("bits,sent", [(8, 20_000), (3, 20_000), (1, 0)])
def test_clusters_are_exact_at_any_cell_size(spark, monkeypatch, bits, sent):
    monkeypatch.setattr(clustering, "SENT_ROWS", sent)
    rng = np.random.default_rng(bits)
    rows = [(i, (rng.standard_normal(6) * 0.2 + i % 4).tolist()) for i in range(250)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (900, [1e30] * 6), (901, [-1e-9] * 6)]
    odd = [(1, None), (2, [1.0] * 5), (3, [1.0] * 5 + [float("nan")]), (4, [None] * 6)]
    found = clustering.cluster_vectors(vectors_of(spark, rows + odd), clusters=9, rounds=3, dimensions=6, bits=bits).toPandas()
    near, away, centroids = plain_clusters(rows, 9, 3, 6)
    key = lambda i: -1 if i is None or i != i else int(i)
    assert (sorted((key(i), int(c), int(d)) for i, c, d in zip(found["vec_id"], found["cluster"], found["distance"]))
            == sorted((key(r[0]), c, d) for r, c, d in zip(rows, near, away)))
    assert set(found["inertia"]) == {sum(away)}
    for cluster, part in found.groupby("cluster"):
        assert set(part["cluster_inertia"]) == {sum(d for d, c in zip(away, near) if c == cluster)}
        assert list(part["centroid"].iat[0]) == centroids[cluster]


def test_intervals_hold_the_distances():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 10))
    centroids = rng.integers(-300, 300, (7, 10))
    for bits in (1, 4, 8):
        cells = clustering.Cells.of(x.min(axis=0), x.max(axis=0), x.mean(axis=0), x.std(axis=0) / 2, bits)
        near, far = cells.tables(centroids)
        numbers, exact = cells.number(x), ((x[:, None] - centroids) ** 2).sum(axis=2)
        low = sum(near[d][numbers[:, d]] for d in range(10))
        high = sum(far[d][numbers[:, d]] for d in range(10))
        assert (low <= exact).all() and (exact <= high).all()
        assert clustering.candidates(numbers, near, far)[np.arange(500), exact.argmin(axis=1)].all()


def test_few_equal_and_no_vectors(spark):
    assert clustering.cluster_digest(vectors_of(spark, [])).count() == 0
    same = vectors_of(spark, [(i, [0.5] * 64) for i in range(50)])
    found = clustering.cluster_digest(same).toPandas()
    assert set(found["cluster"]) == {0} and set(found["distance"]) == {0}
    digest = hashlib.sha256(",".join(["128"] * 64).encode()).hexdigest()
    assert set(found["centroid_sha256"]) == {digest}
    assert clustering.cluster_digest(vectors_of(spark, [(1, [0.25] * 64)])).select(F.sum("inertia")).first()[0] == 0
