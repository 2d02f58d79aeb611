"""Repeated passages and near-duplicates against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from axlewatch.llm import near_dedup as N
from axlewatch.llm import substring_dedup as R
from axlewatch.llm.components import connected_components


def kept_words(texts, window):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - window + 1) if seen[tuple(d[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(d), len(gone), b" ".join(w for j, w in enumerate(d) if j not in gone)))
    return out


def texts_with_repeats(seed, n=40):
    """Shared passages, edited copies, single-word and periodic runs, nulls."""
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            parts.append(rng.choice([
                rng.choice(pool), " ".join(["a"] * rng.randrange(1, 80)), " ".join(["a b"] * rng.randrange(1, 40)),
                " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))]))
        texts.append("\n".join(parts) if rng.random() > 0.05 else None)
    return texts + texts[:3]


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 8), (3, 3)])
def test_repeated_passages(spark, seed, window):
    texts = texts_with_repeats(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in R.repeats_digest(docs, window).collect()}
    want = {i: (n, k, hashlib.sha256(t).hexdigest()) for i, (n, k, t) in enumerate(kept_words(texts, window))}
    assert got == want


def test_anchors_are_those_of_the_window():
    """A window's anchor depends on its words alone, wherever it stands."""
    rng = np.random.default_rng(3)
    for kinds in (2, 6, 1000):
        body = rng.integers(1, kinds + 1, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place, name, start = R.anchors(body, np.array([0, 400]), 35)
        assert list(place) == list(range(366))
        shifted = np.concatenate([rng.integers(1, kinds + 1, 57).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), body])
        place2, name2, start2 = R.anchors(shifted, np.array([0, 457]), 35)
        at = np.searchsorted(place2, place + 57)
        assert (name2[at] == name).all() and (start2[at] - 57 == start).all()


def test_odd_rows_of_passages(spark, odd_documents):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in R.repeats_digest(odd_documents).collect()}
    assert (1, 0, 0) in got and (4, 2, 0) in got and (None, 7, 0) in got
    assert (5, 30_000, 30_000) in got and (6, 30_000, 30_000) in got     # each repeats the other
    assert R.repeats_digest(odd_documents).count() == 9 and R.repeats_digest(odd_documents.limit(0)).count() == 0


def groups(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def family(seed, n=150):
    """Edited copies of one text (a hard family: many pairs near the threshold), exact copies, strangers."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += texts[:20] + [" ".join(f"s{rng.randrange(10**6)}" for _ in range(60)) for _ in range(20)]
    texts += ["", None, "A b", "a B", "one two three four five", "ONE two three four five"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,few", [(1, 4), (2, 0), (3, 10**6)])
def test_near_duplicates(spark, monkeypatch, seed, few):
    """Whether few or many classes are left in a bucket, no link is lost."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "BLOCK_ITEMS", 3000)     # several blocks
    monkeypatch.setattr(N, "BLOCK_CLASSES", 40)
    texts = family(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = N.near_duplicates(docs).collect()
    want = {i: (n, c, i == c) for i, n, c in groups(texts)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == want
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_many_short_texts_of_one_bucket(spark):
    """A block bounds its classes, not only their shingles; strangers of a bucket cost little."""
    texts = [f"thanks for reading this post n{i}" for i in range(9000)]
    texts += ["thanks for reading this post n7 " + "more words of it here x y z " * 2 + e for e in ("a", "b")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}
    assert got == {i: min(i, 9000) for i in range(9002)}


def test_blocks_state_all_links():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(120)]
    items = pa.array([s.tolist() for s in sets], pa.list_(pa.uint64()))
    names = [bytes([i]) for i in range(120)]
    # with a component for each class, what is passed on joins the same classes as all links
    links = N.compare_blocks(names, list(range(120)), names, list(range(120)), items, items, 75)
    top = list(range(120))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        assert 100 * len(np.intersect1d(sets[a[0]], sets[b[0]])) >= 75 * len(np.union1d(sets[a[0]], sets[b[0]]))
        top[root(a[0])] = root(b[0])
    for i in range(120):
        for j in range(i):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                assert root(i) == root(j)


@pytest.mark.parametrize("few", [4, 10**6])
def test_near_duplicates_among_documents_of_other_sizes(spark, monkeypatch, few):
    """Two similar texts meet although both centres of every bucket of theirs are of dissimilar size."""
    monkeypatch.setattr(N, "FEW", few)
    # one key for all: a bucket full of classes of other sizes
    monkeypatch.setattr(N, "band_keys", lambda low: np.arange(3, dtype=np.int64))
    words = [f"a{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:-2], "b1", "b2"])]
    texts += [" ".join(words + [f"own{k}x{i}" for i in range(60 + 50 * k)]) for k in range(12)]
    want = groups(texts)
    assert want[1][2] == 0
    # the centres are the classes of the smallest and the largest hash; neither may be one of the two
    ends = {sorted((hashed(t), i) for i, t in enumerate(texts))[k][1] for k in (0, -1)}
    assert not ends & {0, 1}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect()} == {
        i: (n, c) for i, n, c in want}


def hashed(text):
    import xxhash
    return xxhash.xxh3_128_digest(N.shingles(text, N.WordHashes()).tobytes())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 2**63, 600).astype(np.uint64), rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = np.concatenate([common, own[:200]]), np.concatenate([common, own[200:]])
    agree = (N.signature(a) == N.signature(b)).mean()
    assert abs(agree - 0.6) < 0.15
    assert (N.signature(a) == N.signature(rng.permutation(a))).all()


def test_odd_rows_of_near_duplicates(spark, odd_documents):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(odd_documents).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (6, rows and next(r[1] for r in rows if r[0] == 5), 5, False)} <= rows
    assert any(r[0] is None and r[2] is None for r in rows)
    kept = N.drop_near_duplicates(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    assert N.near_duplicates(odd_documents.limit(0)).count() == 0


def test_components_of_long_chains(spark):
    links = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 99)] + [("0500", "0501"), ("0501", "0502"), ("0502", "0500")]
    df = spark.createDataFrame(links, "a string, b string")
    got = {r["node"]: r["label"] for r in connected_components(df).collect()}
    assert {got[f"{i:04d}"] for i in range(100)} == {"0000"} and {got[n] for n in ("0500", "0501", "0502")} == {"0500"}
    assert connected_components(df.limit(0)).count() == 0
