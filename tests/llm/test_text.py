"""Packing, toxicity, language models, benchmark leaks, pages, graph search and the pipeline."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axlewatch.llm import catalog
from axlewatch.llm import decontamination as D
from axlewatch.llm import graph_search as G
from axlewatch.llm import lm_scoring as L
from axlewatch.llm import packing as K
from axlewatch.llm import page_text as H
from axlewatch.llm import toxicity as T

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- packing

def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer
    spec, _ = K.vocabulary_files()
    plain, encode = Tokenizer.from_file(spec), K.encoder()
    rng = random.Random(1)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|> x", "don't 'LL", "é" * 50, "x" * 3000]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)]))
                      for _ in range(80)) for _ in range(200)]
    for t in texts:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def check_packing(rows, max_length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= max_length
    return len(by)


def test_packing_round_trip(spark, words):
    texts = [" ".join(words(n)) for n in (0, 1, 5, 40, 300, 900, 2500, 40, 40)] + [None] + [" ".join(words(7))] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = K.pack_sequences(docs, 512).collect()
    check_packing(rows, 512)
    encode = K.encoder()
    for i, text in enumerate(texts):
        ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) == len(ids) and (len(ids) > 512 or len(pieces) == 1)
        assert all(p[2] == 512 for p in pieces[1:])
        assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for _, s, n, c in pieces)


def test_plan_is_tight():
    rng = np.random.default_rng(4)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2048)
    histogram = np.bincount(lengths, minlength=2049)
    plan = K.packing_plan(histogram)
    used = np.zeros(2049, np.int64)
    for pattern, n in plan:
        assert sum(pattern) <= 2048
        for v in pattern:
            used[v] += n
    assert (used == histogram).all()
    assert sum(n for _, n in plan) <= 1.01 * -(-lengths.sum() // 2048) + 1


def test_least_squares_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    a, b = rng.random((20, 45)), rng.random(20)
    x = K.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and slope.min() > -1e-6 and abs(slope[x > 1e-9]).max() < 1e-6


def test_odd_rows_are_packed(spark, odd_documents):
    rows = K.pack_sequences(odd_documents).collect()
    assert check_packing(rows, 2048) and sum(r["doc_id"] == 4 for r in rows) == 2
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert K.pack_sequences(odd_documents.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity

def labelled(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmn')}{rng.randrange(30)}" for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["grumblesnark", "Vexatious", "pestilent"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    out = T.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 150 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out)
    assert np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.97
    kept = T.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and 450 < kept.count() < 540


def test_length_does_not_decide(spark):
    """Long clean texts stay clean, random letters too, and a toxic part counts however long the rest is."""
    docs, labels = labelled(spark)
    model = T.train(docs, labels)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = random.Random(8)
    clean = [t for i, t in texts.items() if i not in toxic]
    long = " ".join(rng.choice(clean) for _ in range(3000))
    part = next(t for i, t in texts.items() if i in toxic)
    assert len(long) > 500_000 and T.score(long, model) < 0.5
    assert T.score("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(100_000)), model) < 0.5
    for at in (0, 300_007, len(long)):
        assert T.score(f"{long[:at]} {part} {long[at:]}", model) > 0.7


def test_features_are_exact():
    """A text has just the n-grams that are in it, across chunks and beside NUL bytes."""
    text = "\0\0\0\0abcd Abé" * 3
    data = f" {text} ".encode().lower()
    want = {data[i:i + n] for n in T.LENGTHS for i in range(len(data) - n + 1)}
    assert len(T.features(text)) == len(want) and len(T.features("")) == 0
    long = "x" * (T.CHUNK - 3) + "needle" + "y" * 100
    kept = np.sort(T.features("needle"))
    assert {"needle"[i:i + 4] for i in range(3)} <= {
        f" {long} "[p:p + 4] for p in T.kept_features(long, kept, T.filter_of(kept))[0].tolist()}


def test_odd_rows_are_scored(spark, odd_documents):
    _, labels = labelled(spark, 60)
    out = T.score_documents(odd_documents, labels).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 for r in out)
    assert T.score_documents(odd_documents, labels.limit(0)).where("predicted = 1").count() == 0
    assert T.score_documents(odd_documents.limit(0), labels).count() == 0


# ---------------------------------------------------------------- language models

def plain_losses(texts, good, lean=4.0):
    """Both models by dictionaries, one n-gram after the other."""
    def model(chosen):
        counts = {}
        for t in chosen:
            data = bytes(L.ORDER - 1) + (t or "").encode()
            for i in range(L.ORDER - 1, len(data)):
                for k in range(1, L.ORDER + 1):
                    g = data[i - k + 1:i + 1]
                    counts[g] = counts.get(g, 0) + 1
                    h = (len(g), g[:-1])
                    counts[h] = counts.get(h, 0) + 1

        def p(g):
            low = p(g[1:]) if len(g) > 1 else 1 / 256
            return (counts.get(g, 0) + lean * low) / (counts.get((len(g), g[:-1]), 0) + lean)
        return p

    target, every = model([t for i, t in enumerate(texts) if i in good]), model(texts)
    out = []
    for t in texts:
        data = bytes(L.ORDER - 1) + (t or "").encode()
        grams = [data[i - L.ORDER + 1:i + 1] for i in range(L.ORDER - 1, len(data))]
        out.append(tuple(np.mean([-np.log2(m(g)) for g in grams]) for m in (target, every)) if grams else (None, None))
    return out


@pytest.mark.parametrize("chunk_bytes", [200, 10**7])
def test_losses_equal_plain_counting(spark, words, chunk_bytes):
    texts = [" ".join(words(n, 12)) for n in (3, 30, 60, 1)] + ["", None, "ünï ß", "a", "zz top " * 20]
    good = {0, 2, 6}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in L.score_language(docs, docs.where(F.col("doc_id").isin(*good)), chunk_bytes).collect()}
    for i, (target, every) in enumerate(plain_losses(texts, good)):
        assert out[i]["n_tokens"] == len((texts[i] or "").encode())
        if target is None:
            assert out[i]["score"] is None
        else:
            assert out[i]["ce_target"] == pytest.approx(target) and out[i]["ce_background"] == pytest.approx(every)
            assert out[i]["score"] == pytest.approx(target - every)


def test_odd_rows_have_losses(spark, odd_documents):
    assert L.score_language(odd_documents, odd_documents.limit(0)).count() == 9
    assert L.score_language(odd_documents.limit(0), odd_documents).count() == 0


# ---------------------------------------------------------------- benchmark leaks

def edit_distance(a, b):
    """Smallest distance of a to any part of b, by the full table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert D.Item.of([1], a, 0.1).distance(b) == edit_distance(a, b)


@pytest.mark.parametrize("block_chars", [10**6, 300])
def test_leaks_within_the_budget_are_found(spark, block_chars):
    rng = random.Random(4)
    item = lambda: " ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{rng.randrange(50)}" for _ in range(30))
    items = [item() for _ in range(8)] + [None, "", "tiny item", item(), "short item of letters", "tiny item"]
    items[11] = items[0]
    rows, want = [], set()
    for i in range(60):
        text = [item(), item()]
        if i % 3 == 0:
            k = i // 3 % 8
            leak = list(items[k])
            for _ in range(rng.randrange(0, int(0.06 * len(leak)) + 1)):
                leak[rng.randrange(len(leak))] = rng.choice("xyz")
            text.insert(1, "".join(leak).upper().replace(" ", " ,\n"))
            want |= {(i, k)} | ({(i, 11)} if k == 0 else set())
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([*rows, (60, None), (61, "a Tiny, item!"), (62, "tinyitem tiny items"),
                                  (63, "a short itm of letters"), (64, "a shrt itm of letters")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (0, items[0]), (0, items[0])], "item_id long, text string")
    rows += [(63, "a short itm of letters"), (64, "a shrt itm of letters")]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench, block_chars=block_chars).collect()}
    plain = {i: D.plain(t) for i, t in enumerate(items)}
    brute = {(d, i) for d, t in rows for i, p in plain.items() if int(0.06 * len(p))
             and edit_distance(p, D.plain(t)) <= int(0.06 * len(p))}
    assert got == brute | {(61, 10), (61, 13)} and want <= got and (63, 12) in got
    assert {r["doc_id"] for r in D.drop_leaks(docs, bench, block_chars=block_chars).collect()} == set(range(65)) - {d for d, _ in got}


def test_odd_rows_have_no_leaks(spark, odd_documents):
    bench = spark.createDataFrame([(1, "some benchmark item that is long enough to count")], "item_id long, text string")
    assert D.find_leaks(odd_documents, bench).count() == 0
    assert D.drop_leaks(odd_documents, bench.limit(0)).count() == 9


# ---------------------------------------------------------------- pages

PAGE = """<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header>Site</header><nav><ul><li>x</ul></nav>
<div class="ad big">buy</div><article class=post><header><h1>Head &amp; line</h1></header><p>One<br>two <b>bold<p>Three &lt;x&gt;
<div class="share-bar">Share</div><div>{extra}</div><form>mail</form><section id="comments"><article class="comment">lol</article>
</section></article><aside>side</aside><footer>&copy; f"""


def test_main_text():
    assert H.page_text(PAGE.format(extra="own")) == "Head & line\nOne two bold\nThree <x>\nown"
    assert H.page_text("plain <i>text</i><div>a</div>b") == "plain text\na\nb"
    assert H.page_text("<p>1 < 2 &amp; 3 &#233;<p>") == "1 < 2 & 3 é" and H.page_text("") == ""


def test_marks_are_attributes_not_words():
    long = "a" * 5_000
    assert H.page_text(f'<p data-x="{long}>junk">hello') == "hello"
    assert H.page_text('<p title="hidden gem" data-hidden="x">seen</p><p hidden>not</p>') == "seen"
    assert H.page_text('<p x="open>text</p><p>more') == "text\nmore"
    assert H.page_text("a<!-- <p> x") == "a" and H.page_text("1 > 0 <a <!-- x") == "1 > 0 <a"


@pytest.mark.parametrize("html", [
    "<a " * 330_000, "<div>" * 80_000 + "</x>" * 80_000, "<a b='\">" * 120_000, "<!" * 500_000,
    "<script>" + "</script " * 100_000, "<p><x><b>" + "<b>" * 80_000 + "<hr>" * 80_000,
    "<li><ul>" + "<div>" * 80_000 + "<li></li>" * 50_000, "<p " + "id " * 330_000 + ">x"])
def test_odd_markup_takes_linear_time(html):
    start = time.monotonic()
    H.page_text(html, frozenset([1]))
    assert time.monotonic() - start < 10


def test_site_templates_go(spark):
    rows = [(i, f"https://a.org/{i}", PAGE.format(extra="<div>Read our terms</div>") .replace("One", f"One {i}")) for i in range(8)]
    rows += [(20 + i, f"http://b.org/{i}", PAGE.format(extra="<div>Read our terms</div>").replace("One", f"One {i}")) for i in range(2)]
    rows += [(40, None, None), (41, "odd", ""), (41, "odd", ""), (42, "http://c.org", "<p>" * 3000 + "deep" + "<div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r["page_id"]: r for r in H.extract_text(pages).collect()}
    assert got[3]["text"] == "Head & line\nOne 3 two bold\nThree <x>"
    assert got[20]["text"].endswith("Read our terms")       # two pages make no template
    assert got[40]["text"] == "" and got[42]["text"] == "deep" and got[3]["n_chars"] == len(got[3]["text"])
    assert H.extract_text(pages).count() == 14 and H.extract_text(pages.limit(0)).count() == 0


def test_an_article_line_that_recurs_stays(spark):
    rows = [(i, f"https://a.org/{i}", f"<article><p>Same line.</p><p>Own {i}.</p></article><p>Imprint</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in H.extract_text(pages).collect()} == {f"Same line.\nOwn {i}." for i in range(9)}


# ---------------------------------------------------------------- graph search

def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 16)).astype(np.float32)
    base[200:500] = base[200]       # many copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(7, [float(x) for x in base[7]])]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(0))
    got = {}
    for r in G.nearest_neighbours(table, shard_rows=400, block_rows=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    wide, hits = base.astype(np.float64), 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert all(abs(s - wide[i] @ wide[q]) < 1e-9 for _, i, s in found)
        scores = (wide * wide[q]).sum(axis=1)
        true = [i for i in np.lexsort((np.arange(1500), -scores)) if i != q][:20]
        hits += len(set(true) & {f[1] for f in found})
        keys = [(-s, i) for _, i, s in found]
        assert keys == sorted(keys)
    assert hits >= 0.9 * 20 * len(got)
    assert G.nearest_neighbours(table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in G.nearest_neighbours(few).collect() if r["query_id"] == 0].__len__() == 2


def recall_of(found, vectors, top=20):
    """Share of the nearest by brute force that was found; found: query -> ids."""
    hits = total = 0
    for q, ids in found.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        true = np.argpartition(-scores, top)[:top]
        hits, total = hits + len(set(true.tolist()) & set(ids)), total + top
    return hits / total


@pytest.mark.parametrize("norms", ["one large", "spread", "huge"])
def test_recall_does_not_hang_on_norms(spark, norms):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    if norms == "one large":
        base[17] *= 1e4
    elif norms == "spread":
        base *= rng.uniform(1, 3, (3000, 1))
    else:
        base *= 1e150
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    found = {}
    for r in G.nearest_neighbours(table, least_shards=2).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 150 and recall_of(found, base) >= 0.95


def test_recall_of_a_full_shard_without_clusters():
    """A shard of half the default size; figures of a full one are in the README."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(10_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    edges, entries = G.build_graph(G.lifted(base))
    points, asked = G.padded(G.lifted(base), 0), base[:10_000:200]
    flat = np.column_stack([asked, np.zeros(len(asked))]).astype(np.float32)
    near, _ = G.beam_search(points, np.einsum("ij,ij->i", points, points), G.padded(edges, -1), entries, flat,
                            G.wide(G.SEARCH_BEAM, len(base)))
    assert recall_of({200 * i: n[1:21].tolist() for i, n in enumerate(near)}, base) >= 0.95


# ---------------------------------------------------------------- queries

def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("row", F.lit(1))
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema
        docs = out.cache()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] < sizes[0] <= 200 and sizes[3] == sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, 2048)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_registered_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES)
    assert numbers == list(range(1, 11)) and not set(catalog.ORACLES) - set(catalog.QUERIES)


def test_texts_of_white_space_alone_are_packed(spark):
    """Runs that the fast encoder's pattern cannot read."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + "\t " * 600_000 + "b", " " * 99_999 + "x"]
    found = K.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(K.vocabulary_files()[0])
    for i, text in enumerate(texts):
        assert found[found["doc_id"] == i]["length"].sum() == len(plain.encode(text, add_special_tokens=False).ids) + 1


def test_merged_counts_equal_plain_ones(spark, monkeypatch):
    """Tables that are merged and flushed often give the counts of one pass."""
    monkeypatch.setattr(T, "OPEN_GRAMS", 50)
    monkeypatch.setattr(T, "HELD_GRAMS", 120)
    texts = [("the bad words", 1), ("the good words", 0), (None, 1), ("", 0), ("bad bad bad", 1), ("the the", 0)] * 5
    found = {r["gram"]: (r["toxic"], r["clean"]) for r in
             T.feature_ratios(spark.createDataFrame(texts, "text string, toxic int").coalesce(1)).collect()}
    wanted = {}
    for text, toxic in texts:
        for gram in T.features(text or "").view("int64").tolist():
            a, b = wanted.get(gram, (0, 0))
            wanted[gram] = (a + toxic, b + 1 - toxic)
    assert found == wanted
