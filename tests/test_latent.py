"""Latent vectors against a dense SVD, and what they bring near."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marlspike.operators import embedding, latent, ranking
from marlspike.plans import catalog


def dense(texts, features, idf):
    """The weighted matrix, row by row."""
    out = np.zeros((len(texts), features))
    for k, t in enumerate(texts):
        for at, n in zip(*latent.counted(t, features)):
            out[k, at] = (1 + np.log(n)) * idf[at]
        if (size := np.linalg.norm(out[k])) > 0:
            out[k] /= size
    return out


def topical(seed=4, docs=240):
    """(topic, text): texts of one topic draw a few of its 60 words, so many pairs of them share none."""
    rng = random.Random(seed)
    words = [[f"t{t}w{k}" for k in range(60)] for t in range(6)]
    return [(k % 6, " ".join(rng.choices(words[k % 6], k=9) + rng.choices(["the", "of", "and"], k=3))) for k in range(docs)]


def test_directions_equal_those_of_a_dense_svd(spark, monkeypatch):
    monkeypatch.setattr(latent, "CHUNK", 100)
    texts = [t for _, t in topical()] + [None, "", " \t", "... !"]
    rows = spark.createDataFrame([(t,) for t in texts], "document string").repartition(5)
    model = latent.LatentEmbedder.fit(rows, dimension=5, features=512, passes=12, max_parts=3)
    matrix = dense(texts, 512, model.idf)
    _, values, right = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(model.singular, values[:5], rtol=1e-4)
    assert np.allclose(np.abs((model.directions * right[:5].T).sum(axis=0)), 1.0, atol=1e-3)
    own = matrix @ model.directions
    want = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    assert np.allclose(model.embed(texts), want, atol=1e-9)
    assert np.abs(np.array(model.embed(texts[-4:]))).sum() == 0.0
    again = latent.LatentEmbedder.fit(rows, dimension=5, features=512, passes=12, max_parts=3)
    assert np.allclose(again.directions, model.directions, atol=1e-6)


def test_related_texts_are_near_without_a_shared_word(spark, tmp_path):
    rows = topical()
    docs = spark.createDataFrame([(k, topic, text) for k, (topic, text) in enumerate(rows)], "id long, topic int, document string")
    model = latent.LatentEmbedder.fit(docs, dimension=8, features=2048)
    model.save(spark, str(tmp_path / "model"))
    back = latent.LatentEmbedder.load(spark, str(tmp_path / "model"))
    vectors = np.array([r.embedding for r in embedding.embedded(docs, back).orderBy("id").collect()])
    score = vectors @ vectors.T
    common, near, far = {"the", "of", "and"}, [], []
    for i, (s, a) in enumerate(rows):
        for j, (t, b) in enumerate(rows[:i]):
            if not (set(a.split()) & set(b.split()) - common):
                (near if s == t else far).append(score[i, j])
    assert len(near) > 100 and np.quantile(near, 0.05) > np.quantile(far, 0.95)
    query = docs.where("id = 0").selectExpr("id as q").crossJoin(spark.createDataFrame([(back.embed(["t2w1 t2w2 t2w3"])[0],)], "query array<double>"))
    found = ranking.batch_top_k(query, embedding.embedded(docs, back), 10, "q", ["id"]).collect()
    assert {r.topic for r in found} == {2}


def test_no_texts(spark):
    model = latent.LatentEmbedder.fit(spark.createDataFrame([], "document string"), dimension=4, features=64)
    assert np.abs(np.array(model.embed(["some words"]))).sum() == 0.0


def test_words_of_many_texts_are_counted_as_of_one():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abZ_09 éßİΣς中𝔘٣²\u200d\n.,’ \x00", k=rng.randint(0, 90))) for _ in range(300)] + [None, "", "x" * 64 + " " + "é" * 33 + " " + "y" * 500]
    for features in (7, 8192, 100_000):
        at, n, sizes = latent.counted_all(texts, features)
        one = [latent.counted(t, features) for t in texts]
        assert sizes.tolist() == [len(a) for a, _ in one]
        assert at.tolist() == [x for a, _ in one for x in a] and n.tolist() == [x for _, b in one for x in b]


def wordy(rows, places, features, seed=7):
    """Sparse rows of so many places each, and their idf."""
    rng = np.random.default_rng(seed)
    sizes = np.broadcast_to(places, rows)
    at = np.concatenate([np.sort(rng.permutation(features)[:k]) for k in sizes])
    return at, rng.integers(1, 9, len(at)), sizes, rng.random(features) + 1


def test_dense_and_sparse_rows_give_the_same_products(monkeypatch):
    """Also where both are in one batch and more than one matrix is filled."""
    monkeypatch.setattr(latent, "DENSE_ROWS", 4)
    at, n, sizes, idf = wordy(30, [1, 79, 0, *range(43, 70)], 512)
    basis = np.random.default_rng(1).normal(size=(512, 6))

    def products():
        out = np.zeros((512, 6))
        parts = list(latent._chunks(at, n, sizes, idf))
        for rows in parts:
            rows.twice(basis, out)
        return out, np.concatenate([rows.times(basis) for rows in parts])

    found = []
    for sparse in (0, 9, 10**6):
        monkeypatch.setattr(latent, "SPARSE", sparse)
        found.append(products())
    for other in found[1:]:
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(found[0], other))
    assert np.abs(found[0][0]).sum() > 1


def test_wordy_rows_are_multiplied_fast():
    """A pass over 300 rows of 300 places takes 0.1 s or less with matrices, 0.3 without: below the half of that of single values."""
    at, n, sizes, idf = wordy(300, 300, 8192)
    basis = np.random.default_rng(1).normal(size=(8192, 80))

    def best(f):
        took = []
        for _ in range(5):
            start = time.perf_counter()
            f()
            took.append(time.perf_counter() - start)
        return min(took)

    def single():
        """As rows were multiplied before: a line of directions for every value."""
        row = np.repeat(np.arange(300), sizes)
        products = np.add.reduceat(idf[at][:, None] * basis[at], np.flatnonzero(np.diff(row, prepend=-1)))
        order = np.argsort(at, kind="stable")
        np.add.reduceat(idf[at][order][:, None] * products[row[order]], np.flatnonzero(np.diff(at[order], prepend=-1)))

    assert best(lambda: [r.twice(basis, np.zeros((8192, 80))) for r in latent._chunks(at, n, sizes, idf)]) < 0.6 * best(single)


def test_rows_keep_their_columns_and_get_the_vectors_of_the_model(spark):
    docs = spark.createDataFrame([(k, None if k % 9 == 0 else text, [topic]) for k, (topic, text) in enumerate(topical())], "id long, document string, topics array<int>").repartition(3)
    model, rows = latent.LatentEmbedder.fit_embedded(docs, dimension=8, features=2048)
    assert np.allclose(model.directions, latent.LatentEmbedder.fit(docs, dimension=8, features=2048).directions, atol=1e-6)
    want = {r.id: r for r in embedding.embedded(docs, model).collect()}
    found = rows.collect()
    assert rows.columns == ["id", "topics", "embedding"] and len(found) == 240 == len({r.id for r in found})
    assert all(r.topics == want[r.id].topics and np.allclose(r.embedding, want[r.id].embedding, atol=1e-6) for r in found)
    assert sum(not any(r.embedding) for r in found) == 27


def test_texts_are_read_once(spark, small_dir):
    """The result is made of the counted words: its plan reads no text again."""
    found = catalog.QUERIES["latent_similar"](spark, small_dir)
    assert not [f for f in found.inputFiles() if "documents" in f] and found.count() > 0


def test_best_rows_of_blocks_are_those_of_all_pairs(monkeypatch):
    """With ties, rows low in information, missing vectors and other lengths, whatever the parts."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(-2, 3, 3).astype(float).tolist() for _ in range(400)] + [None, [], [1.0, 2.0], [0.0, 0.0, 0.0]]
    asked = [rng.integers(-2, 3, 3).astype(float).tolist() for _ in range(30)] + [None, [2.0, 1.0]]
    lows, ids = rng.random(len(rows)) < 0.3, rng.permutation(len(rows))
    place = ranking._places([pa.array([None if k == 7 else int(k) for k in ids])], len(rows))

    def score(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return max(0.0, float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))))

    want = set()
    for q, b in enumerate(asked):
        best = sorted((bool(lows[k]), -round(score(a, b), 4), ids[k] != 7, ids[k], k) for k, a in enumerate(rows))[:6]
        want |= {(q, k, -s) for _, s, _, _, k in best}
    vectors, queries = (pa.array(x, pa.list_(pa.float64())) for x in (rows, asked))
    for part in (1024, 64, 5):
        monkeypatch.setattr(ranking, "ROWS_PART", part)
        q, k, s = ranking._best(vectors, lows, place, ranking._Queries(queries), 6, 1e-4, lambda x: ranking._rounded(x, 4), ranking._cosines)
        assert {(a, b, round(c, 4)) for a, b, c in zip(q.tolist(), k.tolist(), s.tolist())} == want and len(q) == len(want)


def test_many_equal_rows_are_ranked_fast(spark):
    """4 million pairs that tie: 2.4 s on 4 cores, and 21.6 when each of them was put in a list."""
    one = F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>")
    rows = spark.range(20_000).select(F.col("id"), one.alias("embedding"), F.lit(False).alias("low_information"))
    queries = spark.range(200).select(F.col("id").alias("q"), one.alias("query"))
    run = lambda n: sorted((r.q, r["rank"], r.id) for r in ranking.batch_top_k(queries.where(f"q < {n}"), rows, 3, "q", ["id"], 4).collect())
    run(1)
    start = time.perf_counter()
    found = run(200)
    took = time.perf_counter() - start
    assert found == [(q, k + 1, k) for q in range(200) for k in range(3)] and took < 5, took
