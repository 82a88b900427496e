import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

import talentlake.operators.encoder as encoder
from talentlake.operators.encoder import LearnedEncoder
from talentlake.operators.similarity import encode, top_k_similar


def texts_of(n, seed=5):
    """Three topics with words of their own, beside common ones."""
    rng = random.Random(seed)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("data", "cook", "nurse")]
    return [" ".join(rng.choices(["the", "of"], k=3) + rng.choices(topics[i % 3], k=6)) for i in range(n)]


def matrix(spark, texts, dims):
    """The weighted rows by plain loops, buckets taken from the encoder."""
    rows = [Counter(r.embedding) for r in encode(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", dims=dims)
            .orderBy("i").collect()]
    df = Counter(b for r in rows for b in r)
    a = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        for b, n in r.items():
            a[i, b] = n * (math.log((1 + len(rows)) / (1 + df[b])) + 1)
        a[i] /= np.linalg.norm(a[i]) or 1
    return a


def test_vectors_are_the_singular_vectors_up_to_sign(spark):
    texts, dims = texts_of(300) + [None, "", "zebra", "the"], 256
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    model = LearnedEncoder.fit(df, "text", dims=dims, rank=3, rounds=30)
    a = matrix(spark, texts, dims)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.singular, s[:3], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(model.vectors * vt[:3].T, axis=0)), 1, atol=1e-6)
    got = {r.id: r.embedding for r in model.vectors_of(df, "id", "text").collect()}
    assert np.allclose([got[i] for i in range(len(texts))], a @ model.vectors, atol=1e-9)


def test_rows_in_another_order_give_the_same_space(spark):
    texts = texts_of(120)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    one, other = (LearnedEncoder.fit(x, "text", dims=128, rank=3, rounds=20) for x in (df.coalesce(1), df.orderBy("text").repartition(7)))
    assert np.allclose(one.vectors @ one.vectors.T, other.vectors @ other.vectors.T, atol=1e-6)


def test_texts_without_common_words_meet_by_topic(spark):
    texts = texts_of(300)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    model = LearnedEncoder.fit(df, "text", dims=1024, rank=4)
    q = model.vectors_of(spark.createDataFrame([(1, "data3"), (2, "cook7"), (3, None)], "query_id int, text string"), "query_id", "text")
    hits = top_k_similar(model.vectors_of(df, "id", "text"), q, 20, "id").collect()
    for query, topic in ((1, "data"), (2, "cook")):
        ids = [r.id for r in hits if r.query_id == query]
        assert len(ids) == 20 and all(re.search(topic, texts[i]) for i in ids)
        assert any(f"{topic}{3 if topic == 'data' else 7} " not in texts[i] + " " for i in ids)
    empty = LearnedEncoder.fit(df.limit(0), "text", dims=64, rank=2)
    assert not empty.vectors.any() and empty.vectors_of(df.limit(2), "id", "text").count() == 2


def test_a_round_multiplies_common_buckets_densely(monkeypatch):
    """A' (A v) of rows with common and rare buckets, empty rows, and one longer than a step, by dense matrices."""
    monkeypatch.setattr(encoder, "CELLS", 300)
    rng = np.random.default_rng(3)
    texts = [(rng.zipf(1.3, rng.integers(0, 25)) % 50).tolist() for _ in range(120)] + [[], list(range(50)) * 2, [49]]
    idf, v = rng.random(50) + 1, rng.standard_normal((50, 6))
    a = np.array([np.bincount(np.array(x, int), minlength=50) * idf for x in texts])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    for dense in (0.0, 0.2, 1.0):
        monkeypatch.setattr(encoder, "DENSE", dense)
        total = np.ones((50, 6))
        encoder._add_product(pa.array(texts, pa.list_(pa.int32())), idf, v, total)
        assert np.allclose(total - 1, a.T @ (a @ v), atol=1e-12)
