"""Word vectors that are trained without holding all words on the driver."""

import heapq
from collections import Counter

import numpy as np

from lumenframe.operators import features as ft
from lumenframe.operators import word_vectors as wv


def huffman_cost(counts):
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_codes_follow_from_the_counts():
    r = np.random.default_rng(4)
    for n in (2, 3, 7, 500):
        counts = sorted((int(x) for x in r.zipf(1.6, n) % 1000 + 1), reverse=True)
        classes = Counter(counts)
        codes = wv.canonical(wv.code_lengths(np.array([*classes]), np.array([*classes.values()])))
        length, code = codes.of(np.arange(n))
        assert sum(c * x for c, x in zip(counts, length.tolist())) == huffman_cost(counts)
        words = sorted(format(c, f"0{x}b") for c, x in zip(code.tolist(), length.tolist()))
        assert sum(2.0**-x for x in length.tolist()) == 1 and not any(b.startswith(a) for a, b in zip(words, words[1:]))


def test_many_words_are_trained_without_the_driver(spark, monkeypatch):
    """Words of one topic end nearer to each other than to words of the other; MLlib isn't asked."""
    monkeypatch.setattr(ft, "Word2Vec", None)
    monkeypatch.setattr(ft, "DRIVER_WORDS", 3)
    monkeypatch.setattr(wv, "PIECE_WORDS", 30_000)
    r = np.random.default_rng(2)
    topics = [[f"{t}{i}" for i in range(20)] for t in "ab"]
    texts = [" ".join(r.choice(topics[i % 2], 40)) for i in range(6000)]
    rare = ["rare", "", None, "a1 rare", "a1"]
    d = spark.createDataFrame([*enumerate([*texts, *rare, *topics[0], *topics[1]])], "id long, text string").repartition(3)
    rows = {r["id"]: (r["text"], np.array(r["vector"])) for r in ft.mean_word_vectors(d, "text").collect()}
    assert len(rows) == len(texts) + 45 and all(v.shape == (16,) and np.isfinite(v).all() for _, v in rows.values())
    by = {t: v for t, v in rows.values()}
    assert not by["rare"].any() and not by[""].any() and not by[None].any()
    np.testing.assert_allclose(by["a1 rare"], by["a1"] / 2)
    text, vector = rows[0]
    np.testing.assert_allclose(vector, np.mean([by[w] for w in text.split()], 0), atol=1e-6)
    m = np.stack([by[w] for t in topics for w in t])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    assert s[:20, :20].min() > s[:20, 20:].max() and s[20:, 20:].min() > s[:20, 20:].max()
