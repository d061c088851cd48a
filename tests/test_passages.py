"""Shared passages against a look at every passage of every text."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import passages
from lumenframe.operators import scaling as sc
from lumenframe.operators.passages import Passages


def brute(docs, n):
    words = [(k, (t or "").encode().split()) for k, t in docs]
    count = {}
    for _, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            count[g] = count.get(g, 0) + 1
    out = []
    for k, w in words:
        covered = {j for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        starts = sorted(j for j in covered if j - 1 not in covered)
        out.append((k, len(w), len(covered), [(a, next(b for b in range(a, len(w) + 1) if b not in covered)) for a in starts]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r[0], r.n_words, r.shared_words, [tuple(s) for s in r.spans]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    header = text(40)
    quotes = [text(r.randint(5, 30)) for _ in range(8)]
    docs = []
    for k in range(150):
        parts = [header] if k % 3 == 0 else []
        parts += [r.choice([text(r.randint(0, 25)), r.choice(quotes)]) for _ in range(r.randint(0, 4))]
        docs.append((k, r.choice([" ", "\n"]).join(parts)))
    return [*docs, (None, header), (None, None), (7, docs[7][1]), (200, ""), (201, "x " * 3000)]


@pytest.mark.parametrize("settings", [Passages(12, 4), Passages(8, 8), Passages(20, 3), Passages(15, 1)])
def test_spans_equal_brute_force(spark, corpus, settings):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    got = rows_of(passages.shared_passages(docs, "doc_id", "text", settings))
    assert got == brute(corpus, settings.n) and sum(bool(r[3]) for r in got) > 50


def test_hot_passages_stay_in_many_tasks(spark, corpus, split_small_keys, monkeypatch):
    """A third of the texts share a header: its places are known by a table that is sent to them."""
    monkeypatch.setattr(sc, "MOST_SENT_KEYS", 100)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(6)
    settings = Passages(12, 4)
    assert rows_of(passages.shared_passages(docs, "doc_id", "text", settings)) == brute(corpus, 12)
    places = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("hash"), F.col("id").alias("at")).repartition(12)
    counted = places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1 or hash % 5 = 0")
    kept = sc.rows_of_keys(places, counted, "hash", "n")
    assert kept.count() == places.join(counted, "hash", "left_semi").count()
    tasks = [r["count"] for r in kept.where("hash = 1").groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) >= 12 and max(tasks) < 4_000


def test_winnowing_names_a_gram_of_every_passage():
    r = np.random.default_rng(2)
    grams = r.integers(0, 50, 3000).astype(np.uint64)
    at = passages.winnowed(grams, 9)
    assert max(np.diff(at)) <= 9 and at[0] < 9 and len(grams) - at[-1] <= 9
    again = passages.winnowed(np.concatenate([r.integers(0, 50, 31).astype(np.uint64), grams[100:400]]), 9)
    assert {a - 100 for a in at if 108 <= a < 392} == {a - 31 for a in again if 39 <= a < 323}
    assert len(passages.winnowed(grams[:8], 9)) == 0


def test_texts_of_shared_passages_go(spark):
    notice = " ".join(f"n{k}" for k in range(60))
    docs = [(1, notice), (2, f"{notice} and a few words"), (3, " ".join(f"own{k}" for k in range(200)) + " " + notice), (4, "short"), (5, None)]
    left = passages.drop_sharing(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5] and left.columns == ["doc_id", "text"]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert passages.shared_passages(none, "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        Passages(5, 6)
