"""Language models against their definitions, and held-out results on the given tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import corpus
from lumenframe.operators import language_models as lm
from lumenframe.operators import learning
from lumenframe.operators import scaling as sc

FOLDER = "/root/testdata/sf0.1"


def brute(docs, good, k):
    split = lambda t: (t or "").lower().split()
    alone, pair, behind = Counter(), Counter(), Counter()
    for _, t in good:
        w = split(t)
        alone.update(w)
        pair.update(zip(w, w[1:]))
        behind.update(w[:-1])
    total = sum(alone.values()) + len(alone) + 1
    out = {}
    for i, t in docs:
        w = split(t)
        if w:
            logs = [math.log((pair[a, b] + k * (alone[b] + 1) / total) / (behind[a] + k)) for a, b in zip(w, w[1:])]
            out[i] = round(math.exp(-(math.log((alone[w[0]] + 1) / total) + sum(logs)) / len(w)), 6)
    return out


def test_bigrams_equal_the_definition_also_with_hot_words(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: " ".join("the" if r.random() < 0.34 else f"w{int(r.paretovariate(0.7)) % 60}" for _ in range(n))
    docs = [(i, text(r.randint(1, 40))) for i in range(200)] + [(300, ""), (301, None), (302, "One")]
    good = docs[:80]
    d, g = (spark.createDataFrame(x, "id long, text string").repartition(4) for x in (docs, good))
    for least in (None, 40):
        if least:
            monkeypatch.setattr(sc, "MOST_SENT_KEYS", least)
            monkeypatch.setattr(sc.split_join, "__defaults__", (None, 3))
            monkeypatch.setattr(lm, "SMALL_WORDS", 3)
            spark.conf.set("lumenframe.hotRows", "5")
        try:
            got = {x.id: round(x.perplexity, 6) for x in lm.bigram_perplexity(d, "id", "text", g, 4.0).collect()}
        finally:
            spark.conf.unset("lumenframe.hotRows")
        assert got == brute(docs, good, 4.0)
    none = d.limit(0)
    assert lm.bigram_perplexity(none, "id", "text", g).collect() == [] and lm.bigram_perplexity(d, "id", "text", none).count() == 201


def test_a_word_in_a_third_of_all_places_stays_in_many_tasks(spark):
    rows = spark.range(90_000).select(F.when(F.col("id") % 3 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id"))).alias("word")).repartition(12)
    table = spark.createDataFrame([("the", 1), ("w1", 2)], "word string, n long")
    spark.conf.set("lumenframe.hotRows", "100000")
    try:
        joined = sc.split_join(rows, table, ["word"], small=1)
        tasks = [r["count"] for r in joined.where("word = 'the'").groupBy(F.spark_partition_id()).count().collect()]
        assert joined.count() == 90_000 and joined.where("n = 1").count() == 30_000 and joined.where("n = 2").count() == 1
    finally:
        spark.conf.unset("lumenframe.hotRows")
    assert len(tasks) >= 12 and max(tasks) < 6_000


def test_profiles_know_held_out_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = lm.held_out(F.col("doc_id"))
    found = lm.language_of(docs.where(out), "doc_id", "text", lm.fit_profiles(docs.where(~out), "text", "lang")).join(docs.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("lang") == F.col("language")).cast("double"))).first()[0]
    plain = corpus.language_bucket(docs.where(out), "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg(F.coalesce((F.col("lang") == F.col("language")).cast("double"), F.lit(0.0)))).first()[0]
    assert right > 0.97 and right >= plain


def test_profiles_of_odd_rows(spark):
    rows = [(1, "abcabc", "x"), (2, "xyzxyz", "y"), (3, None, "x"), (4, "ab", "y"), (5, "abca", None), (6, "zxyz \U0001f600", None)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = {r.id: r.language for r in lm.language_of(docs, "id", "text", lm.fit_profiles(docs, "text", "lang")).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None, 5: "x", 6: "y"}
    none = lm.fit_profiles(docs.limit(0), "text", "lang")
    assert none.names == () and all(r.language is None for r in lm.language_of(docs, "id", "text", none).collect())


def test_toxic_texts_rank_above_others(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    out = lm.held_out(F.col("doc_id"))
    model = learning.text_classifier(docs.where(~out), "text", "toxic")
    rows = learning.text_scores(model, docs.where(out), "doc_id", "text").join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    good, bad = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    assert len(good) > 20 and np.mean(good[:, None] > bad[None]) > 0.95


@pytest.mark.parametrize("text,want", [
    ("He lives at 221B Baker Street, London.", "He lives at [ADDRESS], London."), ("Send it to 1600 Pennsylvania Ave. today", "Send it to [ADDRESS] today"), ("12 Old Mill Lane", "[ADDRESS]"),
    ("Wohnhaft Hauptstraße 12a in Ulm", "Wohnhaft [ADDRESS] in Ulm"), ("Sie zog in die Goethestr. 5 um", "Sie zog in die [ADDRESS] um"), ("au 12, rue de la Paix à Paris", "au [ADDRESS] à Paris"),
    ("vive en Calle de Alcalá 45, Madrid", "vive en [ADDRESS], Madrid"), ("from 10.0.0.1 to a@b.org", "from [IP] to [EMAIL]"), ("the way 12 people drive", "the way 12 people drive"),
    ("In 1999 the Court met", "In 1999 the Court met"), ("Main Street was busy", "Main Street was busy"),
])
def test_addresses_are_replaced(spark, text, want):
    assert corpus.redact_personal(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").first().text == want


def test_perplexities_are_made_once(spark):
    from lumenframe.operators import corpus as cp

    d = spark.createDataFrame([(i, f"a b c w{i}") for i in range(20)], "id long, text string")
    p = lm.bigram_perplexity(d, "id", "text", d)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    assert cp.two_sided(p.mapInArrow(count, p.schema), "perplexity", 0.05, 0.95).count() == 20
    assert seen.value == 20
