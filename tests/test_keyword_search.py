"""Keyword search by postings and block maxima against scoring every text."""

import math
import random
import re
from collections import Counter

from lumenframe.operators import retrieval


def brute(docs, queries, k, k1=1.2, b=0.75):
    words = {i: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for i, t in docs}
    n, avg = len(words), sum(map(len, words.values())) / max(len(words), 1) or 1.0
    tf = {i: Counter(w) for i, w in words.items()}
    df = Counter(w for c in tf.values() for w in c)
    out = set()
    for q, t in queries:
        asked = {w for w in re.split(r"[\W_]+", (t or "").lower()) if w}
        score = {i: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * len(words[i]) / avg)) for w in asked if c[w]) for i, c in tf.items()}
        best = sorted((-round(s, 10), i) for i, s in score.items() if s > 0)[:k]
        out |= {(q, i, rank + 1, -s) for rank, (s, i) in enumerate(best)}
    return out


def got(df):
    return {(r.query_id, r.item_id, r["rank"], round(r.score, 10)) for r in df.collect()}


def corpus(n, seed=4):
    r = random.Random(seed)
    common = "the of and a to".split()
    docs = [(i, " ".join([r.choice(common) for _ in range(r.randint(1, 30))] + [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(r.randint(0, 30))])) for i in range(n)]
    queries = [(q, " ".join(r.choice(common) for _ in range(3)) + " " + " ".join(f"W{r.randint(1, 300)}" for _ in range(r.randint(0, 4)))) for q in range(40)]
    return docs, queries


def test_equals_scoring_every_text(spark):
    docs, queries = corpus(700)
    docs += [(900, None), (901, ""), (902, docs[3][1]), (903, docs[3][1])]
    queries += [(90, ""), (91, None), (92, "unknownword"), (93, "the the the")]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "id long, text string")
    want = brute(docs, queries, 6)
    assert got(retrieval.bm25_topk(d, q, 6)) == want
    assert got(retrieval.bm25_topk(d, q, 6, doc_block=100, query_block=7)) == want
    assert retrieval.bm25_topk(d.limit(0), q, 6).collect() == [] == retrieval.bm25_topk(d, q.limit(0), 6).collect()


def test_runs_that_cannot_win_are_skipped(spark, monkeypatch):
    """Texts come in runs of one topic; a query adds up the postings of its own topic, not those of the words that all texts hold."""
    r = random.Random(2)
    docs = [(i, f"the of and topic{i // 400} " + " ".join(f"w{r.randint(0, 50)}" for _ in range(6))) for i in range(8000)]
    queries = [(q, f"the of and topic{q}") for q in range(20)]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "id long, text string")
    monkeypatch.setattr(retrieval, "MAXIMA_BLOCK", 50)
    seen = spark.sparkContext.accumulator(0)
    near = retrieval.bm25_topk(d.coalesce(1), q, 5, doc_block=10_000, scored=seen).collect()
    assert len(near) == 100 and all(r.item_id // 400 == r.query_id for r in near)
    assert 0 < seen.value < 0.4 * 20 * 8000 * 3


def test_a_task_meets_a_bounded_number_of_texts(spark, monkeypatch):
    """70,000 texts are scored in nine blocks, however few tasks run at once."""
    from pyspark.sql import functions as F

    seen, real = spark.sparkContext.accumulator(0), retrieval._score_block

    def counted(k, scored):
        score = real(k, scored)

        def block(postings, asked):
            seen.add(1)
            return score(postings, asked)

        return block

    monkeypatch.setattr(retrieval, "_score_block", counted)
    docs = spark.range(70_000).select("id", F.concat(F.lit("the w"), F.col("id") % 50).alias("text"))
    near = retrieval.bm25_topk(docs, spark.createDataFrame([(1, "the w7")], "id long, text string"), 3).collect()
    assert [r.item_id for r in sorted(near, key=lambda r: r["rank"])] == [7, 57, 107]
    assert seen.value >= 9
