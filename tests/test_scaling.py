"""The split paths for hot keys give the plain window's result."""

import random

import pandas as pd
import pytest
from compare import _rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import udfs
from lumenframe.operators import business, joins, learning, retrieval, statistics, windows
from lumenframe.operators import scaling as sc


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds half of the rows; ties, null keys and null values."""
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        key = "hot" if i % 2 else rnd.choice(["a", "b", "c", None])
        v = None if rnd.random() < 0.1 else float(rnd.randint(-5, 9))
        rows.append((i, key, rnd.randint(0, 150), v))
    return spark.createDataFrame(rows, "id int, k string, t int, v double").repartition(5)


def same(a, b):
    assert _rows(a.columns, [tuple(r) for r in a.collect()]) == _rows(b.columns, [tuple(r) for r in b.collect()])


def test_running(skewed):
    aggs = {"s": ("sum", "v"), "n": ("count", "v"), "hi": ("max", "v"), "lo": ("min", "v"), "last": ("last", "v"),
            "s0": ("sum", "v", "before"), "n0": ("count", F.lit(1), "before"), "l0": ("last", "v", "before")}
    for keys in (["k"], []):
        same(sc.running(skewed, keys, ["t", "id"], aggs, 10), sc.running(skewed, keys, ["t", "id"], aggs, 10**9))


def test_running_down(skewed):
    aggs = {"s": ("sum", "v"), "n": ("count", F.lit(1), "before")}
    same(sc.running(skewed, ["k"], ["-t", "id"], aggs, 10), sc.running(skewed, ["k"], ["-t", "id"], aggs, 10**9))


def test_neighbours(skewed):
    exprs = {"lag3": lambda w: F.lag("v", 3).over(w), "lead2": lambda w: F.lead("v", 2).over(w),
             "mean": lambda w: F.avg("v").over(w.rowsBetween(-4, 3)), "n": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-4, 3))}
    for keys, order in ((["k"], ["t", "id"]), ([], ["t", "id"]), (["k"], ["-t", "id"])):
        same(sc.neighbours(skewed, keys, order, exprs, 4, 3, 10), sc.neighbours(skewed, keys, order, exprs, 4, 3, 10**9))


def test_ranked(skewed):
    same(sc.ranked(skewed, ["k"], ["t", "id"], {"rn": "row_number", "q": "ntile:7"}, 10),
         sc.ranked(skewed, ["k"], ["t", "id"], {"rn": "row_number", "q": "ntile:7"}, 10**9))
    names = {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"}
    same(sc.ranked(skewed, ["k"], ["t"], names, 10), sc.ranked(skewed, ["k"], ["t"], names, 10**9))


def test_text_order_and_ties(skewed):
    """Blocks follow the whole order list: a text column comes first, and most rows tie on it."""
    tied = skewed.withColumn("day", F.concat(F.lit("d"), (F.col("t") % 2).cast("string")))
    order = ["day", "t", "id"]
    same(sc.ranked(tied, ["k"], order, {"rn": "row_number"}, 10), sc.ranked(tied, ["k"], order, {"rn": "row_number"}, 10**9))
    same(sc.running(tied, ["k"], order, {"s": ("sum", "v"), "l": ("last", "v")}, 10), sc.running(tied, ["k"], order, {"s": ("sum", "v"), "l": ("last", "v")}, 10**9))
    back = {"a": lambda w: F.lag("v", 25).over(w), "b": lambda w: F.lead("id", 13).over(w)}
    spark = tied.sparkSession
    spark.conf.set("lumenframe.blockRows", "20")
    try:
        cut, split = sc.split_hot(tied, ["k"], order, 10)
        sizes = cut.where("_hot").groupBy("k", "_blk").count().agg(F.max("count"), F.count("*")).first()
        assert split and sizes[0] < 100 and sizes[1] > 20
        same(sc.neighbours(tied, ["k"], order, back, 25, 13, 10), sc.neighbours(tied, ["k"], order, back, 25, 13, 10**9))
    finally:
        spark.conf.unset("lumenframe.blockRows")


def test_many_hot_keys(spark):
    rows = spark.range(40_000).select((F.col("id") % 12_000).alias("k"), F.col("id"), (F.col("id") * 7 % 11).alias("v"))
    same(sc.running(rows, ["k"], ["id"], {"s": ("sum", "v")}, 2), sc.running(rows, ["k"], ["id"], {"s": ("sum", "v")}, 10**9))


def test_kappa_of_a_long_scale(spark):
    import numpy as np

    from lumenframe.operators import evaluation

    r = np.random.default_rng(3)
    x = r.integers(0, 30_000, 4_000)
    y = np.where(r.random(4_000) < 0.4, x, r.integers(0, 30_000, 4_000))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for kind, apart in (("none", lambda d: (d != 0).astype(float)), ("linear", np.abs), ("quadratic", lambda d: d.astype(float) ** 2)):
        want = 1 - apart(x - y).sum() / (apart(x[:, None] - y[None, :]).sum() / len(x))
        assert abs(evaluation.kappa(df, "x", "y", kind).first()["kappa"] - want) < 1e-9


def test_trailing(spark, skewed):
    timed = skewed.withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    us = 600 * 1_000_000
    exprs = {"n": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-us, 0)), "s": lambda w: F.sum("v").over(w.rangeBetween(-us, 0))}
    same(sc.trailing(timed, ["k"], "ts", 600, exprs, 10), sc.trailing(timed, ["k"], "ts", 600, exprs, 10**9))
    a = windows.distinct_trailing(timed, ["k"], "ts", 600, "v", "d", 10).select("id", "d")
    w = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-us, 0)
    b = timed.select("id", F.size(F.collect_set(F.coalesce("v", F.lit(-99.0))).over(w)).alias("d"))
    same(a, b)


def test_quantiles(skewed):
    for by in ([], ["k"]):
        args = (skewed, ["v", "t"], [0, 0.1, 0.25, 0.5, 0.9, 1.0], by)
        same(sc.exact_quantiles(*args, max_values=2, hot_rows=10), sc.exact_quantiles(*args))


def test_asof_and_sessions(spark, skewed):
    timed = skewed.withColumn("ts", F.timestamp_seconds(F.col("t") * 700))
    right = timed.where(F.col("v").isNotNull()).groupBy("k", F.col("ts").alias("rts")).agg(F.max("v").alias("x"))
    left = timed.select("id", "k", "ts")
    for tol in (None, 800):
        same(joins.asof_join(left, right, "k", "ts", "rts", ["x"], tol, hot_rows=10), joins.asof_join(left, right, "k", "ts", "rts", ["x"], tol, hot_rows=10**9))
    same(business.sessionize(timed, "k", "ts", 1800, "id", 10), business.sessionize(timed, "k", "ts", 1800, "id", 10**9))


def test_session_gap_edges(spark):
    """30 min stays, 30 m 30 s and 30 m 59 s split."""
    rows = [("u", 0), ("u", 1800), ("u", 1800 + 1830), ("u", 1800 + 1830 + 1859)]
    e = spark.createDataFrame(rows, "u string, s long").select("u", F.timestamp_seconds("s").alias("ts"))
    got = [r["session_id"] for r in business.sessionize(e, "u", "ts").orderBy("ts").collect()]
    assert got == [1, 1, 2, 3]


@pytest.mark.parametrize("block", ["2000000", "7", "64"])
def test_kendall_by_ranges(spark, block):
    rnd = random.Random(6)
    rows = [(rnd.randint(0, 25), rnd.choice([rnd.random(), float(rnd.randint(0, 9))])) for _ in range(500)] + [(None, 1.0), (3, None)] + [(4, 4.0)] * 60
    whole = [r for r in rows if None not in r]
    pairs = [((a[0] - b[0]) * (a[1] - b[1])) for i, a in enumerate(whole) for b in whole[:i]]
    spark.conf.set("lumenframe.blockRows", block)
    spark.conf.set("lumenframe.hotRows", "50")
    try:
        got = statistics.kendall_tau_b(spark.createDataFrame(rows, "x int, y double").repartition(3), "x", "y").first()
    finally:
        spark.conf.unset("lumenframe.blockRows")
        spark.conf.unset("lumenframe.hotRows")
    assert (got.concordant, got.discordant) == (sum(p > 0 for p in pairs), sum(p < 0 for p in pairs))
    none = statistics.kendall_tau_b(spark.createDataFrame([], "x int, y double"), "x", "y").first()
    assert tuple(none) == (0.0, 0.0, 0.0)


def test_knn_blocks(spark):
    rnd = random.Random(2)
    v = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(120)], "id long, vector array<double>")
    for metric in ("cosine", "euclidean"):
        same(retrieval.knn_join(v, v, 4, metric, block_rows=16), retrieval.knn_join(v, v, 4, metric))
    same(retrieval.cosine_topk(v, v, 4), retrieval.cosine_topk(v, v, 4, max_queries=5))


def test_custom_aggregate_equals_builtin(skewed):
    got = udfs.custom_aggregate(skewed.where("v is not null"), ["k"], ["v"], lambda p: {"n": float(len(p)), "s": float(p["v"].sum())},
                                lambda p: {"n": float(p["n"].sum()), "s": float(p["s"].sum())},
                                lambda p: {"mean": float(p["s"].iloc[0] / p["n"].iloc[0])}, "n double, s double", "mean double")
    same(got, skewed.where("v is not null").groupBy("k").agg(F.avg("v").alias("mean")))


def test_ordered_concat_parts(spark):
    d = spark.createDataFrame([("a", i, str(i)) for i in range(25)], "k string, p int, x string")
    parts = joins.ordered_concat(d, ["k"], ["p"], "x", ",", part_rows=10).orderBy("part").collect()
    assert [r["part"] for r in parts] == [0, 1, 2]
    assert ",".join(r["text"] for r in parts) == ",".join(str(i) for i in range(25))


def test_dbscan_matches_brute_force(spark):
    rnd = random.Random(7)
    pts = [(i, rnd.gauss(0, 1) + 5 * (i % 3), rnd.gauss(0, 1)) for i in range(180)] + [(1000 + i, 20 + rnd.random() * 0.1, 3.0) for i in range(30)]
    got = {r["id"]: r for r in learning.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 0.6, 5).collect()}
    near = {a[0]: [b[0] for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.36] for a in pts}
    core = {p for p, ns in near.items() if len(ns) >= 5}
    label = {}
    for p in sorted(core):
        if p in label:
            continue
        todo, label[p] = [p], p
        while todo:
            q = todo.pop()
            for n in near[q]:
                if n in core and n not in label:
                    label[n] = p
                    todo.append(n)
    kinds = {p: "core" if p in core else "border" if any(n in core for n in near[p]) else "noise" for p in near}
    assert {p: r["kind"] for p, r in got.items()} == kinds
    groups = {}
    for p in core:
        groups.setdefault(got[p]["cluster"], set()).add(label[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(label.values()))


def test_components_chain(spark):
    rows = [(i, f"a{i}") for i in range(40)] + [(i + 1, f"a{i}") for i in range(39)] + [(100, "z"), (101, "z")]
    got = {r["e"]: r["component"] for r in retrieval.shared_attribute_components(spark.createDataFrame(rows, "e int, a string"), "e", "a").collect()}
    assert {got[i] for i in range(40)} == {0} and got[100] == got[101] == 100


def test_most_frequent_shuffles_items_of_large_buckets_only(spark):
    """Equal to counting all items, with ties and repeated keys, and few of the rare items are counted one by one."""
    from lumenframe.operators import features as ft

    rows = spark.range(20_000).select(F.concat(F.lit("x"), F.when(F.col("id") % 2 == 0, F.col("id") % 40).otherwise(F.col("id"))).alias("item"), (F.col("id") % 7).alias("key"))
    whole = rows.groupBy("item").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys")).orderBy(F.desc("n"), "item")
    for top in (5, 20, 50):
        found = ft.most_frequent(rows, "item", "key", top)
        assert found.collect() == whole.limit(top).collect()
    plan = ft.most_frequent(rows, "item", "key", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    assert ft.most_frequent(rows.limit(0), "item", "key", 5).collect() == []


def test_unigram_perplexity_with_few_words_sent(spark, monkeypatch):
    from lumenframe.operators import corpus as cp

    d = spark.createDataFrame([(i, " ".join(["a"] * (i % 3) + [f"w{j}" for j in range(i % 9)])) for i in range(60)] + [(60, None), (3, "a z")], "id long, text string")
    want = {r.id: round(r.perplexity, 9) for r in cp.perplexity(d, "id", "text", d.where("id < 30")).collect()}
    monkeypatch.setattr(cp, "SENT_WORDS", 2)
    got = {r.id: round(r.perplexity, 9) for r in cp.perplexity(d, "id", "text", d.where("id < 30")).collect()}
    assert got == want and len(got) == 60 - 7  # seven without words


def test_word_vectors_are_trained_in_several_tasks(spark, monkeypatch):
    from lumenframe.operators import features as ft

    seen = []
    real = ft.Word2Vec
    monkeypatch.setattr(ft, "Word2Vec", lambda **k: (seen.append(k["numPartitions"]), real(**k))[1])
    d = spark.createDataFrame([(f"one two three four {i % 9}",) for i in range(200)], "text string")
    assert ft.mean_word_vectors(d, "text").count() == 200
    monkeypatch.setattr(ft, "TRAIN_CHARS", 1000)
    assert ft.mean_word_vectors(d, "text").count() == 200
    assert seen == [1, 4]


def test_kendall_moves_rows_a_fixed_number_of_times(spark, monkeypatch):
    """Thirty ranges take as many range partitionings as three."""
    frame = type(spark.range(1))
    moved, real = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: (moved.append(a), real(self, *a))[1])
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 40), rnd.randint(0, 200), rnd.randint(1, 3)) for _ in range(600)]
    cells = spark.createDataFrame(rows, "x int, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    held = cells.collect()
    want = sum(a.n * b.n for a in held for b in held if a.x < b.x and a.y > b.y)
    seen = []
    for block in ("20", "200", "1000000"):
        spark.conf.set("lumenframe.blockRows", block)
        try:
            assert statistics.discordant_pairs(cells) == want
        finally:
            spark.conf.unset("lumenframe.blockRows")
        seen.append(len(moved))
        moved.clear()
    assert seen == [2, 2, 1]
