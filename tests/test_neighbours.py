"""Nearest neighbours by pivots against comparing all pairs."""

import numpy as np
import pytest
from compare import _rows

from lumenframe.operators import neighbours, retrieval
from lumenframe.operators.neighbours import Cells

SMALL = Cells(cell_rows=25, item_block=40, query_block=64)


def table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(m)), m)], "id long, vector array<double>").repartition(4)


def clustered(n=3000, dim=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 10, (60, dim))
    return centres[r.integers(0, 60, n)] + r.normal(0, 0.3, (n, dim))


def brute(q, i, k, metric, qid, iid, skip_self=True, earlier_only=False, least=None):
    out = set()
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    for a, x in zip(qid, q):
        s = (unit(i) * unit(x[None])).sum(1) if metric == "cosine" else -np.sqrt(((i - x) ** 2).sum(1))
        ok = [(-round(float(v), 9), int(b)) for b, v in zip(iid, s) if not (skip_self and a == b) and not (earlier_only and b >= a) and (least is None or v >= least)]
        out |= {(int(a), b, rank + 1) for rank, (_, b) in enumerate(sorted(ok)[:k])}
    return out


def got(df):
    return {(r.query_id, r.item_id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_search_equals_all_pairs(spark, metric):
    m = clustered(700)
    m[100:140] = m[7]  # equal vectors: ties by id, and more of them than a block holds
    t = table(spark, m)
    ids = range(len(m))
    assert got(neighbours.nearest(t, t, 4, metric, cells=SMALL)) == brute(m, m, 4, metric, ids, ids)
    some = [k for k in ids if k % 9 == 0]
    assert got(neighbours.nearest(table(spark, m[some], some), t, 3, metric, skip_self=False, earlier_only=True, cells=SMALL)) == brute(m[some], m, 3, metric, some, ids, False, True)
    least = 0.999 if metric == "cosine" else -1.0
    assert got(neighbours.nearest(t, t, 5, metric, least=least, cells=SMALL)) == brute(m, m, 5, metric, ids, ids, least=least)


def test_exact_search_compares_few_pairs_of_clustered_data(spark):
    m = clustered()
    t = table(spark, m)
    seen = spark.sparkContext.accumulator(0)
    near = neighbours.nearest(t, t, 5, "euclidean", cells=Cells(cell_rows=30), compared=seen)
    want = retrieval.knn_join(t, t, 5, "euclidean")
    a, b = ([c for c in df.columns if c != "score"] for df in (near, want))
    assert _rows(a, [tuple(r) for r in near.select(a).collect()]) == _rows(b, [tuple(r) for r in want.select(b).collect()])
    assert 0 < seen.value < 0.1 * len(m) ** 2


def test_data_without_structure_is_searched_right(spark):
    m = np.random.default_rng(5).normal(size=(400, 30))
    t = table(spark, m)
    assert got(neighbours.nearest(t, t, 5, "cosine", cells=SMALL)) == brute(m, m, 5, "cosine", range(400), range(400))


def test_probes_reach_the_recall(spark):
    """Queries are the ids divisible by 50; cells grow in number with the rows, so the share of pairs that is compared falls."""
    shares = []
    for n in (2000, 8000):
        m = clustered(n, 16, seed=n)
        t = table(spark, m)
        q = t.where("id % 50 = 0")
        seen = spark.sparkContext.accumulator(0)
        near = got(neighbours.nearest(q, t, 5, "euclidean", probes=4, cells=Cells(cell_rows=60), compared=seen))
        want = got(neighbours.nearest(q, t, 5, "euclidean", cells=Cells(cell_rows=60)))
        pairs = lambda x: {p[:2] for p in x}
        assert len(pairs(near) & pairs(want)) >= 0.9 * len(want)
        shares.append(seen.value / (n * n / 50))
    assert shares[0] < 0.3 and shares[1] < shares[0]


def test_odd_vectors(spark):
    m = np.array([[0.0, 0], [1, 0], [0, 0], [-1, 0], [2, 0], [0, 1], [-0.0, 0]])
    ids = [5, 4, 3, 9, 1, 7, 0]
    t = table(spark, m, ids)
    for metric in ("cosine", "euclidean"):
        for k in (1, 3, 10):
            assert got(neighbours.nearest(t, t, k, metric, cells=SMALL)) == brute(m, m, k, metric, ids, ids)
    none = t.limit(0)
    assert neighbours.nearest(t, none, 2, cells=SMALL).collect() == [] == neighbours.nearest(none, t, 2, cells=SMALL).collect()
    with pytest.raises(ValueError):
        neighbours.nearest(t, t, 1, "manhattan")


def test_a_third_of_the_rows_alike(spark):
    """Copies leave the items down to k + 1 of them; their queries are spread over blocks."""
    m = clustered(900)
    m[::3] = m[0]
    t = table(spark, m)
    seen = spark.sparkContext.accumulator(0)
    near = got(neighbours.nearest(t, t, 2, "euclidean", cells=SMALL, compared=seen))
    assert near == brute(m, m, 2, "euclidean", range(900), range(900)) and seen.value < 0.2 * 900**2


def test_a_query_travels_once_to_a_group_of_cells(spark):
    from pyspark.sql import functions as F

    """Without structure every cell stays possible; copies are then counted by groups, not by cells."""
    r = np.random.default_rng(5)
    x = spark.createDataFrame([(i, r.normal(size=24).tolist()) for i in range(600)], "id long, vector array<double>")
    v = neighbours._directed(x, "cosine")
    pivots, n = neighbours.fit_pivots(v, Cells(cell_rows=20))
    placed = neighbours._placed(v, spark.sparkContext.broadcast(pivots), "t")
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")).collect()
    known = neighbours._Map(pivots, rows, 200)
    sizes = np.bincount(known.group, weights=known.n)
    assert len(pivots) == 30 and len(sizes) < 10 and sizes.max() <= 200
    sent = neighbours._sent(v.withColumn("reach", F.lit(float("inf"))), spark.sparkContext.broadcast(known), 6, 1, True)
    assert sent.count() <= 600 * len(sizes) and sent.agg(F.sum(F.size("cells"))).first()[0] >= 600 * 25


def test_blocks_of_the_plain_join_grow_with_the_rows(spark, monkeypatch):
    """Two thousand rows in blocks of five: some twenty blocks a side, not four hundred, and the same neighbours."""
    from pyspark.sql import functions as F

    x = table(spark, np.random.default_rng(8).normal(size=(2000, 4)))
    copies = []
    real = F.sequence
    monkeypatch.setattr(F, "sequence", lambda a, b, *c: (copies.append(b), real(a, b, *c))[1])
    near = retrieval.knn_join(x, x, 3, "euclidean", block_rows=5)
    assert len(copies) == 2 and all(spark.range(1).select(c.alias("n")).first()["n"] < 25 for c in copies)
    assert got(near) == got(retrieval.knn_join(x, x, 3, "euclidean", block_rows=4096))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_a_few_queries_go_to_all_items_in_one_pass(spark, metric, monkeypatch):
    """The same rows as by cells, with items and queries without direction, equal vectors and more queries than meet at a time; items are read once, and no pivots are fitted."""
    m = np.round(clustered(900, 6, seed=9), 1)
    m[50:90], m[200:210] = m[3], 0
    t, q = table(spark, m), table(spark, m[::3], [k for k in range(900)][::3])
    options = ({}, {"skip_self": False, "earlier_only": True, "least": 0.99 if metric == "cosine" else -1.0})
    fit, fitted = neighbours.fit_pivots, []
    monkeypatch.setattr(neighbours, "fit_pivots", lambda *a: (fitted.append(1), fit(*a))[1])
    few = [got(neighbours.nearest(q, t, 4, metric, cells=SMALL, **o)) for o in options]
    assert not fitted
    monkeypatch.setattr(neighbours, "FEW_QUERIES", 10)
    assert few == [got(neighbours.nearest(q, t, 4, metric, cells=SMALL, **o)) for o in options] and len(fitted) == 2
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    neighbours.nearest(q.limit(9), t.mapInArrow(counted, t.schema), 4, metric, cells=SMALL).collect()
    assert read.value == 900


def test_numbers_that_short_floats_cannot_hold(spark):
    r = np.random.default_rng(4)
    for scale in (1e-25, 1e25):
        m = r.normal(size=(520, 5)) * scale
        m[::50] *= 1e-4
        t = table(spark, m)
        for metric in ("cosine", "euclidean"):
            assert got(neighbours.nearest(t, t, 3, metric, cells=SMALL)) == {(a, b, n + 1) for a in range(520) for n, b in enumerate(sorted((x for x in range(520) if x != a), key=lambda x, a=a: (_far(m, a, x, metric), x))[:3])}


def _far(m, a, b, metric):
    x, y = m[a], m[b]
    return -float((x / np.linalg.norm(x)) @ (y / np.linalg.norm(y))) if metric == "cosine" else float(np.sqrt(((x - y) ** 2).sum()))


def test_later_items_are_not_compared(spark):
    """Of random vectors all cells stay possible; a search among earlier ones compares little more than half of the pairs."""
    t = table(spark, np.random.default_rng(6).normal(size=(4000, 24)))
    seen = [spark.sparkContext.accumulator(0) for _ in range(2)]
    cells = Cells(cell_rows=400, item_block=4000, query_block=4000)
    for x, earlier in zip(seen, (False, True)):
        neighbours.nearest(t, t, 1, earlier_only=earlier, cells=cells, compared=x).collect()
    assert seen[1].value < 0.75 * seen[0].value


def test_a_length_is_worked_out_once_for_each_vector(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)
    length = F.udf(lambda v: (seen.add(1), v)[1], "array<double>")
    v = table(spark, np.ones((40, 50))).select("id", length.asNondeterministic()("vector").alias("vector"))
    assert neighbours._directed(v, "cosine").agg(F.max(F.element_at("vector", 1))).first()[0] == pytest.approx(50**-0.5)
    plan = neighbours._directed(v, "cosine")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_one_search_serves_all_thresholds(spark):
    m = clustered(600, 6, seed=2)
    t = table(spark, m)
    near = retrieval.nearest_earlier(t, 0.4)
    for x in (0.4, 0.9, 0.9999):
        alone, shared = ({tuple(r) for r in retrieval.semantic_cache(t, x, 0.5, *n).collect()} for n in ((), (near,)))
        assert alone == shared and 0 < sum(r[3] for r in alone) < 600


def test_hyperplane_buckets_by_pairs_and_by_buckets(spark, monkeypatch):
    """Few, large buckets: each pair is met once; the neighbours are those of joining by buckets."""
    m = np.random.default_rng(3).normal(size=(500, 8))
    m[40:50] = m[5]
    t = table(spark, m)
    buckets = {(r.id, r.band, r.bucket) for r in retrieval.hyperplane_buckets(t, 6, 2, 8).collect()}
    by = {i: {x[1:] for x in buckets if x[0] == i} for i in range(500)}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = (unit[:, None] * unit[None]).sum(2)
    want = {(a, b, n + 1) for a in range(500) for n, b in enumerate(sorted((x for x in range(500) if x != a and by[a] & by[x]), key=lambda x, a=a: (-round(s[a, x], 9), x))[:4])}
    joined, real = [], retrieval.knn_join
    monkeypatch.setattr(retrieval, "knn_join", lambda *a, **k: (joined.append(1), real(*a, **k))[1])
    monkeypatch.setattr(retrieval, "LSH_LEAST_ROWS", 100)
    monkeypatch.setattr(retrieval, "LSH_BLOCK", 1200)
    monkeypatch.setattr(retrieval, "LSH_STRIP", 64)
    assert got(retrieval.knn_lsh(t, t, 4, 8, 6, 2)) == want and not joined
    assert got(twice := retrieval.knn_lsh(t.unionAll(t.where("id % 2 = 0")), t.unionAll(t.where("id < 300")), 4, 8, 6, 2)) == want and twice.count() == len(want)
    near = {(a, b) for a, b, _ in got(retrieval.knn_lsh(t, t, 4, 8, 2, 6))}
    assert joined and all(a != b for a, b in near)
    assert retrieval.knn_lsh(t.limit(0), t, 4, 8, 6, 2).collect() == [] == retrieval.knn_lsh(t, t.limit(0), 4, 8, 6, 2).collect()


def test_texts_are_read_once_for_a_few_queries(spark):
    """The vectors of hybrid_search's texts are made once, not once for each step of a search by cells."""
    d = spark.createDataFrame([(i, " ".join(f"w{j * j % (i + 7)}" for j in range(i % 11))) for i in range(300)], "id long, text string").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    v = {r.id: np.array(r.vector) for r in retrieval.hashed_terms(d).collect()}
    near = neighbours.nearest(retrieval.hashed_terms(d.where("id % 30 < 2")), retrieval.hashed_terms(d.mapInArrow(counted, d.schema)), 5, skip_self=False)
    some = [i for i in v if i % 30 < 2]
    # ids divisible by 11 have no words: as a query they score 0 with everything, as an item with every query
    assert any(not v[i].any() for i in some) and got(near) == brute(np.stack([v[i] for i in some]), np.stack([*v.values()]), 5, "cosine", some, [*v], skip_self=False)
    assert read.value <= 2 * 300  # again for the smallest ids, as some queries have no direction


def test_null_vectors_are_treated_alike_by_cells_and_by_one_pass(spark, monkeypatch):
    """Without a place under euclidean, without direction under cosine."""
    m = clustered(120, 4, seed=8)
    t = table(spark, m).unionAll(spark.createDataFrame([(500, None), (-1, None)], "id long, vector array<double>"))
    for metric in ("cosine", "euclidean"):
        both = []
        for few in (512, 0):
            monkeypatch.setattr(neighbours, "FEW_QUERIES", few)
            both.append(got(neighbours.nearest(t, t, 3, metric, cells=SMALL)))
        assert both[0] == both[1] and (500 in {r[0] for r in both[0]}) == (metric == "cosine")
