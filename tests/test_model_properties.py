"""Queries without SQL, against closed forms and definitions worked out with numpy on the same tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import evaluation as ev
from lumenframe.operators import learning as ml
from lumenframe.plans import registry, scoring, training
from lumenframe.sources.tables import Tables
import __spark_entry__  # noqa: F401  registers the plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, FOLDER)


def run(t, name):
    return registry.PLANS[name].build(t).collect()


def newton(x, y, mean, slope, weight, rounds=50):
    """Generalised linear model by reweighted least squares: ``mean`` of the linear predictor, its ``slope``, and the inverse variance ``weight`` of the mean."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(2)
    beta[1] = {"exp": math.log(y.mean())}.get(mean.__name__, 0.0)
    for _ in range(rounds):
        eta = design @ beta
        mu, d = mean(eta), slope(eta)
        w = d**2 * weight(mu)
        z = eta + (y - mu) / d
        beta = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * z))
    return beta


def test_generalised_linear_models(t):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").cast("double").alias("avg"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("span")).toPandas()
    z = d["span"].to_numpy() / 1000
    got = {r.family: (r.coefficient, r.intercept) for r in run(t, "generalized_linear")}
    assert got["gaussian"] == pytest.approx(tuple(np.polyfit(z, d["avg"], 1)), rel=1e-6)
    exp = np.exp
    assert got["poisson"] == pytest.approx(tuple(newton(z, d["n"].to_numpy(), exp, exp, lambda m: 1 / m)), rel=1e-3)
    many = (d["n"] > 15).to_numpy(float)
    if 0 < many.mean() < 1:
        logistic = lambda e: 1 / (1 + np.exp(-e))
        assert got["binomial"] == pytest.approx(tuple(newton(z, many, logistic, lambda e: logistic(e) * (1 - logistic(e)), lambda m: 1 / (m * (1 - m)))), rel=1e-2)


def test_ridge_is_the_closed_form(t):
    d = t.lineitem.select(*[F.col(c).cast("double") for c in [*training.X, "l_extendedprice"]]).toPandas()
    x, y = d[training.X].to_numpy(), d["l_extendedprice"].to_numpy()
    sx, sy = x.std(0, ddof=1), y.std(ddof=1)
    xs, ys = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    w = np.linalg.solve(xs.T @ xs / len(x) + 10.0 / sy * np.eye(x.shape[1]), xs.T @ ys / len(x)) * sy / sx
    got = {r.model: r for r in run(t, "regularized_regression")}
    assert got["ridge"].coefficients == pytest.approx(w.tolist(), rel=1e-3, abs=abs(w).max() * 1e-4)
    assert np.count_nonzero(got["lasso"].coefficients) <= np.count_nonzero(got["elastic"].coefficients) <= len(w) and -1e-9 < got["lasso"].r2 <= got["elastic"].r2 + 1e-6 <= got["ridge"].r2 + 2e-6


def test_discriminants_are_the_closed_form(t):
    train, test = (p.select(*training.X, "y").toPandas().astype(float) for p in training.parts(t))
    accuracy = {}
    for name, shared in (("linear", True), ("quadratic", False)):
        classes = sorted(train["y"].unique())
        parts = [train[train["y"] == c][training.X].to_numpy() for c in classes]
        cov = [np.cov(p.T) for p in parts]
        if shared:
            pooled = sum(c * (len(p) - 1) for c, p in zip(cov, parts)) / (len(train) - len(classes))
            cov = [pooled] * len(classes)
        x = test[training.X].to_numpy()
        score = [math.log(len(p) / len(train)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - p.mean(0), np.linalg.inv(c), x - p.mean(0)) for p, c in zip(parts, cov)]
        accuracy[name] = float((np.array(classes)[np.argmax(score, 0)] == test["y"].to_numpy()).mean())
    got = {r.model: r.accuracy for r in run(t, "discriminant_analysis")}
    assert got == pytest.approx(accuracy, abs=0.01)


def test_principal_components(t):
    m = np.stack([r.embedding for r in t.embeddings.select("embedding").collect()]).astype(float)
    values = np.linalg.eigvalsh(np.cov(m.T))[::-1]
    got = run(t, "pca_variance")[0]
    assert got.explained == pytest.approx(values[:8].sum() / values.sum(), rel=1e-6) and got.lost == pytest.approx(1 - got.explained, rel=1e-6)


def test_bootstrap_intervals_are_those_of_the_mean(t):
    e = t.events.select("event_type", "value").toPandas()
    for r in run(t, "bootstrap_interval"):
        v = e[e.event_type == r.event_type]["value"].dropna()
        half = 1.96 * v.std() / math.sqrt(len(v))
        assert r.low < v.mean() < r.high and (r.high - r.low) / 2 == pytest.approx(half, rel=0.3)
    d = t.lineitem.select((F.col("l_discount") - F.col("l_tax")).cast("double").alias("d")).toPandas()["d"]
    r = run(t, "paired_bootstrap")[0]
    assert r.low < d.mean() < r.high and (r.high - r.low) / 2 == pytest.approx(1.96 * d.std() / math.sqrt(len(d)), rel=0.3)


def test_calibration_lowers_the_brier_score(t):
    p = scoring.predictions(t).select("p", F.col("y").cast("double").alias("y")).toPandas().astype(float)
    raw = float(((p["p"] - p["y"]) ** 2).mean())
    got = {r.method: r.brier for r in run(t, "probability_calibration")}
    assert got["isotonic"] <= got["platt"] + 1e-9 and got["platt"] <= min(raw, p["y"].var(ddof=0)) + 1e-6


def test_overlap_scores_of_texts(spark, t):
    pairs = scoring._turn_pairs(t)
    rows = pairs.select("k", "ref", "cand").toPandas().head(60)
    few = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(zip(rows["ref"], rows["cand"]))], "k long, ref string, cand string")

    def common(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(line[j] + 1 if x == y else max(line[j + 1], new[-1]))
            line = new
        return line[-1]

    for r in ev.rouge_l(few, "k", "ref", "cand").join(ev.bleu(few, "k", "ref", "cand", 2), "k").join(few, "k").collect():
        a, b = r.ref.lower().split(), r.cand.lower().split()
        n = common(a, b)
        want = 2 * n / (len(a) + len(b)) if n else 0.0
        assert r.rouge_l == pytest.approx(want, abs=1e-9)
        a, b = ([w for w in re.split(r"[\W_]+", x.lower()) if w] for x in (r.ref, r.cand))
        precision = []
        for size in (1, 2):
            x, y = (Counter(zip(*(w[i:] for i in range(size)))) for w in (a, b))
            precision.append(sum((x & y).values()) / max(sum(y.values()), 1))
        bleu = math.sqrt(precision[0] * precision[1]) * (1 if len(b) >= len(a) else math.exp(1 - len(a) / len(b))) if min(precision) > 0 else 0.0
        assert r.bleu == pytest.approx(bleu, abs=1e-9)


def test_recursive_chunks_hold_the_whole_text(t):
    from lumenframe.operators import content

    chunks = content.chunk_recursive(t.documents, "doc_id", "text", 1000).toPandas()
    assert chunks["text"].str.len().max() <= 1000
    order = [c for c in chunks.columns if c not in ("doc_id", "text")][0]
    joined = chunks.sort_values(["doc_id", order]).groupby("doc_id")["text"].agg("".join)
    bare = lambda x: "".join(x.replace(".", "").split())  # noqa: E731  what parts chunks, a full stop and white space, goes
    assert {i: bare(x) for i, x in joined.items()} == {r.doc_id: bare(r.text) for r in t.documents.select("doc_id", "text").collect()}


def test_classifiers_beat_chance(t):
    got = {r[0]: r[1] for r in run(t, "classifiers")}
    assert len(got) >= 6 and all(0.4 <= v <= 1 for v in got.values()) and max(got.values()) > 0.5


def test_isolation_finds_what_stands_alone(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(r.normal(0, 1, (400, 2)))] + [(999, 12.0, -11.0)]
    scores = {x[0]: x.score for x in ml.isolation_forest(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"], trees=30).collect()}
    assert max(scores, key=scores.get) == 999 and scores[999] > 0.65


def test_reference_data_of_the_gap_is_drawn_once(spark):
    """The vectors are read for the size, the ranges and the drawing, and not once more for each k."""
    from lumenframe.operators import learning

    read = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def seen(x):
        read.add(1)
        return x

    vectors = spark.range(200).select(F.array(F.rand(1), F.rand(2)).alias("v")).localCheckpoint().select(seen("v").alias("vector"))
    learning.elbow(vectors, "vector", [2, 3, 4])
    plain, n = read.value, 200
    learning.elbow(vectors, "vector", [2, 3, 4], reference=True)
    assert read.value - 2 * plain <= 4.5 * n


def test_reranker_trains_on_parts_that_follow_the_rows(spark, monkeypatch):
    from lumenframe.operators import retrieval

    c = spark.range(1000).select(F.col("id").alias("query_id"), (F.col("id") % 7).cast("double").alias("position"), (F.col("id") % 7 > 3).cast("double").alias("clicked")).coalesce(2)
    seen, real = [], retrieval.Pipeline.fit
    monkeypatch.setattr(retrieval.Pipeline, "fit", lambda self, df, *a: (seen.append((df.columns, df.rdd.getNumPartitions(), df.count())), real(self, df, *a))[1])
    for rows, parts in ((100, 10), (1000, 2)):
        monkeypatch.setattr(retrieval, "TRAIN_ROWS", rows)
        retrieval.fit_reranker(c, ["position"], "clicked")
        assert seen.pop() == (["position", "clicked"], parts, 1000)


def test_reranker_learns_the_same_from_bins(spark, monkeypatch):
    """With at most a value to a bin, the scores are those of training on every row; a handful of rows reaches the trees."""
    from lumenframe.operators import retrieval

    c = spark.range(6000).select(F.col("id").alias("query_id"), F.col("id").alias("item_id"), (F.col("id") % 13).cast("double").alias("a"), F.floor(F.sqrt(F.col("id"))).cast("double").alias("b"), F.lit(3.0).alias("c"))
    c = c.withColumn("b", F.col("b") % 29 / 4).withColumn("y", ((F.xxhash64("item_id") % 10 + F.col("a") + F.col("b") > 9)).cast("double"))
    seen, real = [], retrieval.Pipeline.fit
    monkeypatch.setattr(retrieval.Pipeline, "fit", lambda self, df, *a: (seen.append(df.count()), real(self, df, *a))[1])
    scores = []
    for most in (6000, 100):
        monkeypatch.setattr(retrieval, "EACH_TRAIN_ROWS", most)
        model = retrieval.fit_reranker(c, ["a", "b", "c"], "y")
        scores.append(np.array([r["_p"] for r in model.transform(c).orderBy("query_id").select("_p").collect()]))
    assert seen[0] == 6000 and seen[1] <= 13 * 29
    np.testing.assert_allclose(scores[0], scores[1], atol=1e-9)
    assert len(np.unique(np.round(scores[1], 6))) > 20
    fine = c.withColumn("a", F.rand(5)).withColumn("y", (F.col("a") > 0.7).cast("double"))
    p = retrieval.fit_reranker(fine, ["a"], "y").transform(fine).agg(F.avg(F.abs(F.col("_p") - F.col("y")))).first()[0]
    assert p < 0.05 and seen[-1] <= 32
    with pytest.raises(ValueError):
        retrieval.fit_reranker(c.withColumn("y", F.when(F.col("item_id") > 5, F.col("y"))), ["a"], "y")


def test_folds_hold_the_columns_that_are_learned_from(spark, monkeypatch):
    from lumenframe.operators import learning

    d = spark.range(200).select(F.col("id").cast("string").alias("k"), F.rand(3).alias("x"), (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 4 > 1).cast("int").alias("fold"))
    seen, real = [], learning.CrossValidator.fit
    monkeypatch.setattr(learning.CrossValidator, "fit", lambda self, df, *a: (seen.append(df.columns), real(self, df, *a))[1])
    learning.cross_validate(d, ["x"], "y", "logistic", {"maxIter": [2]}, folds="fold")
    learning.cross_validate(d, ["x"], "y", "logistic", {"maxIter": [2]}, folds=2)
    assert seen == [["x", "y", "fold"], ["x", "y"]]
