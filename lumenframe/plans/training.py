"""MLlib training and scoring over the given tables."""

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lumenframe.functions import scalars as fn
from lumenframe.operators import evaluation as ev
from lumenframe.operators import joins
from lumenframe.operators import learning as ml
from lumenframe.operators.features import entity_features
from lumenframe.plans.registry import plan
from lumenframe.plans.scoring import predictions, vectors
from lumenframe.session import scratch_path

X = ["l_quantity", "l_discount", "l_tax"]


def lines(t):
    """One row per line with a binary target that depends on quantity and price."""
    k = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select(k.alias("k"), *X, "l_extendedprice", (F.col("l_extendedprice") > 40000).cast("double").alias("y"),
                             (F.col("l_orderkey") % 5 == 0).alias("held_out"))


def parts(t):
    d = lines(t)
    return d.where(~F.col("held_out")), d.where(F.col("held_out"))


def _auc(df):
    return BinaryClassificationEvaluator(labelCol="y").evaluate(df)


@plan("R01", "SELECT round(regr_slope(l_extendedprice, l_quantity), 2) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def linear_regression(t):
    m = ml.fit(t.lineitem, ["l_quantity"], "l_extendedprice", "linear").stages[-1]
    return t.spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double").select(
        F.round("slope", 2).alias("slope"), F.round("intercept", 1).alias("intercept"))


@plan("R01")
def regularized_regression(t):
    rows = []
    for name, reg, mix in (("ridge", 10.0, 0.0), ("lasso", 500.0, 1.0), ("elastic", 100.0, 0.5)):
        m = ml.fit(t.lineitem, X, "l_extendedprice", "linear", regParam=reg, elasticNetParam=mix).stages[-1]
        rows.append((name, [float(c) for c in m.coefficients], float(m.summary.r2)))
    return t.spark.createDataFrame(rows, "model string, coefficients array<double>, r2 double")


@plan("R02 R03 R04 R05 R14 R21")
def classifiers(t):
    """Test AUC of every classifier, fitted on the training part."""
    train, test = parts(t)
    settings = {"logistic": {"maxIter": 20}, "svm": {"maxIter": 20}, "tree": {"maxDepth": 4, "seed": 1}, "forest": {"numTrees": 10, "maxDepth": 4, "seed": 1},
                "boosting": {"maxIter": 5, "maxDepth": 3, "seed": 1}, "bayes": {"modelType": "gaussian"}, "perceptron": {"layers": [3, 4, 2], "maxIter": 30, "seed": 1}}
    rows = []
    for kind, params in settings.items():
        cls = ml.fit(train, X, "y", kind, scale=kind in ("svm", "perceptron"), **params) if kind in ("logistic", "svm", "bayes", "perceptron") else _tree(train, kind, params)
        rows.append((kind, float(_auc(cls.transform(test)))))
    return t.spark.createDataFrame(rows, "model string, auc double")


def _tree(train, kind, params):
    from pyspark.ml import Pipeline
    return Pipeline(stages=[*ml.assembler(X), ml.CLASSIFIERS[kind](featuresCol="_x", labelCol="y", **params)]).fit(train)


@plan("R02")
def one_vs_rest(t):
    d = t.lineitem.withColumn("y", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "R", 1.0).otherwise(2.0))
    m = ml.fit_one_vs_rest(d, X, "y", maxIter=5)
    return m.transform(d).groupBy("prediction").agg(F.count("*").alias("n"))


@plan("R04")
def boosting_early_stop(t):
    m = ml.fit_boosting_early_stop(lines(t), X, "y", "held_out", maxIter=10, maxDepth=3, seed=1)
    return t.spark.createDataFrame([(len(m.stages[-1].trees), float(_auc(m.transform(lines(t)))))], "trees int, auc double")


@plan("R04")
def tree_regressors(t):
    train, test = parts(t)
    rows = []
    for kind, params in (("tree", {"maxDepth": 4}), ("forest", {"numTrees": 5, "maxDepth": 4, "seed": 1}), ("boosting", {"maxIter": 5, "maxDepth": 3, "seed": 1})):
        p = ml.score(ml.fit(train, X, "l_extendedprice", kind, **params), test)
        rows.append((kind, float(ev.regression_metrics(p, "l_extendedprice", "prediction").first()["r2"])))
    return t.spark.createDataFrame(rows, "model string, r2 double")


@plan("R05")
def naive_bayes_kinds(t):
    d = t.labels.join(t.documents.select("doc_id", fn.word_count(F.col("text")).alias("w"), fn.has_numbers(F.col("text")).alias("b")), "doc_id").withColumn("y", F.col("quality").cast("double"))
    rows = []
    for kind, cols in (("multinomial", ["w", "b"]), ("bernoulli", ["b"]), ("gaussian", ["w"])):
        p = ml.fit(d, cols, "y", "bayes", modelType=kind).transform(d)
        rows.append((kind, float(p.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])))
    return t.spark.createDataFrame(rows, "kind string, accuracy double")


@plan("R06")
def discriminant_analysis(t):
    train, test = parts(t)
    rows = []
    for name, shared in (("linear", True), ("quadratic", False)):
        p = ml.score_gda(ml.fit_gda(train, X, "y", shared), test, X)
        rows.append((name, float(p.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])))
    return t.spark.createDataFrame(rows, "model string, accuracy double")


@plan("R08 Q26")
def clusterings(t):
    v = vectors(t)
    rows = []
    for kind in ("kmeans", "bisecting"):
        _, out = ml.cluster(v, "vector", 8, kind)
        rows.append((kind, out.select("cluster").distinct().count(), float(ml.silhouette(out))))
    model, rows2 = ml.fit_pca(v, "vector", 4)
    _, out = ml.cluster(ml.pca_scores(model, rows2), "scores", 4, "mixture", maxIter=20)
    rows.append(("mixture", out.select("cluster").distinct().count(), float(ml.silhouette(out))))
    return t.spark.createDataFrame(rows, "kind string, clusters bigint, silhouette double")


@plan("Q26")
def elbow_and_gap(t):
    return ml.elbow(vectors(t), "vector", [2, 4, 8], reference=True)


@plan("R09", """WITH p AS (SELECT p_partkey AS id, p_retailprice AS x, p_size * 4.0 AS y FROM part), n AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 9 GROUP BY 1), c AS (SELECT id FROM n WHERE n >= 4),
  b AS (SELECT DISTINCT a.id FROM p a JOIN p q ON pow(a.x - q.x, 2) + pow(a.y - q.y, 2) <= 9 JOIN c ON c.id = q.id WHERE a.id NOT IN (SELECT id FROM c)) SELECT 'core' AS kind, count(*) AS n FROM c UNION ALL SELECT 'border', count(*) FROM b UNION ALL
  SELECT 'noise', count(*) FROM p WHERE id NOT IN (SELECT id FROM c UNION ALL SELECT id FROM b)""")
def dbscan_kinds(t):
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 4.0).cast("double").alias("y"))
    return ml.dbscan(p, 3.0, 4).groupBy("kind").agg(F.count("*").alias("n"))


@plan("R09", """WITH n AS (SELECT q.vec_id AS id, list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS r
  FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id) SELECT id, round(d, 6) AS distance FROM n WHERE r = 4""")
def k_distance(t):
    return ml.k_distance(vectors(t), 4).select("id", F.round("distance", 6).alias("distance"))


@plan("R10")
def pca_variance(t):
    m, rows = ml.fit_pca(vectors(t), "vector", 8)
    lost = ml.reconstruction_error(m, rows, "vector").first()["lost"]
    kept = float(np.sum(m.explainedVariance.toArray()))
    return t.spark.createDataFrame([(8, kept, float(lost))], "components int, explained double, lost double")


@plan("R11")
def isolation_forest(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("double")).withColumn("h", F.hour("ts").cast("double"))
    s = ml.isolation_forest(e, "event_id", ["value", "k", "h"], trees=20)
    return s.agg(F.count("*").alias("n"), F.round(F.min("score"), 2).alias("low"), F.round(F.max("score"), 2).alias("high"))


@plan("R12", """SELECT event_id, round((value - m) / s, 6) AS z_score, abs((value - m) / s) > 3 AS z_anomaly, NOT (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS iqr_anomaly FROM events,
  (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)""")
def statistical_anomalies(t):
    return ml.zscore_iqr_flags(t.events, "value").select("event_id", F.round("z_score", 6).alias("z_score"), "z_anomaly", "iqr_anomaly")


@plan("R12", """WITH s AS (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vx, var_samp(l_discount) AS vy, covar_samp(l_quantity, l_discount) AS c FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(sqrt((vy * pow(l_quantity - mx, 2) - 2 * c * (l_quantity - mx) * (l_discount - my) + vx * pow(l_discount - my, 2)) / (vx * vy - c * c)), 5) AS distance FROM lineitem, s""")
def mahalanobis_distance(t):
    return ml.mahalanobis(t.lineitem, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("distance", 5).alias("distance"))


@plan("R13")
def als_factorization(t):
    f = t.lineitem.groupBy(F.col("l_suppkey").cast("int").alias("u"), F.col("l_partkey").cast("int").alias("i")).agg(F.count("*").cast("float").alias("n"))
    m = ml.fit_als(f, "u", "i", "n", rank=4, iterations=2)
    return m.transform(f).agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 2).alias("mean"))


@plan("R13", """WITH d AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem), s AS (SELECT i, count(*) AS n FROM d GROUP BY 1), p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM d x JOIN d y ON x.b = y.b AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2)
  SELECT item_a, item_b, round(p.n / sqrt(a.n * c.n), 6) AS cosine FROM p JOIN s a ON a.i = item_a JOIN s c ON c.i = item_b""")
def item_item_similarity(t):
    pairs = joins.co_purchase(t.lineitem, "l_orderkey", "l_partkey", min_support=2, top=None)
    return ml.item_similarity(pairs).select("item_a", "item_b", F.round("cosine", 6).alias("cosine"))


@plan("R15")
def grid_search(t):
    train, _ = parts(t)
    folded = train.withColumn("fold", F.floor(fn.hash_unit(F.col("k")) * 2).cast("int"))
    _, table = ml.cross_validate(folded, X, "y", "logistic", {"regParam": [0.0, 0.1], "maxIter": [5]}, folds="fold")
    _, some = ml.cross_validate(train, X, "y", "logistic", {"regParam": [0.0, 0.01, 0.1], "maxIter": [5]}, folds=2, pick=1)
    return table.withColumn("search", F.lit("grid")).unionByName(some.withColumn("search", F.lit("random")))


@plan("R16")
def learning_curve(t):
    train, test = parts(t)
    return ml.learning_curve(train, test, "k", X, "y", "logistic", [0.1, 1.0], maxIter=5)


@plan("R17")
def feature_weights(t):
    train, _ = parts(t)
    a = ml.weights_table(_tree(train, "forest", {"numTrees": 5, "maxDepth": 3, "seed": 1}), X, t.spark).withColumn("model", F.lit("forest"))
    return a.unionByName(ml.weights_table(ml.fit(train, X, "y", "logistic", maxIter=10), X, t.spark).withColumn("model", F.lit("logistic")))


@plan("R18 J05")
def batch_predict(t):
    train, _ = parts(t)
    m = ml.fit(train, X, "y", "logistic", maxIter=10)
    p = ml.score(m, lines(t), "p").withColumn("tier", ml.risk_tier(F.col("p"))).withColumn("model_version", F.lit("v1"))
    path = scratch_path(t.spark, "scores")
    p.select("k", "p", "tier", "model_version").write.partitionBy("model_version", "tier").parquet(path)
    return t.spark.read.parquet(path).groupBy("model_version", "tier").agg(F.count("*").alias("n"))


@plan("R19", """WITH s AS (SELECT *, CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS s FROM events) SELECT CASE WHEN (event_type = 'error' AND value > 50) OR s >= 0.9 THEN 'block' WHEN s >= 0.7 THEN 'review' WHEN s >= 0.4 THEN 'monitor' ELSE 'approve' END AS band, count(*) AS n FROM s GROUP BY 1""")
def score_bands(t):
    s = fn.hash_unit(F.col("event_id"))
    hit = (F.col("event_type") == "error") & (F.col("value") > 50)
    return t.events.groupBy(ml.score_bands(s, hit).alias("band")).agg(F.count("*").alias("n"))


@plan("R20")
def generalized_linear(t):
    d = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.avg("o_totalprice").alias("avg"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("span"))
    d = d.withColumn("many", (F.col("n") > 15).cast("double")).withColumn("z", F.col("span") / 1000)
    rows = []
    for fam, link, label in (("gaussian", "identity", "avg"), ("binomial", "logit", "many"), ("poisson", "log", "n"), ("gamma", "inverse", "avg")):
        m = ml.fit(d, ["z"], label, "glm", family=fam, link=link, maxIter=10).stages[-1]
        rows.append((fam, float(m.coefficients[0]), float(m.intercept)))
    return t.spark.createDataFrame(rows, "family string, coefficient double, intercept double")


@plan("Q10")
def probability_calibration(t):
    p = predictions(t).withColumn("y", F.col("y").cast("double"))
    out = None
    for how in ("platt", "isotonic"):
        c = ml.calibrated(ml.calibrate(p, "p", "y", how), p)
        row = ev.probability_losses(c, "y", "calibrated").select(F.lit(how).alias("method"), "brier")
        out = row if out is None else out.unionByName(row)
    return out


@plan("Q27")
def importance_and_ablation(t):
    train, test = parts(t)
    m = ml.fit(train, X, "y", "logistic", maxIter=10)
    a = ml.permutation_importance(m, test, "k", X, "y").select(F.lit("permutation").alias("kind"), F.col("feature").alias("name"), F.col("auc_drop").alias("value"))
    b = ml.ablation(train, test, {"size": ["l_quantity"], "terms": ["l_discount", "l_tax"]}, "y", "logistic", maxIter=10)
    return a.unionByName(b.select(F.lit("ablation").alias("kind"), F.col("removed").alias("name"), F.col("auc").alias("value")))


def share(*parts):
    """SQL twin of ``hash_unit``."""
    return "('0x' || left(md5(" + " || ':' || ".join(f"{p}::VARCHAR" for p in parts) + "), 8))::BIGINT / 4294967296.0::DOUBLE"


@plan("F10", f"""WITH p AS (SELECT doc_id AS id, length(text)::DOUBLE AS x, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
  n AS (SELECT a.id, b.id AS item_id, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id QUALIFY rank <= 5),
  c AS (SELECT id, max(rank) AS k FROM n GROUP BY id), d AS (SELECT id, copy, (floor({share("1", "id", "copy")} * k) + 1)::BIGINT AS rank, {share("2", "id", "copy")} AS u FROM c, range(1, 4) AS r(copy))
  SELECT id AS doc_id, copy::INT AS copy, round(p.x + u * (o.x - p.x), 6) AS chars, round(p.y + u * (o.y - p.y), 6) AS spaces FROM d JOIN n USING (id, rank) JOIN p USING (id) JOIN p o ON o.id = n.item_id""")
def smote_minority(t):
    """The toxic documents, the smaller class of the labels, by length and number of spaces."""
    m = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select("doc_id", F.length("text").cast("double").alias("chars"), (F.length("text") - F.length(F.regexp_replace("text", " ", ""))).cast("double").alias("spaces"))
    s = ml.smote(m, ["chars", "spaces"], "doc_id", 3)
    return s.select("doc_id", "copy", F.round("chars", 6).alias("chars"), F.round("spaces", 6).alias("spaces"))


@plan("L06", """WITH o AS (SELECT o_custkey, sum(o_totalprice)::DOUBLE AS total, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
  d AS (SELECT c_custkey, coalesce(total, 0) AS total, coalesce(n, 0) AS n, CASE WHEN c_custkey % 20 <> 0 THEN c_acctbal::DOUBLE END AS bal FROM customer LEFT JOIN o ON o_custkey = c_custkey),
  s AS (SELECT coalesce(nullif(stddev_samp(total), 0), 1) AS st, coalesce(nullif(stddev_samp(n), 0), 1) AS sn FROM d),
  k AS (SELECT a.c_custkey, b.bal FROM d a JOIN d b ON a.bal IS NULL AND b.bal IS NOT NULL, s QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt(pow(a.total / st - b.total / st, 2) + pow(a.n / sn - b.n / sn, 2)), b.c_custkey) <= 5),
  f AS (SELECT c_custkey, avg(bal) AS fill FROM k GROUP BY 1)
  SELECT c_custkey, round(coalesce(bal, fill), 4) AS bal FROM d LEFT JOIN f USING (c_custkey)""")
def impute_knn(t):
    """Every twentieth balance is taken away and filled from customers with like orders."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").cast("double").alias("total"), F.count("*").cast("double").alias("n"))
    d = t.customer.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0.0)).alias("n"), F.when(F.col("c_custkey") % 20 != 0, F.col("c_acctbal").cast("double")).alias("bal"))
    return ml.impute_knn(d, "c_custkey", "bal", ["total", "n"]).select("c_custkey", F.round("bal", 4).alias("bal"))


@plan("M29 R02")
def churn_model(t):
    f = entity_features(t.orders, "o_custkey", "o_orderdate", "o_totalprice", "2001-02-01")
    later = t.orders.where(F.col("o_orderdate") > F.lit("2001-02-01").cast("timestamp_ntz")).select("o_custkey").distinct().withColumn("active", F.lit(1))
    d = f.join(later, "o_custkey", "left").withColumn("y", F.col("active").isNull().cast("double"))
    cols = ["lifetime_orders", "days_since_last_order", "avg_order_value"]
    m = ml.fit(d, cols, "y", "logistic", maxIter=10)
    return t.spark.createDataFrame([(float(_auc(m.transform(d))),)], "auc double")
