"""Model training on tables: MLlib where it has the model, Spark aggregations where it does not."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, GeneralizedLinearRegression, IsotonicRegression,
                                   LinearRegression, RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import dot, hash_unit, norm, safe_divide
from lumenframe.operators.evaluation import permute_column
from lumenframe.operators.neighbours import nearest
from lumenframe.operators.retrieval import shared_attribute_components
from lumenframe.operators.scaling import quantile_values, top_per_group
from lumenframe.session import cut_lineage

REGRESSORS = {"linear": LinearRegression, "tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosting": GBTRegressor,
              "glm": GeneralizedLinearRegression}
CLASSIFIERS = {"logistic": LogisticRegression, "svm": LinearSVC, "tree": DecisionTreeClassifier, "forest": RandomForestClassifier,
               "boosting": GBTClassifier, "bayes": NaiveBayes, "perceptron": MultilayerPerceptronClassifier}


def assembler(features: Sequence[str], scale: bool = False) -> list:
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw" if scale else "_x", handleInvalid="skip")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True))
    return stages


def fit(train: DataFrame, features: Sequence[str], label: str, kind: str, scale: bool = False, **params) -> PipelineModel:
    """Scaling and model are learned on ``train`` only; the returned model transforms any table."""
    cls = REGRESSORS.get(kind) or CLASSIFIERS[kind]
    model = cls(featuresCol="_x", labelCol=label, **params)
    return Pipeline(stages=[*assembler(features, scale), model]).fit(train)


def score(model: PipelineModel, df: DataFrame, probability: str | None = None) -> DataFrame:
    out = model.transform(df)
    if probability:
        out = out.withColumn(probability, vector_to_array("probability")[1])
    return out.drop("_x", "_raw", "rawPrediction", "probability")


def fit_one_vs_rest(train: DataFrame, features: Sequence[str], label: str, **params) -> PipelineModel:
    inner = LogisticRegression(featuresCol="_x", labelCol=label, **params)
    return Pipeline(stages=[*assembler(features), OneVsRest(classifier=inner, featuresCol="_x", labelCol=label)]).fit(train)


def fit_boosting_early_stop(train: DataFrame, features: Sequence[str], label: str, validation: str, **params) -> PipelineModel:
    """``validation`` is a boolean column; boosting stops when its error stops falling."""
    gbt = GBTClassifier(featuresCol="_x", labelCol=label, validationIndicatorCol=validation, **params)
    return Pipeline(stages=[*assembler(features), gbt]).fit(train)


# Gaussian discriminant analysis

def fit_gda(train: DataFrame, features: Sequence[str], label: str, shared: bool = True) -> list[dict]:
    """Prior, mean and covariance per class from one aggregation (shared covariance: linear boundary)."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
            *[F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]]
    rows = train.groupBy(label).agg(*aggs).orderBy(label).collect()  # one row per class
    total = sum(r["n"] for r in rows)
    classes = []
    for r in rows:
        cov = np.zeros((len(features),) * 2)
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        classes.append({"label": r[label], "prior": r["n"] / total, "mean": np.array([r[f"m{i}"] for i in range(len(features))]), "cov": cov})
    if shared:
        pooled = sum(c["prior"] * c["cov"] for c in classes)
        for c in classes:
            c["cov"] = pooled
    return classes


def quadratic_form(features: Sequence[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(features, mean)]
    out = F.lit(0.0)
    for i in range(len(d)):
        for j in range(len(d)):
            out = out + d[i] * d[j] * F.lit(float(inverse[i, j]))
    return out


def score_gda(classes: list[dict], df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    parts = []
    for k, c in enumerate(classes):
        logdet = float(np.linalg.slogdet(c["cov"])[1])
        ll = math.log(c["prior"]) - 0.5 * logdet - 0.5 * quadratic_form(features, c["mean"], np.linalg.inv(c["cov"]))
        parts.append(F.struct(ll.alias("s"), F.lit(-k).alias("k"), F.lit(c["label"]).alias("label")))
    return df.withColumn(out, F.array_max(F.array(*parts))["label"])


# clusters

CLUSTERERS = {"kmeans": KMeans, "mixture": GaussianMixture, "bisecting": BisectingKMeans}


def cluster(df: DataFrame, vector: str, k: int, kind: str = "kmeans", seed: int = 1, **params):
    """Model and table with column ``cluster``; ``vector`` is an array column."""
    rows = df.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = CLUSTERERS[kind](featuresCol="_x", predictionCol="cluster", k=k, seed=seed, **params).fit(rows)
    return model, model.transform(rows)


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="_x", predictionCol="cluster").evaluate(clustered)


def elbow(df: DataFrame, vector: str, ks: Sequence[int], seed: int = 1, reference: bool = False) -> DataFrame:
    """Inertia and silhouette per k, and the gap to uniform data of the same range (by the hash of each vector) if asked."""
    rows = []
    dim = df.select(F.size(vector)).first()[0]
    ranges = df.agg(*[F.struct(F.min(F.col(vector)[i]), F.max(F.col(vector)[i])) for i in range(dim)]).first() if reference else None
    uniform = None
    if reference:
        # The vector's text, costly to write, is made once a row, and the drawn rows once for all k.
        axes = [F.lit(float(ranges[i][0])) + hash_unit(F.lit(seed + i), F.col("_text")) * float(ranges[i][1] - ranges[i][0]) for i in range(dim)]
        uniform = cut_lineage(df.select(F.col(vector).cast("string").alias("_text")).select(F.array(*axes).alias(vector)))
    for k in ks:
        model, out = cluster(df, vector, k, seed=seed)
        inertia = model.summary.trainingCost
        gap = math.log(cluster(uniform, vector, k, seed=seed)[0].summary.trainingCost) - math.log(inertia) if reference else None
        rows.append((k, float(inertia), float(silhouette(out)), gap))
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, gap double")


def fit_pca(df: DataFrame, vector: str, k: int):
    rows = df.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_x", outputCol="_p").fit(rows), rows


def pca_scores(model, rows: DataFrame, out: str = "scores") -> DataFrame:
    return model.transform(rows).withColumn(out, vector_to_array("_p")).drop("_p", "_x")


def reconstruction_error(model, rows: DataFrame, vector: str) -> DataFrame:
    """Share of the centred squared length lost by keeping k components (from column means)."""
    dim = rows.select(F.size(vector)).first()[0]
    means = [float(v) for v in rows.agg(*[F.avg(F.col(vector)[i]) for i in range(dim)]).first()]
    pc = model.pc.toArray()  # dimension x k
    centred = F.zip_with(F.transform(vector, lambda x: x.cast("double")), F.array(*[F.lit(m) for m in means]), lambda a, b: a - b)
    kept = F.lit(0.0)
    for j in range(pc.shape[1]):
        p = dot(F.col("_c"), F.array(*[F.lit(float(v)) for v in pc[:, j]]))
        kept = kept + p * p
    s = rows.select(centred.alias("_c")).select((norm(F.col("_c")) * norm(F.col("_c"))).alias("t"), kept.alias("k"))
    return s.agg((1 - safe_divide(F.sum("k"), F.sum("t"))).alias("lost"))


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Density clusters of ``points(id, x, y)``: core, border or noise and the cluster's smallest cell number.

    The plane is cut into cells with diagonal ``eps``. Points of one cell are neighbours, so a cell with
    ``min_samples`` points is all core without comparing its points; only sparse cells (fewer points
    than that) look at the cells around them. Core cells are linked if some pair of their core points is close;
    links are tested on per-subcell corner points first and on distinct points where that is undecided.
    """
    side = eps / math.sqrt(2)
    cell = [F.floor(F.col(c) / side).cast("bigint").alias(f"c{c}") for c in ("x", "y")]
    p = points.select("id", "x", "y", *cell)
    sizes = p.groupBy("cx", "cy").agg(F.count("*").alias("cell_n"))
    p = p.join(sizes, ["cx", "cy"])
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0) and abs(a * b) != 4])
    sparse = p.where(F.col("cell_n") < min_samples)
    look = sparse.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("cell_n").alias("own_n"), "cx", "cy", F.explode(around).alias("d")).select(
        "pid", "px", "py", "own_n", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    spots = p.groupBy("cx", "cy", "x", "y").agg(F.count("*").alias("w"))
    near = F.pow(F.col("px") - F.col("x"), F.lit(2.0)) + F.pow(F.col("py") - F.col("y"), F.lit(2.0)) <= eps * eps
    found = look.join(spots, ["cx", "cy"]).where(near).groupBy("pid").agg(F.sum("w").alias("others"))
    core = p.join(found, F.col("id") == F.col("pid"), "left").withColumn(
        "core", (F.col("cell_n") >= min_samples) | (F.col("cell_n") + F.coalesce("others", F.lit(0)) >= min_samples)).drop("pid", "others")
    cores = core.where("core").select("x", "y", "cx", "cy", "cell_n").withColumn("cell", F.format_string("%020d:%020d", F.col("cx") + 10**12, F.col("cy") + 10**12))
    fine = side / 8
    tiny = cores.groupBy("cx", "cy", "cell", F.floor(F.col("x") / fine).alias("fx"), F.floor(F.col("y") / fine).alias("fy")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    a = tiny.select(*[F.col(c).alias(f"a_{c}") for c in tiny.columns]).select("*", F.explode(around).alias("d")).select(
        "*", (F.col("a_cx") + F.col("d.dx")).alias("cx"), (F.col("a_cy") + F.col("d.dy")).alias("cy")).drop("d")
    pair = a.join(tiny, ["cx", "cy"]).where(F.col("a_cell") < F.col("cell"))

    def apart(lo, hi, blo, bhi):
        return F.greatest(F.col(blo) - F.col(hi), F.col(lo) - F.col(bhi), F.lit(0.0))

    def widest(lo, hi, blo, bhi):
        return F.greatest(F.col(bhi) - F.col(lo), F.col(hi) - F.col(blo))

    least = F.pow(apart("a_x0", "a_x1", "x0", "x1"), F.lit(2.0)) + F.pow(apart("a_y0", "a_y1", "y0", "y1"), F.lit(2.0))
    most = F.pow(widest("a_x0", "a_x1", "x0", "x1"), F.lit(2.0)) + F.pow(widest("a_y0", "a_y1", "y0", "y1"), F.lit(2.0))
    pair = pair.where(least <= eps * eps).withColumn("sure", most <= eps * eps)
    linked = pair.groupBy("a_cell", "cell").agg(F.max("sure").alias("sure"))
    sure = linked.where("sure").select("a_cell", "cell")
    open_pairs = pair.join(linked.where(~F.col("sure")).select("a_cell", "cell"), ["a_cell", "cell"], "left_semi").select(
        "a_cell", "a_fx", "a_fy", "cell", "fx", "fy")
    exact = cores.select("cell", "x", "y", F.floor(F.col("x") / fine).alias("fx"), F.floor(F.col("y") / fine).alias("fy")).distinct()
    left = exact.select(F.col("cell").alias("a_cell"), F.col("fx").alias("a_fx"), F.col("fy").alias("a_fy"), F.col("x").alias("px"), F.col("y").alias("py"))
    tested = (open_pairs.join(left, ["a_cell", "a_fx", "a_fy"]).join(exact, ["cell", "fx", "fy"]).where(near).select("a_cell", "cell").distinct())
    links = sure.unionByName(tested)
    own = cores.select("cell").distinct()
    both = links.select(F.col("a_cell").alias("cell"), F.concat_ws("|", "a_cell", "cell").alias("link")).unionByName(
        links.select("cell", F.concat_ws("|", "a_cell", "cell").alias("link"))).unionByName(own.select("cell", F.col("cell").alias("link")))
    comp = shared_attribute_components(both, "cell", "link").withColumnRenamed("component", "cluster")
    in_core = core.where("core").withColumn("cell", F.format_string("%020d:%020d", F.col("cx") + 10**12, F.col("cy") + 10**12)).join(comp, "cell").select(
        "id", "cluster", F.lit("core").alias("kind"))
    rest = core.where(~F.col("core")).select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), "cx", "cy")
    wide = F.concat(around, F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"))))
    reach = rest.select("pid", "px", "py", "cx", "cy", F.explode(wide).alias("d")).select(
        "pid", "px", "py", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    hits = reach.join(cores.select("cx", "cy", "x", "y", "cell").distinct(), ["cx", "cy"]).where(near).join(comp, "cell")
    border = hits.groupBy("pid").agg(F.min("cluster").alias("cluster"))
    outer = rest.select("pid").join(border, "pid", "left").select(
        F.col("pid").alias("id"), "cluster", F.when(F.col("cluster").isNotNull(), "border").otherwise("noise").alias("kind"))
    return in_core.unionByName(outer)


def k_distance(points: DataFrame, k: int) -> DataFrame:
    """Distance of every point to its k-th neighbour (``points(id, vector)``)."""
    near = nearest(points, points, k, "euclidean")
    return near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (-F.col("score")).alias("distance"))


# texts

def text_classifier(docs: DataFrame, text: str, label: str, buckets: int = 1 << 16, iterations: int = 50, regularisation: float = 0.005, sparsity: float = 1.0):
    """Logistic regression on which hashed words a text has, rare ones weighing more, fitted on all rows with a label (0 or 1).

    The absolute penalty (``sparsity`` 1) leaves few words with a weight, as the words that mark a class are few.
    """
    stages = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[^\p{L}\p{N}]+", toLowercase=True), HashingTF(inputCol="_w", outputCol="_h", numFeatures=buckets, binary=True),
        IDF(inputCol="_h", outputCol="_f", minDocFreq=2), LogisticRegression(featuresCol="_f", labelCol="_y", probabilityCol="_p", maxIter=iterations, regParam=regularisation, elasticNetParam=sparsity),
    ]
    rows = docs.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(label).cast("double").alias("_y"))
    return Pipeline(stages=stages).fit(rows)


def text_scores(model: PipelineModel, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, score``: the probability of label 1; null texts count as empty."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return model.transform(rows).select(key, vector_to_array("_p")[1].alias("score"))


# anomalies

def isolation_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 1) -> DataFrame:
    """Anomaly score per row. Each tree grows in its own task on ``sample`` rows; scoring is one pass with the small trees."""
    feats = list(features)
    n = df.count()
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in feats])
    # a tree takes the rows of smallest hash; four times as many as it needs are looked at, so that a row is copied only to trees that may take it
    share = 4.0 * sample / max(n, 1)
    drawn = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda k: F.struct(k.alias("tree"), hash_unit(F.lit(seed), k, F.col(key)).alias("_u")))
    picked = rows.select("*", F.inline(F.filter(drawn, lambda d: d["_u"] < share)))
    picked = top_per_group(picked, ["tree"], ["_u"], sample)
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf.sort_values("_u")[feats].to_numpy()
        rng = np.random.default_rng([seed, tree])
        out = []

        def node(x: np.ndarray, depth: int) -> int:
            at = len(out)
            out.append(None)
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
            if depth >= limit or len(spread) == 0:
                out[at] = (tree, at, -1, 0.0, -1, -1, len(x))
                return at
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            low = x[:, f] < cut
            a, b = node(x[low], depth + 1), node(x[~low], depth + 1)
            out[at] = (tree, at, f, cut, a, b, len(x))
            return at

        node(data, 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "low", "high", "size"])

    grown = picked.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, low int, high int, size int").orderBy("tree", "node").collect()
    forest = {}
    for r in grown:  # at most trees * 2 * sample nodes
        forest.setdefault(r["tree"], []).append(tuple(r)[2:])
    arrays = [tuple(np.array(c) for c in zip(*nodes)) for nodes in forest.values()]

    def mean_path(m):
        return 0.0 if m <= 1 else 1.0 if m == 2 else 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m

    norm_len = mean_path(min(sample, n)) or 1.0

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            depth = np.zeros(len(x))
            for feature, cut, low, high, size in arrays:
                at = np.zeros(len(x), dtype=int)
                steps = np.zeros(len(x))
                for _ in range(limit):
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    go_low = x[np.arange(len(x)), np.maximum(feature[at], 0)] < cut[at]
                    at = np.where(inner, np.where(go_low, low[at], high[at]), at)
                    steps += inner
                depth += steps + np.array([mean_path(s) for s in size])[at]
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-depth / len(arrays) / norm_len)})

    return rows.mapInPandas(apply, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def zscore_iqr_flags(df: DataFrame, col: str, z: float = 3, k: float = 1.5) -> DataFrame:
    q1, q3 = quantile_values(df, [col], [0.25, 0.75])[col]
    s = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    x = F.col(col)
    zs = safe_divide(x - F.lit(s["m"]), F.lit(s["s"]))
    return df.withColumns({"z_score": zs, "z_anomaly": F.abs(zs) > z, "iqr_anomaly": ~x.between(q1 - k * (q3 - q1), q3 + k * (q3 - q1))})


def mahalanobis(df: DataFrame, features: Sequence[str], out: str = "distance") -> DataFrame:
    """Distance from the mean in units of the covariance (a k x k matrix is inverted on the driver)."""
    n = len(features)
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(n)]).first()
    mean = np.array([one[f"m{i}"] for i in range(n)])
    cov = np.array([[one[f"c{i}_{j}"] for j in range(n)] for i in range(n)])
    return df.withColumn(out, F.sqrt(quadratic_form(features, mean, np.linalg.inv(cov))))


# recommendation

def fit_als(facts: DataFrame, user: str, item: str, rating: str, rank: int = 8, iterations: int = 5, seed: int = 1, implicit: bool = True):
    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=iterations, seed=seed, implicitPrefs=implicit, coldStartStrategy="drop").fit(facts)


def item_similarity(pairs: DataFrame) -> DataFrame:
    """Cosine of item vectors of buyers from co-occurrence counts ``(item_a, item_b, n, support_a, support_b)``."""
    return pairs.withColumn("cosine", F.col("n") / F.sqrt(F.col("support_a") * F.col("support_b")))


# model selection

def cross_validate(train: DataFrame, features: Sequence[str], label: str, kind: str, grid: dict[str, Sequence], folds: int | str = 3, metric: str = "areaUnderROC",
                   pick: int | None = None, seed: int = 1):
    """Mean score per parameter setting. ``folds`` is a number or the name of an integer fold column;
    ``pick`` tries that many settings of the grid instead of all (seeded)."""
    regression = kind in REGRESSORS and kind not in CLASSIFIERS or metric in ("rmse", "mae", "r2")
    cls = (REGRESSORS if regression else CLASSIFIERS)[kind]
    model = cls(featuresCol="_x", labelCol=label)
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(model.getParam(name), list(values))
    maps = b.build()
    if pick is not None and pick < len(maps):
        maps = [maps[i] for i in sorted(np.random.default_rng(seed).choice(len(maps), pick, replace=False))]
    evaluator = RegressionEvaluator(labelCol=label, metricName=metric) if regression else BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=Pipeline(stages=[*assembler(features), model]), estimatorParamMaps=maps, evaluator=evaluator, seed=seed, parallelism=4)
    # A fold's rows are kept in memory, for all settings: only the columns that are learned from, and a fold column is worked out once.
    train = train.select(*features, label, *([folds] if isinstance(folds, str) else []))
    if isinstance(folds, str):
        n = train.agg(F.max(folds)).first()[0] + 1
        cv = cv.setFoldCol(folds).setNumFolds(n)
    else:
        cv = cv.setNumFolds(folds)
    fitted = cv.fit(train)
    rows = [(", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(s)) for m, s in zip(maps, fitted.avgMetrics)]
    return fitted, train.sparkSession.createDataFrame(rows, "params string, score double")


def learning_curve(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], label: str, kind: str, shares: Sequence[float], **params) -> DataFrame:
    rows = []
    for s in shares:
        part = train.where(hash_unit(F.lit(11), F.col(key)) < s)
        m = fit(part, features, label, kind, **params)
        ev = BinaryClassificationEvaluator(labelCol=label)
        rows.append((float(s), float(ev.evaluate(m.transform(part))), float(ev.evaluate(m.transform(test)))))
    return train.sparkSession.createDataFrame(rows, "share double, train_auc double, test_auc double")


def weights_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Importance, or coefficient and odds ratio, per feature."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        rows = [(f, float(last.featureImportances[i]), None, None) for i, f in enumerate(features)]
    else:
        rows = [(f, None, float(last.coefficients[i]), math.exp(min(float(last.coefficients[i]), 700.0))) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double, coefficient double, odds_ratio double")


def permutation_importance(model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], label: str, seed: int = 1) -> DataFrame:
    """AUC lost when one column is shuffled."""
    ev = BinaryClassificationEvaluator(labelCol=label)
    base = ev.evaluate(model.transform(df))
    rows = [(f, float(base - ev.evaluate(model.transform(permute_column(df, f, key, seed))))) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, auc_drop double")


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], label: str, kind: str, **params) -> DataFrame:
    """AUC without each group of columns."""
    every = [c for cols in groups.values() for c in cols]
    ev = BinaryClassificationEvaluator(labelCol=label)
    rows = [("none", float(ev.evaluate(fit(train, every, label, kind, **params).transform(test))))]
    for g, cols in groups.items():
        left = [c for c in every if c not in set(cols)]
        if left:
            rows.append((g, float(ev.evaluate(fit(train, left, label, kind, **params).transform(test)))))
    return train.sparkSession.createDataFrame(rows, "removed string, auc double")


def calibrate(train: DataFrame, score_col: str, label: str, how: str = "platt") -> PipelineModel:
    last = LogisticRegression(featuresCol="_x", labelCol=label) if how == "platt" else IsotonicRegression(featuresCol="_x", labelCol=label)
    return Pipeline(stages=[*assembler([score_col]), last]).fit(train)


def calibrated(model: PipelineModel, df: DataFrame, out: str = "calibrated") -> DataFrame:
    t = model.transform(df)
    p = vector_to_array("probability")[1] if "probability" in t.columns else F.col("prediction")
    return t.withColumn(out, p).drop("_x", "rawPrediction", "probability", "prediction")


# decisions

def risk_tier(p: Column) -> Column:
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def score_bands(score_col: Column, rules_hit: Column) -> Column:
    """block on a rule hit or a very high score, then review, monitor, approve."""
    return (F.when(rules_hit | (score_col >= 0.9), "block").when(score_col >= 0.7, "review").when(score_col >= 0.4, "monitor").otherwise("approve"))


def smote(minority: DataFrame, features: Sequence[str], key: str, per_row: int, k: int = 5, seed: int = 1) -> DataFrame:
    """Synthetic rows on the line from a row to one of its k nearest minority rows; hashes of seed, key and copy choose which one and where."""
    p = minority.select(F.col(key).cast("bigint").alias("id"), F.array(*[F.col(c).cast("double") for c in features]).alias("vector"))
    near = nearest(p, p, k, "euclidean").select(F.col("query_id").alias("id"), "item_id", "rank")
    counts = near.groupBy("id").agg(F.max("rank").alias("_k"))
    draws = p.join(counts, "id").select("*", F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("copy")).withColumn(
        "rank", (F.floor(hash_unit(F.lit(seed), F.col("id"), F.col("copy")) * F.col("_k")) + 1).cast("int")).withColumn(
        "u", hash_unit(F.lit(seed + 1), F.col("id"), F.col("copy")))
    other = p.select(F.col("id").alias("item_id"), F.col("vector").alias("_o"))
    j = draws.join(near, ["id", "rank"]).join(other, "item_id")
    mixed = F.zip_with("vector", "_o", lambda a, b: a + F.col("u") * (b - a))
    return j.withColumn("_m", mixed).select(F.col("id").alias(key), "copy", *[F.col("_m")[i].alias(c) for i, c in enumerate(features)])


def impute_knn(df: DataFrame, key: str, target: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """Missing targets get the mean of the k nearest complete rows (features scaled to unit sd)."""
    sd = df.agg(*[F.stddev_samp(c).alias(c) for c in features]).first()
    vec = F.array(*[(F.col(c).cast("double") / F.lit(float(sd[c] or 1.0))) for c in features]).alias("vector")
    whole = df.where(F.col(target).isNotNull()).select(F.col(key).alias("id"), vec, target)
    gaps = df.where(F.col(target).isNull()).select(F.col(key).alias("id"), vec)
    near = nearest(gaps, whole, k, "euclidean").join(whole.select(F.col("id").alias("item_id"), F.col(target).alias("_y")), "item_id")
    filled = near.groupBy(F.col("query_id").alias(key)).agg(F.avg("_y").alias("_fill"))
    return df.join(filled, key, "left").withColumn(target, F.coalesce(F.col(target), F.col("_fill"))).drop("_fill")


