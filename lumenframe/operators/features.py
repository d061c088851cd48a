"""Feature engineering: learned parts come from one aggregation (``fit``), the rest is a projection."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import ChiSqSelector, PolynomialExpansion, UnivariateFeatureSelector, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.scalars import clip, cyclical, is_weekend, safe_divide, seconds_between, weekday
from lumenframe.operators.aggregates import corr_pairs, value_counts
from lumenframe.operators.scaling import (attach_row, join_nullsafe, neighbours, quantile_values, running, split_join, spread,
                                          trailing, with_totals)
from lumenframe.operators.word_vectors import known_words, mean_vectors
from lumenframe.session import cut_lineage

# numeric

def qcut_column(x: Column, quantiles: Sequence[float]) -> Column:
    """Right-closed quantile bins from 0; equal edges collapse; outside the edges is null."""
    edges = sorted(set(quantiles))
    if len(edges) < 2:
        return F.lit(None).cast("int")
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + (x > F.lit(e)).cast("int")
    return F.when(x.between(F.lit(edges[0]), F.lit(edges[-1])), code)


def qcut(df: DataFrame, col: str, q: int, out: str) -> DataFrame:
    edges = quantile_values(df, [col], [i / q for i in range(q + 1)])[col]
    return df.withColumn(out, qcut_column(F.col(col), edges))


def cut_column(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Fixed right-closed bins ``(edge, next edge]``."""
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels):
        hit = (x > lo) & (x <= hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def numeric_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log (if nothing is negative), five quantile bins, z-score, values clipped to 1%-99%."""
    s = df.agg(*[a for c in cols for a in (F.min(c).alias(f"lo_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    q = quantile_values(df, cols, [0.01, 0.99, 0, 0.2, 0.4, 0.6, 0.8, 1])
    new = {}
    for c in cols:
        x = F.col(c)
        if s[f"lo_{c}"] is None:
            continue
        if s[f"lo_{c}"] >= 0:
            new[f"{c}_log"] = F.log1p(x)
        new[f"{c}_binned"] = qcut_column(x, q[c][2:])
        new[f"{c}_zscore"] = safe_divide(x - F.lit(s[f"m_{c}"]), F.lit(s[f"s_{c}"]))
        new[f"{c}_clipped"] = clip(x, q[c][0], q[c][1])
    return df.withColumns(new)


def fit_scaler(train: DataFrame, cols: Sequence[str], how: str) -> dict[str, tuple[float, float]]:
    """(shift, scale) per column: standard, minmax, robust or unit (largest absolute value)."""
    if how == "robust":
        return {c: (q[1], (q[2] - q[0])) for c, q in quantile_values(train, cols, [0.25, 0.5, 0.75]).items()}
    row = train.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.min(c).alias(f"a_{c}"),
                                                F.max(c).alias(f"b_{c}"), F.max(F.abs(c)).alias(f"u_{c}"))]).first()
    pick = {"standard": lambda c: (row[f"m_{c}"], row[f"s_{c}"]), "minmax": lambda c: (row[f"a_{c}"], row[f"b_{c}"] - row[f"a_{c}"]),
            "unit": lambda c: (0.0, row[f"u_{c}"])}[how]
    return {c: pick(c) for c in cols}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: safe_divide(F.col(c) - F.lit(a), F.lit(b)) for c, (a, b) in scaler.items()})


def fit_power(df: DataFrame, col: str, lambdas: Sequence[float], method: str = "box-cox") -> float:
    """The lambda with the largest profile log-likelihood; all candidates in one aggregation."""
    x = F.col(col)
    if method == "box-cox":
        logs = F.log(F.when(x > 0, x))
    else:
        logs = F.signum(x) * F.log1p(F.abs(x))
    aggs = [F.count(col).alias("n"), F.sum(logs).alias("l")]
    aggs += [F.var_pop(power_column(x, lam, method)).alias(f"v{i}") for i, lam in enumerate(lambdas)]
    row = df.agg(*aggs).first()

    def score(i):
        v = row[f"v{i}"]
        return -math.inf if not v or v <= 0 else -0.5 * row["n"] * math.log(v) + (lambdas[i] - 1) * row["l"]

    return lambdas[max(range(len(lambdas)), key=score)]


def power_column(x: Column, lam: float, method: str = "box-cox") -> Column:
    if method == "box-cox":
        p = F.when(x > 0, x)
        return F.log(p) if lam == 0 else (F.pow(p, F.lit(lam)) - 1) / lam
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def interactions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Products and ratios of every pair of long and double columns (ratio by 0 is null)."""
    kept = [c for c in cols if isinstance(df.schema[c].dataType, (T.LongType, T.DoubleType))]
    new = {}
    for i, a in enumerate(kept):
        for b in kept[i + 1:]:
            new[f"{a}_x_{b}"] = F.col(a) * F.col(b)
            new[f"{a}_div_{b}"] = safe_divide(F.col(a).cast("double"), F.col(b))
    return df.withColumns(new)


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, out: str = "poly") -> DataFrame:
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    return PolynomialExpansion(degree=degree, inputCol="_v", outputCol="_p").transform(rows).withColumn(
        out, vector_to_array("_p")).drop("_v", "_p")


# categorical

def frequency_encode(df: DataFrame, col: str) -> DataFrame:
    f = value_counts(df, col).select(col, F.col("share").alias(f"{col}_freq"))
    return df.join(f, col, "left")


def fit_target_encoding(train: DataFrame, col: str, target: str, smooth: float = 20) -> tuple[DataFrame, float]:
    mean = train.agg(F.avg(target)).first()[0]
    g = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    return g.select(col, ((F.col("_s") + smooth * mean) / (F.col("_n") + smooth)).alias(f"{col}_target_enc")), mean


def target_encode(df: DataFrame, encoding: DataFrame, col: str, default: float | None = None) -> DataFrame:
    out = df.join(encoding, col, "left")
    name = f"{col}_target_enc"
    return out if default is None else out.withColumn(name, F.coalesce(name, F.lit(default)))


def target_encode_loo(df: DataFrame, col: str, target: str) -> DataFrame:
    """Mean of the other rows of the category."""
    t = with_totals(df, [col], [F.sum(target).alias("_s"), F.count(target).alias("_n")])
    own = F.coalesce(F.col(target), F.lit(0))
    return t.withColumn(f"{col}_loo", safe_divide(F.col("_s") - own, F.col("_n") - F.col(target).isNotNull().cast("int"))).drop("_s", "_n")


def target_encode_kfold(df: DataFrame, col: str, target: str, fold: str) -> DataFrame:
    """Mean of the category in the other folds."""
    per = df.groupBy(col, fold).agg(F.sum(target).alias("_fs"), F.count(target).alias("_fn"))
    all_ = per.groupBy(col).agg(F.sum("_fs").alias("_s"), F.sum("_fn").alias("_n"))
    enc = join_nullsafe(per, all_, [col]).select(col, fold, safe_divide(F.col("_s") - F.coalesce("_fs", F.lit(0)),
                                                                        F.col("_n") - F.col("_fn")).alias(f"{col}_oof"))
    return join_nullsafe(df, enc, [col, fold])


def target_encode_ordered(df: DataFrame, col: str, target: str, order: Sequence[str]) -> DataFrame:
    """Mean of the category's earlier rows."""
    r = running(df, [col], order, {"_s": ("sum", target, "before"), "_n": ("count", target, "before")})
    return r.withColumn(f"{col}_past", safe_divide(F.col("_s"), F.col("_n"))).drop("_s", "_n")


def categories(df: DataFrame, col: str, most: int) -> list:
    """Sorted non-null values, or an empty list if there are more than ``most``."""
    got = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(most + 1).collect()]
    return sorted(got) if len(got) <= most else []


def one_hot(df: DataFrame, col: str, most: int = 10, drop_first: bool = True) -> DataFrame:
    values = categories(df, col, most)
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values[1 if drop_first else 0:]})


def label_encode(df: DataFrame, col: str, order: Sequence | None = None) -> DataFrame:
    """Code by sorted value (from a lookup table) or by the given order."""
    if order is not None:
        code = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col)).cast("int") - 1
        return df.withColumn(f"{col}_code", F.when(F.col(col).isNotNull() & (code >= 0), code))
    rows = categories(df, col, 100_000)
    if not rows and not df.where(F.col(col).isNotNull()).isEmpty():
        raise ValueError("too many categories for a code table; use a hash code")
    lookup = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(rows)],
                                             T.StructType([df.schema[col], T.StructField(f"{col}_code", T.IntegerType())]))
    return df.join(lookup, col, "left")


# date and text

def datetime_features(df: DataFrame, col: str) -> DataFrame:
    d = F.col(col)
    s, c = cyclical(F.month(d), 12)
    return df.withColumns({f"{col}_year": F.year(d), f"{col}_month": F.month(d), f"{col}_dayofweek": weekday(d), f"{col}_hour": F.hour(d),
                           f"{col}_is_weekend": is_weekend(d), f"{col}_month_sin": s, f"{col}_month_cos": c})


TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TERM), lambda w: w != "")


def term_counts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return spread(df.select(id_col, text)).select(id_col, F.explode(terms(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``tf / document length * ln(N / df)``. A text is split once; its length travels with its terms, and terms of very many texts meet their counts by a broadcast."""
    split = spread(df.select(id_col, text)).select(id_col, terms(F.col(text)).alias("_w")).select(id_col, F.size("_w").alias("_len"), F.explode("_w").alias("term"))
    counts = cut_lineage(split.groupBy(id_col, "_len", "term").agg(F.count("*").alias("tf")))
    seen = cut_lineage(counts.groupBy("term").agg(F.count("*").alias("_df")))
    n = df.count()
    return split_join(counts, seen, ["term"], "_df").select(id_col, "term", (F.col("tf") / F.col("_len") * F.log(F.lit(float(n)) / F.col("_df"))).alias("tfidf"))


def word_ngrams(text: Column, n: int) -> Column:
    """Word n-grams; the word list is bound once (a lambda argument), not split again per n-gram."""
    none = F.array().cast("array<string>")

    def grams(w):
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)),
                                                  lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(none)

    return F.element_at(F.transform(F.array(terms(text)), grams), 1)


#: Hash buckets that rows are counted in before their items, and buckets that are sent to every task at most.
COUNT_BUCKETS, MOST_SENT_BUCKETS = 1 << 22, 1_000_000


def most_frequent(rows: DataFrame, item: str, key: str, top: int) -> DataFrame:
    """``item, n, keys``: the ``top`` items with most rows, ties to the smaller, with their rows and different keys.

    All rows are counted by hash buckets first. The items of the largest buckets give a number that the last of the ``top`` has at least; an item of a bucket with fewer rows than that can't be among
    them, so only the other buckets' items are shuffled. Without frequent items that is all of them.
    """
    hashed = rows.withColumn("_b", F.pmod(F.xxhash64(item), F.lit(COUNT_BUCKETS)))
    held = cut_lineage(hashed.groupBy("_b").agg(F.count("*").alias("_n")))
    largest = held.orderBy(F.desc("_n"), "_b").limit(4 * top).select("_b")
    sure = hashed.join(F.broadcast(largest), "_b", "left_semi").groupBy(item).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(top).agg(F.min("n"), F.count("*")).first()
    kept = held.where(F.col("_n") >= F.lit(sure[0])).select("_b") if sure[1] == top else held.select("_b")
    if kept.count() <= min(MOST_SENT_BUCKETS, held.count() // 2):
        hashed = hashed.join(F.broadcast(kept), "_b", "left_semi")
    per = hashed.groupBy(item, key).agg(F.count("*").alias("c"))
    return per.groupBy(item).agg(F.sum("c").alias("n"), F.count("*").alias("keys")).orderBy(F.desc("n"), item).limit(top)


#: Characters of text that one task trains word vectors on, and words that MLlib may hold on the driver, at about a kilobyte each.
TRAIN_CHARS, DRIVER_WORDS = 16_000_000, 250_000


def mean_word_vectors(df: DataFrame, text: str, size: int = 16, min_count: int = 5, seed: int = 1, iterations: int = 1) -> DataFrame:
    """Word2Vec trained on the texts; each row gets the mean of its word vectors.

    All texts are trained on, about ``TRAIN_CHARS`` characters in a task; what several tasks learned, Spark averages, so that vectors of more text than that differ from those of one long task.
    MLlib holds all words of the model on the driver; more than ``DRIVER_WORDS`` are trained by ``word_vectors`` instead.
    """
    rows = df.withColumn("_w", terms(F.col(text)))
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    if chars > 2 * min_count * DRIVER_WORDS:  # fewer can't hold so many words
        known = known_words(df, terms(F.col(text)), min_count)
        if known.count() > DRIVER_WORDS:
            return mean_vectors(df, terms(F.col(text)), known, size, seed, iterations, "vector")
    parts = max(1, -(-chars // TRAIN_CHARS))
    model = Word2Vec(vectorSize=size, minCount=min_count, seed=seed, maxIter=iterations, numPartitions=parts, inputCol="_w", outputCol="_v").fit(rows.select("_w"))
    return model.transform(rows).withColumn("vector", vector_to_array("_v")).drop("_w", "_v")


# time series and entities

def timeseries_features(df: DataFrame, col: str, order: Sequence[str], keys: Sequence[str] = (), windows: Sequence[int] = (7, 14, 30),
                        lags: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """Rolling mean and sd (null until the window is full), lags, difference, relative change."""
    def full(agg: Callable, n: int):
        def build(w):
            frame = w.rowsBetween(-(n - 1), 0)
            return F.when(F.count(col).over(frame) == n, agg(col).over(frame))
        return build

    exprs: dict[str, Callable] = {}
    for n in windows:
        exprs[f"{col}_roll_mean_{n}"] = full(F.avg, n)
        exprs[f"{col}_roll_std_{n}"] = full(F.stddev_samp, n)
    for n in lags:
        exprs[f"{col}_lag_{n}"] = lambda w, n=n: F.lag(col, n).over(w)
    exprs[f"{col}_diff"] = lambda w: F.col(col) - F.lag(col, 1).over(w)
    exprs[f"{col}_pct_change"] = lambda w: safe_divide(F.col(col) - F.lag(col, 1).over(w), F.lag(col, 1).over(w))
    return neighbours(df, keys, order, exprs, before=max([*windows, *[n + 1 for n in lags]]) - 1)


def entity_features(facts: DataFrame, entity: str, ts: str, value: str, as_of: str, windows: Sequence[int] = (7, 14, 30, 60, 90)) -> DataFrame:
    """Counts and sums per window ``(as_of - w, as_of]``, lifetime totals, recency; one scan, one grouping."""
    now = F.lit(as_of).cast("date")
    age = F.datediff(now, F.to_date(ts))
    aggs = [F.count("*").alias("lifetime_orders"), F.sum(value).alias("lifetime_revenue"), F.avg(value).alias("avg_order_value"),
            F.min(F.to_date(ts)).alias("first_order"), F.max(F.to_date(ts)).alias("last_order")]
    for w in windows:
        inside = (age >= 0) & (age < w)
        aggs += [F.count_if(inside).alias(f"order_count_{w}d"), F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0.0)).alias(f"revenue_{w}d")]
    out = facts.where(age >= 0).groupBy(entity).agg(*aggs)
    lo, hi = min(windows), max(windows)
    return out.withColumns({"days_since_last_order": F.datediff(now, "last_order"), "days_since_first_order": F.datediff(now, "first_order"),
                            "recent_ratio": safe_divide(F.col(f"revenue_{lo}d"), F.col(f"revenue_{hi}d"))})


def rolling_panel(facts: DataFrame, entity: str, ts: str, value: str, start: str, end: str, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and date with rolling counts and sums over the last w days."""
    day = F.to_date(ts)
    daily = facts.groupBy(entity, day.alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    spine = facts.select(entity).distinct().select(entity, F.explode(dates).alias("day"))
    whole = spine.join(daily, [entity, "day"], "left").na.fill({"n": 0, "total": 0.0})
    exprs: dict[str, Callable] = {}
    for w in windows:
        exprs[f"n_{w}d"] = lambda win, w=w: F.sum("n").over(win.rowsBetween(-(w - 1), 0))
        exprs[f"total_{w}d"] = lambda win, w=w: F.sum("total").over(win.rowsBetween(-(w - 1), 0))
    return neighbours(whole, [entity], ["day"], exprs, before=max(windows) - 1)


def preference_vector(facts: DataFrame, entity: str, category: str, values: Sequence, amount: str) -> DataFrame:
    """Share of an entity's total per category."""
    g = facts.groupBy(entity).agg(F.sum(amount).alias("_t"), *[
        F.coalesce(F.sum(F.when(F.col(category) == v, F.col(amount))), F.lit(0.0)).alias(str(v)) for v in values])
    return g.select(entity, *[safe_divide(F.col(str(v)), F.col("_t")).alias(str(v)) for v in values])


def item_features(lines: DataFrame, items: DataFrame, item: str, category: str, price: str, ts: str, quantity: str) -> DataFrame:
    """Price against the category mean, and units sold per active day."""
    cat = items.groupBy(category).agg(F.avg(price).alias("_cat"))
    sold = lines.groupBy(item).agg(F.sum(quantity).alias("units"), F.datediff(F.max(ts), F.min(ts)).alias("_span"))
    return items.join(cat, category).join(sold, item, "left").select(
        item, safe_divide(F.col(price), F.col("_cat")).alias("price_ratio"), F.coalesce("units", F.lit(0.0)).alias("units"),
        safe_divide(F.coalesce("units", F.lit(0.0)), F.col("_span") + 1).alias("velocity"))


def fraud_features(events: DataFrame, entity: str, ts: str, order: Sequence[str], amount: str, attribute: str, flagged: Column) -> DataFrame:
    """Per event, from the past only: amount against the entity's mean so far, entity age, first use of an
    attribute, events in the last hour, and earlier flagged events that share the attribute."""
    a = running(events.withColumn("_f", flagged.cast("int")), [entity], order, {
        "_s": ("sum", amount, "before"), "_n": ("count", amount, "before"), "_first": ("min", ts)})
    b = running(a, [attribute], order, {"flagged_before": ("sum", "_f", "before")})
    c = running(b, [entity, attribute], order, {"_seen": ("count", F.lit(1), "before")})
    us = 3_600_000_000
    d = trailing(c, [entity], ts, 3600, {"velocity_1h": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-us, 0))})
    return d.withColumns({"amount_deviation": F.col(amount) - safe_divide(F.col("_s"), F.col("_n")),
                          "age_hours": seconds_between(F.col(ts), F.col("_first")) / 3600, "new_attribute": (F.col("_seen") == 0).cast("int"),
                          "flagged_before": F.coalesce("flagged_before", F.lit(0))}).drop("_s", "_n", "_first", "_f", "_seen")


def churn_label(features: DataFrame, horizon: int = 90) -> DataFrame:
    return features.withColumn("churned", (F.col("days_since_last_order") > horizon).cast("int"))


# selection

def correlation_filter(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns left after dropping the later one of every strongly correlated pair."""
    strong = {(r["a"], r["b"]) for r in corr_pairs(df, cols).where(F.abs("r") > limit).collect()}
    kept: list[str] = []
    for c in cols:
        if not any((k, c) in strong for k in kept):
            kept.append(c)
    return kept


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Discrete mutual information in nats, from joint counts."""
    j = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    px, py = j.groupBy(x).agg(F.sum("n").alias("nx")), j.groupBy(y).agg(F.sum("n").alias("ny"))
    w = attach_row(j.join(px, x).join(py, y), j.agg(F.sum("n").alias("t")))
    return w.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def low_variance(df: DataFrame, cols: Sequence[str], limit: float) -> DataFrame:
    one = df.agg(*[F.var_samp(c).alias(c) for c in cols])
    return one.unpivot([], list(cols), "feature", "variance").withColumn("keep", F.col("variance") > limit)


def select_univariate(df: DataFrame, cols: Sequence[str], label: str, k: int, categorical: bool = False) -> list[str]:
    """The ``k`` best columns by chi-square (categorical features) or ANOVA F."""
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    if categorical:
        model = ChiSqSelector(numTopFeatures=k, featuresCol="_v", labelCol=label, outputCol="_o").fit(rows)
    else:
        sel = UnivariateFeatureSelector(featuresCol="_v", labelCol=label, outputCol="_o", selectionMode="numTopFeatures")
        model = sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k).fit(rows)
    return [cols[i] for i in model.selectedFeatures]


def select_recursive(df: DataFrame, cols: Sequence[str], label: str, k: int) -> list[str]:
    """Fit, drop the column with the smallest standardised weight, repeat until ``k`` are left."""
    left = list(cols)
    while len(left) > k:
        sds = df.agg(*[F.stddev_samp(c).alias(c) for c in left]).first()
        rows = VectorAssembler(inputCols=left, outputCol="_v").transform(df)
        weights = LinearRegression(featuresCol="_v", labelCol=label).fit(rows).coefficients
        left.remove(min(zip(left, weights), key=lambda p: abs(p[1]) * (sds[p[0]] or 0))[0])
    return left


def select_l1(df: DataFrame, cols: Sequence[str], label: str, reg: float) -> list[str]:
    rows = VectorAssembler(inputCols=list(cols), outputCol="_v").transform(df)
    weights = LinearRegression(featuresCol="_v", labelCol=label, regParam=reg, elasticNetParam=1.0).fit(rows).coefficients
    return [c for c, w in zip(cols, weights) if abs(w) > 1e-12]
