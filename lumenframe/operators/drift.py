"""Drift and monitoring over a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import pvalues as pv
from lumenframe.functions.scalars import cosine, md5_bucket, pearson_r, safe_divide
from lumenframe.operators.evaluation import confusion_counts, rates, roc_auc
from lumenframe.operators.retrieval import group_centroids
from lumenframe.operators.scaling import attach_row, neighbours, running
from lumenframe.operators.statistics import ks_distance, psi


def data_drift(ref: DataFrame, cur: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """KS distance, asymptotic p-value and severity per feature, largest distance first."""
    rows = ks_distance(ref, cur, features).collect()  # one row per feature
    out = []
    for r in rows:
        p = pv.ks_asymptotic(r["ks"], r["n_ref"], r["n_cur"])
        out.append((r["feature"], round(r["ks"], 4), round(p, 6), p < alpha, "HIGH" if r["ks"] > 0.2 else "MEDIUM" if r["ks"] > 0.1 else "LOW"))
    out.sort(key=lambda x: (-x[1], x[0]))
    return ref.sparkSession.createDataFrame(out, "feature string, ks_statistic double, p_value double, drift_detected boolean, severity string")


def psi_report(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    return psi(ref, cur, features).withColumn("status", F.when(F.col("psi") > 0.25, "ALERT").when(F.col("psi") > 0.1, "WARNING").otherwise("OK"))


def concept_drift(pred: DataFrame, day: str, y: str, yhat: str, window: int = 7) -> DataFrame:
    """Accuracy, precision and recall over the last ``window`` days, from daily counts (full windows only)."""
    daily = pred.groupBy(day).agg(*confusion_counts(F.col(y), F.col(yhat)))

    def total(c):
        return lambda w: F.sum(c).over(w.rowsBetween(-(window - 1), 0))

    rolled = neighbours(daily, [], [day], {**{f"_{c}": total(c) for c in ("tp", "fp", "fn", "tn")},
                                           "_d": lambda w: F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0))}, before=window - 1)
    named = rolled.where(F.col("_d") == window).select(day, *[F.col(f"_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")])
    return rates(named).select(day, "accuracy", "precision", "recall")


def concept_drift_verdict(rolled: DataFrame, day: str, window: int = 7, threshold: float = 0.05) -> DataFrame:
    """Mean accuracy of the first ``window`` rows against the last ones."""
    a = rolled.orderBy(day).limit(window).agg(F.avg("accuracy").alias("baseline"))
    b = rolled.orderBy(F.desc(day)).limit(window).agg(F.avg("accuracy").alias("recent"))
    return attach_row(a, b).withColumn("drop", F.col("baseline") - F.col("recent")).withColumn("drift_detected", F.col("drop") > threshold)


def learn_feature_stats(ref: DataFrame, features: Sequence[str]) -> dict[str, dict]:
    row = ref.agg(*[F.struct(F.avg(F.col(c).isNull().cast("int")).alias("null_rate"), F.min(c).alias("low"), F.max(c).alias("high"),
                             F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in features]).first()
    return {c: row[c].asDict() for c in features}


def feature_health(cur: DataFrame, stats: dict[str, dict]) -> DataFrame:
    """Null-rate spike (1.5 times), range, mean shift (z > 3) and stuck values per feature."""
    one = cur.agg(*[F.struct(F.avg(F.col(c).isNull().cast("int")).alias("null_rate"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"),
                             F.avg(c).alias("mean"), F.approx_count_distinct(c).alias("distinct")).alias(c) for c in stats])
    items = []
    for c, s in stats.items():
        v = F.col(c)
        z = safe_divide(F.abs(v["mean"] - F.lit(s["mean"])), F.lit(s["std"]))
        items.append(F.struct(F.lit(c).alias("feature"), (v["null_rate"] > F.lit(s["null_rate"]) * 1.5).alias("null_spike"),
                              (v["low"] < F.lit(s["low"])).alias("below_range"), (v["high"] > F.lit(s["high"])).alias("above_range"),
                              (z > 3).alias("mean_shift"), (v["distinct"] <= 1).alias("stuck")))
    return one.select(F.inline(F.array(*items)))


def prediction_distribution(pred: DataFrame, day: str, score: str, ref_mean: float, ref_sd: float, threshold: float = 0.5) -> DataFrame:
    s = F.col(score)
    return pred.groupBy(day).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.avg((s >= threshold).cast("double")).alias("positive_rate"),
                                 F.avg(F.greatest(s, 1 - s)).alias("confidence"), (F.min(s) == F.max(s)).alias("collapsed")).withColumn(
        "shift", safe_divide(F.abs(F.col("mean") - F.lit(ref_mean)), F.lit(ref_sd)))


def daily_monitor(ref: DataFrame, cur: DataFrame, features: Sequence[str], y: str, score: str) -> DataFrame:
    """Alerts: 3 or more features over PSI 0.25, prediction shift over 3 sd, AUC drop over 0.05; retrain if any is critical."""
    drifted = psi_report(ref, cur, features).agg(F.count_if(F.col("psi") > 0.25).cast("double").alias("value"))
    base = ref.agg(F.avg(score).alias("m"), F.stddev_samp(score).alias("s")).first()
    shift = cur.agg((F.abs(F.avg(score) - base["m"]) / base["s"]).alias("value"))
    old = roc_auc(ref, y, score).first()["auc"]
    drop = roc_auc(cur, y, score).select((F.lit(old) - F.col("auc")).alias("value"))
    rules = [("features_drifted", drifted, F.col("value") >= 3, "HIGH"), ("prediction_shift", shift, F.col("value") > 3, "CRITICAL"),
             ("auc_drop", drop, F.col("value") > 0.05, "HIGH")]
    checks = reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("check"), "value", F.when(c, s).otherwise("OK").alias("severity")) for n, d, c, s in rules])
    crit = checks.agg(F.max((F.col("severity") == "CRITICAL").cast("int")).alias("_c"))
    return attach_row(checks, crit).select("check", "value", "severity", (F.col("_c") == 1).alias("retrain"))


def alert_severity(metrics: DataFrame, rules: Sequence[tuple[str, float, str]]) -> DataFrame:
    """``rules``: (metric, limit, severity); the severest broken rule per metric row."""
    order = {"INFO": 1, "WARNING": 2, "HIGH": 3, "CRITICAL": 4}
    table = metrics.sparkSession.createDataFrame([(m, float(v), s, order[s]) for m, v, s in rules], "metric string, limit double, severity string, level int")
    hit = metrics.join(F.broadcast(table), "metric").where(F.col("value") > F.col("limit"))  # a handful of rules
    return hit.groupBy(*metrics.columns).agg(F.max_by("severity", "level").alias("severity"))


def by_segment(pred: DataFrame, dims: Sequence[str], y: str, yhat: str) -> DataFrame:
    """Rates globally and per segment level."""
    r = pred.rollup(*dims).agg(*confusion_counts(F.col(y), F.col(yhat)), F.grouping_id().alias("_g"))
    named = [F.when(F.col("_g").bitwiseAND(1 << (len(dims) - 1 - i)) != 0, "ALL").otherwise(F.col(d).cast("string")).alias(d) for i, d in enumerate(dims)]
    return rates(r.select(*named, "tp", "fp", "fn", "tn"))


def categorical_drift(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """Shares on both sides, their difference, new and gone categories, chi-square part."""
    a = ref.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("nr"))
    b = cur.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("nc"))
    j = a.join(b, col, "full").na.fill(0, ["nr", "nc"])
    j = attach_row(j, j.agg(F.sum("nr").alias("_r"), F.sum("nc").alias("_c")))
    sr, sc = F.col("nr") / F.col("_r"), F.col("nc") / F.col("_c")
    e = sr * F.col("_c")
    return j.select(col, sr.alias("ref_share"), sc.alias("cur_share"), (sc - sr).alias("change"), (F.col("nr") == 0).alias("is_new"),
                    (F.col("nc") == 0).alias("is_gone"), safe_divide(F.pow(F.col("nc") - e, F.lit(2.0)), e).alias("chi2_part"))


def ab_variant(user: Column, share_a: int = 50) -> Column:
    """Sticky variant from the md5 bucket of the user."""
    return F.when(md5_bucket(user, 100) < share_a, "A").otherwise("B")


def variant_guardrails(df: DataFrame, variant: str, error: Column, value: str, expected_share: float = 0.5, kill_at: float = 0.05) -> DataFrame:
    """Counts per variant, error and value means, sample-ratio chi-square, kill flag if errors rise by more than ``kill_at``."""
    g = df.groupBy(variant).agg(F.count("*").alias("n"), F.avg(error.cast("double")).alias("error_rate"), F.avg(value).alias("mean_value"))
    base = g.where(F.col(variant) == "A").select(F.col("error_rate").alias("_e"), F.col("n").alias("_na"))
    whole = attach_row(attach_row(g, g.agg(F.sum("n").alias("_n"))), base)
    want = F.col("_n") * F.when(F.col(variant) == "A", expected_share).otherwise(1 - expected_share)
    return whole.select(variant, "n", "error_rate", "mean_value", (F.pow(F.col("n") - want, F.lit(2.0)) / want).alias("ratio_chi2"),
                        (F.col("error_rate") - F.col("_e") > kill_at).alias("kill"))


def shadow_compare(a: DataFrame, b: DataFrame, key: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Agreement and mean difference of two models on the same requests."""
    j = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key)
    same = (F.col("_a") >= threshold) == (F.col("_b") >= threshold)
    return j.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mean_difference"),
                 F.count_if(~same).alias("disagreements"))


def serving_skew(offline: DataFrame, online: DataFrame, key: str, features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Share of rows whose offline and online values differ, per feature."""
    j = offline.select(key, *[F.col(c).alias(f"a_{c}") for c in features]).join(online.select(key, *[F.col(c).alias(f"b_{c}") for c in features]), key)

    def differs(c):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())

    return j.agg(*[F.avg(differs(c).cast("double")).alias(c) for c in features]).unpivot([], list(features), "feature", "mismatch_rate")


def exposure_concentration(shown: DataFrame, period: str, item: str) -> DataFrame:
    """Herfindahl index, Gini coefficient and number of items per period."""
    c = shown.groupBy(period, item).agg(F.count("*").alias("n"))
    sizes = c.groupBy(period, "n").agg(F.count("*").alias("items"))
    cum = running(sizes, [period], ["n"], {"_ci": ("sum", "items"), "_before": ("sum", "items", "before")})
    # sum of rank * n over items sorted by n; ranks of equal counts are averaged
    mid = F.coalesce("_before", F.lit(0)) + (F.col("items") + 1) / 2
    g = cum.groupBy(period).agg(F.sum("items").alias("k"), F.sum(F.col("n") * F.col("items")).alias("t"), F.sum(mid * F.col("n") * F.col("items")).alias("rn"),
                                F.sum(F.col("n") * F.col("n") * F.col("items")).alias("sq"))
    return g.select(period, F.col("k").alias("items"), (F.col("sq") / (F.col("t") * F.col("t"))).alias("hhi"),
                    (2 * F.col("rn") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k")).alias("gini"))


def embedding_drift(ref: DataFrame, cur: DataFrame, vector: str) -> DataFrame:
    """Cosine of the two mean vectors."""
    both = ref.select(F.lit("ref").alias("side"), vector).unionByName(cur.select(F.lit("cur").alias("side"), vector))
    c = group_centroids(both, "side", vector)
    two = c.agg(F.max(F.when(F.col("side") == "ref", F.col("vector"))).alias("a"), F.max(F.when(F.col("side") == "cur", F.col("vector"))).alias("b"))
    return two.select(cosine(F.col("a"), F.col("b")).alias("centroid_cosine"))


def online_offline_gap(offline: DataFrame, online: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Offline metric next to the online rate per model and period, and the correlation of their changes."""
    model, period = keys
    j = offline.join(online, list(keys))
    d = neighbours(j, [model], [period], {"_do": lambda w: F.col("offline") - F.lag("offline").over(w),
                                          "_dn": lambda w: F.col("online") - F.lag("online").over(w)}, before=1)
    return d.groupBy(model).agg(F.count("*").alias("periods"), F.avg(F.col("offline") - F.col("online")).alias("mean_gap"), pearson_r(F.col("_do"), F.col("_dn")).alias("delta_corr"))
