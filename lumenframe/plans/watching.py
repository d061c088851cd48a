"""Drift and monitoring over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import drift as dr
from lumenframe.plans.registry import plan
from lumenframe.plans.scoring import PRED, predictions


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def halves(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("double")
    e = t.events.withColumn("k", k)
    return e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut)


def _ks(f, x):
    return f"""SELECT '{f}' AS feature, max(abs(a - b)) AS ks FROM (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS a, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS b FROM
  (SELECT {x} AS v, count_if(ts < TIMESTAMP '2024-01-16') AS r, count_if(ts >= TIMESTAMP '2024-01-16') AS c FROM events GROUP BY 1))"""


K = "CAST(props->>'$.k' AS DOUBLE)"


@plan("S01 N17", f"SELECT feature, round(ks, 4) AS ks_statistic, CASE WHEN ks > 0.2 THEN 'HIGH' WHEN ks > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ({_ks('value', 'value')} UNION ALL {_ks('k', K)})")
def detect_data_drift(t):
    return dr.data_drift(*halves(t), ["value", "k"]).select("feature", "ks_statistic", "severity")


def _psi(f, x):
    return f"""SELECT '{f}' AS feature, sum((c - p) * ln(c / p)) AS psi FROM (SELECT greatest(coalesce(sum(r), 0) / (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16'), 0.001) AS p,
  greatest(coalesce(sum(c), 0) / (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16'), 0.001) AS c FROM range(10) g(i) LEFT JOIN (SELECT len(list_filter((SELECT quantile_cont({x}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM events WHERE ts < TIMESTAMP '2024-01-16'),
  lambda e: e <= {x})) AS bin, (ts < TIMESTAMP '2024-01-16')::INT AS r, (ts >= TIMESTAMP '2024-01-16')::INT AS c FROM events) ON bin = i GROUP BY i)"""


@plan("S02 N18", f"SELECT feature, round(psi, 4) AS psi, CASE WHEN psi > 0.25 THEN 'ALERT' WHEN psi > 0.1 THEN 'WARNING' ELSE 'OK' END AS status FROM ({_psi('value', 'value')} UNION ALL {_psi('k', K)})")
def psi_report(t):
    return dr.psi_report(*halves(t), ["value", "k"])


ROLL = """d AS (SELECT day, count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp, count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn FROM p GROUP BY day),
  w AS (SELECT day, sum(tp) OVER o AS tp, sum(fp) OVER o AS fp, sum(fn) OVER o AS fn, sum(tn) OVER o AS tn, count(*) OVER o AS n FROM d WINDOW o AS (ORDER BY day ROWS 6 PRECEDING)),
  r AS (SELECT day, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM w WHERE n = 7)"""


@plan("S03", f"WITH {PRED}, {ROLL} SELECT strftime(day, '%Y-%m-%d') AS day, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall FROM r")
def concept_drift(t):
    r = dr.concept_drift(predictions(t), "day", "y", "yhat")
    return r.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@plan("S03", f"""WITH {PRED}, {ROLL}, v AS (SELECT (SELECT avg(accuracy) FROM (SELECT accuracy FROM r ORDER BY day LIMIT 7)) AS b, (SELECT avg(accuracy) FROM (SELECT accuracy FROM r ORDER BY day DESC LIMIT 7)) AS c)
  SELECT round(b, 6) AS baseline, round(c, 6) AS recent, round(b - c, 6) AS "drop", b - c > 0.05 AS drift_detected FROM v""")
def concept_drift_verdict(t):
    return _r(dr.concept_drift_verdict(dr.concept_drift(predictions(t), "day", "y", "yhat"), "day"), 6, "drift_detected")


@plan("S04", """WITH a AS (SELECT min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS s FROM events WHERE ts < TIMESTAMP '2024-01-16'), b AS (SELECT min(value * 2) AS lo, max(value * 2) AS hi, avg(value * 2) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-16')
  SELECT 'value' AS feature, FALSE AS null_spike, b.lo < a.lo AS below_range, b.hi > a.hi AS above_range, abs(b.m - a.m) / a.s > 3 AS mean_shift, FALSE AS stuck FROM a, b""")
def feature_health(t):
    ref, cur = halves(t)
    return dr.feature_health(cur.withColumn("value", F.col("value") * 2), dr.learn_feature_stats(ref, ["value"]))


@plan("S05", f"""WITH {PRED} SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(avg(p), 6) AS mean, round(avg((p >= 0.5)::INT), 6) AS positive_rate, round(avg(greatest(p, 1 - p)), 6) AS confidence,
  min(p) = max(p) AS collapsed, round(abs(avg(p) - 0.5) / 0.2, 6) AS shift FROM p GROUP BY day""")
def prediction_distribution(t):
    d = dr.prediction_distribution(predictions(t), "day", "p", 0.5, 0.2)
    return _r(d.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 6, "day", "n", "collapsed")


@plan("S06", f"""WITH {PRED}, a AS (SELECT * FROM p WHERE day < DATE '2024-01-16'), b AS (SELECT * FROM p WHERE day >= DATE '2024-01-16'),
  u AS (SELECT (SELECT sum(CASE WHEN x.p > z.p THEN 1 WHEN x.p = z.p THEN 0.5 ELSE 0 END) / count(*) FROM (SELECT p FROM a WHERE y = 1) x, (SELECT p FROM a WHERE y = 0) z) - (SELECT sum(CASE WHEN x.p > z.p THEN 1 WHEN x.p = z.p THEN 0.5 ELSE 0 END) / count(*) FROM (SELECT p FROM b WHERE y = 1) x, (SELECT p FROM b WHERE y = 0) z) AS v)
  SELECT 'features_drifted' AS "check", (sum((c - q) * ln(c / q)) > 0.25)::INT::DOUBLE AS value, 'OK' AS severity, FALSE AS retrain FROM (SELECT greatest(coalesce(sum(r), 0) / (SELECT count(*) FROM a), 0.001) AS q,
  greatest(coalesce(sum(k), 0) / (SELECT count(*) FROM b), 0.001) AS c FROM range(10) g(i) LEFT JOIN (SELECT len(list_filter((SELECT quantile_cont(a.p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) FROM a), lambda e: e <= x.p)) AS bin,
  (x.day < DATE '2024-01-16')::INT AS r, (x.day >= DATE '2024-01-16')::INT AS k FROM p x) ON bin = i GROUP BY i) UNION ALL
  SELECT 'prediction_shift', round(abs((SELECT avg(p) FROM b) - (SELECT avg(p) FROM a)) / (SELECT stddev_samp(p) FROM a), 6) AS value, 'OK' AS severity, FALSE AS retrain UNION ALL
  SELECT 'auc_drop', round(v, 6), CASE WHEN v > 0.05 THEN 'HIGH' ELSE 'OK' END, FALSE FROM u""")
def daily_monitor(t):
    p = predictions(t)
    cut = F.lit("2024-01-16").cast("date")
    m = dr.daily_monitor(p.where(F.col("day") < cut), p.where(F.col("day") >= cut), ["p"], "y", "p")
    return m.withColumn("value", F.round("value", 6))


@plan("S07", """WITH m AS (SELECT 'error_rate' AS metric, ts::DATE AS d, avg((event_type = 'error')::INT) AS value FROM events GROUP BY 2) SELECT strftime(d, '%Y-%m-%d') AS day, round(value, 6) AS value,
  CASE WHEN value > 0.1 THEN 'CRITICAL' WHEN value > 0.05 THEN 'HIGH' ELSE 'WARNING' END AS severity FROM m WHERE value > 0.01""")
def alert_severity(t):
    m = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("value"))
    m = m.select(F.lit("error_rate").alias("metric"), F.date_format("d", "yyyy-MM-dd").alias("day"), "value")
    a = dr.alert_severity(m, [("error_rate", 0.01, "WARNING"), ("error_rate", 0.05, "HIGH"), ("error_rate", 0.1, "CRITICAL")])
    return a.select("day", F.round("value", 6).alias("value"), "severity")


@plan("S08", f"""WITH {PRED} SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, round(avg((y = yhat)::INT), 6) AS accuracy, count(*) AS n FROM p GROUP BY ROLLUP (source, lang)""")
def monitor_by_segment(t):
    s = dr.by_segment(predictions(t), ["source", "lang"], "y", "yhat")
    return s.select("source", "lang", F.round("accuracy", 6).alias("accuracy"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))


@plan("S09", """WITH j AS (SELECT event_type, count_if(ts < TIMESTAMP '2024-01-16' AND event_type <> 'error') AS r, count_if(ts >= TIMESTAMP '2024-01-16' AND event_type <> 'signup') AS c FROM events GROUP BY 1),
  s AS (SELECT *, r / sum(r) OVER () AS sr, c / sum(c) OVER () AS sc, sum(c) OVER () AS tc FROM j) SELECT event_type, round(sr, 6) AS ref_share, round(sc, 6) AS cur_share, round(sc - sr, 6) AS change, r = 0 AS is_new, c = 0 AS is_gone, round(pow(c - sr * tc, 2) / nullif(sr * tc, 0), 4) AS chi2_part FROM s""")
def categorical_drift(t):
    ref, cur = halves(t)
    d = dr.categorical_drift(ref.where(F.col("event_type") != "error"), cur.where(F.col("event_type") != "signup"), "event_type")
    return _r(_r(d, 6, "event_type", "is_new", "is_gone", "chi2_part"), 4, "event_type", "is_new", "is_gone", "ref_share", "cur_share", "change")


V = "CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50 THEN 'A' ELSE 'B' END"


@plan("S10", f"SELECT {V} AS variant, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def ab_assign(t):
    return t.events.groupBy(dr.ab_variant(F.col("user_id")).alias("variant")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@plan("S11", f"""WITH g AS (SELECT {V} AS variant, count(*) AS n, avg((event_type = 'error')::INT) AS e, avg(value) AS v FROM events GROUP BY 1) SELECT variant, n, round(e, 6) AS error_rate, round(v, 4) AS mean_value,
  round(pow(n - sum(n) OVER () * 0.5, 2) / (sum(n) OVER () * 0.5), 4) AS ratio_chi2, e - max(CASE WHEN variant = 'A' THEN e END) OVER () > 0.05 AS kill FROM g""")
def sample_ratio_and_guardrails(t):
    e = t.events.withColumn("variant", dr.ab_variant(F.col("user_id")))
    g = dr.variant_guardrails(e, "variant", F.col("event_type") == "error", "value")
    return g.select("variant", "n", F.round("error_rate", 6).alias("error_rate"), F.round("mean_value", 4).alias("mean_value"), F.round("ratio_chi2", 4).alias("ratio_chi2"), "kill")


@plan("S12", f"""WITH {PRED}, b AS (SELECT p AS a, round(0.5 * p + 0.5 * y, 4) AS b FROM p) SELECT count(*) AS n, round(avg(((a >= 0.5) = (b >= 0.5))::INT), 6) AS agreement, round(avg(abs(a - b)), 6) AS mean_difference, count_if((a >= 0.5) <> (b >= 0.5)) AS disagreements FROM b""")
def shadow_compare(t):
    a = predictions(t)
    b = a.withColumn("p", F.round(0.5 * F.col("p") + 0.5 * F.col("y"), 4))
    return _r(dr.shadow_compare(a, b, "doc_id", "p"), 6, "n", "disagreements")


@plan("S13", "SELECT 'c_acctbal' AS feature, round(avg((c_custkey % 20 = 0)::INT), 6) AS mismatch_rate FROM customer UNION ALL SELECT 'c_nationkey', 0 FROM (SELECT 1)")
def training_serving_skew(t):
    online = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 20 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return _r(dr.serving_skew(t.customer, online, "c_custkey", ["c_acctbal", "c_nationkey"]), 6, "feature")


@plan("S14", """WITH c AS (SELECT year(l_shipdate) AS y, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT y, n, sum(n) OVER (PARTITION BY y) AS t, row_number() OVER (PARTITION BY y ORDER BY n) AS rn, count(*) OVER (PARTITION BY y) AS k FROM c)
  SELECT y, max(k) AS items, round(sum(pow(n / t, 2)), 8) AS hhi, round(2 * sum(rn * n) / (max(k) * max(t)) - (max(k) + 1) / max(k), 6) AS gini FROM r GROUP BY y""")
def feedback_loop_metrics(t):
    g = dr.exposure_concentration(t.lineitem.withColumn("y", F.year("l_shipdate")), "y", "l_partkey")
    return g.select("y", "items", F.round("hhi", 8).alias("hhi"), F.round("gini", 6).alias("gini"))


@plan("S15", """WITH e AS (SELECT vec_id % 2 AS s, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT s, i, avg(x) AS x FROM e GROUP BY ALL)
  SELECT round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS centroid_cosine FROM m a JOIN m b ON a.i = b.i AND a.s = 0 AND b.s = 1""")
def embedding_drift(t):
    return _r(dr.embedding_drift(t.embeddings.where(F.col("vec_id") % 2 == 0), t.embeddings.where(F.col("vec_id") % 2 == 1), "embedding"), 6)


@plan("S16", f"""WITH {PRED}, a AS (SELECT source, day, avg((y = yhat)::INT) AS offline, avg(yhat) AS online FROM p GROUP BY ALL), d AS (SELECT *, offline - lag(offline) OVER w AS x, online - lag(online) OVER w AS z FROM a WINDOW w AS (PARTITION BY source ORDER BY day))
  SELECT source, count(*) AS periods, round(avg(offline - online), 6) AS mean_gap, round(corr(x, z), 6) AS delta_corr FROM d GROUP BY source""")
def online_offline_gap(t):
    p = predictions(t)
    off = p.groupBy("source", "day").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("offline"))
    on = p.groupBy("source", "day").agg(F.avg("yhat").alias("online"))
    return _r(dr.online_offline_gap(off, on, ["source", "day"]), 6, "source", "periods")


