"""Statistical tests over the given tables."""

from pyspark.sql import functions as F

from lumenframe.functions import scalars as fn
from lumenframe.operators import statistics as st
from lumenframe.plans.registry import plan


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def user_outcomes(t):
    """One row per user: variant by md5 bucket, converted, revenue, number of events."""
    e = t.events.groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("int")).alias("converted"),
                                        F.sum("value").alias("revenue"), F.count("*").alias("n_events"),
                                        F.count_if(F.col("event_type") == "click").alias("clicks"))
    return e.withColumn("variant", F.when(fn.md5_bucket(F.col("user_id"), 100) < 50, "A").otherwise("B"))


USERS = """u AS (SELECT user_id, max((event_type = 'purchase')::INT) AS converted, sum(value) AS revenue, count(*) AS n_events, count_if(event_type = 'click') AS clicks,
  CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50 THEN 'A' ELSE 'B' END AS variant FROM events GROUP BY user_id)"""
LINE_M = """(SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m1,
  avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS v2 FROM lineitem)"""


@plan("N01", """WITH b AS (SELECT avg((l_quantity > 25)::INT) FILTER (WHERE l_returnflag = 'A') AS p1, avg((l_quantity > 25)::INT) FILTER (WHERE l_returnflag = 'R') AS p2,
  count(*) FILTER (WHERE l_returnflag = 'A') AS n1, count(*) FILTER (WHERE l_returnflag = 'R') AS n2, avg((l_quantity > 25)::INT) FILTER (WHERE l_returnflag IN ('A', 'R')) AS p FROM lineitem)
  SELECT round(p1, 6) AS p1, round(p2, 6) AS p2, round((p2 - p1) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)), 6) AS z FROM b""")
def z_test_proportions(t):
    d = t.lineitem.withColumn("big", (F.col("l_quantity") > 25).cast("int"))
    return _r(st.z_test_proportions(d, "l_returnflag", "big", "A", "R").drop("p_value"), 6)


@plan("N02", f"""SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, (n1 + n2 - 2)::DOUBLE AS dof FROM {LINE_M}""")
def t_test_independent(t):
    return _r(st.t_test(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R").drop("p_value"), 6)


@plan("N02", f"""SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 3) AS dof FROM {LINE_M}""")
def welch_test(t):
    r = st.t_test(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R", welch=True)
    return r.select(F.round("t", 6).alias("t"), F.round("dof", 3).alias("dof"))


@plan("N03", "SELECT round(avg(d), 6) AS mean_diff, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, (count(*) - 1)::DOUBLE AS dof FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def t_test_paired(t):
    return _r(st.t_test_paired(t.lineitem, F.col("l_discount"), F.col("l_tax")).drop("p_value"), 6)


@plan("N04", """WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')),
  r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM d)
  SELECT round(sum(r) - count(*) * (count(*) + 1) / 2.0, 1)::DOUBLE AS u, count(*)::DOUBLE AS n1 FROM r WHERE g = 'A'""")
def mann_whitney_u(t):
    return _r(st.mann_whitney(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R").select("u", "n1"), 1)


@plan("N05", """WITH g AS (SELECT count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), a AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm FROM g)
  SELECT round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f, (count(*) - 1)::DOUBLE AS d1, (sum(n) - count(*))::DOUBLE AS d2 FROM a""")
def anova_oneway(t):
    return _r(st.anova(t.lineitem, "l_returnflag", "l_quantity").drop("p_value"), 6)


@plan("N06", """WITH o AS (SELECT event_type AS a, hour(ts) // 6 AS b, count(*) AS o FROM events GROUP BY ALL), c AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM o)
  SELECT round(sum(pow(o - e, 2) / e), 6) AS chi2, 12.0::DOUBLE AS dof FROM c""")
def chi_square_test(t):
    d = t.events.select("event_type", F.floor(F.hour("ts") / 6).alias("q"))
    return _r(st.chi_square(d, "event_type", "q").drop("p_value"), 6)


@plan("N07", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
  SELECT round(corr(a, b), 6) AS rho, (SELECT round(corr(l_quantity, l_extendedprice), 6) FROM lineitem) AS r FROM r""")
def spearman_pearson(t):
    rho = st.spearman(t.lineitem, "l_quantity", "l_extendedprice").first()["rho"]
    r = st.pearson(t.lineitem, "l_quantity", "l_extendedprice")
    return r.select(F.round(F.lit(rho), 6).alias("rho"), F.round("r", 6).alias("r"))


@plan("N07", """WITH c AS (SELECT quality AS x, toxic AS y, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), p AS (SELECT sum(CASE WHEN a.x < b.x AND a.y < b.y THEN a.n * b.n END) AS conc, sum(CASE WHEN a.x < b.x AND a.y > b.y THEN a.n * b.n END) AS disc FROM c a, c b),
  t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0 FROM c), tx AS (SELECT sum(s * (s - 1) / 2) AS t FROM (SELECT sum(n) AS s FROM c GROUP BY x)), ty AS (SELECT sum(s * (s - 1) / 2) AS t FROM (SELECT sum(n) AS s FROM c GROUP BY y))
  SELECT round((conc - disc) / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS tau_b, conc AS concordant, disc AS discordant FROM p, t, tx, ty""")
def kendall_tau(t):
    return _r(st.kendall_tau_b(t.labels, "quality", "toxic"), 6)


@plan("N07", """WITH c AS (SELECT l_quantity AS x, l_extendedprice AS y, count(*) AS n FROM lineitem GROUP BY ALL), l AS (SELECT DISTINCT x FROM c), v AS (SELECT DISTINCT y FROM c),
  g AS (SELECT l.x, v.y, sum(coalesce(n, 0)) OVER (PARTITION BY l.x ORDER BY v.y DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l CROSS JOIN v LEFT JOIN c ON c.x = l.x AND c.y = v.y),
  k AS (SELECT y, x, sum(coalesce(above, 0)) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worse FROM g),
  d AS (SELECT sum(n * coalesce(worse, 0))::DOUBLE AS disc FROM c JOIN k USING (x, y)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS n0, sum(n * (n - 1)) / 2 AS txy FROM c),
  tx AS (SELECT sum(s * (s - 1) / 2) AS t FROM (SELECT sum(n) AS s FROM c GROUP BY x)), ty AS (SELECT sum(s * (s - 1) / 2) AS t FROM (SELECT sum(n) AS s FROM c GROUP BY y)),
  r AS (SELECT n0, tx.t AS tx, ty.t AS ty, (n0 - tx.t - ty.t + txy - disc)::DOUBLE AS conc, disc FROM d, t, tx, ty)
  SELECT round((conc - disc) / (sqrt(n0 - tx) * sqrt(n0 - ty)), 6) AS tau_b, conc AS concordant, disc AS discordant FROM r""")
def kendall_tau_prices(t):
    """Two columns of very many levels."""
    return _r(st.kendall_tau_b(t.lineitem, "l_quantity", "l_extendedprice"), 6)


@plan("N08", """WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS m FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1), c AS (SELECT g, n, avg(pow(l_quantity - m, 2)) AS m2, avg(pow(l_quantity - m, 3)) AS m3, avg(pow(l_quantity - m, 4)) AS m4
  FROM lineitem JOIN m ON g = l_returnflag GROUP BY g, n) SELECT g AS sample, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4), 4) AS jb FROM c""")
def normality_test(t):
    return st.normality(t.lineitem, "l_returnflag", "l_quantity", "A", "R").select("sample", F.round("jb", 4).alias("jb"))


@plan("N09", """WITH d AS (SELECT l_returnflag AS g, abs(l_quantity - median(l_quantity) OVER (PARTITION BY l_returnflag)) AS z FROM lineitem), s AS (SELECT count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM d GROUP BY g),
  a AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS gm FROM s) SELECT round((sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f FROM a""")
def levene_test(t):
    return _r(st.levene(t.lineitem, "l_returnflag", "l_quantity").select("f"), 6)


@plan("N10")
def auto_test(t):
    return st.auto_test(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R")


@plan("N11 N12", f"""SELECT round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS d, CASE WHEN abs((m1 - m2) / sqrt((v1 + v2) / 2)) < 0.2 THEN 'Negligible' ELSE 'Larger' END AS effect,
  round(m1 - m2 - 1.96 * sqrt(v1 / n1 + v2 / n2), 4) AS low, round(m1 - m2 + 1.96 * sqrt(v1 / n1 + v2 / n2), 4) AS high FROM {LINE_M}""")
def effect_size_and_interval(t):
    args = (t.lineitem, "l_returnflag", "l_extendedprice", "A", "R")
    d, ci = st.cohens_d(*args), st.ci_diff_means(*args).first()
    return d.select(F.round("d", 6).alias("d"), "effect", F.round(F.lit(ci["low"]), 4).alias("low"), F.round(F.lit(ci["high"]), 4).alias("high"))


@plan("N13", f"""WITH {USERS}, m AS (SELECT avg(revenue) FILTER (WHERE variant = 'A') AS a, avg(revenue) FILTER (WHERE variant = 'B') AS b, count(*) FILTER (WHERE variant = 'A') AS na, count(*) FILTER (WHERE variant = 'B') AS nb,
  var_samp(revenue) FILTER (WHERE variant = 'A') AS va, var_samp(revenue) FILTER (WHERE variant = 'B') AS vb FROM u) SELECT 'revenue' AS metric, round(a, 4) AS control, round(b, 4) AS treatment, na::DOUBLE AS n_control, nb::DOUBLE AS n_treatment,
  round((b - a) / a * 100, 4) AS lift, round(b - a - 1.96 * sqrt(va / na + vb / nb), 4) AS low, round(b - a + 1.96 * sqrt(va / na + vb / nb), 4) AS high FROM m""")
def ab_test_revenue(t):
    return _r(st.ab_test(user_outcomes(t), "variant", "revenue", "A", "B", conversion=False).drop("p_value", "significant"), 4, "metric")


@plan("N14", f"""WITH {USERS}, l AS (SELECT variant, metric, v FROM (SELECT variant, revenue::DOUBLE AS revenue, n_events::DOUBLE AS n_events, clicks::DOUBLE AS clicks FROM u) UNPIVOT (v FOR metric IN (revenue, n_events, clicks))),
  m AS (SELECT metric, avg(v) FILTER (WHERE variant = 'A') AS a, avg(v) FILTER (WHERE variant = 'B') AS b, count(*) FILTER (WHERE variant = 'A') AS na, count(*) FILTER (WHERE variant = 'B') AS nb, var_samp(v) FILTER (WHERE variant = 'A') AS va,
  var_samp(v) FILTER (WHERE variant = 'B') AS vb FROM l GROUP BY metric) SELECT metric, round(b - a, 5) AS diff, round((b - a) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 5) AS t FROM m""")
def ab_multi_metrics(t):
    return _r(st.ab_multi(user_outcomes(t), "variant", ["revenue", "n_events", "clicks"], "A", "B").select("metric", "diff", "t"), 5, "metric")


@plan("N15", f"""WITH {USERS}, b AS (SELECT avg((clicks > 12)::INT) AS p FROM u) SELECT variant, count(*) AS n, ceil(pow(1.959963984540054 + 0.8416212335729143, 2) * (p * (1 - p) + (p + 0.05) * (0.95 - p)) / 0.0025)::INT AS needed,
  count(*) >= ceil(pow(1.959963984540054 + 0.8416212335729143, 2) * (p * (1 - p) + (p + 0.05) * (0.95 - p)) / 0.0025) AS enough FROM u, b GROUP BY variant, p""")
def sample_size_adequacy(t):
    u = user_outcomes(t).withColumn("heavy", (F.col("clicks") > 12).cast("int"))
    return st.sample_adequacy(u, "variant", "heavy", 0.05)


@plan("N16")
def bootstrap_interval(t):
    return st.bootstrap_ci(t.events, "value", ["event_type"], rounds=200, seed=1)


@plan("N16")
def paired_bootstrap(t):
    return st.paired_bootstrap(t.lineitem, "l_discount", "l_tax", rounds=200, seed=1)


KS = """WITH d AS (SELECT l_extendedprice AS v, (l_shipdate < TIMESTAMP '1998-06-01')::INT AS r FROM lineitem), c AS (SELECT v, sum(r) AS r, sum(1 - r) AS c FROM d GROUP BY v),
  s AS (SELECT sum(r) OVER (ORDER BY v) / sum(r) OVER () AS a, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS b FROM c) SELECT 'l_extendedprice' AS feature, round(max(abs(a - b)), 6) AS ks FROM s"""


@plan("N17", KS)
def ks_two_samples(t):
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    r = st.ks_distance(t.lineitem.where(F.col("l_shipdate") < cut), t.lineitem.where(F.col("l_shipdate") >= cut), ["l_extendedprice"])
    return r.select("feature", F.round("ks", 6).alias("ks"))


@plan("N18", """WITH r AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-16'), c AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-16'), e AS (SELECT quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM r),
  b AS (SELECT len(list_filter(q, lambda x: x <= value)) AS bin, 1 AS r, 0 AS c FROM r, e UNION ALL SELECT len(list_filter(q, lambda x: x <= value)), 0, 1 FROM c, e),
  p AS (SELECT i, greatest(coalesce(sum(r), 0) / (SELECT count(*) FROM r), 0.001) AS p, greatest(coalesce(sum(c), 0) / (SELECT count(*) FROM c), 0.001) AS c FROM range(10) g(i) LEFT JOIN b ON bin = i GROUP BY i)
  SELECT 'value' AS feature, round(sum((c - p) * ln(c / p)), 4) AS psi FROM p""")
def population_stability(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return st.psi(t.events.where(F.col("ts") < cut), t.events.where(F.col("ts") >= cut), ["value"])


@plan("N19", """WITH a AS (SELECT event_type, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') / (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS p, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') / (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-16') AS q FROM events GROUP BY 1)
  SELECT round(-sum(p * ln(p)), 8) AS entropy, round(-sum(p * ln(q)), 8) AS cross_entropy, round(sum(p * ln(p / q)), 8) AS kl FROM a""")
def entropy_and_kl(t):
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    c = t.events.groupBy("event_type").agg(F.count_if(cut).alias("a"), F.count_if(~cut).alias("b"))
    tot = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).first()
    return _r(st.distribution_entropy(c.select((F.col("a") / tot["ta"]).alias("p"), (F.col("b") / tot["tb"]).alias("q")), "p", "q"), 8)


@plan("N20", """WITH c AS (SELECT quality, count(*) AS n, count_if(toxic = 0) AS l, count_if(toxic <> 0) AS r FROM labels GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS pn, l / sum(l) OVER () AS pl, r / sum(r) OVER () AS pr, sum(l) OVER () / sum(n) OVER () AS w FROM c)
  SELECT round(1 - sum(pn * pn), 8) AS gini, round(max(w) * (1 - sum(pl * pl)) + (1 - max(w)) * (1 - sum(pr * pr)), 8) AS gini_split,
  round(-sum(pn * log2(pn)) + max(w) * sum(CASE WHEN pl > 0 THEN pl * log2(pl) ELSE 0 END) + (1 - max(w)) * sum(CASE WHEN pr > 0 THEN pr * log2(pr) ELSE 0 END), 8) AS information_gain FROM s""")
def gini_information_gain(t):
    return _r(st.split_gain(t.labels, "quality", F.col("toxic") == 0), 8)


@plan("N21", """SELECT o_orderpriority, n, round(p, 6) AS rate, round(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS low, round(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS high FROM
  (SELECT o_orderpriority, count(*) AS n, avg((o_totalprice > 200000)::INT) AS p FROM orders GROUP BY 1)""")
def segment_intervals(t):
    return _r(st.segment_intervals(t.orders, "o_orderpriority", F.col("o_totalprice") > 200000), 6, "o_orderpriority", "n")
