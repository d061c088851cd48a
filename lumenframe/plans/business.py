"""Sessions, funnels, cohorts, RFM, KPIs and series over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import business as bz
from lumenframe.operators import timeseries as ts
from lumenframe.plans.registry import plan

AS_OF = "2001-08-01"
STEPS = ["view", "click", "signup", "purchase"]


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


@plan("O01", """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM g)
  SELECT user_id, session_id::BIGINT AS session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, count_if(event_type = 'purchase') AS purchases,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 3) AS seconds FROM s GROUP BY ALL""")
def sessionize(t):
    s = bz.session_stats(bz.sessionize(t.events, "user_id", "ts", tie="event_id"), "user_id", "ts",
                         [F.count_if(F.col("event_type") == "purchase").alias("purchases")])
    return s.select("user_id", "session_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", "purchases", F.round("seconds", 3).alias("seconds"))


FLAGS = "f AS (SELECT user_id, " + ", ".join(f"max((event_type = '{s}')::INT) AS {s}" for s in STEPS) + " FROM events GROUP BY user_id), c AS (SELECT " + ", ".join(f"sum({s}) AS {s}" for s in STEPS) + " FROM f)"
FUNNEL = " UNION ALL ".join(
    f"SELECT {i + 1} AS position, '{s}' AS step, {s} AS users, {'NULL' if not i else f'{s} / nullif({STEPS[i - 1]}, 0)'}::DOUBLE AS step_rate, {s} / nullif({STEPS[0]}, 0) AS overall_rate FROM c" for i, s in enumerate(STEPS))


@plan("O02", f"WITH {FLAGS} SELECT position, step, users::BIGINT AS users, round(step_rate, 6) AS step_rate, round(overall_rate, 6) AS overall_rate FROM ({FUNNEL})")
def funnel(t):
    return _r(bz.funnel(t.events, "user_id", "event_type", STEPS), 6, "position", "step", "users")


@plan("O03", f"""WITH {FLAGS}, p AS ({FUNNEL}), l AS (SELECT position, step, users::BIGINT AS users, (lag(users) OVER (ORDER BY position) - users)::BIGINT AS lost, (lag(users) OVER (ORDER BY position) - users) / lag(users) OVER (ORDER BY position) AS s FROM p)
  SELECT position, step, users, lost, round(s, 6) AS lost_share, coalesce(lost = max(lost) OVER (), FALSE) AS largest_loss, coalesce(s = max(s) OVER (), FALSE) AS largest_share FROM l""")
def funnel_dropoff(t):
    d = bz.funnel_dropoff(bz.funnel(t.events, "user_id", "event_type", STEPS))
    return d.withColumn("lost_share", F.round("lost_share", 6))


@plan("O04", """WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN a ON e.user_id = a.user_id AND e.ts > a.t WHERE event_type = 'click' GROUP BY 1),
  c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN b ON e.user_id = b.user_id AND e.ts > b.t WHERE event_type = 'signup' GROUP BY 1), d AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN c ON e.user_id = c.user_id AND e.ts > c.t WHERE event_type = 'purchase' GROUP BY 1)
  SELECT 1 AS position, 'view' AS step, count(*) AS users FROM a UNION ALL SELECT 2, 'click', count(*) FROM b UNION ALL SELECT 3, 'signup', count(*) FROM c UNION ALL SELECT 4, 'purchase', count(*) FROM d""")
def ordered_funnel(t):
    return bz.ordered_funnel(t.events, "user_id", "event_type", "ts", STEPS)


COHORT = """WITH a AS (SELECT DISTINCT o_custkey AS u, date_trunc('{p}', o_orderdate) AS p FROM orders), f AS (SELECT u, min(p) AS c FROM a GROUP BY u),
  g AS (SELECT c, date_diff('{p}', c, p)::INT AS age, count(*) AS users FROM a JOIN f USING (u) GROUP BY ALL)
  SELECT strftime(c, '%Y-%m-%d') AS cohort, age, users, round(users / first_value(users) OVER (PARTITION BY c ORDER BY age), 3) AS retention FROM g"""


@plan("O05", COHORT.format(p="month"))
def cohort_retention(t):
    return bz.cohort_retention(t.orders, "o_custkey", "o_orderdate", "M").withColumn("cohort", _day("cohort"))


@plan("O05", COHORT.format(p="quarter"))
def cohort_retention_quarterly(t):
    return bz.cohort_retention(t.orders, "o_custkey", "o_orderdate", "Q").withColumn("cohort", _day("cohort"))


@plan("O05 D12", """WITH a AS (SELECT DISTINCT user_id AS u, date_trunc('week', ts) AS p FROM events), f AS (SELECT u, min(p) AS c FROM a GROUP BY u), g AS (SELECT c, date_diff('day', c, p) // 7 AS age, count(*) AS n FROM a JOIN f USING (u) GROUP BY ALL)
  SELECT strftime(c, '%Y-%m-%d') AS cohort, max(CASE WHEN age = 0 THEN n END) AS "0", max(CASE WHEN age = 1 THEN n END) AS "1", max(CASE WHEN age = 2 THEN n END) AS "2" FROM g GROUP BY c""")
def cohort_matrix_weekly(t):
    r = bz.cohort_retention(t.events, "user_id", "ts", "W")
    return bz.cohort_matrix(r, [0, 1, 2], "users").withColumn("cohort", _day("cohort"))


def _cuts(col):
    return ", ".join(f"quantile_cont({col}, {q}) AS {col}{i}" for i, q in enumerate((0, 0.25, 0.5, 0.75, 1)))


@plan("O06", f"""WITH p AS (SELECT o_custkey, date_diff('day', max(o_orderdate)::DATE, (SELECT max(o_orderdate)::DATE FROM orders)) + 1 AS r, count(*) AS f, sum(o_totalprice) AS m FROM orders GROUP BY 1), q AS (SELECT {_cuts('r')}, {_cuts('f')}, {_cuts('m')} FROM p),
  s AS (SELECT o_custkey, r, f, m, 4 - (r > r1)::INT - (r > r2)::INT - (r > r3)::INT AS rs, 1 + (f > f1)::INT + (f > f2)::INT + (f > f3)::INT AS fs, 1 + (m > m1)::INT + (m > m2)::INT + (m > m3)::INT AS ms FROM p, q)
  SELECT o_custkey, r AS recency, f AS frequency, round(m, 2) AS monetary, rs AS recency_score, fs AS frequency_score, ms AS monetary_score, rs + fs + ms AS rfm_score FROM s""")
def rfm(t):
    return bz.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice").withColumn("monetary", F.round("monetary", 2))


@plan("O07", """WITH p AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY ALL), l AS (SELECT *, lead(m) OVER (PARTITION BY k ORDER BY m) = m + INTERVAL 1 MONTH AS kept FROM p),
  g AS (SELECT m, sum(v) AS revenue, count(*) AS customers, count(*) FILTER (WHERE kept) AS kept FROM l GROUP BY m)
  SELECT strftime(m, '%Y-%m-%d') AS month, round(revenue, 2) AS revenue, customers, round(revenue / customers, 4) AS arpu, round((revenue - lag(revenue) OVER w) / lag(revenue) OVER w, 6) AS growth,
  round(lag(kept) OVER w / lag(customers) OVER w, 6) AS retention, round(1 - lag(kept) OVER w / lag(customers) OVER w, 6) AS churn FROM g WINDOW w AS (ORDER BY m)""")
def monthly_kpis(t):
    k = bz.monthly_kpis(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    return k.select(_day("month").alias("month"), F.round("revenue", 2).alias("revenue"), "customers", F.round("arpu", 4).alias("arpu"),
                    *[F.round(c, 6).alias(c) for c in ("growth", "retention", "churn")])


@plan("O07", """WITH d AS (SELECT ts::DATE AS d, count(DISTINCT user_id) AS dau FROM events GROUP BY 1), m AS (SELECT date_trunc('month', ts) AS m, count(DISTINCT user_id) AS mau FROM events GROUP BY 1)
  SELECT strftime(m, '%Y-%m-%d') AS month, round(avg(dau), 4) AS dau, mau, round(avg(dau) / mau, 6) AS stickiness FROM d JOIN m ON date_trunc('month', d) = m GROUP BY m, mau""")
def dau_mau(t):
    return bz.dau_mau(t.events, "user_id", "ts").select(_day("month").alias("month"), F.round("dau", 4).alias("dau"), "mau", F.round("stickiness", 6).alias("stickiness"))


@plan("O07", """SELECT c_mktsegment, round(1000.0 / new, 4) AS cac, round(rev / n * 0.3 / (left_n / n), 2) AS ltv, round(rev / n * 0.3 / (left_n / n) / (1000.0 / new), 4) AS ltv_cac FROM (SELECT c_mktsegment, sum(total) AS rev, count(*) AS n,
  count_if(last < TIMESTAMP '2001-01-01') AS left_n, count_if(first >= TIMESTAMP '1996-01-01') AS new FROM (SELECT o_custkey, sum(o_totalprice) AS total, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey GROUP BY 1)""")
def unit_economics(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    g = per.join(t.customer, "c_custkey").groupBy("c_mktsegment").agg(
        F.sum("total").alias("rev"), F.count("*").alias("n"), F.count_if(F.col("last") < stamp("2001-01-01")).alias("gone"),
        F.count_if(F.col("first") >= stamp("1996-01-01")).alias("new"))
    u = bz.unit_economics(F.col("rev"), F.col("n"), 0.3, F.col("gone") / F.col("n"), F.lit(1000.0), F.col("new"))
    return g.select("c_mktsegment", F.round(u["cac"], 4).alias("cac"), F.round(u["ltv"], 2).alias("ltv"), F.round(u["ltv_cac"], 4).alias("ltv_cac"))


@plan("O08", """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT *, lag(n) OVER w AS previous, lag(m) OVER w AS pm FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY m))
  SELECT o_custkey, strftime(m, '%Y-%m-%d') AS month, previous, n FROM l WHERE pm = m - INTERVAL 1 MONTH AND previous >= 1 AND n >= 2 * previous""")
def high_growth_entities(t):
    return bz.growing_entities(t.orders, "o_custkey", "o_orderdate", 2.0, 1).withColumn("month", _day("month"))


@plan("O09", f"""WITH a AS (SELECT *, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS a FROM orders), g AS (SELECT o_custkey, sum(CASE WHEN a < 180 THEN o_totalprice ELSE 0 END) AS recent, sum(CASE WHEN a >= 180 THEN o_totalprice ELSE 0 END) AS previous FROM a WHERE a >= 0 AND a < 360 GROUP BY 1)
  SELECT o_custkey, round(recent, 2) AS recent, round(previous, 2) AS previous, round((recent - previous) / previous, 6) AS change FROM g WHERE previous <> 0 AND (recent - previous) / previous < -0.2""")
def declining_entities(t):
    d = bz.declining_entities(t.orders, "o_custkey", "o_orderdate", "o_totalprice", AS_OF, days=180)
    return d.select("o_custkey", F.round("recent", 2).alias("recent"), F.round("previous", 2).alias("previous"), F.round("change", 6).alias("change"))


@plan("O11", """WITH g AS (SELECT o_orderpriority, o_orderstatus, sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END) AS before, sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END) AS after FROM orders GROUP BY ALL)
  SELECT o_orderpriority, o_orderstatus, round(before, 2) AS before, round(after, 2) AS after, round(after - before, 2) AS change, round((after - before) / sum(after - before) OVER (), 6) AS contribution FROM g""")
def segment_drilldown(t):
    y = F.year("o_orderdate")
    d = bz.drilldown(t.orders, ["o_orderpriority", "o_orderstatus"], y == 1999, y == 2000, "o_totalprice")
    return d.select("o_orderpriority", "o_orderstatus", *[F.round(c, 2).alias(c) for c in ("before", "after", "change")], F.round("contribution", 6).alias("contribution"))


@plan("O12", """SELECT o_custkey, count(d) AS gaps, round(avg(d), 4) AS mean_days, round(stddev_samp(d), 4) AS sd_days FROM (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS d FROM orders) GROUP BY 1""")
def interarrival(t):
    return _r(bz.interarrival(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]), 4, "o_custkey", "gaps")


@plan("O13", """SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1
  HAVING strftime(min(o_orderdate), '%Y-%m') = '1995-03' AND date_diff('day', max(o_orderdate), TIMESTAMP '2001-08-01') < 200""")
def new_active_cohort(t):
    c = bz.new_and_active(t.orders, "o_custkey", "o_orderdate", "1995-03", AS_OF, 200)
    return c.select("o_custkey", _day("first").alias("first"), _day("last").alias("last"))


@plan("O14", """SELECT c_custkey AS k, count(m) AS active_periods, coalesce(max(m) - min(m) + 1 - count(m), 0) AS empty_periods, count(m) = 0 AS no_rows FROM customer LEFT JOIN
  (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders) ON o_custkey = c_custkey GROUP BY 1""")
def boundary_report(t):
    return bz.boundary_report(t.orders.withColumnRenamed("o_custkey", "k"), "k", "o_orderdate", "month", t.customer.select(F.col("c_custkey").alias("k")))


@plan("O15", """WITH l AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events), c AS (SELECT event_type, next_state, count(*) AS n FROM l WHERE next_state IS NOT NULL GROUP BY ALL)
  SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM c""")
def transition_matrix(t):
    return _r(bz.transition_matrix(t.events, "user_id", ["ts", "event_id"], "event_type"), 6, "event_type", "next_state", "n")


SERIES = "SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1"


@plan("P01", f"""SELECT strftime(d, '%Y-%m-%d') AS day, CASE WHEN count(*) OVER w = 7 THEN round(avg(v) OVER w, 4) END AS odd, CASE WHEN count(*) OVER e = 4 THEN round(avg(v) OVER e, 4) END AS even FROM ({SERIES})
  WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), e AS (ORDER BY d ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def centered_moving_average(t):
    s = ts.daily_series(t.orders, "o_orderdate", "o_totalprice")
    a = ts.centered_average(s, "day", "v", 7).withColumnRenamed("moving_average", "odd")
    b = ts.centered_average(a, "day", "v", 4)
    return b.select(_day("day").alias("day"), F.round("odd", 4).alias("odd"), F.round("moving_average", 4).alias("even"))


@plan("P02", f"SELECT strftime(d, '%Y-%m-%d') AS day, round((v - lag(v, 7) OVER (ORDER BY d)) / lag(v, 7) OVER (ORDER BY d) * 100, 4) AS pct FROM ({SERIES})")
def pct_change(t):
    s = ts.pct_change(ts.daily_series(t.orders, "o_orderdate", "o_totalprice"), "day", "v", 7)
    return s.select(_day("day").alias("day"), F.round("pct_change", 4).alias("pct"))


@plan("P04", f"""WITH s AS (SELECT *, (row_number() OVER (ORDER BY d) - 1) % 7 AS phase, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS trend FROM ({SERIES}) WINDOW w AS (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  p AS (SELECT phase, avg(v - trend) AS s FROM s GROUP BY 1), c AS (SELECT phase, s - avg(s) OVER () AS seasonal FROM p)
  SELECT strftime(d, '%Y-%m-%d') AS day, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS resid FROM s JOIN c USING (phase)""")
def seasonal_decompose(t):
    s = ts.seasonal_decompose(ts.daily_series(t.orders, "o_orderdate", "o_totalprice"), "day", "v", 7)
    return s.select(_day("day").alias("day"), *[F.round(c, 3).alias(c) for c in ("trend", "seasonal", "resid")])


@plan("P04", f"""WITH s AS (SELECT *, (row_number() OVER (ORDER BY d) - 1) % 12 AS phase, CASE WHEN count(*) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN (sum(v) OVER (ORDER BY d ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(v, 6) OVER (ORDER BY d) + lead(v, 6) OVER (ORDER BY d)) / 2) / 12 END AS trend
  FROM (SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)) SELECT strftime(d, '%Y-%m-%d') AS day, round(trend, 3) AS trend FROM s""")
def seasonal_decompose_even(t):
    m = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return ts.seasonal_decompose(m, "day", "v", 12).select(_day("day").alias("day"), F.round("trend", 3).alias("trend"))


@plan("P05", f"""WITH s AS ({SERIES}), e AS (SELECT max(d) AS e, arg_max(v, d) AS v, regr_slope(v, date_diff('day', DATE '1970-01-01', d)) AS b, regr_intercept(v, date_diff('day', DATE '1970-01-01', d)) AS a FROM s),
  l AS (SELECT v, row_number() OVER (ORDER BY d DESC) AS back FROM s), h AS (SELECT i::INT AS step, (e + i::INT)::DATE AS day FROM e, range(1, 8) r(i))
  SELECT step, strftime(day, '%Y-%m-%d') AS day, 'naive' AS method, round(v, 2) AS forecast FROM h, e UNION ALL
  SELECT step, strftime(day, '%Y-%m-%d'), 'linear_trend', round(a + b * date_diff('day', DATE '1970-01-01', day), 2) FROM h, e UNION ALL
  SELECT step, strftime(day, '%Y-%m-%d'), 'seasonal_naive', round(v, 2) FROM h JOIN l ON back = 8 - step UNION ALL
  SELECT step, strftime(day, '%Y-%m-%d'), 'moving_average', round((SELECT avg(v) FROM l WHERE back <= 28), 2) FROM h""")
def forecast(t):
    f = ts.forecast(ts.daily_series(t.orders, "o_orderdate", "o_totalprice"), "day", "v", 7, 7, 28)
    return f.select("step", _day("day").alias("day"), "method", F.round("forecast", 2).alias("forecast"))


@plan("P07", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT strftime(a.m, '%Y-%m-%d') AS month, round(a.v, 2) AS total, round(b.v, 2) AS last_year, round((a.v - b.v) / b.v, 6) AS yoy,
  round(a.v / avg(a.v) OVER (PARTITION BY month(a.m)), 6) AS vs_season FROM m a LEFT JOIN m b ON a.m = b.m + INTERVAL 1 YEAR""")
def year_over_year(t):
    y = ts.year_over_year(t.orders, "o_orderdate", "o_totalprice")
    return y.select(_day("month").alias("month"), F.round("total", 2).alias("total"), F.round("last_year", 2).alias("last_year"), F.round("yoy", 6).alias("yoy"), F.round("vs_season", 6).alias("vs_season"))


@plan("P08", f"SELECT strftime(d, '%Y-%m-%d') AS day, round(lag(v, 1) OVER (ORDER BY d), 2) AS lag_1, round(lag(v, 30) OVER (ORDER BY d), 2) AS lag_30, round(lag(v, 365) OVER (ORDER BY d), 2) AS lag_365 FROM ({SERIES})")
def lag_features(t):
    s = ts.lag_features(ts.daily_series(t.orders, "o_orderdate", "o_totalprice"), "day", "v", [1, 30, 365])
    return s.select(_day("day").alias("day"), *[F.round(c, 2).alias(c) for c in ("lag_1", "lag_30", "lag_365")])


@plan("P09", "SELECT o_custkey, round(regr_slope(o_totalprice, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)), 5) AS slope FROM orders GROUP BY 1")
def per_entity_trend(t):
    return ts.entity_trend(t.orders, "o_custkey", "o_orderdate", "o_totalprice").select("o_custkey", F.round("slope", 5).alias("slope"))
