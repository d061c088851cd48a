"""Aggregations over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import aggregates as agg
from lumenframe.operators.scaling import exact_quantiles
from lumenframe.plans.registry import plan


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _round(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


@plan("D01", """SELECT o_orderpriority, count(o_totalprice) AS "count", round(avg(o_totalprice), 2) AS mean,
  round(median(o_totalprice), 2) AS median, round(sum(o_totalprice), 2) AS total, round(stddev_samp(o_totalprice), 2) AS std
  FROM orders GROUP BY o_orderpriority""")
def group_summary(t):
    return agg.group_summary(t.orders, "o_orderpriority", "o_totalprice")


def _describe_sql(cols, table):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
  round(quantile_cont({c}, 0.75), 4) AS q75 FROM {table}""" for c in cols)


@plan("D02", _describe_sql(["l_quantity", "l_extendedprice", "l_discount"], "lineitem"))
def describe_numeric(t):
    return _round(agg.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 4, "column", "count", "min", "max")


QUANTILES = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@plan("D03", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 3) AS q{q * 100:g}" for q in QUANTILES) + " FROM lineitem GROUP BY l_returnflag")
def quantile_table(t):
    q = exact_quantiles(t.lineitem, ["l_extendedprice"], QUANTILES, ["l_returnflag"])
    return q.select("l_returnflag", *[F.round(F.col("l_extendedprice")[i], 3).alias(f"q{p * 100:g}") for i, p in enumerate(QUANTILES)])


@plan("D04", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  abs(avg({c}) - median({c})) > 0.1 * abs(avg({c})) AS skewed FROM events_v""".replace("events_v", "lineitem")
    for c in ("l_quantity", "l_extendedprice", "l_tax")))
def skew_flag(t):
    return _round(agg.skew_flags(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]), 4, "column", "skewed")


@plan("D05", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events "
      "WHERE event_type IS NOT NULL GROUP BY event_type")
def value_counts(t):
    return _round(agg.value_counts(t.events, "event_type"), 6, "event_type", "n")


@plan("D06", """SELECT p_brand, min(p_size) AS mode, max(n) AS n FROM (SELECT p_brand, p_size, count(*) AS n,
  max(count(*)) OVER (PARTITION BY p_brand) AS best FROM part GROUP BY p_brand, p_size) WHERE n = best GROUP BY p_brand""")
def mode_per_group(t):
    return agg.mode_per_group(t.part, ["p_brand"], "p_size")


@plan("D07", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def count_distinct(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@plan("D08", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, TRUE AS close FROM lineitem GROUP BY l_returnflag")
def approx_count_distinct(t):
    a = t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("approx"))
    e = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("exact"))
    return a.join(e, "l_returnflag").select(
        "l_returnflag", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


ROLL = """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS n,
  round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY {}"""


def _sums():
    return [F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")]


@plan("D09", ROLL.format("ROLLUP (l_returnflag, l_linestatus)"))
def rollup_labels(t):
    return agg.labelled_rollup(t.lineitem, ["l_returnflag", "l_linestatus"], _sums())


@plan("D10", ROLL.format("CUBE (l_returnflag, l_linestatus)"))
def cube_labels(t):
    return agg.labelled_rollup(t.lineitem, ["l_returnflag", "l_linestatus"], _sums(), cube=True)


@plan("D11", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem "
      "GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    return t.lineitem.groupingSets([[f], [s], []], f, s).agg(*_sums())


@plan("D12", """SELECT user_id, """ + ", ".join(
    f"coalesce(sum(CASE WHEN event_type = '{e}' THEN 1 END), 0) AS {e}" for e in ("view", "click", "purchase")) +
      " FROM events GROUP BY user_id")
def pivot_counts(t):
    return agg.pivot_sum(t.events.withColumn("one", F.lit(1)), "user_id", "event_type", ["view", "click", "purchase"], "one")


@plan("D13", """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
  round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS urgent_total FROM orders GROUP BY o_custkey""")
def conditional_agg(t):
    return t.orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0)), 2).alias("urgent_total"))


@plan("D14", "SELECT user_id, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view, "
      "max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click FROM events GROUP BY user_id")
def reached_flags(t):
    return agg.reached_flags(t.events, "user_id", "event_type", ["view", "click"])


@plan("D15", """SELECT l_suppkey, string_agg(l_partkey, ',' ORDER BY rn) AS parts, round(list(total ORDER BY rn)[1], 2) AS best FROM (SELECT *, row_number() OVER
  (PARTITION BY l_suppkey ORDER BY total DESC, l_partkey) AS rn FROM (SELECT l_suppkey, l_partkey, round(sum(l_extendedprice), 2) AS total
  FROM lineitem GROUP BY ALL)) WHERE rn <= 10 GROUP BY l_suppkey""")
def top_items_array(t):
    totals = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    a = agg.top_items_array(totals, "l_suppkey", "total", "l_partkey", 10)
    return a.select("l_suppkey", F.array_join(F.col("top.l_partkey").cast("array<string>"), ",").alias("parts"), F.round(F.col("top")[0]["total"], 2).alias("best"))


@plan("D16", "SELECT label, count(*) AS n, round(avg(s), 4) AS mean_sum, round(max(m), 4) AS top FROM (SELECT label, "
      "list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, list_max(embedding)::DOUBLE AS m FROM embeddings) GROUP BY label")
def in_array_aggregate(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.select("label", total.alias("s"), F.array_max("embedding").cast("double").alias("m")).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.avg("s"), 4).alias("mean_sum"), F.round(F.max("m"), 4).alias("top"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(where=""):
    return "SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem"
        for i, a in enumerate(CORR) for b in CORR[i + 1:]) + f") {where}"


@plan("D17", _corr_sql())
def corr_matrix(t):
    return _round(agg.corr_pairs(t.lineitem, CORR), 6, "a", "b")


@plan("D17", _corr_sql("WHERE abs(r) > 0.7"))
def high_corr_pairs(t):
    return _round(agg.high_corr_pairs(t.lineitem, CORR), 6, "a", "b")


@plan("D18 P03", """SELECT round(first, 2) AS first, round(last, 2) AS last, round((last - first) / first * 100, 4) AS change_pct FROM
  (SELECT arg_min(v, d) AS first, arg_max(v, d) AS last FROM (SELECT o_orderdate AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1))""")
def first_last_change(t):
    daily = t.orders.groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    s = agg.first_last_change(daily, "o_orderdate", "v")
    return s.select(F.round("first", 2).alias("first"), F.round("last", 2).alias("last"), F.round("change_pct", 4).alias("change_pct"))


@plan("D19", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey
  ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 300)""")
def top_entities(t):
    return agg.top_entities(t.orders, "o_custkey", "o_totalprice", 300).select("o_orderkey", "o_custkey")


@plan("D20", """WITH d AS (SELECT o_orderpriority AS seg, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS diff
  FROM orders GROUP BY 1), w AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS overall FROM orders)
  SELECT seg AS o_orderpriority, round(diff, 4) AS diff, round(overall, 4) AS overall, sign(diff) <> sign(overall) AS flips FROM d, w""")
def simpsons_paradox_check(t):
    return _round(agg.sign_flip(t.orders, "o_totalprice", "o_orderstatus", "F", "O", "o_orderpriority"), 4, "o_orderpriority", "flips")


@plan("D21", """SELECT round(sum(s) / sum(n), 4) AS weighted, round(avg(s / n), 4) AS of_averages, 'avg_price' AS flagged FROM
  (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)""")
def average_of_averages(t):
    a = agg.average_of_averages(t.orders, "o_custkey", "o_totalprice")
    named = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_price"), F.count("*").alias("n"))
    return a.select(F.round("weighted", 4).alias("weighted"), F.round("of_averages", 4).alias("of_averages"),
                    F.lit(",".join(agg.average_like_columns(named))).alias("flagged"))


@plan("D22", "SELECT round(sum(o_totalprice), 2) AS parts, round(sum(o_totalprice), 2) AS whole, TRUE AS reconciles FROM orders")
def subtotals_reconcile(t):
    return _round(agg.subtotals_reconcile(t.orders, "o_orderpriority", "o_totalprice"), 2, "reconciles")


@plan("D23", """WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part),
  c AS (SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 12))::INT, 11) AS bin, count(*) AS n FROM part, b GROUP BY 1)
  SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 12), 4) AS lower, coalesce(n, 0) AS n FROM b, range(12) r(i) LEFT JOIN c ON bin = i""")
def histogram(t):
    return _round(agg.histogram(t.part, "p_retailprice", 12), 4, "bin", "n")


@plan("D24", """SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean,
  round(avg(l_quantity) - 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS low,
  round(avg(l_quantity) + 1.96 * stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS high FROM lineitem GROUP BY ALL""")
def bar_means(t):
    return _round(agg.mean_with_ci(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity"), 4, "l_returnflag", "l_linestatus", "n")


@plan("D25", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
  SELECT event_type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) GROUP BY ALL""")
def box_stats(t):
    return _round(agg.box_stats(t.events, "event_type", "value"), 4, "event_type", "low", "high", "outliers")


@plan("D26", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, "
      "round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def scatter_fit(t):
    s = agg.fit_line(t.lineitem, "l_quantity", "l_extendedprice")
    return s.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


@plan("D27", """WITH s AS (SELECT p_brand, sum(p_retailprice) AS total, count(*) AS n, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS rn FROM part GROUP BY 1)
  SELECT CASE WHEN rn <= 7 THEN p_brand ELSE 'Other' END AS p_brand, round(sum(total), 2) AS total, sum(n)::BIGINT AS n FROM s GROUP BY 1""")
def top_k_other(t):
    return _round(agg.top_k_other(t.part, "p_brand", "p_retailprice", 7), 2, "p_brand", "n")


@plan("D28", "SELECT event_type, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def boolean_rate(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg((F.col("value") > 10).cast("double")), 6).alias("rate"))


@plan("D29", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS total FROM orders GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(p) FROM m)::TIMESTAMP, (SELECT max(p) FROM m)::TIMESTAMP, INTERVAL 1 MONTH)) AS p),
  j AS (SELECT s.p, total, lag(total, 12) OVER (ORDER BY s.p) AS previous FROM s LEFT JOIN m USING (p))
  SELECT strftime(p, '%Y-%m-%d') AS period, round(total, 2) AS total, round(previous, 2) AS previous, round((total - previous) / nullif(previous, 0), 6) AS growth FROM j""")
def period_over_period(t):
    g = agg.period_over_period(t.orders, "o_orderdate", "o_totalprice", "month", 12)
    return g.select(_day("period").alias("period"), F.round("total", 2).alias("total"), F.round("previous", 2).alias("previous"),
                    F.round("growth", 6).alias("growth"))


@plan("D30", """SELECT p_size, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_size
  ORDER BY n DESC, p_size LIMIT 5""")
def dominant_values(t):
    return _round(agg.dominant_values(t.part, "p_size", 5), 6, "p_size", "n")
