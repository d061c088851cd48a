"""Joins over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import joins
from lumenframe.plans.registry import plan


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@plan("C01 C07", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer JOIN nation "
      "ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join_small(t):
    dim = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.join_small(t.customer, dim, "c_nationkey").groupBy("n_name").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))


@plan("C01", """SELECT o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def inner_join_facts(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return o.join(t.lineitem, "l_orderkey").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@plan("C02", "SELECT c_custkey, n, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, "
      "round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def left_join_stats(t):
    s = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return t.customer.select("c_custkey").join(s, "c_custkey", "left")


@plan("C03", "SELECT s_suppkey, c.n FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 "
      "GROUP BY c_nationkey) c RIGHT JOIN supplier ON c_nationkey = s_nationkey")
def right_join_counts(t):
    c = t.customer.where(F.col("c_acctbal") > 5000).groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.count("*").alias("n"))
    return c.join(t.supplier, "s_nationkey", "right").select("s_suppkey", "n")


@plan("C04", """SELECT k, round(a, 2) AS spent, b AS events_n FROM (SELECT o_custkey AS k, sum(o_totalprice) AS a FROM orders GROUP BY 1)
  FULL JOIN (SELECT user_id AS k, count(*) AS b FROM events GROUP BY 1) USING (k)""")
def full_outer_join(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    b = t.events.groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("events_n"))
    return a.join(b, "k", "full")


@plan("C05", """SELECT s_suppkey, strftime(d, '%Y-%m-%d') AS day FROM supplier, generate_series(TIMESTAMP '2001-07-01',
  TIMESTAMP '2001-07-31', INTERVAL 1 DAY) g(d)""")
def entity_date_spine(t):
    return joins.with_date_spine(t.supplier.select("s_suppkey"), "2001-07-01", "2001-07-31").select(
        "s_suppkey", _day("day").alias("day"))


@plan("C06", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def left_anti_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@plan("C08 O10", """WITH d AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem),
  s AS (SELECT i, count(*) AS support FROM d GROUP BY i),
  p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM d x JOIN d y ON x.b = y.b AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT item_a, item_b, n, a.support AS support_a, c.support AS support_b FROM p JOIN s a ON a.i = item_a JOIN s c ON c.i = item_b
  ORDER BY n DESC, item_a, item_b LIMIT 100""")
def product_affinity(t):
    return joins.co_purchase(t.lineitem, "l_orderkey", "l_partkey", min_support=2, top=100)


SNAPSHOTS = ["1997-12-31", "1998-12-31", "1999-12-31", "2000-12-31", "2001-12-31"]


@plan("C09", f"""SELECT k AS o_custkey, strftime(d, '%Y-%m-%d') AS snapshot, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total
  FROM (SELECT DISTINCT o_custkey AS k FROM orders), (SELECT unnest({SNAPSHOTS})::DATE AS d) LEFT JOIN orders
  ON o_custkey = k AND o_orderdate::DATE <= d GROUP BY ALL""")
def snapshot_totals(t):
    s = joins.accumulate_to_snapshots(t.orders, "o_custkey", "o_orderdate", "o_totalprice", SNAPSHOTS)
    return s.select("o_custkey", _day("snapshot").alias("snapshot"), "n", F.round("total", 2).alias("total"))


@plan("C10", """SELECT tag, count(*) AS parts, round(sum(rev), 2) AS revenue FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS tag, p_partkey FROM part)
  JOIN (SELECT l_partkey, sum(l_extendedprice) AS rev FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey GROUP BY tag""")
def aggregate_before_join(t):
    tags = t.part.select(F.col("p_partkey").alias("l_partkey"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    rev = t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("rev"))
    return tags.join(rev, "l_partkey").groupBy("tag").agg(F.count("*").alias("parts"), F.round(F.sum("rev"), 2).alias("revenue"))


@plan("C11", """SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after,
  round(count(*) / (SELECT count(*) FROM orders), 4) AS factor, count(*) > (SELECT count(*) FROM orders) AS explodes
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def check_join_explosion(t):
    return joins.count_explosion(t.orders.select(F.col("o_orderkey").alias("k")),
                                 t.lineitem.select(F.col("l_orderkey").alias("k")), "k")


@plan("C12", """WITH f AS (SELECT user_id, ts AS fts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)
  SELECT e.event_id, round(f.value, 2) AS last_purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e
  ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.fts""")
def asof_last_purchase(t):
    left = t.events.where(F.col("event_type") != "purchase").select("event_id", "user_id", "ts")
    right = t.events.where(F.col("event_type") == "purchase").groupBy("user_id", F.col("ts").alias("fts")).agg(
        F.max("value").alias("value"))
    return joins.asof_join(left, right, "user_id", "ts", "fts", ["value"]).select(
        "event_id", F.round("value", 2).alias("last_purchase"))


@plan("C13", """WITH m AS (SELECT conv_id, turn, text, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM conversations)
  SELECT conv_id, chapter, 0 AS part, count(*) AS n, length(string_agg(text, ' ' ORDER BY turn)) AS chars FROM m GROUP BY conv_id, chapter""")
def interval_join(t):
    turns = t.conversations.select("conv_id", "turn", "text")
    marks = t.conversations.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("start"), F.col("turn").alias("chapter"))
    placed = joins.into_intervals(turns, marks, "conv_id", "turn", "start", "chapter")
    text = joins.ordered_concat(placed, ["conv_id", "chapter"], ["turn"], "text")
    n = placed.groupBy("conv_id", "chapter").agg(F.count("*").alias("n"))
    on = text["conv_id"].eqNullSafe(n["conv_id"]) & text["chapter"].eqNullSafe(n["chapter"])
    return text.join(n, on).select(text["conv_id"], text["chapter"], "part", "n", F.length("text").alias("chars"))


@plan("C14", "SELECT user_id, count(*) AS n_rows FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY user_id")
def relationship_check(t):
    return joins.orphan_keys(t.events, "user_id", t.supplier, "s_suppkey")


@plan("C15 K27", """SELECT count(*) AS expected, count(k) AS covered, round(count(k) / count(*), 4) AS share, count(k) / count(*) >= 0.95 AS passed
  FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') ON k = c_custkey""")
def coverage_join(t):
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
    return joins.coverage(t.customer.select(F.col("c_custkey").alias("k")), recent.select(F.col("o_custkey").alias("k")), "k")


@plan("C16 M16", """SELECT p_partkey, round(avg(p_retailprice) OVER w, 4) AS m, round(stddev_samp(p_retailprice) OVER w, 4) AS sd,
  min(p_retailprice) OVER w AS lo, max(p_retailprice) OVER w AS hi, round(p_retailprice - avg(p_retailprice) OVER w, 4) AS dev
  FROM part WINDOW w AS (PARTITION BY p_brand)""")
def merge_back_group_stats(t):
    m = joins.merge_group_stats(t.part, "p_brand", "p_retailprice")
    c = "p_brand_p_retailprice_"
    return m.select("p_partkey", F.round(c + "mean", 4).alias("m"), F.round(c + "std", 4).alias("sd"),
                    F.col(c + "min").alias("lo"), F.col(c + "max").alias("hi"),
                    F.round("p_retailprice_dev_from_p_brand", 4).alias("dev"))


@plan("C17", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def lambda_merge(t):
    cut = F.lit("2024-01-30").cast("timestamp_ntz")

    def view(df):
        return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    merged = joins.merge_views(view(t.events.where(F.col("ts") < cut)), view(t.events.where(F.col("ts") >= cut)),
                               ["event_type"], ["n", "total"])
    return merged.select("event_type", "n", F.round("total", 2).alias("total"))
