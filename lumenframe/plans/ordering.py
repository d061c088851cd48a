"""Window functions, sorting, sampling and splits over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import sampling as smp
from lumenframe.operators import windows as win
from lumenframe.operators.scaling import neighbours, ranked, running, top_per_group, with_totals
from lumenframe.plans.registry import plan


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@plan("E01", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
  rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate)) AS dr FROM orders""")
def rank_functions(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    a = ranked(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"rn": "row_number"})
    return ranked(a, ["o_custkey"], ["y"], {"rk": "rank", "dr": "dense_rank"}).select("o_orderkey", "rn", "rk", "dr")


@plan("E02", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(t):
    return win.latest_per_key(t.orders, ["o_custkey"], ["-o_orderdate", "-o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@plan("E03", """SELECT o_orderkey, lag(o_totalprice) OVER w AS prev_o_totalprice, lead(o_totalprice) OVER w AS next_o_totalprice,
  date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead(t):
    o = ["o_orderdate", "o_orderkey"]
    a = win.lag_lead(t.orders, ["o_custkey"], o, "o_totalprice")
    return neighbours(a, ["o_custkey"], o, {"days": lambda w: F.datediff("o_orderdate", F.lag("o_orderdate").over(w))}, 1).select(
        "o_orderkey", "prev_o_totalprice", "next_o_totalprice", "days")


@plan("E04", """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_sum_count(t):
    return running(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                   {"total": ("sum", "o_totalprice"), "n": ("count", F.lit(1))}).select(
        "o_orderkey", F.round("total", 2).alias("total"), "n")


@plan("E05", """SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS mean3, max(o_totalprice) OVER w AS max3 FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING)""")
def rolling_rows(t):
    return win.rolling_rows(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3,
                            {"mean3": F.avg("o_totalprice"), "max3": F.max("o_totalprice")}).select(
        "o_orderkey", F.round("mean3", 4).alias("mean3"), "max3")


@plan("E06", """SELECT event_id, count(*) OVER w AS h24_n, round(sum(value) OVER w, 2) AS h24_sum FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""")
def range_frame(t):
    return win.range_counts(t.events, ["user_id"], "ts", 86400, "value", "h24").select(
        "event_id", "h24_n", F.round("h24_sum", 2).alias("h24_sum"))


@plan("E07", """SELECT o_orderkey, first_value(o_totalprice) OVER w AS first, last_value(o_totalprice) OVER w AS last, nth_value(o_totalprice, 2) OVER w AS nth
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def first_last_nth(t):
    return win.first_last_nth(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 2).select(
        "o_orderkey", "first", "last", "nth")


@plan("E08", """SELECT p_partkey, round(percent_rank() OVER w, 6) AS pct_rank, round(cume_dist() OVER w, 6) AS cume, ntile(10) OVER w AS decile
  FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)""")
def ntile_percent_rank(t):
    return win.rank_columns(t.part, ["p_type"], ["p_retailprice", "p_partkey"]).select(
        "p_partkey", F.round("pct_rank", 6).alias("pct_rank"), F.round("cume", 6).alias("cume"), "decile")


@plan("E09", "SELECT p_partkey, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand), 4) AS above FROM part")
def partition_avg_compare(t):
    return with_totals(t.part, ["p_brand"], [F.avg("p_retailprice").alias("m")]).select(
        "p_partkey", F.round(F.col("p_retailprice") - F.col("m"), 4).alias("above"))


DAILY = "SELECT o_orderdate AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1"


@plan("E10 P06", f"""SELECT strftime(d, '%Y-%m-%d') AS day, round(avg(v) OVER (ORDER BY d ROWS 6 PRECEDING) / avg(v) OVER (ORDER BY d ROWS 29 PRECEDING), 6) AS momentum
  FROM ({DAILY})""")
def ratio_of_windows(t):
    daily = t.orders.groupBy(F.col("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return win.ratio_of_frames(daily, [], ["d"], "v", 7, 30).select(_day("d").alias("day"), F.round("momentum", 6).alias("momentum"))


@plan("E11", """SELECT a.event_id, count(DISTINCT b.event_type) AS kinds FROM events a JOIN events b ON a.user_id = b.user_id
  AND b.ts BETWEEN a.ts - INTERVAL 24 HOUR AND a.ts GROUP BY a.event_id""")
def distinct_in_window(t):
    return win.distinct_trailing(t.events, ["user_id"], "ts", 86400, "event_type", "kinds").select("event_id", "kinds")


@plan("E12", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
  SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS length FROM a GROUP BY user_id, event_type, g""")
def consecutive_runs(t):
    return win.run_lengths(t.events, ["user_id"], ["ts", "event_id"], "event_type").select(
        "user_id", "event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "length")


@plan("E13", """SELECT o_orderkey, best_before, best_before IS NULL OR o_totalprice > best_before AS keep FROM (SELECT *, max(o_totalprice) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM orders)""")
def running_best(t):
    return win.running_best(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "best_before", "keep")


@plan("F01", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def order_by_total(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@plan("F02", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_n(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@plan("F03", """SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def top_n_per_group(t):
    return top_per_group(t.customer, ["c_mktsegment"], ["-c_acctbal", "c_custkey"], 5, "rank").select("c_mktsegment", "c_custkey", "rank")


UNIT = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0"


@plan("F04", f"SELECT o_orderkey FROM orders ORDER BY {UNIT.format(chr(39) + '7:' + chr(39) + ' || o_orderkey')}, o_orderkey LIMIT 500")
def sample_n(t):
    return smp.sample_n(t.orders, "o_orderkey", 500, seed=7).select("o_orderkey")


@plan("F04", f"SELECT o_orderkey FROM orders WHERE {UNIT.format(chr(39) + '3:' + chr(39) + ' || o_orderkey')} < 0.08")
def sample_fraction(t):
    return smp.sample_fraction(t.orders, "o_orderkey", 0.08, seed=3).select("o_orderkey")


@plan("F05", f"""SELECT split, count(*) AS n FROM (SELECT CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT {UNIT.format(chr(39) + '1:' + chr(39) + ' || o_orderkey')} AS u FROM orders)) GROUP BY split""")
def random_split(t):
    return smp.random_split(t.orders, "o_orderkey", {"train": 0.7, "val": 0.15, "test": 0.15}, seed=1).groupBy("split").agg(
        F.count("*").alias("n"))


@plan("F06", """SELECT c_mktsegment, ceil(0.7 * n)::BIGINT AS train, (n - ceil(0.7 * n))::BIGINT AS test FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def stratified_split(t):
    s = smp.stratified_split(t.customer, "c_custkey", "c_mktsegment", 0.7, seed=1)
    return s.groupBy("c_mktsegment").agg(F.count_if(F.col("split") == "train").alias("train"),
                                         F.count_if(F.col("split") == "test").alias("test"))


@plan("F07", """SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first FROM orders GROUP BY 1""")
def temporal_split(t):
    return smp.temporal_split(t.orders, "o_orderdate", "2000-01-01", "2001-01-01").groupBy("split").agg(
        F.count("*").alias("n"), _day(F.min("o_orderdate")).alias("first"))


@plan("F08", f"""SELECT floor({UNIT.format(chr(39) + '5:' + chr(39) + ' || o_custkey')} * 5)::INT AS fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1""")
def group_kfold(t):
    return smp.kfold(t.orders, "o_custkey", 5, seed=5).groupBy("fold").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@plan("F08", """WITH d AS (SELECT o_orderdate, ntile(6) OVER (ORDER BY o_orderdate) AS b FROM (SELECT DISTINCT o_orderdate FROM orders))
  SELECT k::INT AS fold, count(*) FILTER (WHERE b <= k) AS train, count(*) FILTER (WHERE b = k + 1) AS test FROM orders JOIN d USING (o_orderdate), range(1, 6) r(k) GROUP BY k""")
def time_series_split(t):
    s = smp.time_series_split(t.orders, "o_orderdate", 5)
    return s.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))


@plan("F08", """SELECT c_mktsegment, count(*) AS n, 5 AS folds, TRUE AS even FROM customer GROUP BY 1""")
def stratified_kfold(t):
    s = smp.stratified_kfold(t.customer, "c_custkey", "c_mktsegment", 5, seed=2)
    per = s.groupBy("c_mktsegment", "fold").agg(F.count("*").alias("n"))
    return per.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.count("*").alias("folds"),
                                           (F.max("n") - F.min("n") <= 1).alias("even"))


@plan("F08", f"""SELECT floor({UNIT.format(chr(39) + '1:' + chr(39) + ' || c_custkey')} * 3)::INT AS outer_fold,
  floor({UNIT.format(chr(39) + '2:' + chr(39) + ' || c_custkey')} * 2)::INT AS inner_fold, count(*) AS n FROM customer GROUP BY ALL""")
def nested_kfold(t):
    return smp.nested_kfold(t.customer, "c_custkey", 3, 2, seed=1).groupBy("outer_fold", "inner_fold").agg(F.count("*").alias("n"))


@plan("F09", """SELECT quality, CASE WHEN n = m THEN n ELSE n * (m // n) END AS over_n, CASE WHEN n > 1.2 * s THEN TRUE ELSE FALSE END AS cut FROM
  (SELECT quality, count(*) AS n, max(count(*)) OVER () AS m, min(count(*)) OVER () AS s FROM labels GROUP BY quality)""")
def resample_classes(t):
    over = smp.oversample(t.labels, "quality").groupBy("quality").agg(F.count("*").alias("over_n"))
    under = smp.undersample(t.labels, "doc_id", "quality", seed=1).groupBy("quality").agg(F.count("*").alias("kept"))
    full = t.labels.groupBy("quality").agg(F.count("*").alias("n"))
    return over.join(under, "quality").join(full, "quality").select(
        "quality", "over_n", (F.col("kept") < 0.95 * F.col("n")).alias("cut"))


@plan("F11", "SELECT quality, n, round(total / (k * n), 6) AS weight FROM (SELECT quality, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS k FROM labels GROUP BY quality)")
def class_weights(t):
    return smp.class_weights(t.labels, "quality").select("quality", "n", F.round("weight", 6).alias("weight"))
