"""Projection, filter, set operations and scalar functions over the given tables."""

from pyspark.sql import functions as F

from lumenframe.functions import scalars as fn
from lumenframe.operators import relational as rel
from lumenframe.plans.registry import plan

AS_OF = "2001-08-01"


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _days_since(c):
    return F.datediff(F.lit(AS_OF).cast("date"), F.to_date(c))


@plan("B01", "SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_totalprice AS BIGINT) AS price, "
      "o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'")
def select_rename_cast(t):
    whole = t.orders.withColumn("o_totalprice", F.bround("o_totalprice", 0))
    return rel.staged(whole, {"order_id": ("o_orderkey", "bigint"), "customer_id": ("o_custkey", "bigint"),
                              "price": ("o_totalprice", "bigint"), "status": ("o_orderstatus", "string")},
                      F.col("o_orderstatus") != "P")


@plan("B02 B03", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events "
      "WHERE event_type = 'purchase' AND value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id")
def filter_by_label(t):
    return (rel.filter_by_label(t.events, "event_type", "purchase", "value").dropna(subset=["user_id"])
            .groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


@plan("B04", "SELECT count(c_acctbal) AS with_balance, count(*) AS n, 5 AS n_columns FROM customer")
def drop_sparse_columns(t):
    sparse = t.customer.withColumn("note", F.when(F.col("c_custkey") % 4 == 0, "x"))
    kept = rel.drop_sparse_columns(sparse, 0.5)
    return kept.agg(F.count("c_acctbal").alias("with_balance"), F.count("*").alias("n"),
                    F.lit(len(kept.columns)).alias("n_columns"))


@plan("B05", "SELECT c_custkey, c_mktsegment FROM customer")
def select_columns_by_position(t):
    return rel.select_positions(t.customer, [0, 4])


@plan("B06", f"""SELECT CASE WHEN d > 90 THEN 'churned' WHEN d > 30 THEN 'at_risk' ELSE 'active' END AS status,
  count(*) AS n FROM (SELECT date_diff('day', max(o_orderdate)::DATE, DATE '{AS_OF}') AS d FROM orders GROUP BY o_custkey)
  GROUP BY 1""")
def case_status(t):
    last = t.orders.groupBy("o_custkey").agg(_days_since(F.max("o_orderdate")).alias("d"))
    return last.groupBy(rel.case_status(F.col("d")).alias("status")).agg(F.count("*").alias("n"))


@plan("B07 D13", """SELECT o_custkey, round(sum(CASE WHEN o_orderdate >= TIMESTAMP '2000-08-01' THEN o_totalprice ELSE 0 END), 2) AS recent,
  round(sum(CASE WHEN o_orderdate < TIMESTAMP '2000-08-01' THEN o_totalprice ELSE 0 END), 2) AS earlier FROM orders
  WHERE o_orderdate >= TIMESTAMP '1999-08-01' GROUP BY o_custkey HAVING recent < 0.8 * earlier""")
def having_revenue_drop(t):
    cut = F.lit("2000-08-01").cast("timestamp_ntz")
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    return (t.orders.where(day >= F.lit("1999-08-01").cast("timestamp_ntz")).groupBy("o_custkey")
            .agg(F.round(F.sum(F.when(day >= cut, price).otherwise(0)), 2).alias("recent"),
                 F.round(F.sum(F.when(day < cut, price).otherwise(0)), 2).alias("earlier"))
            .where(F.col("recent") < 0.8 * F.col("earlier")))


@plan("B08 C06", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o "
      "WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def exists_large_order(t):
    big = t.orders.where(F.col("o_totalprice") > 400000)
    return t.customer.join(big, t.customer.c_custkey == big.o_custkey, "left_semi").select("c_custkey", "c_name")


@plan("B09", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey IN "
      "(SELECT p_partkey FROM part WHERE p_size > 45)")
def in_subquery(t):
    t.lineitem.createOrReplaceTempView("lf_lineitem")
    t.part.createOrReplaceTempView("lf_part")
    return t.spark.sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lf_lineitem WHERE l_partkey IN "
                       "(SELECT p_partkey FROM lf_part WHERE p_size > 45)")


@plan("B10", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o WHERE
  o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
  AND o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def correlated_filter(t):
    return rel.above_key_average(t.orders, "o_custkey", "o_totalprice", "o_orderdate").select(
        "o_orderkey", "o_custkey", "o_totalprice")


@plan("B11", "SELECT CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END AS label, count(*) AS n FROM part GROUP BY 1")
def binary_label(t):
    return t.part.groupBy(rel.binary_label(F.col("p_retailprice"), 1000).alias("label")).agg(F.count("*").alias("n"))


@plan("B12", """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY o_custkey),
  named AS (SELECT c_mktsegment, total, n FROM spend JOIN customer ON o_custkey = c_custkey)
  SELECT c_mktsegment, count(*) AS customers, round(avg(total), 2) AS avg_total, sum(n) AS orders_n FROM named GROUP BY c_mktsegment""")
def cte_steps(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    named = spend.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return named.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.round(F.avg("total"), 2).alias("avg_total"), F.sum("n").alias("orders_n"))


@plan("B13", """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent FROM region UNION ALL
  SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 's' || s_suppkey, s_name, 'n' || s_nationkey FROM supplier),
  tree AS (SELECT id, name, 0 AS depth, name AS path FROM nodes WHERE parent IS NULL UNION ALL
  SELECT c.id, c.name, t.depth + 1, t.path || ' > ' || c.name FROM nodes c JOIN tree t ON c.parent = t.id)
  SELECT * FROM tree""")
def recursive_hierarchy(t):
    def node(df, mark, key, name, parent):
        return df.select(F.concat(F.lit(mark), key).alias("id"), F.col(name).alias("name"), parent.alias("parent"))

    nodes = (node(t.region, "r", "r_regionkey", "r_name", F.lit(None).cast("string"))
             .unionByName(node(t.nation, "n", "n_nationkey", "n_name", F.concat(F.lit("r"), "n_regionkey")))
             .unionByName(node(t.supplier, "s", "s_suppkey", "s_name", F.concat(F.lit("n"), "s_nationkey"))))
    return rel.walk_hierarchy(nodes, "id", "parent", "name")


@plan("B14", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_acctbal <= 9000 AND c_nationkey >= 3")
def range_constraint_filter(t):
    return t.customer.where(rel.in_ranges({"c_acctbal": (0, 9000), "c_nationkey": (3, None)})).select(
        "c_custkey", "c_acctbal")


@plan("B15", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def map_values(t):
    return rel.map_values(t.customer, "c_nationkey", t.nation, "n_nationkey", "n_name", "nation").select(
        "c_custkey", "nation")


# set operations

@plan("G01", "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def union_all(t):
    return (t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
            .unionByName(t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))))


@plan("G02", "SELECT DISTINCT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def union_distinct(t):
    return t.orders.select(F.col("o_custkey").alias("k")).union(t.customer.select("c_custkey")).distinct()


@plan("G03", """SELECT k, 'both' AS side FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events)
  UNION ALL SELECT k, 'missing' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def intersect_except(t):
    both = t.orders.select(F.col("o_custkey").alias("k")).intersect(t.events.select("user_id"))
    missing = rel.population_diff(t.customer.select(F.col("c_custkey").alias("k")),
                                  t.orders.select(F.col("o_custkey").alias("k")), "k")
    return both.withColumn("side", F.lit("both")).unionByName(missing)


@plan("G04", "SELECT 'big' AS name, count(*) AS n FROM orders WHERE o_totalprice > 200000 UNION ALL "
      "SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'")
def set_difference_columns(t):
    wider = t.orders.withColumn("big", F.col("o_totalprice") > 200000).withColumn(
        "urgent", F.col("o_orderpriority") == "1-URGENT")
    added = rel.new_columns(t.orders, wider)
    counts = wider.agg(*[F.count_if(F.col(c)).alias(c) for c in added])
    return counts.unpivot([], added, "name", "n")


# scalar functions

@plan("H01 H03", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio, "
      "coalesce(nullif(l_tax, 0), -1) AS tax FROM lineitem")
def safe_divide_nullif(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(fn.safe_divide(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("ratio"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.lit(-1.0)).alias("tax"))


@plan("H02", "SELECT doc_id, coalesce(TRY_CAST(split_part(lower(source), '_', 1) AS INTEGER), -999) AS a, "
      "TRY_CAST(CAST(n_chars AS VARCHAR) AS INTEGER) AS b FROM documents")
def safe_cast(t):
    return t.documents.select(
        "doc_id", F.coalesce(F.split_part(F.lower("source"), F.lit("_"), F.lit(1)).try_cast("int"), F.lit(-999)).alias("a"),
        F.col("n_chars").cast("string").try_cast("int").alias("b"))


@plan("H04 H05", "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS lg, round(sqrt(p_size), 6) AS rt, "
      "round(sin(p_size), 6) AS sn, abs(p_size - 25) AS away, p_size % 7 AS rest, "
      "CASE WHEN p_size < 10 THEN 10 WHEN p_size > 40 THEN 40 ELSE p_size END AS clipped FROM part")
def math_functions(t):
    s = F.col("p_size")
    return t.part.select(
        "p_partkey", F.round(F.log1p("p_retailprice"), 6).alias("lg"), F.round(F.sqrt(s), 6).alias("rt"),
        F.round(F.sin(s), 6).alias("sn"), F.abs(s - 25).alias("away"), (s % 7).alias("rest"),
        fn.clip(s, 10, 40).alias("clipped"))


@plan("H06", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS plus7,
  strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS age,
  year(o_orderdate) AS y, len(generate_series(date_trunc('month', o_orderdate)::TIMESTAMP, o_orderdate, INTERVAL 1 DAY)) AS day_n FROM orders""")
def date_functions(t):
    d = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey", _day(F.date_add(d, 7)).alias("plus7"), _day(F.date_trunc("quarter", d)).alias("quarter"),
        _days_since("o_orderdate").alias("age"), F.extract(F.lit("YEAR"), d).alias("y"),
        F.size(F.sequence(F.to_date(F.date_trunc("month", d)), d)).alias("day_n"))


@plan("H07 H08 H09", """SELECT event_id, isodow(ts) - 1 AS dow, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend,
  CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part,
  CASE WHEN ts::DATE = last_day(ts) THEN 1 ELSE 0 END AS month_end,
  CASE WHEN ts::DATE = last_day(ts) AND month(ts) % 3 = 0 THEN 1 ELSE 0 END AS quarter_end,
  CASE WHEN strftime(ts, '%m-%d') IN ('01-01', '01-15') THEN 1 ELSE 0 END AS holiday, dayofyear(ts) AS doy,
  round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos FROM events""")
def calendar_features(t):
    ts = F.col("ts")
    s, c = fn.cyclical(F.hour(ts), 24)
    return t.events.select(
        "event_id", fn.weekday(ts).alias("dow"), fn.is_weekend(ts).alias("weekend"), fn.part_of_day(ts).alias("part"),
        fn.is_month_end(ts).alias("month_end"), fn.is_quarter_end(ts).alias("quarter_end"),
        fn.is_holiday(ts, ["01-01", "01-15"]).alias("holiday"), F.dayofyear(ts).alias("doy"),
        F.round(s, 6).alias("hour_sin"), F.round(c, 6).alias("hour_cos"))


@plan("H10 H21", r"""SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, len(string_split(url, '/')) AS parts,
  contains(url, 'page=') AS paged, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages""")
def url_functions(t):
    u = F.col("url")
    return t.pages.select("page_id", fn.url_host(u).alias("host"), F.size(F.split(u, "/")).alias("parts"),
                          u.contains("page=").alias("paged"), fn.is_web_url(u).alias("valid"))


@plan("H11 H12 M13", r"""SELECT doc_id, length(text) AS len, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS numbers,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS n_unique FROM documents""")
def text_features(t):
    x = F.col("text")
    return t.documents.select("doc_id", fn.text_length(x).alias("len"), fn.word_count(x).alias("n_words"),
                              fn.has_numbers(x).alias("numbers"), fn.unique_words(x).alias("n_unique"))


def _label_sql(prefix):
    return f"""CASE WHEN v >= 1e9 THEN printf('{prefix}%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('{prefix}%.1fM', v / 1e6)
  WHEN v >= 1e3 THEN printf('{prefix}%.1fK', v / 1e3) ELSE '{prefix}' || format('{{:,}}', CAST(v AS BIGINT)) END"""


@plan("H13", f"""SELECT o_custkey, {_label_sql('$')} AS money, {_label_sql('')} AS plain, printf('%.1f%%', share) AS pct FROM
  (SELECT o_custkey, floor(sum(o_totalprice) / 1000) * 250 + 3 AS v, count(*) * 1.0 AS share FROM orders GROUP BY o_custkey)""")
def format_number(t):
    s = t.orders.groupBy("o_custkey").agg((F.floor(F.sum("o_totalprice") / 1000) * 250 + 3).cast("double").alias("v"),
                                          (F.count("*") * 1.0).cast("double").alias("share"))
    v = F.col("v")
    return s.select("o_custkey", fn.format_number(v, "currency").alias("money"), fn.format_number(v).alias("plain"),
                    fn.format_number(F.col("share"), "percent").alias("pct"))


@plan("H14 D16", """SELECT doc_id, lang AS lang, count(*) AS n, sum(length(line)) AS chars, max(length(line)) AS longest,
  round(avg(length(line)), 4) AS mean_len FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL""")
def nested_items(t):
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.length(x).alias("len")))
    nested = t.documents.select(F.struct("doc_id", "lang").alias("doc"), lines.alias("lines"))
    chars = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x["len"])
    return nested.select("doc.doc_id", "doc.lang", F.size("lines").alias("n"), chars.alias("chars"),
                         F.array_max("lines.len").alias("longest"), F.round(chars / F.size("lines"), 4).alias("mean_len"))


@plan("H14", "SELECT lang, count(*) AS n, max(len(string_split(text, chr(10)))) AS most FROM "
      "(SELECT lang, text, unnest(string_split(text, chr(10))) FROM documents) GROUP BY lang")
def unnest_items(t):
    lines = t.documents.select("lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("lang").agg(F.count("*").alias("n"), (F.max("pos") + 1).alias("most"))


@plan("H15", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) + 1 AS k1, "
      "props->>'$.none' AS missing FROM events")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
                           (F.variant_get(F.parse_json("props"), "$.k", "bigint") + 1).alias("k1"),
                           F.get_json_object("props", "$.none").alias("missing"))


MD5_100 = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % 100"


@plan("H16 M11 S10", f"SELECT {MD5_100.format('user_id')} AS bucket, count(*) AS n, count(DISTINCT user_id) AS users, "
      f"CASE WHEN {MD5_100.format('user_id')} < 50 THEN 'A' ELSE 'B' END AS variant FROM events GROUP BY bucket")
def hash_bucket(t):
    b = fn.md5_bucket(F.col("user_id"), 100)
    return (t.events.withColumn("bucket", b).groupBy("bucket")
            .agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
            .withColumn("variant", F.when(F.col("bucket") < 50, "A").otherwise("B")))


@plan("H17", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def timezone_normalize(t):
    utc = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "America/Bogota")
    return t.events.select("event_id", F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("utc"))


@plan("H19", """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm,
  round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS cos_rev FROM embeddings""")
def vector_norms(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(fn.norm(e), 5).alias("norm"),
                               F.round(fn.cosine(e, F.reverse(e)), 5).alias("cos_rev"))


@plan("H20", """SELECT p_partkey, round(p_retailprice / (p_size * p_size), 6) AS ratio, p_retailprice - p_size AS diff,
  p_size * p_size AS sq, p_brand || '_' || p_type AS crossed FROM part""")
def ratio_and_cross(t):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return t.part.select("p_partkey", F.round(fn.safe_divide(p, s * s), 6).alias("ratio"), (p - s).alias("diff"),
                         (s * s).alias("sq"), F.concat_ws("_", "p_brand", "p_type").alias("crossed"))
