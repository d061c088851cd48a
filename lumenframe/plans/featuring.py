"""Feature engineering over the given tables."""

from pyspark.sql import functions as F

from lumenframe.functions import scalars as fn
from lumenframe.operators import features as ft
from lumenframe.plans.registry import plan

AS_OF = "2001-08-01"


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


EDGES = ", ".join(f"quantile_cont(p_retailprice, {q}) AS e{int(q * 10)}" for q in (0.2, 0.4, 0.6, 0.8))


@plan("M01 M02", f"""SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS lg, (p_retailprice > e2)::INT + (p_retailprice > e4)::INT + (p_retailprice > e6)::INT + (p_retailprice > e8)::INT AS binned,
  round((p_retailprice - m) / s, 6) AS z, round(greatest(least(p_retailprice, b), a), 4) AS clipped FROM part,
  (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s, quantile_cont(p_retailprice, 0.01) AS a, quantile_cont(p_retailprice, 0.99) AS b, {EDGES} FROM part)""")
def numeric_features(t):
    f = ft.numeric_features(t.part, ["p_retailprice"])
    c = "p_retailprice_"
    return f.select("p_partkey", F.round(c + "log", 6).alias("lg"), F.col(c + "binned").alias("binned"), F.round(c + "zscore", 6).alias("z"),
                    F.round(c + "clipped", 4).alias("clipped"))


@plan("M02", """SELECT bin, count(*) AS n FROM (SELECT (l_quantity > quantile_cont(l_quantity, 0.25) OVER ())::INT + (l_quantity > quantile_cont(l_quantity, 0.5) OVER ())::INT
  + (l_quantity > quantile_cont(l_quantity, 0.75) OVER ())::INT AS bin FROM lineitem) GROUP BY bin""")
def qcut_quartiles(t):
    return ft.qcut(t.lineitem, "l_quantity", 4, "bin").groupBy("bin").agg(F.count("*").alias("n"))


@plan("M03", "SELECT CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size <= 30 AND p_size > 10 THEN 'medium' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS bin, count(*) AS n FROM part GROUP BY 1")
def cut_fixed(t):
    return t.part.groupBy(ft.cut_column(F.col("p_size"), [0, 10, 30, 50], ["small", "medium", "large"]).alias("bin")).agg(F.count("*").alias("n"))


@plan("M04", """SELECT p_partkey, round((p_size - m) / s, 6) AS standard, round((p_size - a) / (b - a), 6) AS minmax, round((p_size - q2) / (q3 - q1), 6) AS robust, round(p_size / u, 6) AS unit
  FROM part, (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s, min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, max(abs(p_size))::DOUBLE AS u, quantile_cont(p_size, 0.25) AS q1,
  quantile_cont(p_size, 0.5) AS q2, quantile_cont(p_size, 0.75) AS q3 FROM part WHERE p_partkey % 5 <> 0)""")
def scalers(t):
    p = t.part.select("p_partkey", "p_size")
    train = p.where(F.col("p_partkey") % 5 != 0)
    out = p
    for how in ("standard", "minmax", "robust", "unit"):
        scaled = ft.apply_scaler(p, ft.fit_scaler(train, ["p_size"], how))
        out = out.join(scaled.select("p_partkey", F.round("p_size", 6).alias(how)), "p_partkey")
    return out.drop("p_size")


GRID = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]


@plan("M05", "SELECT method, lam FROM (" + " UNION ALL ".join(
    f"SELECT 'box-cox' AS method, {lam}::DOUBLE AS lam, -0.5 * count(*) * ln(var_pop({'ln(o_totalprice)' if lam == 0 else f'(pow(o_totalprice, {lam}) - 1) / {lam}'})) + ({lam} - 1) * sum(ln(o_totalprice)) AS ll FROM orders"
    for lam in GRID) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'yeo-johnson', {lam}::DOUBLE, -0.5 * count(*) * ln(var_pop({'ln(1 + o_totalprice)' if lam == 0 else f'(pow(o_totalprice + 1, {lam}) - 1) / {lam}'})) + ({lam} - 1) * sum(ln(1 + o_totalprice)) FROM orders"
    for lam in GRID) + ") QUALIFY row_number() OVER (PARTITION BY method ORDER BY ll DESC) = 1")
def power_transform(t):
    rows = [(m, ft.fit_power(t.orders, "o_totalprice", GRID, m)) for m in ("box-cox", "yeo-johnson")]
    return t.spark.createDataFrame(rows, "method string, lam double")


@plan("M06", "SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / (SELECT count(p_brand) FROM part), 6) AS freq FROM part")
def frequency_encode(t):
    return ft.frequency_encode(t.part, "p_brand").select("p_partkey", F.round("p_brand_freq", 6).alias("freq"))


@plan("M07", "SELECT p_partkey, round((sum(p_retailprice) OVER w + 20 * (SELECT avg(p_retailprice) FROM part)) / (count(*) OVER w + 20), 6) AS enc FROM part WINDOW w AS (PARTITION BY p_brand)")
def target_encode(t):
    enc, mean = ft.fit_target_encoding(t.part, "p_brand", "p_retailprice")
    return ft.target_encode(t.part, enc, "p_brand", mean).select("p_partkey", F.round("p_brand_target_enc", 6).alias("enc"))


FOLD = "(CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 5)"


@plan("M08", f"""WITH f AS (SELECT *, {FOLD} AS fold FROM part), k AS (SELECT p_brand, fold, sum(p_retailprice) AS fs, count(*) AS fn FROM f GROUP BY ALL),
  a AS (SELECT *, sum(fs) OVER (PARTITION BY p_brand) AS s, sum(fn) OVER (PARTITION BY p_brand) AS n FROM k)
  SELECT p_partkey, round((sum(p_retailprice) OVER w - p_retailprice) / nullif(count(*) OVER w - 1, 0), 9) AS loo, round((s - fs) / nullif(n - fn, 0), 9) AS oof,
  round(avg(p_retailprice) OVER (PARTITION BY f.p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS past
  FROM f JOIN a ON f.p_brand = a.p_brand AND f.fold = a.fold WINDOW w AS (PARTITION BY f.p_brand)""")
def target_encode_safe(t):
    p = t.part.withColumn("fold", fn.md5_bucket(F.col("p_partkey"), 5))
    a = ft.target_encode_loo(p, "p_brand", "p_retailprice")
    b = ft.target_encode_kfold(a, "p_brand", "p_retailprice", "fold")
    c = ft.target_encode_ordered(b, "p_brand", "p_retailprice", ["p_partkey"])
    return c.select("p_partkey", F.round("p_brand_loo", 9).alias("loo"), F.round("p_brand_oof", 9).alias("oof"), F.round("p_brand_past", 9).alias("past"))


@plan("M09", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(t):
    return ft.one_hot(t.customer, "c_mktsegment").drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@plan("M10", """SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS ord FROM customer""")
def label_encode(t):
    a = ft.label_encode(t.customer, "c_mktsegment").select("c_custkey", "c_mktsegment_code")
    b = ft.label_encode(t.customer, "c_mktsegment", ["MACHINERY", "BUILDING"]).select("c_custkey", F.col("c_mktsegment_code").alias("ord"))
    return a.join(b, "c_custkey")


@plan("M12", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) - 1 AS dow, hour(o_orderdate) AS h, (isodow(o_orderdate) >= 6)::INT AS we,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS ms, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS mc FROM orders""")
def datetime_features(t):
    c = "o_orderdate_"
    return ft.datetime_features(t.orders, "o_orderdate").select(
        "o_orderkey", F.col(c + "year").alias("y"), F.col(c + "month").alias("m"), F.col(c + "dayofweek").alias("dow"), F.col(c + "hour").alias("h"),
        F.col(c + "is_weekend").alias("we"), F.round(c + "month_sin", 6).alias("ms"), F.round(c + "month_cos", 6).alias("mc"))


@plan("M14", """SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS q_x_e, round(l_quantity / nullif(l_extendedprice, 0), 8) AS q_div_e,
  round(l_quantity / nullif(l_discount, 0), 6) AS q_div_d FROM lineitem""")
def interactions(t):
    f = ft.interactions(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"])
    return f.select("l_orderkey", "l_linenumber", F.round("l_quantity_x_l_extendedprice", 4).alias("q_x_e"),
                    F.round("l_quantity_div_l_extendedprice", 8).alias("q_div_e"), F.round("l_quantity_div_l_discount", 6).alias("q_div_d"))


def _full(n, agg):
    return f"CASE WHEN count(v) OVER (ORDER BY d ROWS {n - 1} PRECEDING) = {n} THEN round({agg}(v) OVER (ORDER BY d ROWS {n - 1} PRECEDING), 4) END"


@plan("M15 P08", f"""SELECT strftime(d, '%Y-%m-%d') AS day, {_full(7, 'avg')} AS m7, {_full(30, 'stddev_samp')} AS s30, round(lag(v, 7) OVER (ORDER BY d), 2) AS lag7,
  round(v - lag(v) OVER (ORDER BY d), 2) AS diff, round((v - lag(v) OVER (ORDER BY d)) / nullif(lag(v) OVER (ORDER BY d), 0), 6) AS pct FROM (SELECT o_orderdate AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)""")
def timeseries_features(t):
    daily = t.orders.groupBy(F.col("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    f = ft.timeseries_features(daily, "v", ["d"])
    return f.select(_day("d").alias("day"), F.round("v_roll_mean_7", 4).alias("m7"), F.round("v_roll_std_30", 4).alias("s30"), F.round("v_lag_7", 2).alias("lag7"),
                    F.round("v_diff", 2).alias("diff"), F.round("v_pct_change", 6).alias("pct"))


SPLIT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@plan("M17", f"""WITH w AS (SELECT doc_id, unnest({SPLIT}) AS term FROM documents), l AS (SELECT doc_id, len({SPLIT}) AS len FROM documents),
  c AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term)
  SELECT doc_id, count(*) AS terms, round(max(tf / len * ln((SELECT count(*) FROM documents) / df)), 6) AS top, round(sum(tf / len * ln((SELECT count(*) FROM documents) / df)), 5) AS total
  FROM c JOIN d USING (term) JOIN l USING (doc_id) GROUP BY doc_id""")
def tfidf(t):
    return ft.tfidf(t.documents, "doc_id", "text").groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.round(F.max("tfidf"), 6).alias("top"), F.round(F.sum("tfidf"), 5).alias("total"))


@plan("M18")
def word_embeddings(t):
    v = ft.mean_word_vectors(t.documents, "text")
    return v.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(fn.norm(F.col("vector"))), 3).alias("mean_norm"))


@plan("M19", f"""WITH w AS (SELECT doc_id, {SPLIT} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS gram FROM w WHERE len(w) >= 3)
  SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 100""")
def top_ngrams(t):
    g = t.documents.select("doc_id", F.explode(ft.word_ngrams(F.col("text"), 3)).alias("gram"))
    return ft.most_frequent(g, "gram", "doc_id", 100).withColumnRenamed("keys", "docs")


@plan("M20", "SELECT p_partkey, p_size::DOUBLE AS x, (p_size * p_size)::DOUBLE AS xx FROM part")
def polynomial_features(t):
    return ft.polynomial(t.part, ["p_size"]).select("p_partkey", F.col("poly")[0].alias("x"), F.col("poly")[1].alias("xx"))


@plan("M21", "SELECT 'l_quantity,l_tax' AS kept, count(*) AS n FROM lineitem")
def correlation_filter(t):
    d = t.lineitem.withColumn("q2", F.col("l_quantity") * 2 + 1)
    kept = ft.correlation_filter(d, ["l_quantity", "q2", "l_tax"])
    return d.agg(F.lit(",".join(kept)).alias("kept"), F.count("*").alias("n"))


@plan("M22", """WITH j AS (SELECT event_type AS x, hour(ts) AS y, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM j)
  SELECT round(sum(n / t * ln(n * t / (nx * ny))), 8) AS mi FROM a""")
def mutual_information(t):
    e = t.events.select("event_type", F.hour("ts").alias("h"))
    return ft.mutual_information(e, "event_type", "h").select(F.round("mi", 8).alias("mi"))


@plan("M23", "SELECT feature, round(v, 6) AS variance, v > 1 AS keep FROM (SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS v FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount) FROM lineitem)")
def variance_threshold(t):
    return ft.low_variance(t.lineitem, ["l_quantity", "l_discount"], 1).select("feature", F.round("variance", 6).alias("variance"), "keep")


@plan("M24")
def feature_selection(t):
    d = t.lineitem.select((F.col("l_quantity")).alias("q"), F.col("l_tax").alias("x"), F.col("l_discount").alias("d"), "l_extendedprice",
                          (F.col("l_extendedprice") > 40000).cast("double").alias("y"), F.floor(F.col("l_quantity") / 10).cast("double").alias("qb"),
                          F.floor(F.col("l_tax") * 100).cast("double").alias("xb"))
    rows = [("anova", ft.select_univariate(d, ["q", "x", "d"], "y", 1)), ("chi2", ft.select_univariate(d, ["qb", "xb"], "y", 1, categorical=True)),
            ("recursive", ft.select_recursive(d, ["q", "x", "d"], "l_extendedprice", 1)), ("l1", ft.select_l1(d, ["q", "x", "d"], "l_extendedprice", 2000.0))]
    return t.spark.createDataFrame([(m, ",".join(c)) for m, c in rows], "method string, kept string")


def _win(w):
    return (f"count(*) FILTER (WHERE a < {w}) AS order_count_{w}d, round(coalesce(sum(o_totalprice) FILTER (WHERE a < {w}), 0), 2) AS revenue_{w}d")


@plan("M25", f"""SELECT o_custkey, count(*) AS lifetime_orders, round(sum(o_totalprice), 2) AS lifetime_revenue, round(avg(o_totalprice), 4) AS avg_order_value, min(a) AS days_since_last_order,
  max(a) AS days_since_first_order, {', '.join(_win(w) for w in (7, 14, 30, 60, 90))}, round(coalesce(sum(o_totalprice) FILTER (WHERE a < 7), 0) / nullif(coalesce(sum(o_totalprice) FILTER (WHERE a < 90), 0), 0), 6) AS recent_ratio
  FROM (SELECT *, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS a FROM orders) WHERE a >= 0 GROUP BY o_custkey""")
def entity_feature_table(t):
    f = ft.entity_features(t.orders, "o_custkey", "o_orderdate", "o_totalprice", AS_OF).drop("first_order", "last_order")
    digits = {"avg_order_value": 4, "recent_ratio": 6}
    money = [c for c in f.columns if "revenue" in c]
    return f.select(*[F.round(c, digits.get(c, 2)).alias(c) if c in digits or c in money else c for c in f.columns])


@plan("M26", """WITH f AS (SELECT c_nationkey AS k, o_orderdate::DATE AS d, count(*) AS n, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  s AS (SELECT k, unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT k FROM f)),
  j AS (SELECT s.k, s.d, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM s LEFT JOIN f USING (k, d))
  SELECT k, strftime(d, '%Y-%m-%d') AS day, sum(n) OVER (PARTITION BY k ORDER BY d ROWS 6 PRECEDING)::BIGINT AS n_7d, round(sum(v) OVER (PARTITION BY k ORDER BY d ROWS 29 PRECEDING), 2) AS total_30d FROM j""")
def rolling_feature_panel(t):
    f = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    p = ft.rolling_panel(f, "k", "o_orderdate", "o_totalprice", "1995-01-01", AS_OF)
    return p.select("k", _day("day").alias("day"), "n_7d", F.round("total_30d", 2).alias("total_30d"))


@plan("M27", """SELECT l_suppkey, round(sum(CASE WHEN p_type = 'ECONOMY' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS "ECONOMY",
  round(sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS "PROMO" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def preference_vector(t):
    j = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    v = ft.preference_vector(j, "l_suppkey", "p_type", ["ECONOMY", "PROMO"], "l_extendedprice")
    return v.select("l_suppkey", F.round("ECONOMY", 6).alias("ECONOMY"), F.round("PROMO", 6).alias("PROMO"))


@plan("M27", """SELECT p_partkey, round(p_retailprice / avg(p_retailprice) OVER (PARTITION BY p_type), 6) AS price_ratio, coalesce(u, 0) AS units, round(u / (d + 1), 6) AS velocity FROM part LEFT JOIN
  (SELECT l_partkey, sum(l_quantity) AS u, date_diff('day', min(l_shipdate), max(l_shipdate)) AS d FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def item_features(t):
    lines = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    f = ft.item_features(lines, t.part, "p_partkey", "p_type", "p_retailprice", "l_shipdate", "l_quantity")
    return f.select("p_partkey", F.round("price_ratio", 6).alias("price_ratio"), "units", F.round("velocity", 6).alias("velocity"))


@plan("M28", """WITH e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT event_id, round(value - avg(value) OVER p, 9) AS amount_deviation, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 3600000000, 5) AS age_hours,
  (count(*) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0)::INT AS new_attribute,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS velocity_1h,
  coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY k ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS flagged_before
  FROM e WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def fraud_features(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    f = ft.fraud_features(e, "user_id", "ts", ["ts", "event_id"], "value", "k", F.col("event_type") == "error")
    return f.select("event_id", F.round("amount_deviation", 9).alias("amount_deviation"), F.round("age_hours", 5).alias("age_hours"), "new_attribute", "velocity_1h", "flagged_before")


@plan("M29", f"""SELECT churned, count(*) AS n, round(avg(total), 2) AS mean_revenue FROM (SELECT (date_diff('day', max(o_orderdate)::DATE, DATE '{AS_OF}') > 90)::INT AS churned, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) GROUP BY churned""")
def churn_label(t):
    f = ft.churn_label(ft.entity_features(t.orders, "o_custkey", "o_orderdate", "o_totalprice", AS_OF))
    return f.groupBy("churned").agg(F.count("*").alias("n"), F.round(F.avg("lifetime_revenue"), 2).alias("mean_revenue"))
