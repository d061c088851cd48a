"""Profiling, data-quality rules and cleaning over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import cleaning as cl
from lumenframe.operators import quality as qa
from lumenframe.plans.registry import plan


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def dirty(t):
    """Customer with duplicates, gaps, outliers, placeholders and sentinels set by rules on the key."""
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    base = t.customer.select(
        k, "c_nationkey",
        F.when(k % 7 == 0, None).when(k % 43 == 0, -1.0).when(k % 97 == 0, bal * 100).otherwise(bal).alias("c_acctbal"),
        F.when(k % 31 == 0, "N/A").when(k % 29 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return base.unionByName(base.where(k % 50 == 0))


DIRTY = """base AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN -1.0
  WHEN c_custkey % 97 = 0 THEN c_acctbal * 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 31 = 0 THEN 'N/A'
  WHEN c_custkey % 29 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer),
  dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE c_custkey % 50 = 0)"""


@plan("K01", "SELECT count(*) AS n_rows, 6 AS n_columns, 'bigint:2, double:1, string:2, timestamp_ntz:1' AS types FROM orders")
def table_overview(t):
    return qa.overview(t.orders)


@plan("K02", """SELECT * FROM (VALUES ('doc_id', 'numeric'), ('n_chars', 'numeric'), ('text', 'text'), ('lang', 'categorical'),
  ('source', 'categorical'), ('day', 'datetime')) v("column", kind)""")
def classify_columns(t):
    dated = t.documents.withColumn("day", F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")))
    return qa.classify_columns(dated)


@plan("K03", f"""WITH {DIRTY} SELECT 'c_acctbal' AS "column", count(*) - count(c_acctbal) AS missing, round(100.0 * (count(*) - count(c_acctbal)) / count(*), 2) AS percent FROM dirty
  UNION ALL SELECT 'c_mktsegment', count(*) - count(c_mktsegment), round(100.0 * (count(*) - count(c_mktsegment)) / count(*), 2) FROM dirty""")
def missing_report(t):
    return qa.missing_report(dirty(t))


@plan("K04", f"""WITH {DIRTY} SELECT 'c_custkey' AS "column", FALSE AS mostly_zero, FALSE AS has_negative UNION ALL SELECT 'c_nationkey', count_if(c_nationkey = 0) > 0.5 * count(*), min(c_nationkey) < 0 FROM dirty
  UNION ALL SELECT 'c_acctbal', count_if(c_acctbal = 0) > 0.5 * count(*), min(c_acctbal) < 0 FROM dirty""")
def numeric_flags(t):
    return qa.numeric_flags(dirty(t))


def _cat_sql(col):
    return f"""SELECT '{col}' AS "column", count(DISTINCT {col}) AS n_unique, (SELECT {col} FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
  count(DISTINCT {col}) > 50 AS high_cardinality, count(DISTINCT {col}) = count(*) AS likely_id FROM part"""


@plan("K05", " UNION ALL ".join(_cat_sql(c) for c in ("p_name", "p_brand", "p_type")))
def categorical_profile(t):
    return qa.categorical_profile(t.part)


@plan("K06", "SELECT toxic, round(count(*) / sum(count(*)) OVER (), 3) AS share, min(count(*)) OVER () / sum(count(*)) OVER () < 0.1 AS imbalanced FROM labels GROUP BY toxic")
def target_classes(t):
    return qa.target_classes(t.labels, "toxic")


@plan("K06", "SELECT round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std FROM part")
def target_numeric(t):
    s = qa.target_numeric(t.part, "p_retailprice")
    return s.select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@plan("K07", "SELECT round(max(n) / min(n), 6) AS ratio, max(n) / min(n) > 10 AS extreme FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)")
def class_imbalance(t):
    return qa.imbalance_ratio(t.labels, "toxic").select(F.round("ratio", 6).alias("ratio"), "extreme")


@plan("K08", f"WITH {DIRTY} SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates, "
      "round(100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty))) / count(*), 2) AS percent FROM dirty")
def duplicate_rows(t):
    return qa.duplicate_rows(dirty(t))


@plan("K09", """SELECT 'doc_id' AS "column", count(doc_id) - count(DISTINCT doc_id) AS duplicates FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)""")
def duplicate_ids(t):
    both = t.documents.select("doc_id").unionByName(t.labels.select("doc_id"))
    return qa.duplicate_ids(both, qa.id_columns(both))


@plan("K10", f"""WITH {DIRTY}, r AS (SELECT 'c_acctbal' AS "column", 100.0 * count(c_acctbal) / count(*) AS p FROM dirty UNION ALL
  SELECT 'c_mktsegment', 100.0 * count(c_mktsegment) / count(*) FROM dirty) SELECT "column", round(p, 1) AS percent,
  CASE WHEN p > 99 THEN 'GREEN' WHEN p >= 95 THEN 'YELLOW' WHEN p >= 80 THEN 'ORANGE' ELSE 'RED' END AS grade FROM r WHERE p < 100""")
def completeness_grade(t):
    return qa.completeness_grade(dirty(t))


SENTINEL_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {v}::DOUBLE AS sentinel, count_if({c} = {v}) AS n, count(*) AS a FROM dirty"
    for c in ("c_custkey", "c_nationkey", "c_acctbal") for v in qa.SENTINELS)


@plan("K11", f'WITH {DIRTY} SELECT "column", sentinel, n FROM ({SENTINEL_SQL}) WHERE n > 0.01 * a')
def sentinel_flags(t):
    return qa.sentinel_flags(dirty(t))


@plan("K12", """SELECT 'l_quantity5' AS "column", 100.0 AS percent, TRUE AS biased UNION ALL SELECT 'l_quantity', round(100.0 * count_if(l_quantity % 5 = 0) / count(l_quantity), 2),
  count_if(l_quantity % 5 = 0) > 0.8 * count(l_quantity) FROM lineitem""")
def round_number_bias(t):
    return qa.round_number_bias(t.lineitem.select("l_quantity", (F.col("l_quantity") * 5).alias("l_quantity5")))


@plan("K13", f"""WITH {DIRTY} SELECT 'c_mktsegment' AS "column", 'n/a' AS placeholder, count(*) AS n FROM dirty WHERE c_mktsegment = 'N/A'""")
def text_placeholders(t):
    return qa.text_placeholders(dirty(t))


@plan("K14", """SELECT 'price' AS "column", count_if(p < 0) AS bad_negatives, 0 AS outside_0_100, FALSE AS placeholder_thousands FROM (SELECT p_retailprice - 950 AS p FROM part)
  UNION ALL SELECT 'rate', 0, count_if(p_size > 40), FALSE FROM part UNION ALL SELECT 'fee', 0, 0, TRUE""")
def magnitude_checks(t):
    size = F.col("p_size")
    return qa.magnitude_checks(t.part.select((F.col("p_retailprice") - 950).alias("price"), (size * 2.5 - 0.1).alias("rate"),
                                             (F.floor(size / 20) * 1000).alias("fee")))


@plan("K15", """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last,
  count_if(o_orderdate > TIMESTAMP '2001-07-01') AS future FROM orders""")
def time_consistency(t):
    r = qa.time_consistency(t.orders, "2001-07-01")
    return r.select("column", _day("first").alias("first"), _day("last").alias("last"), "future")


@plan("K16", """SELECT * FROM (VALUES ('o_custkey', FALSE, FALSE, FALSE, TRUE), ('one', TRUE, FALSE, TRUE, TRUE), ('none', TRUE, TRUE, FALSE, TRUE),
  ('num', FALSE, FALSE, TRUE, TRUE), ('o_orderdate', FALSE, FALSE, FALSE, TRUE)) v("column", constant, all_null, numeric_as_string, stale)""")
def red_flags(t):
    d = t.orders.select("o_custkey", F.lit("1").alias("one"), F.lit(None).cast("string").alias("none"),
                        F.col("o_totalprice").cast("string").alias("num"), "o_orderdate")
    return qa.red_flags(d, "o_orderdate", "2002-01-01")


MONTHS = """m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS p, sum(o_totalprice) AS total FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(p) FROM m), (SELECT max(p) FROM m), INTERVAL 1 MONTH)) AS p),
  j AS (SELECT s.p, total, (total - lag(total) OVER (ORDER BY s.p)) / nullif(lag(total) OVER (ORDER BY s.p), 0) AS c FROM s LEFT JOIN m USING (p))"""


@plan("K17", f"WITH {MONTHS} SELECT strftime(p, '%Y-%m-%d') AS period, total IS NULL AS missing, round(c, 6) AS change, coalesce(abs(c) > 0.5, FALSE) AS jump FROM j")
def time_gaps(t):
    g = qa.time_gaps(t.orders.where(F.month("o_orderdate") != 4), "o_orderdate", "month", "o_totalprice")
    return g.select(_day("period").alias("period"), "missing", F.round("change", 6).alias("change"), "jump")


@plan("K18", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS n FROM orders, (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders)
  WHERE (a = date_trunc('month', a) OR date_trunc('month', o_orderdate) > date_trunc('month', a))
  AND (b::DATE = last_day(b) OR date_trunc('month', o_orderdate) < date_trunc('month', b)) GROUP BY 1""")
def partial_period_filter(t):
    return qa.full_periods(t.orders, "o_orderdate", "month").groupBy(_day(F.date_trunc("month", "o_orderdate")).alias("period")).agg(
        F.count("*").alias("n"))


@plan("K19", """WITH d AS (SELECT date_trunc('day', ts) AS p, count_if(event_type = 'purchase')::DOUBLE AS num, count_if(event_type = 'click')::DOUBLE AS den FROM events GROUP BY 1)
  SELECT strftime(p, '%Y-%m-%d') AS period, round(num / nullif(den, 0), 6) AS rate, den = 0 AS zero,
  coalesce(abs((den - lag(den) OVER (ORDER BY p)) / nullif(lag(den) OVER (ORDER BY p), 0)) > 0.1, FALSE) AS shifted FROM d""")
def denominator_check(t):
    e = F.col("event_type")
    r = qa.denominator_check(t.events, "ts", "day", (e == "purchase").cast("int"), (e == "click").cast("int"), 0.1)
    return r.select(_day("period").alias("period"), F.round("rate", 6).alias("rate"), "zero", "shifted")


@plan("K20", """SELECT count_if(r = 0) AS zeros, count_if(r = 1) AS ones, count(DISTINCT r) = 1 AS identical FROM
  (SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY user_id)""")
def rate_extremes(t):
    r = t.events.groupBy("user_id").agg(F.avg((F.col("event_type") == "purchase").cast("double")).alias("r"))
    return qa.rate_extremes(r, "r")


@plan("K21 K24", f"""WITH {DIRTY} SELECT rule, failing, failing = 0 AS passed FROM (
  SELECT 'not_null:c_acctbal' AS rule, count_if(c_acctbal IS NULL) AS failing FROM dirty UNION ALL
  SELECT 'accepted_values:c_mktsegment', count_if(c_mktsegment NOT IN ('BUILDING','HOUSEHOLD','MACHINERY','AUTOMOBILE','FURNITURE')) FROM dirty UNION ALL
  SELECT 'accepted_range:c_acctbal', count_if(c_acctbal < 0 OR c_acctbal > 10000) FROM dirty UNION ALL
  SELECT 'row_count', 0 UNION ALL
  SELECT 'unique:c_custkey', (SELECT sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY c_custkey HAVING count(*) > 1)) UNION ALL
  SELECT 'unique:c_custkey,c_nationkey', (SELECT sum(n) FROM (SELECT count(*) AS n FROM dirty GROUP BY c_custkey, c_nationkey HAVING count(*) > 1)))""")
def rule_tests(t):
    segments = ["BUILDING", "HOUSEHOLD", "MACHINERY", "AUTOMOBILE", "FURNITURE"]
    return qa.run_rules(dirty(t), [qa.not_null("c_acctbal"), qa.accepted_values("c_mktsegment", segments),
                                   qa.accepted_range("c_acctbal", 0, 10000)],
                        unique=[["c_custkey"], ["c_custkey", "c_nationkey"]], rows=(1, 10**12))


@plan("K22", f"""WITH {DIRTY} SELECT 'non_negative' AS rule, count_if(c_acctbal < 0) AS failing, count_if(c_acctbal < 0) = 0 AS passed FROM dirty UNION ALL
  SELECT 'known_nation', 0, TRUE""")
def custom_sql_tests(t):
    return qa.assert_sql({"lf_dirty": dirty(t), "lf_nation": t.nation}, {
        "non_negative": "SELECT * FROM lf_dirty WHERE c_acctbal < 0",
        "known_nation": "SELECT * FROM lf_dirty d WHERE NOT EXISTS (SELECT 1 FROM lf_nation n WHERE n.n_nationkey = d.c_nationkey)"})


@plan("K23", """SELECT * FROM (VALUES ('c_custkey', 'bigint', 'bigint', 'ok'), ('c_acctbal', 'int', 'double', 'type'), ('c_phone', 'string', NULL, 'missing'),
  ('c_name', NULL, 'string', 'extra'), ('c_nationkey', NULL, 'int', 'extra'), ('c_mktsegment', NULL, 'string', 'extra')) v("column", expected, actual, status)""")
def schema_check(t):
    return qa.schema_check(t.customer, {"c_custkey": "bigint", "c_acctbal": "int", "c_phone": "string"})


@plan("K25", f"""WITH {DIRTY} SELECT 'balance_filled' AS "check", round(count(c_acctbal) / count(*), 6) AS value, 0.8::DOUBLE AS threshold, count(c_acctbal) / count(*) >= 0.8 AS passed FROM dirty
  UNION ALL SELECT 'rows', count(*)::DOUBLE, 100000000.0::DOUBLE, FALSE FROM dirty""")
def quality_gate(t):
    d = dirty(t).agg((F.count("c_acctbal") / F.count("*")).alias("filled"), F.count("*").cast("double").alias("rows"))
    checks = d.select(F.inline(F.array(
        F.struct(F.lit("balance_filled").alias("check"), F.round("filled", 6).alias("value"), F.lit(0.8).alias("threshold")),
        F.struct(F.lit("rows").alias("check"), F.col("rows").alias("value"), F.lit(1e8).alias("threshold")))))
    return qa.quality_gate(checks, strict=False)


@plan("K26", """SELECT dimension, round(share, 6) AS share FROM (SELECT 1.0 AS completeness, (SELECT count(DISTINCT o_custkey) / count(*) FROM orders) AS uniqueness,
  avg(CASE WHEN o_totalprice > 50000 THEN 1.0 ELSE 0 END) AS validity, avg(CASE WHEN o_orderdate <= TIMESTAMP '2001-01-01' THEN 1.0 ELSE 0 END) AS timeliness,
  avg(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1.0 ELSE 0 END) AS consistency FROM orders) UNPIVOT (share FOR dimension IN (completeness, uniqueness, validity, timeliness, consistency))""")
def quality_dimensions(t):
    r = qa.dimension_report(t.orders, "o_custkey", F.col("o_totalprice") > 50000, "o_orderdate", "2001-01-01", F.col("o_orderstatus").isin("F", "O"))
    return r.select("dimension", F.round("share", 6).alias("share"))


@plan("K28", """SELECT count(*) AS shared_keys FROM (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' INTERSECT
  SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')""")
def split_overlap(t):
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return qa.split_overlap(t.orders.where(F.col("o_orderdate") < cut), t.orders.where(F.col("o_orderdate") >= cut), "o_custkey")


@plan("K28", """SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS r, abs(corr(l_quantity, l_extendedprice)) > 0.95 AS leaks FROM lineitem
  UNION ALL SELECT 'copy', 1.0, TRUE""")
def leaking_features(t):
    r = qa.leaking_features(t.lineitem.withColumn("copy", F.col("l_extendedprice") * 2), ["l_quantity", "copy"], "l_extendedprice")
    return r.select("feature", F.round("r", 6).alias("r"), "leaks")


@plan("K28", "SELECT count(*) AS future_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate")
def future_dated_features(t):
    j = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate").join(t.lineitem.select("l_orderkey", "l_shipdate"), "l_orderkey")
    return qa.future_dated(j, "o_orderdate", "l_shipdate")


@plan("K29", """SELECT 'x' AS "column", count(*) AS n_rows, count_if(p_size % 10 = 0) AS nan, count_if(p_size % 10 = 1) AS infinite FROM part""")
def nan_inf_check(t):
    x = F.when(F.col("p_size") % 10 == 0, float("nan")).when(F.col("p_size") % 10 == 1, float("inf")).otherwise(F.col("p_retailprice"))
    return qa.nan_inf_check(t.part.select(x.alias("x")), ["x"])


@plan("K30", "SELECT round(sum(o_totalprice), 1) AS direct, round(sum(o_totalprice), 1) AS by_entity, TRUE AS agrees FROM orders")
def cross_validate_metric(t):
    r = qa.cross_validate_metric(t.orders, "o_custkey", "o_totalprice")
    return r.select(F.round("direct", 1).alias("direct"), F.round("by_entity", 1).alias("by_entity"), "agrees")


# cleaning

@plan("L01", f"WITH {DIRTY} SELECT DISTINCT c_custkey, c_acctbal FROM dirty")
def drop_duplicates(t):
    return cl.drop_duplicates(dirty(t)).select("c_custkey", "c_acctbal")


@plan("L01", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def drop_duplicates_subset(t):
    return cl.drop_duplicates(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@plan("L02 H18", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey = 0 THEN 'x' ELSE '' END AS mixed FROM orders")
def fix_types(t):
    s = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") == 0, "x").otherwise("")).alias("mixed"))
    fixed, found = cl.fix_types(s)
    assert found == ["d"], found
    return fixed.select("o_orderkey", _day("d").alias("d"), "mixed")


@plan("L03", f"WITH {DIRTY} SELECT c_custkey, round(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM dirty)), 4) AS bal FROM dirty")
def impute_median(t):
    d = dirty(t)
    return cl.fill(d, cl.learn_fill(d, ["c_acctbal"])).select("c_custkey", F.round("c_acctbal", 4).alias("bal"))


@plan("L03", f"WITH {DIRTY} SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM dirty)), 4) AS bal FROM dirty")
def impute_mean(t):
    d = dirty(t)
    return cl.fill(d, cl.learn_fill(d, ["c_acctbal"], "mean")).select("c_custkey", F.round("c_acctbal", 4).alias("bal"))


@plan("L04", f"WITH {DIRTY} SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS seg FROM dirty")
def impute_mode(t):
    d = dirty(t)
    return cl.fill(d, cl.learn_modes(d, ["c_mktsegment"])).select("c_custkey", F.col("c_mktsegment").alias("seg"))


@plan("L04 L05", f"WITH {DIRTY} SELECT c_custkey, coalesce(c_mktsegment, 'unknown') AS seg, CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END AS c_acctbal_is_missing FROM dirty")
def missing_indicator(t):
    d = cl.missing_indicators(dirty(t), ["c_acctbal"])
    return cl.fill(d, {"c_mktsegment": "unknown"}).select("c_custkey", F.col("c_mktsegment").alias("seg"), "c_acctbal_is_missing")


@plan("L07")
def impute_iterative(t):
    h = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
                          F.when(F.col("l_orderkey") % 11 != 0, F.col("l_tax")).alias("l_tax"))
    out = cl.impute_iterative(h, ["l_quantity", "l_extendedprice", "l_tax"])
    return out.agg(F.count("*").alias("n"), F.count("l_extendedprice").alias("filled"), F.round(F.avg("l_extendedprice"), 1).alias("mean"))


def _iqr(prev, col, name):
    return f"""{name}q AS (SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM {prev}),
  {name} AS (SELECT {prev}.* FROM {prev}, {name}q WHERE a = b OR {col} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"""


SEQ = ", ".join([_iqr("src", "c_acctbal", "s1"), _iqr("s1", "c_nationkey", "s2")])


@plan("L08", f"WITH {DIRTY}, src AS (SELECT * FROM dirty), {SEQ} SELECT c_custkey, c_acctbal FROM s2")
def remove_outliers_iqr(t):
    return cl.remove_outliers_iqr(dirty(t), ["c_acctbal", "c_nationkey"]).select("c_custkey", "c_acctbal")


@plan("L09", f"WITH {DIRTY} SELECT c_custkey FROM dirty, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM dirty) WHERE abs(c_acctbal - m) <= 3 * s")
def remove_outliers_zscore(t):
    return cl.remove_outliers_zscore(dirty(t), ["c_acctbal"]).select("c_custkey")


@plan("L10", "SELECT o_orderkey, round(least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.999) FROM orders)), 4) AS capped FROM orders")
def cap_quantile(t):
    return cl.cap_quantile(t.orders, "o_totalprice").select("o_orderkey", F.round("o_totalprice", 4).alias("capped"))


@plan("L10", "SELECT o_orderkey, round(greatest(least(o_totalprice, b), a), 4) AS w FROM orders, (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders)")
def winsorize(t):
    return cl.winsorize(t.orders, ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice", 4).alias("w"))


@plan("L11 L12", f"""WITH {DIRTY}, u AS (SELECT DISTINCT * FROM dirty), src AS (SELECT c_custkey, c_nationkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM u)) AS c_acctbal,
  coalesce(c_mktsegment, (SELECT c_mktsegment FROM u WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS seg FROM u),
  {_iqr("src", "c_custkey", "s1")}, {_iqr("s1", "c_nationkey", "s2")}, {_iqr("s2", "c_acctbal", "s3")} SELECT c_custkey, round(c_acctbal, 4) AS bal, lower(trim(seg)) AS seg FROM s3""")
def clean_table(t):
    cfg = cl.CleanConfig.from_dict({"normalize": ["c_mktsegment"], "required": ["c_custkey"]})
    out, _ = cl.clean_table(dirty(t), cfg)
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("bal"), F.col("c_mktsegment").alias("seg"))


@plan("L11", f"""WITH {DIRTY}, u AS (SELECT DISTINCT * FROM dirty) SELECT * FROM (SELECT 'original_rows' AS step, count(*) AS n FROM dirty UNION ALL
  SELECT 'duplicates_removed', (SELECT count(*) FROM dirty) - count(*) FROM u UNION ALL SELECT 'columns_to_datetime', 0 UNION ALL
  SELECT 'cells_filled', 2 * count(*) - count(c_acctbal) - count(c_mktsegment) FROM u UNION ALL SELECT 'outliers_removed', 0 UNION ALL SELECT 'final_rows', count(*) FROM u)""")
def clean_report(t):
    _, report = cl.clean_table(dirty(t), cl.CleanConfig(outliers=None))
    return t.spark.createDataFrame(report, "step string, n bigint")
