"""Idempotent writes, versions, experiment logs and the user-function surface over the given tables."""

import pandas as pd
from pyspark.sql import functions as F

from lumenframe.functions import udfs
from lumenframe.operators import bookkeeping as bk
from lumenframe.operators.scaling import neighbours
from lumenframe.plans.registry import plan
from lumenframe.sources.keyed_table import KeyedTable
from lumenframe.session import scratch_path


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


YEARLY = "SELECT year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def _yearly(df):
    return df.groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("V01", YEARLY)
def overwrite_partition(t):
    path = scratch_path(t.spark, "by-year")
    o = t.orders.withColumn("y", F.year("o_orderdate"))
    bk.overwrite_partition(o, path, "y")
    for _ in range(2):  # the same partition again: nothing doubles
        bk.overwrite_partition(o.where(F.col("y") == 1999), path, "y")
    return _yearly(t.spark.read.parquet(path))


@plan("V02", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0""")
def merge_upsert(t):
    c = t.customer.select("c_custkey", "c_acctbal", F.lit(1).alias("rev"))
    src = c.where(F.col("c_custkey") % 3 == 0).select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(2).alias("rev"))
    older = src.select("c_custkey", (F.col("c_acctbal") - 7).alias("c_acctbal"), F.lit(1).alias("rev"))
    return bk.merge_upsert(c.where(F.col("c_custkey") % 5 != 0), src.unionByName(older), ["c_custkey"], ["-rev"]).select("c_custkey", "c_acctbal")


@plan("V02", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0""")
def keyed_merge(t):
    """The same merge into a stored table of key ranges."""
    c = t.customer.select("c_custkey", "c_acctbal", F.lit(1).alias("rev"))
    src = c.where(F.col("c_custkey") % 3 == 0).select("c_custkey", (F.col("c_acctbal") + 1).cast(c.schema["c_acctbal"].dataType).alias("c_acctbal"), F.lit(2).alias("rev"))
    older = src.select("c_custkey", (F.col("c_acctbal") - 7).cast(c.schema["c_acctbal"].dataType).alias("c_acctbal"), F.lit(1).alias("rev"))
    table = KeyedTable(t.spark, scratch_path(t.spark, "keyed"), ["c_custkey"])
    table.merge(c.where(F.col("c_custkey") % 5 != 0))
    table.merge(src.unionByName(older), ["-rev"])
    return table.read().select("c_custkey", "c_acctbal")


@plan("V03", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 2) AS total, 3 AS versions FROM events")
def incremental_load(t):
    root = scratch_path(t.spark, "incremental")
    for until in ("2024-01-12", "2024-01-21", "2024-02-01"):
        table = bk.incremental(t.spark, root, t.events.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")), ["event_id"], "ts")
    return table.read().agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"),
                                              F.lit(len(table.versions())).alias("versions"))


@plan("V04", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' GROUP BY ALL")
def backfill_days(t):
    path = scratch_path(t.spark, "backfill")

    def build(day):
        return t.events.where(F.to_date("ts") == F.lit(day).cast("date")).groupBy("event_type").agg(F.count("*").alias("n"))

    bk.backfill(["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-06"], build, path, "day")
    return t.spark.read.schema("event_type string, n bigint, day string").parquet(path)


@plan("V05", "SELECT how, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer, (VALUES ('view'), ('table'), ('incremental'), ('ephemeral')) v(how) GROUP BY how")
def materializations(t):
    root = scratch_path(t.spark, "models")
    c = t.customer.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    out = None
    for how in ("view", "table", "incremental", "ephemeral"):
        m = bk.materialize(c, how, f"lf_model_{how}", root, ["c_custkey"], "ts").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumn("how", F.lit(how))
        out = m if out is None else out.unionByName(m)
    return out


@plan("V06", """SELECT c_mktsegment, round(sum(total), 2) AS total, 'staged,spend,segments' AS run_order, 'spend,segments' AS downstream FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def model_graph(t):
    g = bk.ModelGraph()
    g.add("segments", lambda spend, c: spend.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.round(F.sum("total"), 2).alias("total")), ["spend", "customer"])
    g.add("spend", lambda s: s.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), ["staged"])
    g.add("staged", lambda o: o.where(F.col("o_orderstatus") == "F"), ["orders"])
    built = g.build({"orders": t.orders, "customer": t.customer})
    return built["segments"].withColumn("run_order", F.lit(",".join(g.order()))).withColumn("downstream", F.lit(",".join(g.downstream("spend"))))


@plan("V07", "SELECT 1 AS version, count(*) AS n FROM nation UNION ALL SELECT 2, count(*) FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 3, count(*) FROM nation WHERE n_regionkey > 1")
def snapshot_versions(t):
    root = scratch_path(t.spark, "versions")
    for df in (t.nation, t.nation.where(F.col("n_regionkey") != 0), t.nation.where(F.col("n_regionkey") > 1)):
        bk.write_version(df, root)
    out = None
    for v in bk.versions(t.spark, root):
        one = bk.read_version(t.spark, root, v).agg(F.lit(v).alias("version"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


SCD = """c AS (SELECT o_custkey, o_orderstatus, o_orderdate, o_orderkey, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders), s AS (SELECT * FROM c WHERE p IS NULL OR p <> o_orderstatus),
  v AS (SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM s)"""


@plan("V08", f"WITH {SCD} SELECT o_custkey, o_orderstatus, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to, valid_to IS NULL AS is_current FROM v")
def scd2_status(t):
    s = bk.scd2(t.orders, "o_custkey", "o_orderdate", ["o_orderstatus"], ["o_orderkey"])
    return s.select("o_custkey", "o_orderstatus", _day("valid_from").alias("valid_from"), _day("valid_to").alias("valid_to"), "is_current")


@plan("V08 V07", f"WITH {SCD} SELECT o_orderstatus, count(*) AS n FROM v WHERE valid_from <= TIMESTAMP '2000-01-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-01-01') GROUP BY 1")
def valid_at_date(t):
    s = bk.scd2(t.orders, "o_custkey", "o_orderdate", ["o_orderstatus"], ["o_orderkey"])
    return bk.valid_at(s, F.lit("2000-01-01").cast("timestamp_ntz")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def runs(t):
    """An experiment log from parts: one run per part, brands as models."""
    s = F.round(F.col("p_retailprice") / 10000 + (F.col("p_size") % 7) / 1000, 6)
    return t.part.select(F.format_string("exp%08d", "p_partkey").alias("id"), F.col("p_brand").alias("model"), F.col("p_partkey").alias("seq"),
                         F.when(F.col("p_size") % 11 != 0, s).alias("val_score"), F.when(F.col("p_size") % 11 == 0, "CRASH").when(F.col("p_size") % 2 == 0, "KEEP").otherwise("DISCARD").alias("status"))


RUNS = """r AS (SELECT printf('exp%08d', p_partkey) AS id, p_brand AS model, p_partkey AS seq, CASE WHEN p_size % 11 <> 0 THEN round(p_retailprice / 10000 + (p_size % 7) / 1000, 6) END AS val_score,
  CASE WHEN p_size % 11 = 0 THEN 'CRASH' WHEN p_size % 2 = 0 THEN 'KEEP' ELSE 'DISCARD' END AS status FROM part)"""


@plan("V09", f"""WITH {RUNS}, k AS (SELECT * FROM r WHERE status = 'KEEP' AND val_score > 0) SELECT count(*) AS total, count_if(status = 'KEEP') AS keep, count_if(status = 'DISCARD') AS discard, count_if(status = 'CRASH') AS crash,
  (SELECT min(val_score) FROM k) AS baseline, (SELECT max(val_score) FROM k) AS best, (SELECT id FROM k ORDER BY val_score DESC, id DESC LIMIT 1) AS best_id, (SELECT round(max(val_score) - min(val_score), 6) FROM k) AS improvement FROM r""")
def results_summary(t):
    return bk.results_summary(runs(t)).withColumn("improvement", F.round("improvement", 6))


@plan("V09 F02", f"WITH {RUNS} SELECT id, val_score FROM r WHERE status = 'KEEP' AND val_score > 0 ORDER BY val_score DESC, id LIMIT 5")
def top_runs(t):
    return bk.top_runs(runs(t)).select("id", "val_score")


DECIDED = f"""{RUNS}, d AS (SELECT *, CASE WHEN val_score IS NULL THEN 'CRASH' WHEN max(val_score) OVER w IS NULL OR val_score > max(val_score) OVER w THEN 'KEEP' ELSE 'DISCARD' END AS decision FROM r
  WINDOW w AS (PARTITION BY model ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@plan("V10 E13", f"WITH {DECIDED} SELECT id, decision FROM d")
def keep_discard(t):
    return bk.keep_discard(runs(t), ["model"], ["seq"], "val_score").select("id", "decision")


@plan("V11 E12", f"""WITH {DECIDED}, k AS (SELECT model, seq, (val_score - lag(val_score, 2) OVER (PARTITION BY model ORDER BY seq)) / nullif(lag(val_score, 2) OVER (PARTITION BY model ORDER BY seq), 0) AS g FROM d WHERE decision = 'KEEP'),
  w AS (SELECT *, sum((decision = 'DISCARD')::INT) OVER (PARTITION BY model ORDER BY seq ROWS 2 PRECEDING) AS dd, lag(val_score, 4) OVER (PARTITION BY model ORDER BY seq) AS f, max(val_score) OVER (PARTITION BY model ORDER BY seq ROWS 4 PRECEDING) AS m FROM d)
  SELECT id, CASE WHEN dd = 3 THEN 'three_discards' WHEN g < 0.001 THEN 'flat_keeps' WHEN (m - f) / nullif(f, 0) < 0.0025 THEN 'flat_window' END AS stop_reason FROM w LEFT JOIN k USING (model, seq)""")
def stopping_rule(t):
    d = bk.keep_discard(runs(t), ["model"], ["seq"], "val_score")
    return bk.stopping_rule(d, ["model"], ["seq"], "val_score").select("id", "stop_reason")


@plan("V12", f"""WITH {RUNS}, k AS (SELECT id, row_number() OVER (PARTITION BY model ORDER BY val_score DESC, seq) AS rn FROM r WHERE status = 'KEEP' AND val_score > 0) SELECT id, CASE WHEN rn IS NULL THEN 'registered' WHEN rn = 1 THEN 'production' WHEN rn = 2 THEN 'staging' ELSE 'archived' END AS stage FROM r LEFT JOIN k USING (id)""")
def stage_promotion(t):
    return bk.stage_promotion(runs(t), "model", "seq", "val_score", (F.col("status") == "KEEP") & (F.col("val_score") > 0)).select("id", "stage")


# user functions

@plan("J01", "SELECT o_orderkey, round(o_totalprice * 1.08, 4) AS with_tax FROM orders")
def scalar_function(t):
    taxed = udfs.scalar(lambda s: s * 1.08, "double")
    return t.orders.select("o_orderkey", F.round(taxed("o_totalprice"), 4).alias("with_tax"))


def _hits(pdf: pd.DataFrame) -> dict:
    return {"n": float(len(pdf)), "s": float(pdf["l_extendedprice"].sum()), "sq": float((pdf["l_extendedprice"] ** 2).sum())}


def _add(pdf: pd.DataFrame) -> dict:
    return {c: float(pdf[c].sum()) for c in ("n", "s", "sq")}


def _cv(pdf: pd.DataFrame) -> dict:
    r = pdf.iloc[0]
    mean = r["s"] / r["n"]
    return {"cv": float((r["sq"] / r["n"] - mean * mean) ** 0.5 / mean)}


@plan("J02 J03", "SELECT l_returnflag, round(stddev_pop(l_extendedprice) / avg(l_extendedprice), 6) AS cv FROM lineitem GROUP BY 1")
def custom_aggregate(t):
    a = udfs.custom_aggregate(t.lineitem, ["l_returnflag"], ["l_extendedprice"], _hits, _add, _cv, "n double, s double, sq double", "cv double")
    return a.select("l_returnflag", F.round("cv", 6).alias("cv"))


@plan("J06 E05", """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 1 PRECEDING), 2) AS s_2, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 4 PRECEDING), 2) AS s_5 FROM orders""")
def macro_windows(t):
    m = neighbours(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], udfs.rolling_macros(F.sum, "o_totalprice", [2, 5], "s"), before=4)
    return m.select("o_orderkey", F.round("s_2", 2).alias("s_2"), F.round("s_5", 2).alias("s_5"))


@plan("J07", "SELECT o_custkey, count(*) AS orders_n, round(avg(o_totalprice), 4) AS mean_order FROM orders GROUP BY 1")
def feature_definitions(t):
    book = udfs.FeatureBook("o_custkey")

    @book.feature("orders_n", "analytics", "orders per customer")
    def orders_n(df):
        return df.groupBy("o_custkey").agg(F.count("*").alias("orders_n"))

    @book.feature("mean_order", "analytics", "mean order value", fresh_hours=6)
    def mean_order(df):
        return df.groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_order"))

    return book.compute(t.orders, ["orders_n", "mean_order"])
