"""Readers, writers and manifests over the given tables."""

from pyspark.sql import functions as F

from lumenframe.plans.registry import plan
from lumenframe.session import scratch_path
from lumenframe.sources import listings, readers, writers

ORDERS_CSV = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string")


@plan("A01 A10", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, "
      "strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY ALL")
def read_csv(t):
    path = scratch_path(t.spark, "orders-csv")
    writers.write_csv(t.orders, path)
    df = readers.read_csv(t.spark, path, ORDERS_CSV)
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"))


@plan("A02", "SELECT count(*) AS n, count(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END) AS with_balance, "
      "round(sum(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END), 2) AS total FROM customer")
def read_delimited(t):
    path = scratch_path(t.spark, "customer-psv")
    holed = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")))
    writers.write_csv(holed, path, sep="|", na="?")
    df = readers.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                          "c_mktsegment string", sep="|", na="?")
    return df.agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_balance"),
                  F.round(F.sum("c_acctbal"), 2).alias("total"))


@plan("A03", """SELECT status, count(*) AS n, count(test_score) AS tested, round(max(val_score), 4) AS best FROM (
  SELECT CASE WHEN p_size % 10 = 0 THEN 'CRASH' WHEN p_size % 3 = 0 THEN 'KEEP' ELSE 'DISCARD' END AS status,
         round(p_retailprice / 10000, 4) AS val_score,
         CASE WHEN p_size % 10 <> 0 THEN round(p_retailprice / 20000, 4) END AS test_score FROM part) GROUP BY status""")
def read_tsv_log(t):
    size = F.col("p_size")
    log = t.part.select(
        F.format_string("exp%06d", "p_partkey").alias("id"), F.lit("auc").alias("metric"),
        F.round(F.col("p_retailprice") / 10000, 4).alias("val_score"),
        F.when(size % 10 != 0, F.round(F.col("p_retailprice") / 20000, 4)).alias("test_score"),
        size.cast("double").alias("memory_mb"),
        F.when(size % 10 == 0, "CRASH").when(size % 3 == 0, "KEEP").otherwise("DISCARD").alias("status"),
        F.col("p_name").alias("description"))
    path = scratch_path(t.spark, "log-tsv")
    writers.write_csv(log, path, sep="\t", na="-")
    return readers.read_tsv_log(t.spark, path).groupBy("status").agg(
        F.count("*").alias("n"), F.count("test_score").alias("tested"), F.round(F.max("val_score"), 4).alias("best"))


@plan("A04 A10", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem "
      "WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY l_returnflag")
def read_parquet_filtered(t):
    since = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    df = readers.read_parquet(t.spark, f"{t.folder}/lineitem.parquet", since)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@plan("A05", "SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total, max(p_size) AS max_size "
      "FROM part GROUP BY p_type")
def read_arff(t):
    path = scratch_path(t.spark, "part-arff")
    head = ["% parts", "@RELATION part", "@ATTRIBUTE p_partkey integer", "@ATTRIBUTE 'p_name' string",
            "@ATTRIBUTE p_type {A,B}", "@ATTRIBUTE p_size integer", "@ATTRIBUTE p_retailprice numeric", "", "@DATA"]
    t.spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(path)
    quoted = F.concat_ws(",", F.col("p_partkey"), F.concat(F.lit("'"), "p_name", F.lit("'")),
                         F.col("p_type"), F.col("p_size"), F.col("p_retailprice"))
    t.part.select(quoted.alias("value")).write.mode("append").text(path)
    return readers.read_arff(t.spark, path).groupBy("p_type").agg(
        F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"), F.max("p_size").alias("max_size"))


@plan("A06", "SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS k_total FROM events GROUP BY event_type")
def read_json_lines(t):
    path = scratch_path(t.spark, "events-json")
    t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("props")).write.json(path)
    df = readers.read_json(t.spark, path, "event_id bigint, event_type string, props struct<k: bigint>")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("props.k").alias("k_total"))


@plan("A07", "SELECT count(*) AS n, count(DISTINCT p_name) AS questions, sum(length(lpad(CAST(p_size AS VARCHAR), 3, '0'))) "
      "AS answer_chars FROM part")
def read_xml_pairs(t):
    path = scratch_path(t.spark, "pairs-xml")
    pairs = t.part.select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("question"),
                          F.lpad(F.col("p_size").cast("string"), 3, "0").alias("answer"))
    pairs.write.format("xml").option("rowTag", "qa_pair").option("rootTag", "evaluation").save(path)
    return readers.read_xml_pairs(t.spark, path).agg(
        F.count("*").alias("n"), F.count_distinct("question").alias("questions"),
        F.sum(F.length("answer")).alias("answer_chars"))


@plan("A08", "SELECT lang, sum(length(text) + 1) AS chars, sum(length(text) - length(replace(text, chr(10), '')) + 1) AS line_breaks "
      "FROM documents GROUP BY lang")
def read_text_corpus(t):
    path = scratch_path(t.spark, "text-files")
    # text files of up to 200 documents; the writer ends each document with a line break
    t.documents.select("lang", "text").write.option("maxRecordsPerFile", 200).partitionBy("lang").text(path)
    df = readers.read_text_corpus(t.spark, path + "/lang=*/*.txt")
    return df.groupBy(F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("lang")).agg(
        F.sum("n_chars").alias("chars"), F.sum(F.col("n_lines") - 1).alias("line_breaks"))


@plan("A09", """SELECT doc_type, count(*) AS n FROM (SELECT CASE
  WHEN lower(url) LIKE '%.pdf%' THEN 'pdf' WHEN lower(url) LIKE '%.docx%' THEN 'docx'
  WHEN lower(url) LIKE '%.txt%' THEN 'txt' WHEN lower(url) LIKE '%.md%' THEN 'markdown'
  WHEN regexp_matches(lower(url), '\\.(jpg|jpeg|png|gif|webp|bmp)') THEN 'image' ELSE 'unknown' END AS doc_type
  FROM (SELECT url || CASE WHEN page_id % 5 = 0 THEN '.PDF' WHEN page_id % 5 = 1 THEN '/a.png' ELSE '' END AS url
        FROM pages)) GROUP BY doc_type""")
def detect_doc_type(t):
    tail = F.when(F.col("page_id") % 5 == 0, ".PDF").when(F.col("page_id") % 5 == 1, "/a.png").otherwise("")
    return t.pages.select(readers.detect_doc_type(F.concat("url", tail)).alias("doc_type")).groupBy("doc_type").agg(
        F.count("*").alias("n"))


@plan("A11", "SELECT '{\"lang\":\"' || lang || '\",\"n\":' || count(*) || '}' AS report FROM documents GROUP BY lang")
def json_report(t):
    path = scratch_path(t.spark, "report-json")
    counts = t.documents.groupBy("lang").agg(F.count("*").alias("n"))
    writers.write_json_report(counts, path)
    back = readers.read_json(t.spark, path, "lang string, n bigint")
    return writers.json_report(back)


@plan("A12", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS dt, count(*) AS n, "
      "round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' GROUP BY 1")
def write_partitioned(t):
    path = scratch_path(t.spark, "orders-by-day")
    writers.write_partitioned(t.orders, path, "o_orderdate", ["o_custkey"], grain="month")
    kept = t.spark.read.parquet(path).where(F.col("dt") >= F.lit("2001-07-01").cast("date"))
    return kept.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("A13", """SELECT f.o_custkey, strftime(f.o_orderdate, '%Y-%m-%d') AS day, f.spend, l.urgent FROM
  (SELECT o_custkey, o_orderdate, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY ALL) f JOIN
  (SELECT o_custkey, o_orderdate, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
   FROM orders GROUP BY ALL) l USING (o_custkey, o_orderdate)
  WHERE f.o_orderdate BETWEEN TIMESTAMP '2001-05-03' AND TIMESTAMP '2001-08-01'""")
def export_training_set(t):
    keys = ["o_custkey", "o_orderdate"]
    feats = t.orders.groupBy(*keys).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    labels = t.orders.groupBy(*keys).agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent"))
    path = scratch_path(t.spark, "training-set")
    writers.write_parquet(writers.export_training_set(feats, labels, ["o_custkey"], "o_orderdate",
                                                      "2001-05-03", "2001-08-01"), path)
    return t.spark.read.parquet(path).select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "spend", "urgent")


@plan("A14", """SELECT 'nation' AS dataset, count(*) AS n_rows, 3 AS n_columns, '2024-01-31' AS created,
  CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))), 1, 8)
  AS BIGINT)) AS BIGINT) AS checksum FROM nation""")
def data_manifest(t):
    return listings.data_manifest(t.nation, "nation", "2024-01-31")


@plan("A15", """SELECT title, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title))
  ORDER BY source, doc_id) AS rn FROM (SELECT doc_id, source, split_part(text, ' ', 1) AS title FROM documents))
  WHERE rn = 1 AND trim(title) <> '' ORDER BY source, doc_id LIMIT 50""")
def merge_dataset_listings(t):
    docs = t.documents.select("doc_id", "source", F.split_part("text", F.lit(" "), F.lit(1)).alias("title"))
    web = docs.where(F.col("source") == "web")
    rest = docs.where(F.col("source") != "web")
    return listings.merge_listings([web, rest], "title", "source", "doc_id", 50)


@plan("A16", """SELECT doc_id, 'cc-' || lang AS license, source || ',' || lang AS tasks FROM documents""")
def parse_tags(t):
    tags = F.array(F.concat(F.lit("license:cc-"), "lang"), F.concat(F.lit("task_categories:"), "source"),
                   F.lit("size:small"), F.concat(F.lit("task_categories:"), "lang"))
    return t.documents.select("doc_id", listings.tag_value(tags, "license").alias("license"),
                              F.array_join(listings.tag_values(tags, "task_categories"), ",").alias("tasks"))
