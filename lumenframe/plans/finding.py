"""Search and recommendation over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import retrieval as rt
from lumenframe.operators.neighbours import nearest
from lumenframe.plans.hashing import crc32
from lumenframe.plans.registry import plan
from lumenframe.plans.scoring import NEAR, vectors


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


W = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
BM25 = f"""d AS (SELECT doc_id, {W} AS w FROM documents), dl AS (SELECT doc_id, len(w) AS len, avg(len(w)) OVER () AS avgdl, count(*) OVER () AS n FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS (SELECT DISTINCT item_id AS qid, unnest({W}) AS term FROM benchmark),
  s AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 10) AS s FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
  b AS (SELECT qid AS query_id, doc_id AS item_id, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)"""


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("id"), "text")


@plan("U01", f"WITH {BM25} SELECT query_id, item_id, rank, round(score, 5) AS score FROM b")
def bm25_topk(t):
    return rt.bm25_topk(*_docs(t), 10).select("query_id", "item_id", "rank", F.round("score", 5).alias("score"))


@plan("U01", f"WITH d AS (SELECT doc_id, unnest({W}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY ALL) SELECT term, count(*) AS docs, sum(tf)::BIGINT AS uses FROM p GROUP BY term ORDER BY docs DESC, term LIMIT 200")
def inverted_index_top(t):
    i = rt.inverted_index(t.documents, "doc_id", "text")
    return i.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses")).orderBy(F.desc("docs"), "term").limit(200)


@plan("U02", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL) GROUP BY label),
  s AS (SELECT c.label AS query_id, vec_id AS item_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS s FROM c, embeddings) SELECT query_id, item_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(t):
    v = vectors(t)
    centroids = rt.group_centroids(v, "label", "vector").select(F.col("label").cast("bigint").alias("id"), "vector")
    return _r(rt.cosine_topk(centroids, v, 10), 6, "query_id", "item_id", "rank")


@plan("U03", f"WITH {NEAR.format(k=5)} SELECT query_id, item_id, round(s, 6) AS score, rank FROM k")
def knn_join(t):
    v = vectors(t)
    return _r(rt.knn_join(v, v, 5, block_rows=256), 6, "query_id", "item_id", "rank")


@plan("U03", """WITH n AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, -list_distance(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id)
  SELECT query_id, item_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM n QUALIFY rank <= 3""")
def knn_euclidean(t):
    v = vectors(t)
    return _r(rt.knn_join(v, v, 3, "euclidean"), 6, "query_id", "item_id", "rank")


@plan("U03", f"WITH {NEAR.format(k=5)} SELECT query_id, item_id, round(s, 6) AS score, rank FROM k")
def knn_pivots(t):
    """Exact, by cells and distance bounds."""
    v = vectors(t)
    return _r(nearest(v, v, 5), 6, "query_id", "item_id", "rank")


@plan("U03", f"WITH {NEAR.format(k=5)} SELECT query_id, item_id, round(s, 6) AS score, rank FROM k WHERE query_id % 50 = 0")
def knn_probes(t):
    """Approximate: the eight nearest cells of each fiftieth vector. The given tables have fewer cells than that, so all neighbours are found here."""
    v = vectors(t)
    return _r(nearest(v.where("id % 50 = 0"), v, 5, probes=8), 6, "query_id", "item_id", "rank")


@plan("U03")
def knn_lsh_recall(t):
    """Share of the true neighbours that hyperplane buckets find."""
    v = vectors(t)
    exact = nearest(v, v, 5).select("query_id", "item_id")
    near = rt.knn_lsh(v, v, 5, 64, bands=16, bits=3).select("query_id", "item_id", F.lit(1).alias("hit"))
    return exact.join(near, ["query_id", "item_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@plan("R07", f"WITH {NEAR.format(k=5)}, v AS (SELECT query_id, il, count(*) AS n FROM k GROUP BY ALL) SELECT query_id, il AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, il) = 1")
def knn_classify(t):
    v = vectors(t)
    return rt.knn_classify(v, v, "label", 5)


@plan("R07", f"WITH {NEAR.format(k=5)} SELECT query_id, round(avg(il), 6) AS predicted FROM k GROUP BY 1")
def knn_regress(t):
    v = vectors(t)
    return _r(rt.knn_regress(v, v, "label", 5), 6, "query_id")


@plan("U04", f"""WITH {BM25.replace("rank <= 10", "rank <= 20")}, t AS (SELECT term, {crc32("term")} % 128 AS bkt FROM (SELECT DISTINCT unnest({W}) AS term FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))),
  x AS (SELECT doc_id AS id, bkt, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({W}) AS term FROM documents) JOIN t USING (term) GROUP BY ALL), y AS (SELECT item_id AS id, bkt, count(*)::DOUBLE AS n FROM (SELECT item_id, unnest({W}) AS term FROM benchmark) JOIN t USING (term) GROUP BY ALL),
  xn AS (SELECT id, sqrt(sum(n * n)) AS len FROM x GROUP BY id), yn AS (SELECT id, sqrt(sum(n * n)) AS len FROM y GROUP BY id),
  dots AS (SELECT y.id AS query_id, x.id AS item_id, sum(x.n * y.n) AS dot FROM x JOIN y USING (bkt) GROUP BY ALL),
  v AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY dot / xn.len / yn.len DESC, item_id) AS rank FROM dots JOIN xn ON xn.id = item_id JOIN yn ON yn.id = query_id QUALIFY rank <= 20),
  f AS (SELECT query_id, item_id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, item_id, rank FROM b UNION ALL SELECT query_id, item_id, rank FROM v) GROUP BY ALL)
  SELECT query_id, item_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_search(t):
    """Keyword list and list by vectors of hashed terms of the same queries, fused."""
    docs, queries = _docs(t)
    near = nearest(rt.hashed_terms(queries), rt.hashed_terms(docs), 20, skip_self=False)
    return rt.fuse_ranks(rt.bm25_topk(docs, queries, 20), near, 10).select("query_id", "item_id", F.round("score", 9).alias("score"), "rank")


def co_bought(t):
    """Candidate parts per supplier with units, price and category."""
    lines = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("orders_n"), F.sum("l_quantity").alias("units"))
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    return lines.join(part, "l_partkey")


@plan("U05")
def rerank_candidates(t):
    c = co_bought(t).select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.col("orders_n").cast("double").alias("position"), "p_retailprice",
                            "units", (F.col("units") > 25).cast("double").alias("clicked"))
    c = rt.stored(c, "rerank-candidates")
    return rt.rerank(rt.fit_reranker(c, ["position", "p_retailprice"], "clicked"), c, 5)


@plan("U06", """WITH c AS (SELECT l_suppkey, l_partkey, p_type, sum(l_quantity) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_type ORDER BY units DESC, l_partkey) AS r FROM c)
  SELECT l_suppkey, l_partkey, p_type, units, row_number() OVER (PARTITION BY l_suppkey ORDER BY units DESC, l_partkey) AS rank FROM s WHERE r <= 2 QUALIFY rank <= 5""")
def two_stage_recommend(t):
    return rt.recommend(co_bought(t), "l_suppkey", "l_partkey", "units", "p_type", 5, 2)


@plan("U07", """WITH o AS (SELECT o_custkey, c_nationkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey), p AS (SELECT o_custkey, l_partkey FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, l_partkey) = 1),
  s AS (SELECT c_nationkey, l_partkey FROM (SELECT c_nationkey, l_partkey, count(*) AS n FROM o GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, l_partkey) = 1)
  SELECT c_custkey AS o_custkey, coalesce(p.l_partkey, s.l_partkey) AS l_partkey, CASE WHEN p.l_partkey IS NOT NULL THEN 'personal' ELSE 'segment' END AS origin FROM customer c LEFT JOIN p ON p.o_custkey = c.c_custkey LEFT JOIN s ON s.c_nationkey = c.c_nationkey""")
def cold_start_fallback(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey").join(c, "o_custkey")
    return rt.with_fallback(c, "o_custkey", "c_nationkey", rt.popular_items(o, "l_partkey", 1, ["o_custkey"]), rt.popular_items(o, "l_partkey", 1, ["c_nationkey"]),
                            rt.popular_items(o, "l_partkey", 1), "l_partkey")


_THRESHOLDS = (0.4, 0.92)


@plan("U08", f"""WITH n AS (SELECT q.vec_id AS id, max(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[])) AS s FROM embeddings q LEFT JOIN embeddings i ON i.vec_id < q.vec_id GROUP BY 1)
  SELECT threshold::DOUBLE AS threshold, count(*) AS queries, count_if(s >= threshold) AS hits, round(avg(coalesce((s >= threshold)::INT, 0)), 6) AS hit_rate, round(sum(CASE WHEN s >= threshold THEN 0 ELSE 0.005 END)::DOUBLE, 4) AS cost
  FROM n, (VALUES {", ".join(f"({x})" for x in _THRESHOLDS)}) AS c(threshold) GROUP BY threshold""")
def semantic_cache(t):
    """At a loose threshold, which has hits among unrelated vectors, and at the strict one of a cache in use."""
    out, near = None, rt.nearest_earlier(vectors(t), min(_THRESHOLDS))
    for x in _THRESHOLDS:
        c = rt.semantic_cache(vectors(t), x, 0.005, near)
        row = c.agg(F.lit(x).alias("threshold"), F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.sum("cost"), 4).alias("cost"))
        out = row if out is None else out.unionByName(row)
    return out


@plan("U09", r"""WITH r AS (SELECT CASE WHEN n > 60 THEN 'large' WHEN n > 20 OR contains(text, chr(10)) THEN 'medium' ELSE 'small' END AS tier FROM (SELECT text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role = 'user'))
  SELECT tier, count(*) AS n, round(sum(CASE tier WHEN 'large' THEN 0.01 WHEN 'medium' THEN 0.002 ELSE 0.0005 END)::DOUBLE, 6) AS cost FROM r GROUP BY tier""")
def query_router(t):
    r = rt.route_queries(t.conversations.where(F.col("role") == "user"), "text", {"large": 0.01, "medium": 0.002, "small": 0.0005})
    return r.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@plan("U10", """SELECT user_id, CAST(props->>'$.k' AS BIGINT) AS item, max(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0.0 END)::DOUBLE AS label FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY ALL""")
def implicit_labels(t):
    return rt.implicit_labels(t.events, "user_id", F.get_json_object("props", "$.k").cast("bigint"), "event_type")


@plan("U11", """WITH s AS (SELECT 1 + event_id % 10 AS rank, count(*) AS shown, avg((event_type = 'click')::INT) AS ctr FROM events GROUP BY 1) SELECT rank, shown, round(ctr, 6) AS ctr, round((SELECT ctr FROM s WHERE rank = 1) / nullif(ctr, 0), 6) AS weight FROM s""")
def position_bias_ctr(t):
    return _r(rt.position_ctr(t.events.withColumn("rank", 1 + F.col("event_id") % 10), "rank", F.col("event_type") == "click"), 6, "rank", "shown")


@plan("U12", """WITH RECURSIVE n AS (SELECT DISTINCT x.user_id AS a, y.user_id AS b FROM events x JOIN events y ON x.value = y.value AND x.props = y.props),
  r AS (SELECT a AS s, a AS v FROM n UNION SELECT s, b FROM r JOIN n ON n.a = r.v) SELECT s AS user_id, min(v) AS component FROM r GROUP BY s""")
def shared_attribute_components(t):
    """Users who have an event of the same properties and value in common."""
    e = t.events.where("value IS NOT NULL AND props IS NOT NULL").select("user_id", F.struct("value", "props").alias("a"))
    return rt.shared_attribute_components(e, "user_id", "a")
