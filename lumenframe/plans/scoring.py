"""Model-quality figures over predictions derived from labels and documents."""

from pyspark.sql import functions as F

from lumenframe.functions import scalars as fn
from lumenframe.operators import evaluation as ev
from lumenframe.operators import retrieval as rt
from lumenframe.operators.neighbours import nearest
from lumenframe.plans.registry import plan


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


def predictions(t):
    """doc_id, y, p, yhat, segment columns and a day, by rules on the key."""
    p = F.round(0.3 * F.col("quality") + 0.7 * fn.hash_unit(F.col("doc_id")), 2)
    d = t.documents.select("doc_id", "source", "lang")
    return t.labels.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), "toxic", p.alias("p"), (p >= 0.5).cast("int").alias("yhat"), "source", "lang",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("day"))


PRED = """p AS (SELECT doc_id, quality AS y, toxic, round(0.3 * quality + 0.7 * (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0), 2) AS p,
  (round(0.3 * quality + 0.7 * (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0), 2) >= 0.5)::INT AS yhat, source, lang,
  DATE '2024-01-01' + (doc_id % 30)::INT AS day FROM labels JOIN documents USING (doc_id))"""
CM = "count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp, count_if(y = 1 AND yhat = 0) AS fn, count_if(y = 0 AND yhat = 0) AS tn"
RATES = """round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity,
  round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f_beta"""
KEEP = ("tp", "fp", "fn", "tn", "source", "lang")


@plan("Q01", f"WITH {PRED} SELECT y, yhat, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(t):
    return ev.confusion(predictions(t), "y", "yhat")


@plan("Q02", f"WITH {PRED}, c AS (SELECT {CM} FROM p) SELECT tp, fp, fn, tn, {RATES} FROM c")
def binary_metrics(t):
    return _r(ev.binary_metrics(predictions(t), "y", "yhat"), 6, *KEEP)


def _classes(t):
    """Label and nearest-centroid style guess per vector: guess is right unless the hash says otherwise."""
    return t.embeddings.select("vec_id", "label", F.when(fn.hash_unit(F.col("vec_id")) < 0.7, F.col("label")).otherwise((F.col("label") + 1) % 9).alias("guess"))


CLASSES = """c AS (SELECT vec_id, label, CASE WHEN CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN label ELSE (label + 1) % 9 END AS guess FROM embeddings),
  r AS (SELECT k AS class, count_if(label = k) AS support, count_if(guess = k) AS predicted, count_if(label = k AND guess = k) AS tp FROM c, (SELECT DISTINCT label AS k FROM embeddings) GROUP BY k),
  s AS (SELECT class, support, predicted, tp, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall, 2 * tp / nullif(predicted + support, 0) AS f1 FROM r)"""


@plan("Q03", f"WITH {CLASSES} SELECT class, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def classification_report(t):
    return _r(ev.class_report(_classes(t), "label", "guess"), 6, "class", "support", "predicted", "tp")


@plan("Q03", f"""WITH {CLASSES} SELECT round(2 * sum(tp) / sum(predicted + support), 6) AS micro_f1, round(avg(coalesce(f1, 0)), 6) AS macro_f1, round(sum(coalesce(f1, 0) * support) / sum(support), 6) AS weighted_f1,
  round(avg(coalesce(precision, 0)), 6) AS macro_precision, round(avg(coalesce(recall, 0)), 6) AS macro_recall FROM s""")
def averaged_f1(t):
    return _r(ev.averaged_report(ev.class_report(_classes(t), "label", "guess")), 6)


AUC = "sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END)"


@plan("Q04", f"WITH {PRED} SELECT round({AUC} / count(*), 6) AS auc FROM (SELECT p FROM p WHERE y = 1) a, (SELECT p FROM p WHERE y = 0) b")
def roc_auc(t):
    return _r(ev.roc_auc(predictions(t), "y", "p"), 6)


CURVE = "c AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY p), k AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM c)"


@plan("Q04", f"WITH {PRED}, {CURVE} SELECT p AS threshold, round(cp / ap, 6) AS tpr, round(cn / an, 6) AS fpr FROM k")
def roc_curve(t):
    return _r(ev.roc_curve(predictions(t), "y", "p"), 6, "threshold")


@plan("Q05", f"WITH {PRED}, {CURVE} SELECT p AS threshold, round(cp / (cp + cn), 6) AS precision, round(cp / ap, 6) AS recall FROM k")
def pr_curve(t):
    return _r(ev.pr_curve(predictions(t), "y", "p").drop("_step"), 6, "threshold")


@plan("Q05", f"WITH {PRED}, {CURVE} SELECT round(sum(cp / (cp + cn) * pos / ap), 6) AS average_precision FROM k")
def average_precision(t):
    return _r(ev.average_precision(predictions(t), "y", "p"), 6)


GRID = [i / 20 for i in range(1, 20)]


def _sweep_sql(extra=""):
    return f"""WITH {PRED}, t AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold), c AS (SELECT threshold, count_if(y = 1 AND p >= threshold) AS tp, count_if(y = 0 AND p >= threshold) AS fp,
  count_if(y = 1 AND p < threshold) AS fn, count_if(y = 0 AND p < threshold) AS tn FROM p, t GROUP BY threshold)"""


@plan("Q06", _sweep_sql() + " SELECT threshold, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, (5 * fn + fp)::DOUBLE AS cost FROM c")
def threshold_sweep(t):
    s = ev.threshold_sweep(predictions(t), "y", "p", GRID, c_fn=5, c_fp=1)
    return s.select("threshold", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.col("cost").cast("double").alias("cost"))


@plan("Q06", _sweep_sql() + " SELECT threshold, (5 * fn + fp)::DOUBLE AS cost, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c ORDER BY cost, threshold LIMIT 1")
def cost_optimal_threshold(t):
    s = ev.cheapest_threshold(ev.threshold_sweep(predictions(t), "y", "p", GRID, c_fn=5, c_fp=1))
    return s.select("threshold", F.col("cost").cast("double").alias("cost"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@plan("Q07", f"WITH {PRED}, {CURVE} SELECT round(max(cp / (cp + cn)), 6) AS precision, arg_max(p, cp / (cp + cn)) AS threshold FROM k WHERE cp / ap >= 0.95")
def precision_at_recall(t):
    return _r(ev.precision_at_recall(predictions(t), "y", "p", 0.95), 6, "threshold")


@plan("Q08", f"""WITH {PRED}, q AS (SELECT y, p, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM p) SELECT round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier,
  round(exp(avg(-(y * ln(q) + (1 - y) * ln(1 - q)))), 6) AS perplexity FROM q""")
def probability_losses(t):
    return _r(ev.probability_losses(predictions(t), "y", "p"), 6)


CAL = "c AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate FROM p GROUP BY 1)"


@plan("Q09", f"WITH {PRED}, {CAL} SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, (SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) FROM c) AS ece FROM c")
def calibration_curve(t):
    c = ev.calibration(predictions(t), "y", "p")
    ece = ev.expected_calibration_error(c).first()["ece"]
    return _r(c, 6, "bin", "n").withColumn("ece", F.round(F.lit(ece), 6))


@plan("Q11", """WITH p AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS h FROM orders) SELECT round(sqrt(avg(pow(y - h, 2))), 4) AS rmse, round(avg(abs(y - h)), 4) AS mae,
  round(avg(CASE WHEN y <> 0 THEN abs((y - h) / y) END) * 100, 4) AS mape, round(avg(2 * abs(y - h) / (abs(y) + abs(h))) * 100, 4) AS smape, round(1 - sum(pow(y - h, 2)) / (var_pop(y) * count(*)), 8) AS r2,
  round(1 - (sum(pow(y - h, 2)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 2), 8) AS adj_r2 FROM p""")
def regression_metrics(t):
    from lumenframe.operators.scaling import with_totals
    p = with_totals(t.orders, ["o_orderpriority"], [F.avg("o_totalprice").alias("h")])
    m = ev.regression_metrics(p, "o_totalprice", "h")
    return m.select(*[F.round(c, 4).alias(c) for c in ("rmse", "mae", "mape", "smape")], F.round("r2", 8).alias("r2"), F.round("adj_r2", 8).alias("adj_r2"))


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


NEAR = """n AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS ql, i.label AS il, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM n QUALIFY rank <= {k})"""


@plan("Q12", f"""WITH {NEAR.format(k=10)}, h AS (SELECT *, (ql = il)::INT AS r, sum((ql = il)::INT) OVER (PARTITION BY query_id ORDER BY rank) AS h FROM k), t AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS nr FROM embeddings),
  m AS (SELECT query_id, nr, sum(r) AS hits, sum(r / log2(rank + 1)) AS dcg, sum(r * h / rank) AS ap, min(CASE WHEN r = 1 THEN rank END) AS first FROM h JOIN t USING (query_id) GROUP BY ALL)
  SELECT round(avg(hits / 10), 6) AS precision, round(avg(coalesce(hits / nullif(nr, 0), 0)), 6) AS recall, round(avg(coalesce(dcg / nullif(list_sum(list_transform(range(1, least(nr, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 0)), 6) AS ndcg,
  round(avg(coalesce(ap / nullif(least(nr, 10), 0), 0)), 6) AS map, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m""")
def ranking_metrics(t):
    v = vectors(t)
    near = nearest(v, v, 10)
    lab = v.select("id", "label")
    sizes = lab.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    j = (near.join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")
         .join(lab.select(F.col("id").alias("item_id"), F.col("label").alias("il")), "item_id").withColumn("rel", (F.col("ql") == F.col("il")).cast("int")))
    totals = lab.join(sizes, "label").select(F.col("id").alias("query_id"), "n_relevant")
    return _r(ev.mean_of(ev.ranking_metrics(j, "query_id", "rank", "rel", totals, 10), ["precision", "recall", "ndcg", "map", "mrr"]), 6)


@plan("Q13", f"""WITH {NEAR.format(k=1)} SELECT round(count(DISTINCT item_id) / (SELECT count(*) FROM embeddings), 6) AS coverage, round(count(DISTINCT il) / (SELECT count(DISTINCT label) FROM embeddings), 6) AS category_coverage FROM k""")
def catalog_coverage(t):
    v = vectors(t)
    shown = nearest(v, v, 1).select(F.col("item_id").alias("id"))
    return _r(ev.catalog_coverage(shown, "id", v, "label"), 6)


def _kappa_sql(w):
    d = {"none": "(x <> y)::INT", "linear": "abs(x - y)", "quadratic": "pow(x - y, 2)"}[w]
    return f"SELECT '{w}' AS weights, 1 - (SELECT avg({d}) FROM r) / (SELECT sum(a.n * b.n * {d.replace('x', 'a.x').replace('y', 'b.y')}) / pow((SELECT count(*) FROM r), 2) FROM a, b) AS k"


@plan("Q14", f"""WITH r AS (SELECT least(p_size // 10, 4) AS x, CASE WHEN p_partkey % 3 = 0 THEN least(p_size // 12, 4) ELSE least(p_size // 10, 4) END AS y FROM part), a AS (SELECT x, count(*)::DOUBLE AS n FROM r GROUP BY 1), b AS (SELECT y, count(*)::DOUBLE AS n FROM r GROUP BY 1)
  SELECT weights, round(k, 6) AS kappa, (SELECT round(avg((x = y)::INT), 6) FROM r) AS agreement FROM ({' UNION ALL '.join(_kappa_sql(w).replace('a.a.', 'a.').replace('b.b.', 'b.') for w in ('none', 'linear', 'quadratic'))})""")
def cohens_kappa(t):
    s = F.col("p_size")
    cap = lambda n: F.least(F.floor(s / n), F.lit(4))
    r = t.part.select(cap(10).alias("x"), F.when(F.col("p_partkey") % 3 == 0, cap(12)).otherwise(cap(10)).alias("y"))
    out = None
    for w in ("none", "linear", "quadratic"):
        k = ev.kappa(r, "x", "y", w).select(F.lit(w).alias("weights"), F.round("kappa", 6).alias("kappa"), F.round("agreement", 6).alias("agreement"))
        out = k if out is None else out.unionByName(k)
    return out


def verdicts(t):
    """One forward and one swapped verdict per turn, by rules on the key and the text length."""
    n = F.length("text")
    base = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("pair_id"), n.alias("len_a"), ((n * 7 + F.col("turn") * 31) % 400).alias("len_b"), "turn")
    fwd = F.when(F.col("len_a") > F.col("len_b"), "A").when(F.col("len_a") < F.col("len_b"), "B").otherwise("tie")
    swp = F.when(F.col("turn") % 3 == 0, "A").when(F.col("len_a") > F.col("len_b"), "B").otherwise("A")
    return base.withColumn("pass", F.lit("forward")).withColumn("verdict", fwd).unionByName(base.withColumn("pass", F.lit("swapped")).withColumn("verdict", swp))


VERD = """b AS (SELECT conv_id || '-' || turn AS pair_id, length(text) AS la, (length(text) * 7 + turn * 31) % 400 AS lb, turn FROM conversations),
  v AS (SELECT *, CASE WHEN la > lb THEN 'A' WHEN la < lb THEN 'B' ELSE 'tie' END AS f, CASE WHEN turn % 3 = 0 THEN 'B' WHEN la > lb THEN 'A' ELSE 'B' END AS s FROM b)"""


@plan("Q15", f"WITH {VERD} SELECT CASE WHEN f = s THEN f ELSE 'tie' END AS verdict, f = s AS consistent, count(*) AS n FROM v GROUP BY ALL")
def judge_consistency(t):
    return ev.judge_consistency(verdicts(t), "pair_id", "pass", "verdict").groupBy("verdict", "consistent").agg(F.count("*").alias("n"))


@plan("Q16", "SELECT doc_id, round((CASE WHEN quality IS NOT NULL THEN (1 + 4 * quality) * 0.5 ELSE 0 END + (1 + doc_id % 5) * 0.3 + (5 - 4 * toxic) * 0.2) / 1.0, 4) AS score FROM labels")
def rubric_score(t):
    s = t.labels.select("doc_id", (1 + 4 * F.col("quality")).alias("accuracy"), (1 + F.col("doc_id") % 5).alias("style"), (5 - 4 * F.col("toxic")).alias("safety"))
    return _r(ev.rubric_score(s, "doc_id", {"accuracy": 0.5, "style": 0.3, "safety": 0.2}), 4, "doc_id")


@plan("Q17", f"WITH {VERD} SELECT round(avg(CASE f WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 END), 6) AS first_wins, round(corr(CASE f WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 END, la - lb), 6) AS length_corr FROM v")
def judge_bias(t):
    return _r(ev.judge_bias(verdicts(t).where(F.col("pass") == "forward"), "verdict", F.col("len_a"), F.col("len_b")), 6)


@plan("Q18", """SELECT count(*) AS n, count_if(p_size % 10 = p_partkey % 10) AS correct, round(100.0 * count_if(p_size % 10 = p_partkey % 10) / count(*), 4) AS accuracy, round(avg(p_retailprice / 100), 4) AS mean_seconds,
  round(avg(p_size % 4), 4) AS mean_calls, sum(p_size % 4)::BIGINT AS total_calls FROM part""")
def exact_match_eval(t):
    d = t.part.select((F.col("p_size") % 10).cast("string").alias("e"), (F.col("p_partkey") % 10).cast("string").alias("a"), (F.col("p_retailprice") / 100).alias("s"), (F.col("p_size") % 4).alias("c"))
    return _r(ev.exact_match(d, "e", "a", "s", "c"), 4, "n", "correct", "total_calls")


def _turn_pairs(t):
    a = t.conversations.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ref"))
    b = t.conversations.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    return a.join(b, ["conv_id", "turn"]).select(F.concat_ws("-", "conv_id", "turn").alias("k"), "ref", "cand")


W = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@plan("Q19", f"""WITH pr AS (SELECT a.conv_id || '-' || a.turn AS k, {W.format('a.text')} AS r, {W.format('b.text')} AS c FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
  x AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest(r) AS g FROM pr) GROUP BY ALL), y AS (SELECT k, g, count(*) AS n FROM (SELECT k, unnest(c) AS g FROM pr) GROUP BY ALL),
  m AS (SELECT k, sum(least(x.n, y.n)) AS m FROM x JOIN y USING (k, g) GROUP BY k) SELECT k, round(coalesce(m / nullif(len(c), 0), 0), 6) AS precision, round(coalesce(m / nullif(len(r), 0), 0), 6) AS recall, round(coalesce(2 * m / nullif(len(r) + len(c), 0), 0), 6) AS f1 FROM pr LEFT JOIN m USING (k)""")
def rouge_one(t):
    return _r(ev.ngram_overlap(_turn_pairs(t), "k", "ref", "cand", 1), 6, "k")


@plan("Q19")
def rouge_l_and_bleu(t):
    p = _turn_pairs(t)
    return ev.rouge_l(p, "k", "ref", "cand").join(ev.bleu(p, "k", "ref", "cand", 2), "k").agg(
        F.count("*").alias("n"), F.avg("rouge_l").alias("rouge_l"), F.avg("bleu").alias("bleu"))


@plan("Q20", """WITH e AS (SELECT user_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS want, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'click' ELSE event_type END AS got, value FROM events)
  SELECT CASE WHEN want IS NULL AND got IS NULL THEN 'right_none' WHEN want IS NULL THEN 'unneeded' WHEN got IS NULL THEN 'missed' WHEN want = got THEN 'right' ELSE 'wrong' END AS outcome, count(*) AS n, count(DISTINCT user_id) AS tasks, round(sum(value), 2) AS cost FROM e GROUP BY 1""")
def tool_selection(t):
    e, i = F.col("event_type"), F.col("event_id")
    want = F.when(e != "view", e)
    got = F.when(i % 5 == 0, None).when(i % 7 == 0, "click").otherwise(e)
    return _r(ev.tool_selection(t.events, "user_id", want, got, F.col("value")), 2, "outcome", "n", "tasks")


@plan("Q21", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM events GROUP BY 1")
def latency_percentiles(t):
    return _r(ev.latency_percentiles(t.events, "value", ["event_type"]), 4, "event_type")


@plan("Q22", f"WITH {PRED}, c AS (SELECT source, {CM} FROM p GROUP BY source) SELECT source, tp, fp, fn, tn, {RATES} FROM c")
def subgroup_metrics(t):
    return _r(ev.binary_metrics(predictions(t), "y", "yhat", ["source"]), 6, *KEEP)


@plan("Q22", f"WITH {PRED}, a AS (SELECT a.source, {AUC} / count(*) AS auc FROM (SELECT p, source FROM p WHERE y = 1) a JOIN (SELECT p, source FROM p WHERE y = 0) b ON a.source = b.source GROUP BY 1) SELECT round(max(auc) - min(auc), 6) AS gap, round(min(auc) / max(auc), 6) AS parity FROM a")
def subgroup_gap(t):
    return _r(ev.subgroup_gap(ev.roc_auc(predictions(t), "y", "p", ["source"]), "auc"), 6)


@plan("Q23", """SELECT doc_id, quality AS old, CASE WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END AS new, 'changed' AS change FROM labels WHERE doc_id % 11 = 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 UNION ALL
  SELECT doc_id, quality, NULL, 'removed' FROM labels WHERE doc_id % 13 = 0 AND doc_id % 17 <> 0 UNION ALL SELECT doc_id, NULL, CASE WHEN doc_id % 11 = 0 THEN 1 - quality ELSE quality END, 'added' FROM labels WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0""")
def golden_diff(t):
    old = t.labels.where(F.col("doc_id") % 17 != 0)
    new = t.labels.where(F.col("doc_id") % 13 != 0).withColumn("quality", F.when(F.col("doc_id") % 11 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return ev.golden_diff(old, new, "doc_id", "quality")


@plan("Q24", """WITH r AS (SELECT p_brand, p_partkey, round(p_retailprice / 10000, 6) AS s, p_size FROM part) SELECT p_brand, p_partkey, s, round(s / nullif(p_size, 0), 9) AS per_minute,
  round(s - lag(s) OVER (PARTITION BY p_brand ORDER BY p_partkey), 9) AS gain, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) = 1 AS winner FROM r""")
def compare_experiments(t):
    r = t.part.select("p_brand", "p_partkey", F.round(F.col("p_retailprice") / 10000, 6).alias("s"), "p_size")
    return _r(ev.compare_experiments(r, "p_partkey", "s", "p_size", "p_brand"), 9, "p_brand", "p_partkey", "s", "winner")


@plan("Q25", """WITH s AS (SELECT avg(quality) AS m FROM labels), d AS (SELECT quality AS y, CAST('0x' || substr(md5('4:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM labels)
  SELECT round(avg((y = (m >= 0.5)::INT)::INT), 6) AS majority, round(avg((y = (u < m)::INT)::INT), 6) AS stratified, round(sqrt(avg(pow(y - m, 2))), 6) AS mean_rmse FROM d, s""")
def dummy_baseline(t):
    return _r(ev.dummy_baselines(t.labels, t.labels, "doc_id", "quality", seed=4), 6)


@plan("Q27", """SELECT round(corr(l_quantity, l_extendedprice), 6) AS before, TRUE AS broken FROM lineitem""")
def permutation_importance(t):
    d = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), "l_quantity", "l_extendedprice")
    before = d.agg(F.corr("l_quantity", "l_extendedprice")).first()[0]
    after = ev.permute_column(d, "l_quantity", "k", seed=3).agg(F.corr("l_quantity", "l_extendedprice").alias("r"))
    return after.select(F.round(F.lit(before), 6).alias("before"), (F.abs("r") < 0.05).alias("broken"))


@plan("Q28", r"""SELECT CASE WHEN text LIKE '%{{%' THEN 'adversarial' WHEN n > 120 THEN 'complex' WHEN n > 40 THEN 'medium' ELSE 'simple' END AS difficulty, role, count(*) AS n FROM
  (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM conversations) GROUP BY ALL""".replace("{{", "{"))
def difficulty_cells(t):
    return ev.difficulty_cells(t.conversations, "text", F.col("text").contains("{")).groupBy("difficulty", "role").agg(F.count("*").alias("n"))
