"""Model-quality figures over a predictions table, as counts and running counts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import clip, hash_unit, pearson_r, safe_divide, words
from lumenframe.operators.features import terms, word_ngrams
from lumenframe.operators.scaling import attach_row, exact_quantiles, join_nullsafe, neighbours, ranked, running, value_counts_prefix


def confusion(pred: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    return pred.groupBy(*by, y, yhat).agg(F.count("*").alias("n"))


def confusion_counts(y: Column, yhat: Column) -> list[Column]:
    return [F.count_if((y == a) & (yhat == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def rates(counts: DataFrame, beta: float = 2.0) -> DataFrame:
    """accuracy, precision, recall, specificity, F1, F-beta from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    b2 = beta * beta
    return counts.withColumns({
        "accuracy": safe_divide(tp + tn, tp + fp + fn + tn), "precision": safe_divide(tp, tp + fp), "recall": safe_divide(tp, tp + fn),
        "specificity": safe_divide(tn, tn + fp), "f1": safe_divide(2 * tp, 2 * tp + fp + fn),
        "f_beta": safe_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp)})


def binary_metrics(pred: DataFrame, y: str, yhat: str, by: Sequence[str] = (), beta: float = 2.0) -> DataFrame:
    return rates(pred.groupBy(*by).agg(*confusion_counts(F.col(y), F.col(yhat))), beta)


def class_report(pred: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1 and support per class; a class never predicted has null precision."""
    c = confusion(pred, y, yhat)
    true = c.groupBy(F.col(y).alias("class")).agg(F.sum("n").alias("support"))
    hit = c.where(F.col(y) == F.col(yhat)).select(F.col(y).alias("class"), F.col("n").alias("tp"))
    said = c.groupBy(F.col(yhat).alias("class")).agg(F.sum("n").alias("predicted"))
    j = true.join(said, "class", "full").join(hit, "class", "left").na.fill(0, ["support", "predicted", "tp"])
    return j.select("class", "support", safe_divide(F.col("tp"), F.col("predicted")).alias("precision"),
                    safe_divide(F.col("tp"), F.col("support")).alias("recall"),
                    safe_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "tp", "predicted")


def averaged_report(report: DataFrame) -> DataFrame:
    """Micro, macro and weighted F1 (an undefined part counts 0)."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return report.agg(safe_divide(2.0 * F.sum("tp"), F.sum("predicted") + F.sum("support")).alias("micro_f1"), F.avg(z("f1")).alias("macro_f1"),
                      (F.sum(z("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
                      F.avg(z("precision")).alias("macro_precision"), F.avg(z("recall")).alias("macro_recall"))


def score_curve(pred: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (descending): positives and negatives at or above it, and the totals."""
    cum = value_counts_prefix(pred, by, score, {"pos": F.col(y).cast("long"), "neg": (1 - F.col(y)).cast("long")}, down=True)
    sums = cum.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return join_nullsafe(cum, sums, by) if by else attach_row(cum, sums)


def roc_auc(pred: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank form: a tie between a positive and a negative counts half."""
    c = score_curve(pred, y, score, by)
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos")) + F.col("neg") * F.col("pos") / 2)
    return c.groupBy(*by).agg(safe_divide(wins, (F.max("all_pos") * F.max("all_neg")).cast("double")).alias("auc"))


def roc_curve(pred: DataFrame, y: str, score: str) -> DataFrame:
    return score_curve(pred, y, score).select(F.col(score).alias("threshold"), safe_divide(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
                                              safe_divide(F.col("cum_neg"), F.col("all_neg")).alias("fpr"))


def pr_curve(pred: DataFrame, y: str, score: str) -> DataFrame:
    c = score_curve(pred, y, score)
    return c.select(F.col(score).alias("threshold"), (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    safe_divide(F.col("cum_pos"), F.col("all_pos")).alias("recall"), safe_divide(F.col("pos"), F.col("all_pos")).alias("_step"))


def average_precision(pred: DataFrame, y: str, score: str) -> DataFrame:
    return pr_curve(pred, y, score).agg(F.sum(F.col("precision") * F.col("_step")).alias("average_precision"))


def threshold_sweep(pred: DataFrame, y: str, score: str, thresholds: Sequence[float], c_fn: float = 1.0, c_fp: float = 1.0) -> DataFrame:
    """Counts, rates and cost for each threshold from one pass."""
    s = F.col(score)
    one = pred.agg(*[F.struct(*confusion_counts(F.col(y), (s >= t).cast("int"))).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("c")) for i, t in enumerate(thresholds)])
    out = rates(one.select(F.inline(rows)).select("threshold", "c.*"))
    return out.withColumn("cost", c_fn * F.col("fn") + c_fp * F.col("fp"))


def cheapest_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy("cost", "threshold").limit(1).select("threshold", "cost", "precision", "recall")


def precision_at_recall(pred: DataFrame, y: str, score: str, recall: float) -> DataFrame:
    ok = pr_curve(pred, y, score).where(F.col("recall") >= recall)
    return ok.agg(F.max("precision").alias("precision"), F.max_by("threshold", "precision").alias("threshold"))


def probability_losses(pred: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = clip(F.col(p), eps, 1 - eps)
    loss = F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))
    return pred.agg(loss.alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.exp(loss).alias("perplexity"))


def calibration(pred: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return pred.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def regression_metrics(pred: DataFrame, y: str, yhat: str, n_features: int = 1, by: Sequence[str] = ()) -> DataFrame:
    a, b = F.col(y).cast("double"), F.col(yhat).cast("double")
    e = a - b
    n = F.count(e)
    r2 = 1 - safe_divide(F.sum(e * e), F.var_pop(a) * n)
    return pred.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                                 (F.avg(F.when(a != 0, F.abs(e / F.nullif(a, F.lit(0.0))))) * 100).alias("mape"),
                                 (F.avg(safe_divide(2 * F.abs(e), F.abs(a) + F.abs(b))) * 100).alias("smape"), r2.alias("r2"),
                                 (1 - (1 - r2) * safe_divide(n - 1, n - n_features - 1)).alias("adj_r2"))


def ranking_metrics(ranked_items: DataFrame, query: str, rank: str, relevance: str, totals: DataFrame, k: int) -> DataFrame:
    """Per query precision, recall, ndcg, average precision and reciprocal rank at k.

    ``totals(query, n_relevant)`` holds all queries; one without relevant items scores 0.
    """
    top = ranked_items.where(F.col(rank) <= k)
    hits = running(top, [query], [rank], {"_h": ("sum", relevance)})
    r = F.col(relevance).cast("double")
    per = hits.groupBy(query).agg(F.sum(r).alias("h"), F.sum(r / F.log2(F.col(rank) + 1.0)).alias("dcg"),
                                  F.sum(r * F.col("_h") / F.col(rank)).alias("ap"), F.min(F.when(r > 0, F.col(rank))).alias("first"))
    j = totals.join(per, query, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("n_relevant"), 1.0 / F.log2(i + 1.0)).otherwise(0.0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(query, z(F.col("h") / k).alias("precision"), z(safe_divide(F.col("h"), F.col("n_relevant"))).alias("recall"),
                    z(safe_divide(F.col("dcg"), ideal)).alias("ndcg"), z(safe_divide(F.col("ap"), F.least("n_relevant", F.lit(k)))).alias("map"),
                    z(safe_divide(F.lit(1.0), F.col("first"))).alias("mrr"))


def mean_of(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in cols])


def catalog_coverage(recommended: DataFrame, item: str, catalog: DataFrame, category: str) -> DataFrame:
    """Share of the catalog recommended at least once, and the mean number of categories per list share."""
    r = recommended.select(item).distinct().agg(F.count("*").alias("shown"))
    c = catalog.agg(F.count("*").alias("items"), F.count_distinct(category).alias("all_categories"))
    d = recommended.join(catalog.select(item, category), item).agg(F.count_distinct(category).alias("categories"))
    return attach_row(attach_row(r, c), d).select((F.col("shown") / F.col("items")).alias("coverage"),
                                                   (F.col("categories") / F.col("all_categories")).alias("category_coverage"))


def kappa(df: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """Cohen's kappa; weights none, linear or quadratic on numeric ratings.

    The expected disagreement is the sum over all pairs of one rater's and the other's ratings. Without weights it needs the counts of equal
    ratings only, quadratic needs sums and sums of squares, linear the running counts of both raters along the scale.
    """
    x, y = F.col(a), F.col(b)
    cells = df.where(x.isNotNull() & y.isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    if weights == "none":
        apart = (x != y).cast("double")
    else:
        apart = F.abs(x - y).cast("double") if weights == "linear" else F.pow((x - y).cast("double"), F.lit(2.0))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(n * apart).alias("o"), F.sum(F.when(x == y, n).otherwise(0.0)).alias("same"))
    sides = cells.select(x.alias("v"), n.alias("na"), F.lit(0.0).alias("nb")).unionByName(cells.select(y.alias("v"), F.lit(0.0).alias("na"), n.alias("nb")))
    scale = sides.groupBy("v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    if weights == "none":
        expected = scale.agg((F.sum("na") * F.sum("nb") - F.sum(na * nb)).alias("e"))
    elif weights == "quadratic":
        v = F.col("v").cast("double")
        expected = scale.agg((F.sum(na * v * v) * F.sum("nb") - 2 * F.sum(na * v) * F.sum(nb * v) + F.sum("na") * F.sum(nb * v * v)).alias("e"))
    else:  # |x - y| counts each step of the scale between them once: below * above on both sides of the step
        steps = running(scale, [], ["v"], {"ca": ("sum", "na"), "cb": ("sum", "nb")})
        steps = neighbours(steps, [], ["v"], {"next": lambda w: F.lead("v").over(w)}, after=1)
        steps = attach_row(steps, scale.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb")))
        ca, cb = F.col("ca"), F.col("cb")
        crossing = ca * (F.col("tb") - cb) + cb * (F.col("ta") - ca)
        expected = steps.agg(F.coalesce(F.sum(crossing * (F.col("next") - F.col("v")).cast("double")), F.lit(0.0)).alias("e"))
    return attach_row(seen, expected).select((F.col("same") / n).alias("agreement"), (1 - safe_divide(F.col("o"), F.col("e") / n)).alias("kappa"))


def judge_consistency(verdicts: DataFrame, pair: str, pass_col: str, verdict: str) -> DataFrame:
    """Verdicts of a forward and a swapped pass; the swapped label is flipped back, disagreement is a tie."""
    v = F.col(verdict)
    plain = F.when(F.col(pass_col) == "swapped", F.when(v == "A", "B").when(v == "B", "A").otherwise(v)).otherwise(v)
    two = verdicts.withColumn("_v", plain).groupBy(pair).agg(
        F.max(F.when(F.col(pass_col) == "forward", F.col("_v"))).alias("forward"), F.max(F.when(F.col(pass_col) == "swapped", F.col("_v"))).alias("swapped"))
    same = F.col("forward").eqNullSafe(F.col("swapped"))
    return two.select(pair, F.when(same, F.col("forward")).otherwise("tie").alias("verdict"), same.alias("consistent"))


def rubric_score(scores: DataFrame, unit: str, criteria: dict[str, float]) -> DataFrame:
    """Weighted mean of criteria columns (missing ones leave the weights)."""
    num = sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(0.0) for c, w in criteria.items()), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in criteria.items()), F.lit(0.0))
    return scores.select(unit, safe_divide(num, den).alias("score"))


def judge_bias(verdicts: DataFrame, verdict: str, len_a: Column, len_b: Column) -> DataFrame:
    """How often the first place wins, and the correlation of winning with being longer."""
    first = F.when(F.col(verdict) == "A", 1.0).when(F.col(verdict) == "B", 0.0)
    return verdicts.agg(F.avg(first).alias("first_wins"), pearson_r(first, len_a - len_b).alias("length_corr"))


def exact_match(df: DataFrame, expected: str, actual: str, seconds: str, calls: str) -> DataFrame:
    ok = F.coalesce(F.col(expected) == F.col(actual), F.lit(False)).cast("int")
    return df.agg(F.count("*").alias("n"), F.sum(ok).alias("correct"), (100 * F.avg(ok)).alias("accuracy"), F.avg(seconds).alias("mean_seconds"),
                  F.avg(calls).alias("mean_calls"), F.sum(calls).alias("total_calls"))


def ngram_overlap(pairs: DataFrame, key: str, reference: str, candidate: str, n: int) -> DataFrame:
    """ROUGE-n precision, recall and F1 from clipped n-gram counts."""
    def counts(c, name):
        return pairs.select(key, F.explode(word_ngrams(F.col(c), n)).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))

    j = counts(reference, "r").join(counts(candidate, "c"), [key, "g"], "full").na.fill(0, ["r", "c"])
    s = j.groupBy(key).agg(F.sum(F.least("r", "c")).alias("m"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.select(key).join(s, key, "left").select(
        key, zero(safe_divide(F.col("m"), F.col("c"))).alias("precision"), zero(safe_divide(F.col("m"), F.col("r"))).alias("recall"),
        zero(safe_divide(2.0 * F.col("m"), F.col("r") + F.col("c"))).alias("f1"))


def bleu(pairs: DataFrame, key: str, reference: str, candidate: str, max_n: int = 4) -> DataFrame:
    """Geometric mean of clipped n-gram precisions with brevity penalty (0 if any precision is 0)."""
    out = pairs.select(key, F.size(terms(F.col(reference))).alias("_r"), F.size(terms(F.col(candidate))).alias("_c"))
    logs = F.lit(0.0)
    for n in range(1, max_n + 1):
        out = out.join(ngram_overlap(pairs, key, reference, candidate, n).select(key, F.col("precision").alias(f"_p{n}")), key)
        logs = logs + F.when(F.col(f"_p{n}") > 0, F.log(f"_p{n}"))
    brevity = F.when(F.col("_c") >= F.col("_r"), 1.0).otherwise(F.exp(1 - safe_divide(F.col("_r"), F.col("_c"))))
    return out.select(key, F.coalesce(F.exp(logs / max_n) * brevity, F.lit(0.0)).alias("bleu"))


def rouge_l(pairs: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """Longest common subsequence of words, F1; the subsequence itself runs in an Arrow UDF on whole texts."""
    @F.pandas_udf("bigint")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        def lcs(x, y):
            # bit-parallel: one integer holds a row of the table
            masks: dict = {}
            for i, w in enumerate(x):
                masks[w] = masks.get(w, 0) | (1 << i)
            full = (1 << len(x)) - 1
            row = full
            for w in y:
                hit = row & masks.get(w, 0)
                row = ((row + hit) | (row - hit)) & full
            return len(x) - bin(row).count("1")
        return pd.Series([lcs(list(x), list(y)) for x, y in zip(a, b)])

    w = pairs.select(key, words(F.lower(F.col(reference))).alias("_r"), words(F.lower(F.col(candidate))).alias("_c"))
    m = w.select(key, common("_r", "_c").alias("m"), F.size("_r").alias("r"), F.size("_c").alias("c"))
    return m.select(key, "m", safe_divide(2.0 * F.col("m"), F.col("r") + F.col("c")).alias("rouge_l"))


def tool_selection(df: DataFrame, task: str, expected: Column, called: Column, price: Column) -> DataFrame:
    """right, unneeded, missed or wrong tool per call, calls and cost per task."""
    kind = (F.when(expected.isNull() & called.isNull(), "right_none").when(expected.isNull(), "unneeded").when(called.isNull(), "missed")
            .when(expected == called, "right").otherwise("wrong"))
    return df.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct(task).alias("tasks"), F.sum(price).alias("cost"))


def latency_percentiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    q = exact_quantiles(df, [value], [0.5, 0.9, 0.95, 0.99], by)
    return q.select(*by, *[F.col(value)[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def subgroup_gap(by_group: DataFrame, metric: str) -> DataFrame:
    return by_group.agg((F.max(metric) - F.min(metric)).alias("gap"), safe_divide(F.min(metric), F.max(metric)).alias("parity"))


def golden_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Rows that are new, gone or changed between two result tables."""
    a = old.select(key, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, key, "full").select(key, "old", "new", kind.alias("change")).where(F.col("change").isNotNull())


def compare_experiments(runs: DataFrame, order: str, score: str, minutes: str, slice_col: str) -> DataFrame:
    """Score per minute, gain over the run before, and the winner within each slice."""
    g = neighbours(runs, [slice_col], [order], {"gain": lambda w: F.col(score) - F.lag(score).over(w)}, before=1)
    best = runs.groupBy(slice_col).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("_best"))
    return g.join(best, slice_col).select(slice_col, order, score, safe_divide(F.col(score), F.col(minutes)).alias("per_minute"), "gain",
                                          (F.col(order) == F.col("_best")).alias("winner"))


def dummy_baselines(train: DataFrame, test: DataFrame, key: str, y: str, seed: int = 0) -> DataFrame:
    """Accuracy of the majority class and of a draw by class share; error of the mean."""
    n = train.groupBy(y).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), y).first()[y]
    share = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
    draw = (hash_unit(F.lit(seed), F.col(key)) < share).cast("int")
    return test.agg(F.avg((F.col(y) == top).cast("double")).alias("majority"), F.avg((F.col(y) == draw).cast("double")).alias("stratified"),
                    F.sqrt(F.avg(F.pow(F.col(y) - F.lit(share), F.lit(2.0)))).alias("mean_rmse"))


def permute_column(df: DataFrame, col: str, key: str, seed: int = 0) -> DataFrame:
    """The column's values in hash order; keys keep their rows."""
    a = ranked(df.withColumn("_u", hash_unit(F.lit(seed), F.col(key))), [], ["_u", key], {"_rn": "row_number"}).select("_rn", F.col(col).alias("_v"))
    numbered = ranked(df.withColumn("_u", hash_unit(F.lit(seed + 1), F.col(key))), [], ["_u", key], {"_rn": "row_number"})
    return numbered.join(a, "_rn").withColumn(col, F.col("_v")).drop("_rn", "_v", "_u")


def difficulty_cells(df: DataFrame, text: str, hard_mark: Column) -> DataFrame:
    """simple, medium, complex by length; adversarial by rule."""
    n = F.size(words(F.col(text)))
    level = F.when(hard_mark, "adversarial").when(n > 120, "complex").when(n > 40, "medium").otherwise("simple")
    return df.withColumn("difficulty", level)
