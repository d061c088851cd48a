"""Worked values with known results, and small edge tables."""

import math

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import pvalues as pv
from lumenframe.functions import scalars as fn
from lumenframe.operators import aggregates as agg
from lumenframe.operators import bookkeeping as bk
from lumenframe.operators import business as bz
from lumenframe.operators import cleaning as cl
from lumenframe.operators import content as ct
from lumenframe.operators import evaluation as ev
from lumenframe.operators import features as ft
from lumenframe.operators import quality as qa
from lumenframe.operators import relational as rel
from lumenframe.operators import statistics as st
from lumenframe.operators.scaling import neighbours, ranked


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_rank_ties(spark):
    d = spark.createDataFrame([(1, 500), (2, 500), (3, 300), (4, 100)], "id int, total int")
    r = ranked(ranked(d, [], ["-total", "id"], {"rn": "row_number"}), [], ["-total"], {"rk": "rank", "dr": "dense_rank"}).orderBy("id")
    assert rows(r, "rn", "rk", "dr") == [(1, 1, 1), (2, 1, 1), (3, 3, 2), (4, 4, 3)]


def test_lag_days(spark):
    d = spark.createDataFrame([(x,) for x in ("2024-01-01", "2024-01-08", "2024-01-20", "2024-02-15")], "s string").select(F.to_date("s").alias("d"))
    g = neighbours(d, [], ["d"], {"n": lambda w: F.datediff("d", F.lag("d").over(w))}, 1).orderBy("d")
    assert [r["n"] for r in g.collect()] == [None, 7, 12, 26]


def test_category_walk(spark):
    d = spark.createDataFrame([(1, "Clothing", None), (2, "Men's", 1), (3, "Shirts", 2), (4, "Women's", 1)], "id int, name string, parent int")
    got = {r["name"]: (r["depth"], r["path"]) for r in rel.walk_hierarchy(d, "id", "parent", "name").collect()}
    assert got == {"Clothing": (0, "Clothing"), "Men's": (1, "Clothing > Men's"), "Shirts": (2, "Clothing > Men's > Shirts"), "Women's": (1, "Clothing > Women's")}
    loop = spark.createDataFrame([(1, "a", None), (2, "b", 1), (2, "b", 2)], "id int, name string, parent int")
    with pytest.raises(RuntimeError):
        rel.walk_hierarchy(loop, "id", "parent", "name", max_depth=3)


def test_rollup_subtotals(spark):
    d = spark.createDataFrame([("Canada", "a", 1.2), ("Canada", "b", 0.8), ("US", "a", 3.5), ("US", "b", 2.1)], "c string, p string, v double")
    got = {(r["c"], r["p"]): round(r["s"], 6) for r in agg.labelled_rollup(d, ["c", "p"], [F.sum("v").alias("s")]).collect()}
    assert got[("Canada", "ALL")] == 2.0 and got[("US", "ALL")] == 5.6 and got[("ALL", "ALL")] == 7.6


def test_confusion_rates(spark):
    d = spark.createDataFrame([(85, 30, 15, 870)], "tp int, fp int, fn int, tn int")
    r = ev.rates(d).first()
    assert [round(r[c], 3) for c in ("accuracy", "precision", "recall", "specificity", "f1")] == [0.955, 0.739, 0.85, 0.967, 0.791]


def test_cross_entropy(spark):
    d = spark.createDataFrame(list(zip([0.0, 0.0, 1.0, 0.0, 0.0], [0.05, 0.1, 0.7, 0.1, 0.05])), "p double, q double")
    assert round(st.distribution_entropy(d, "p", "q").first()["cross_entropy"], 3) == 0.357


def test_population_sd(spark):
    d = spark.createDataFrame([(float(x),) for x in (12, 15, 18, 22, 25, 30, 35)], "x double")
    assert round(d.agg(F.stddev_pop("x")).first()[0], 2) == 7.61


def experiment_log(spark):
    return spark.createDataFrame([("exp000", 0.8523, "KEEP"), ("exp001", 0.8612, "KEEP"), ("exp002", 0.8590, "DISCARD"), ("exp003", 0.0, "CRASH"),
                                  ("exp004", 0.8634, "KEEP")], "id string, val_score double, status string")


def test_experiment_log(spark):
    s = bk.results_summary(experiment_log(spark)).first()
    assert (s["total"], s["keep"], s["discard"], s["crash"], s["best_id"], round(s["improvement"], 4)) == (5, 3, 1, 1, "exp004", 0.0111)
    d = bk.keep_discard(experiment_log(spark).withColumn("val_score", F.when(F.col("val_score") > 0, F.col("val_score"))), [], ["id"], "val_score").orderBy("id")
    assert [r["decision"] for r in d.collect()] == ["KEEP", "KEEP", "DISCARD", "CRASH", "KEEP"]


def test_effect_labels():
    assert [st.effect_label(d) for d in (0.1, 0.3, 0.6, 0.9)] == ["Negligible", "Small", "Medium", "Large"]


def test_completeness_grades(spark):
    d = spark.range(1000).select(*[F.when(F.col("id") >= n, F.lit(1)).alias(c) for c, n in (("a", 5), ("b", 30), ("c", 150), ("d", 500))])
    assert {r["column"]: r["grade"] for r in qa.completeness_grade(d).collect()} == {"a": "GREEN", "b": "YELLOW", "c": "ORANGE", "d": "RED"}


def test_tail_probabilities():
    assert round(pv.normal_two_sided(1.959963984540054), 6) == 0.05
    assert round(pv.t_two_sided(2.2281388519649385, 10), 6) == 0.05
    assert round(pv.f_upper(4.964602743730711, 1, 10), 6) == 0.05
    assert round(pv.chi2_upper(3.841458820694124, 1), 6) == 0.05
    assert round(pv.chi2_upper(18.307038053275146, 10), 6) == 0.05
    assert round(pv.ks_asymptotic(1.3580986 / math.sqrt(50), 100, 100), 3) == 0.05


def test_number_labels(spark):
    d = spark.createDataFrame([(1.5e9,), (2.34e6,), (4321.0,), (999.0,), (-2500.0,)], "v double")
    assert [r[0] for r in d.select(fn.format_number(F.col("v"), "currency")).collect()] == ["$1.5B", "$2.3M", "$4.3K", "$999", "$-2.5K"]


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "g string, v double, d timestamp")
    assert agg.group_summary(empty, "g", "v").count() == 0
    assert qa.duplicate_rows(empty).first()["duplicates"] in (0, None)
    assert cl.remove_outliers_iqr(empty, ["v"]).count() == 0
    assert agg.describe(empty, ["v"]).first()["count"] == 0
    flat = spark.createDataFrame([("a", 3.0)] * 9, "g string, v double")
    assert cl.remove_outliers_iqr(flat, ["v"]).count() == 9
    assert agg.corr_pairs(flat.withColumn("w", F.lit(1.0)), ["v", "w"]).first()["r"] is None
    assert ft.numeric_features(flat, ["v"]).first()["v_zscore"] is None


def test_all_null_column_stays(spark):
    d = spark.createDataFrame([(1.0, None, None), (None, None, None), (3.0, None, "x")], "a double, b double, c string")
    out, _ = cl.clean_table(d, cl.CleanConfig(outliers=None))
    got = out.orderBy("a").collect()
    assert [r["a"] for r in got] == [1.0, 2.0, 3.0] and all(r["b"] is None for r in got) and {r["c"] for r in got} == {"x"}
    assert cl.remove_outliers_iqr(d, ["b"]).count() == 3


def test_mode_tie_and_null_group(spark):
    d = spark.createDataFrame([("g", "b"), ("g", "a"), (None, "z"), ("g", None)], "g string, v string")
    got = {r["g"]: r["mode"] for r in agg.mode_per_group(d, ["g"], "v").collect()}
    assert got == {"g": "a", None: "z"}


def test_blank_and_long_text(spark):
    d = spark.createDataFrame([("",), ("   ",), ("héllo wörld 1",), ("w " * 20_000,)], "x string")
    got = rows(d.select(fn.word_count(F.col("x")).alias("n"), fn.unique_words(F.col("x")).alias("u"), fn.has_numbers(F.col("x")).alias("h")), "n", "u", "h")
    assert got == [(0, 0, 0), (0, 0, 0), (3, 3, 1), (20_000, 1, 0)]
    c = ct.chunk_fixed(d.where(F.length("x") > 1000).withColumn("id", F.lit(1)), "id", "x", 300, 50)
    assert c.agg(F.max("chunk"), F.sum("n_words")).first()[0] == math.ceil((20_000 - 50) / 250) - 1


def test_zero_denominators(spark):
    d = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in d.select(fn.safe_divide(F.col("a"), F.col("b"))).collect()] == [None, None]
    f = spark.createDataFrame([("u", "view")], "u string, e string")
    assert [r["step_rate"] for r in bz.funnel(f, "u", "e", ["buy", "view"]).orderBy("position").collect()] == [None, None]


def test_class_never_predicted_and_query_without_hits(spark):
    d = spark.createDataFrame([(0, 0), (1, 0)], "y int, h int")
    got = {r["class"]: r["precision"] for r in ev.class_report(d, "y", "h").collect()}
    assert got == {0: 0.5, 1: None}
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "q int, rank int, rel int")
    t = spark.createDataFrame([(1, 1), (2, 0), (3, 4)], "q int, n_relevant int")
    m = {x["q"]: (x["ndcg"], x["map"], x["mrr"]) for x in ev.ranking_metrics(r, "q", "rank", "rel", t, 5).collect()}
    assert m[1] == (1.0, 1.0, 1.0) and m[2] == (0.0, 0.0, 0.0) and m[3] == (0.0, 0.0, 0.0)


def test_judge_flip(spark):
    d = spark.createDataFrame([(1, "forward", "A"), (1, "swapped", "B"), (2, "forward", "A"), (2, "swapped", "A"), (3, "forward", "tie"), (3, "swapped", "tie")],
                              "p int, pass string, v string")
    assert {r["p"]: r["verdict"] for r in ev.judge_consistency(d, "p", "pass", "v").collect()} == {1: "A", 2: "tie", 3: "tie"}


def test_quality_gate_raises(spark):
    c = spark.createDataFrame([("a", 0.5, 0.9), ("b", 1.0, 0.9)], "check string, value double, threshold double")
    with pytest.raises(qa.QualityGateError, match="^a$"):
        qa.quality_gate(c)


def test_partial_months(spark):
    d = spark.sql("select explode(sequence(date'2024-01-15', date'2024-03-31')) as d")
    assert {r[0] for r in qa.full_periods(d, "d", "month").select(F.month("d")).distinct().collect()} == {2, 3}


def test_page_without_headings_and_hidden_parts(spark):
    html = ["<p>one</p><script>x()</script><nav>menu</nav><p>two</p>",
            "<title>T</title><meta name='Author' content='me'><h1>A</h1><p>a text</p><pre><code class='language-python'>print('hello world')</code></pre><h2>B &amp; C</h2><p>b text</p>"]
    d = spark.createDataFrame(list(enumerate(html)), "id int, html string")
    a, b = ct.html_extract(d, "id", "html").orderBy("id").collect()
    assert [s["heading"] for s in a["sections"]] == ["Content"] and "menu" not in a["raw_text"] and "x()" not in a["raw_text"]
    assert b["title"] == "T" and b["metadata"] == {"author": "me"} and [(s["heading"], s["level"]) for s in b["sections"]] == [("A", 1), ("B & C", 2)]
    assert b["sections"][0]["content"] == "a text" and b["code_blocks"][0]["language"] == "python" and b["code_blocks"][0]["code"] == "print('hello world')"


def test_notebook_issues(spark):
    import json
    bad = {"cells": [{"cell_type": "code", "source": ["x = 1"], "outputs": []}, {"cell_type": "code", "source": ["import torch\n", "open('/data/a.csv')"], "outputs": [{"output_type": "s"}]},
                     {"cell_type": "code", "source": ["from os import path"], "outputs": []}, {"cell_type": "code", "source": [" "], "outputs": []}]}
    good = {"cells": [{"cell_type": "markdown", "source": ["# Title"]}, {"cell_type": "code", "source": ["import pandas"], "outputs": []}]}
    d = spark.createDataFrame([(1, json.dumps(bad)), (2, json.dumps(good))], "id int, nb string")
    got = {r["id"]: r for r in ct.notebook_quality(d, "id", "nb").collect()}
    assert len(got[1]["issues"]) == 8 and got[1]["score"] == 2 and got[1]["imports"] == ["os", "torch"]
    assert got[2]["issues"] == [] and got[2]["score"] == 10


def test_bootstrap_near_closed_form(spark):
    d = spark.range(4000).select((F.col("id") % 17).cast("double").alias("x"))
    r = st.bootstrap_ci(d, "x", rounds=400, seed=3).first()
    s = d.agg(F.avg("x"), F.stddev_samp("x")).first()
    half = 1.96 * s[1] / math.sqrt(4000)
    assert abs(r["low"] - (s[0] - half)) < 0.3 * half and abs(r["high"] - (s[0] + half)) < 0.3 * half
    assert r == st.bootstrap_ci(d.repartition(7), "x", rounds=400, seed=3).first()


def test_algorithms_in_code(spark):
    rows = [(1, "def f(x):\n  for y in x:\n    return y", "Sorting by hand " + "x" * 60), (2, "while true: loop", ""), (3, "IF a THEN b ELSE c\nRETURN d", None), (4, "x = 1", "none"), (5, None, None)]
    b = spark.createDataFrame(rows, "id long, code string, said string")
    got = {r.id: (r.name, r.description, r.n_marks) for r in ct.algorithms_in_code(b, "id", F.col("code"), F.col("said")).collect()}
    assert got == {1: (("Sorting by hand " + "x" * 60)[:50], "Sorting by hand " + "x" * 60, 3), 3: ("Detected Algorithm", "Algorithm from code", 3)}


def test_preference_pairs_take_any_answer_id(spark):
    from lumenframe.operators import corpus

    a = spark.createDataFrame([("p", "b", 2.0), ("p", "a", 2.0), ("p", "c", 1.0), ("p", "d", 1.0), ("q", "x", 1.0), ("q", "y", 1.0), ("q", "z", None)], "prompt string, answer string, score double")
    assert [(r.prompt, r.chosen, r.rejected, round(r.loss, 9)) for r in corpus.preference_pairs(a, "prompt", "answer", "score").collect()] == [("p", "a", "c", round(math.log1p(math.exp(-1)), 9))]


def test_page_results_leave_in_small_parts(spark, monkeypatch):
    """One batch of many pages gives its rows a few at a time, in order, with every page."""
    import pyarrow as pa

    from lumenframe.operators import content as ct

    seen = []
    pages = [None, ""] + [f"<title>t{i}</title><h1>head</h1><p>{'word ' * 4000}</p><meta name='a' content='{i}'><pre><code class='lang-c'>int main(void) {{}}</code></pre>" for i in range(500)]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string")
    monkeypatch.setattr(type(d), "mapInArrow", lambda self, f, schema: seen.append(f))
    ct.html_extract(d, "id", "html")
    out = list(seen[0](iter([pa.RecordBatch.from_pydict({"id": list(range(len(pages))), "html": pages})])))
    assert max(b.num_rows for b in out) <= ct.SENT_CHARS // 20_000 + 3
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["id"] for r in rows] == list(range(len(pages))) and [r["title"] for r in rows] == ["", ""] + [f"t{i}" for i in range(500)]
    assert rows[9]["metadata"] == [("a", "7")] and rows[9]["code_blocks"][0]["language"] == "c" and rows[9]["sections"][0]["heading"] == "head" and len(rows[9]["raw_text"]) > 19_000
