import math
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lumenframe.llm import rule_ensemble

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def fitted(spark, tables):
    from lumenframe.session import ship_package

    ship_package(spark)
    return rule_ensemble.fit(*tables)


def test_held_out_accuracy(tables, fitted):
    docs, labels = tables
    rows = rule_ensemble.score(docs, fitted).join(labels, "doc_id").collect()
    apart = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert [r for r in rows if r.held_out] == apart and len(apart) > 500
    assert sum(r.predicted == r.quality for r in apart) / len(apart) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_labels_are_not_looked_at(tables, fitted):
    docs, labels = tables
    apart = rule_ensemble.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(apart, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(docs, turned) == fitted


def test_the_compiled_column_says_what_the_rules_say(tables, fitted):
    docs, _ = tables
    some = docs.filter("doc_id < 400")
    stats = {r.doc_id: r.asDict() for r in rule_ensemble.with_statistics(some.select("doc_id", "text")).collect()}
    for r in rule_ensemble.score(some, fitted).collect():
        s = stats[r.doc_id]
        holds = lambda rule: all((s[c.statistic] > c.threshold) == c.above for c in rule)
        total = fitted.intercept + sum(w for rule, w in fitted.rules if holds(rule))
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_the_ensemble_is_sparse(fitted):
    assert 1 <= len(fitted.rules) < 60 and all(rule for rule, _ in fitted.rules)


def test_paths_keep_one_condition_for_each_direction():
    c = rule_ensemble.Condition
    path = (c("a", True, 1.0), c("a", True, 3.0), c("a", False, 9.0), c("b", False, 2.0), c("b", False, 1.0))
    assert rule_ensemble._tightened(path) == {c("a", True, 3.0), c("a", False, 9.0), c("b", False, 1.0)}


def test_scoring_is_a_plain_projection(tables, fitted):
    plan = rule_ensemble.score(tables[0], fitted)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Join"))


def test_odd_rows(spark, odd_docs, no_docs, fitted):
    rows = rule_ensemble.score(odd_docs, fitted).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert rule_ensemble.score(no_docs, fitted).collect() == []


def test_few_or_odd_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rule_ensemble.fit(odd_docs, none).rules == () and rule_ensemble.fit(odd_docs, none).intercept == 0.0
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 7, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    e = rule_ensemble.fit(odd_docs, one)
    assert e.rules == () and e.intercept > 0
    assert {r.predicted for r in rule_ensemble.score(odd_docs, e).collect()} == {1}


def test_the_bound_on_labelled_rows_holds(spark, tables):
    docs, labels = tables
    e = rule_ensemble.fit(docs, labels, settings=rule_ensemble.Settings(most_rows=300))
    assert e.rules


def by_hand(text):
    """The statistics, from their names."""
    text = text or ""
    words, lines = [w for w in re.split("[ \t-\r]+", text) if w], text.split("\n")
    n_words, size = max(len(words), 1), max(len(text), 1)
    share = lambda pattern: len(regex.findall(pattern, text)) / size
    return {
        "words": len(words), "word_length": len(text) / n_words, "distinct_words": len(set(words)) / n_words, "distinct_lines": len(set(lines)) / len(lines),
        "line_words": len(words) / len(lines), "symbols": sum(text.count(c) for c in "#*$%&|<>{}\\^~=+") / size, "bangs": (text.count("!") + text.count("?")) / size,
        "capitals": share(r"\p{Lu}"), "digits": sum(c in "0123456789" for c in text) / size, "stops": text.count(".") / size, "commas": sum(text.count(c) for c in ",;:") / size,
        "other": sum(not regex.match(r"[\p{L}\p{N}]", c) and c not in " \t\n\x0b\f\r.,;:!?#*$%&|<>{}\\^~=+-" for c in text) / size,
    }


def test_statistics_by_hand(spark, tables, odd_docs):
    for df in (tables[0].filter("doc_id < 300").select("doc_id", "text"), odd_docs.filter("doc_id is not null").select("doc_id", "text").distinct()):
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in rule_ensemble.with_statistics(df).collect():
            assert {k: r[k] for k in rule_ensemble.statistics()} == pytest.approx(by_hand(texts[r.doc_id]), rel=1e-9), r.doc_id


def test_weights_are_the_optimum_of_the_lasso(tables, fitted):
    """At the optimum the loss falls along each kept rule as fast as the penalty rises, and not at all along the intercept."""
    docs, labels = tables
    rows = docs.join(labels, "doc_id").filter(~rule_ensemble.held_out(F.col("doc_id"))).select("text", "quality").collect()
    assert 1000 < len(rows) < rule_ensemble.Settings().most_rows
    stats = [by_hand(r.text) for r in rows]
    holds = np.array([[all((s[c.statistic] > c.threshold) == c.above for c in rule) for rule, _ in fitted.rules] for s in stats], float)
    weights, y = np.array([w for _, w in fitted.rules]), np.array([r.quality for r in rows], float)
    miss = 1 / (1 + np.exp(-(fitted.intercept + holds @ weights))) - y
    penalty = rule_ensemble.Settings().penalty
    assert abs(miss.mean()) < 0.1 * penalty
    assert (holds.T @ miss / len(y)).tolist() == pytest.approx((-penalty * np.sign(weights)).tolist(), abs=0.25 * penalty)
