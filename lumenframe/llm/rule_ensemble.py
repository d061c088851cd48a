"""Quality score by a sparse ensemble of rules over text statistics.

1. Statistics of a text are built-in column expressions (``statistics()``): shares, means and counts over the whole text.
2. A random forest of shallow trees is fitted to the labelled rows; each path from a root to a node is a rule, a conjunction of conditions ``statistic <= x`` or ``> x``.
3. A logistic regression with a lasso penalty weighs the rules; most weights become 0 and their rules are dropped.
4. The rules that are left are compiled into one column expression, so that scoring is a plain projection: no model object, no Python, no shuffle.

Fitting uses at most ``most_rows`` labelled rows (those with the smallest hash of the id, so the choice doesn't depend on how the table is stored), in one task of
bounded size. Labels are learned only from rows whose ``crc32`` of the id modulo 5 isn't 0. Statistics never look at ids, languages, sources or labels.

Null texts count as empty and get a score like any text. Rows without an id are scored and not held out. Null labels are not learned from. Without labelled rows the score is 0.5; with one class only it is the same for all texts.
Repeated rows give repeated result rows; repeated labels weigh more. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import named, stored, texts_of


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("double")


def _share(pattern: str) -> Column:
    return _count(pattern) / F.greatest(F.length("text"), F.lit(1))


def statistics() -> dict[str, Column]:
    """Name of each statistic and its expression over ``text``, ``word list`` and ``line list``."""
    n_words = F.greatest(F.size("word list"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size("line list"), F.lit(1)).cast("double")
    return {
        "words": F.size("word list").cast("double"),
        "word_length": F.length("text") / n_words,
        "distinct_words": F.size(F.array_distinct("word list")) / n_words,
        "distinct_lines": F.size(F.array_distinct("line list")) / n_lines,
        "line_words": F.size("word list") / n_lines,
        "symbols": _share(r"[#*$%&|<>{}\\^~=+]"),
        "bangs": _share("[!?]"),
        "capitals": _share(r"\p{Lu}"),
        "digits": _share("[0-9]"),
        "stops": _share("[.]"),
        "commas": _share("[,;:]"),
        "other": _share(r"[^\p{L}\p{N}\s.,;:!?#*$%&|<>{}\\^~=+-]"),
    }


def with_statistics(texts: DataFrame) -> DataFrame:
    """Adds one column for each statistic to rows with a ``text``."""
    text = texts.withColumn("text", F.coalesce("text", F.lit("")))
    parts = text.withColumn("word list", F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")).withColumn("line list", F.split("text", "\n"))
    return parts.withColumns(statistics()).drop("word list", "line list", "text")


@dataclass(frozen=True)
class Settings:
    most_rows: int = 20_000
    trees: int = 24
    depth: int = 3
    penalty: float = 0.001
    seed: int = 11


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool  # > threshold, else <=
    threshold: float


Rule = frozenset  # of conditions


@dataclass(frozen=True)
class Ensemble:
    """Rules with their weights; ``score`` is a column over statistics."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(compiled(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def compiled(rule: Rule) -> Column:
    out = F.lit(True)
    for c in sorted(rule, key=lambda c: (c.statistic, c.above, c.threshold)):
        out = out & ((F.col(c.statistic) > F.lit(c.threshold)) if c.above else (F.col(c.statistic) <= F.lit(c.threshold)))
    return out


def _tightened(path: tuple[Condition, ...]) -> Rule:
    """The path with one condition for each statistic and direction."""
    best: dict[tuple[str, bool], float] = {}
    for c in path:
        key = (c.statistic, c.above)
        best[key] = c.threshold if key not in best else (max if c.above else min)(best[key], c.threshold)
    return frozenset(Condition(s, a, t) for (s, a), t in best.items())


def tree_rules(model, names: list[str]) -> list[Rule]:
    """Every path of every tree of a fitted forest, each once; a path and its sibling say the same in trees of one split, so both stay."""
    found: dict[Rule, None] = {}

    def walk(node, path: tuple[Condition, ...]) -> None:
        if path:
            found.setdefault(_tightened(path))
        if node.subtreeDepth() > 0:
            split = node.split()
            name = names[split.featureIndex()]
            walk(node.leftChild(), (*path, Condition(name, False, split.threshold())))
            walk(node.rightChild(), (*path, Condition(name, True, split.threshold())))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return sorted(found, key=lambda r: sorted((c.statistic, c.above, c.threshold) for c in r))


def held_out(doc_id: Column) -> Column:
    """True for rows that are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Ensemble:
    """Learns rules and weights from the labelled rows that aren't held out."""
    known = labels.select(named(id_col).cast("long").alias("doc_id"), named(label_col).cast("double").alias("label"))
    known = known.filter(F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.most_rows)
    sample = texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most ``most_rows`` rows of two numbers
    names = list(statistics())
    rows = stored(with_statistics(sample).select("doc_id", "label", *names), "labelled")
    classes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        n, ones = sum(classes.values()), classes.get(1.0, 0)
        share = (ones + 1) / (n + 2)
        return Ensemble(_logit(share))
    rows = rows.orderBy("doc_id", "label", *names).coalesce(1)  # the forest draws per partition; bounded by ``most_rows``
    vectors = VectorAssembler(inputCols=names, outputCol="statistics").transform(rows)
    forest = RandomForestClassifier(
        featuresCol="statistics", labelCol="label", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, featureSubsetStrategy="onethird")
    rules = tree_rules(forest.fit(vectors), names)
    if not rules:
        return Ensemble(_logit(classes[1.0] / sum(classes.values())))
    marks = rows.select("label", *(compiled(r).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    marks = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(marks).select("label", "rules")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", regParam=settings.penalty, elasticNetParam=1.0, standardization=False, maxIter=200).fit(marks)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(lasso.intercept, tuple((r, w) for r, w in zip(rules, weights) if w != 0.0))


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def score(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    rows = with_statistics(texts_of(docs, id_col, text_col)).withColumn("score", ensemble.score())
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
