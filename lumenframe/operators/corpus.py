"""Text corpora and tuning data: duplicates, filters, reports, sampling, chat turns. DataFrame expressions, but for the search for n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.scalars import words
from lumenframe.operators.pairs import holds, marked, spot
from lumenframe.operators.passages import runs, word_hashes
from lumenframe.operators.scaling import exact_quantiles, join_nullsafe, ranked, split_join, spread, with_totals
from lumenframe.session import cut_lineage

# Frequent short words that tell languages apart.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "von"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "this"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con"),
    "fr": ("le", "la", "les", "des", "et", "est", "un", "une", "du", "que", "pour", "dans"),
}

_NAMES = r"[A-Z][A-Za-z'.-]*"
# Shapes of personal data and the tag that replaces each.
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    "card": (r"\b[0-9]{13,16}\b", "[CARD]"),
    "ip": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[IP]"),
    "phone": (r"\+?\b[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}\b", "[PHONE]"),
    # number, names and kind of street; street with its kind and number; number, kind and name; kind, name and number
    "address": (
        rf"\b[0-9]{{1,5}}[A-Za-z]?,? (?:{_NAMES} ){{1,4}}(?:Street|Avenue|Road|Boulevard|Lane|Drive|Court|Square|Place|Terrace|Way|St|Ave|Rd|Blvd|Ln|Dr|Ct|Sq|Pl)\b\.?"
        r"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?\b"
        r"|\b[0-9]{1,4},? (?:rue|avenue|boulevard|place|chemin|impasse) (?:(?:de|du|des|la|le|les) |[dl]'){0,3}[A-ZÀ-Ý][A-Za-zÀ-ÿ'-]+"
        r"|\b(?:Calle|Avenida|Avda\.|Plaza|Paseo) (?:(?:de|del|la|las|los|el) ){0,3}[A-ZÁÉÍÓÚÑ][A-Za-zÀ-ÿ]+,? [0-9]{1,4}\b",
        "[ADDRESS]",
    ),
}


def hash_share(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values only, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def exact_dedup(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lowest key of each text after lower-casing and squeezing white space, with the number of copies. Null texts are one group."""
    return docs.groupBy(F.sha2(F.coalesce(squeezed(F.col(text)), F.lit("\x00")), 256).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")


def line_dedup(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Texts without the lines that stand in at least ``least`` documents, and the number of lines dropped. Very frequent lines, empty ones too, stay in their tasks (``split_join``)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    told = docs.select(F.explode(F.array_distinct(F.transform(lines, F.trim))).alias("line")).where("line <> ''")
    often = cut_lineage(told.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("line", F.lit(True).alias("often")))
    each = docs.select(key, F.posexplode(lines).alias("pos", "raw")).withColumn("line", F.trim("raw"))
    marked = split_join(each, often, ["line"])
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "raw", F.coalesce("often", F.lit(False)).alias("often")))), lambda x: ~x["often"])
    return marked.groupBy(key).agg(F.array_join(F.transform(kept, lambda x: x["raw"]), "\n").alias("text"), F.count_if("often").alias("dropped"))


def language_bucket(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Language with the largest share of stop words (the first in alphabet on ties); none without any."""
    w = F.transform(words(F.lower(text)), lambda x: F.regexp_replace(x, r"[.,;:!?]+$", ""))

    def hit(marks):
        return F.size(F.filter(w, lambda x: x.isin(*marks)))

    hits = {name: hit(marks) for name, marks in STOP_WORDS.items()}
    scored = docs.select(key, *[n.alias(name) for name, n in hits.items()])
    best = F.greatest(*map(F.col, hits))
    pick = F.coalesce(*[F.when(F.col(name) == best, F.lit(name)) for name in sorted(hits)])
    return scored.select(key, F.when(best > 0, pick).alias("language"), best.alias("hits"))


#: Words of a model that are sent to every task, the most frequent ones.
SENT_WORDS = 500_000


def perplexity(docs: DataFrame, key: str, text: str, good: DataFrame) -> DataFrame:
    """Unigram perplexity with add-one smoothing; the model counts the texts of ``good`` (same columns)."""
    def places(df, *by):
        return spread(df.select(*by, text)).select(*by, F.explode(words(F.lower(text))).alias("word"))

    model = cut_lineage(places(good).groupBy("word").agg(F.count("*").alias("seen")))
    size = model.agg(F.sum("seen").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = size["total"] or 0, size["kinds"] or 0
    # a small model meets the places where they are; for a large one, the frequent words do, and a text's other words are counted before they travel
    common = cut_lineage(model.orderBy(F.desc("seen"), "word").limit(SENT_WORDS)) if kinds > SENT_WORDS else model
    met = places(docs, key).join(F.broadcast(common), "word", "left")
    mine = met.groupBy(key, "seen").agg(F.count("*").alias("n"))
    if kinds > SENT_WORDS:
        rare = met.where("seen IS NULL").groupBy(key, "word").agg(F.count("*").alias("n"))
        mine = mine.where("seen IS NOT NULL").unionByName(split_join(cut_lineage(rare), model, ["word"]).select(key, "seen", "n"))
    p = (F.coalesce("seen", F.lit(0)) + 1) / F.lit(float(total + kinds + 1))
    return mine.groupBy(key).agg(F.exp(-F.sum(F.col("n") * F.log(p)) / F.sum("n")).alias("perplexity"))


def two_sided(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Adds ``keep``: the value lies between two quantiles of its column. The rows are made once, not again for the quantiles."""
    df = cut_lineage(df)
    edges = exact_quantiles(df, [column], [low, high]).first()[column]
    return df.withColumn("keep", F.col(column).between(*edges) if edges else F.lit(True))


def heuristic_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Shares that simple quality rules look at."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines = words(t), F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(w), F.lit(1))
    return docs.select(
        key, F.size(w).alias("n_words"), (F.regexp_count(t, F.lit(r"[#*$%&|<>{}]")) / F.greatest(F.length(t), F.lit(1))).alias("special_share"),
        (F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / n).alias("mean_word"),
        (1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))).alias("repeated_lines"),
        (F.size(F.array_distinct(w)) / n).alias("distinct_words"))


def heuristic_filter(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``keep`` to the features: 10+ words, few special characters, ordinary word length, few repeated lines, some variety."""
    f = heuristic_features(docs, key, text)
    ok = ((F.col("n_words") >= 10) & (F.col("special_share") <= 0.1) & F.col("mean_word").between(2, 12) & (F.col("repeated_lines") <= 0.3)
          & ((F.col("distinct_words") >= 0.2) | (F.col("n_words") > 2000)))
    return f.withColumn("keep", ok)


def redact_personal(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Personal data replaced by tags, kind after kind, and how many of each."""
    out = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    for kind, (pattern, tag) in PERSONAL.items():
        out = out.withColumn(kind, F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, tag))
    return out


#: Bits of the filter that n-grams of the items leave before texts are searched for them.
GRAM_BITS = 24


def ngram_hits(docs: DataFrame, key: str, text: str, items: DataFrame, item_text: str, n: int) -> DataFrame:
    """Number of distinct word n-grams that a document shares with any item; only documents with some.

    The items' n-grams set bits in a filter of fixed size. A task hashes the runs of words of its texts, and only those that the filter lets pass leave it, as written, and
    are joined with the items' own.
    """
    def grams(column: str, bits=None, kind: str = "key string"):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, found, at = [], [], []
                for k, t in zip(batch.column("key").to_pylist(), batch.column("t").to_pylist()):
                    w = (t or "").encode().split()
                    spots = spot(runs(word_hashes(t or ""), n), GRAM_BITS)
                    for place in range(len(spots)) if bits is None else np.flatnonzero(holds(bits.value, spots)).tolist():
                        keys.append(k)
                        found.append(b" ".join(w[place : place + n]))
                        at.append(int(spots[place]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(found, pa.binary()), pa.array(at, pa.int64())], names=["key", "gram", "at"])

        return lambda df, k: df.select(k.alias("key"), F.lower(F.col(column)).alias("t")).mapInArrow(run, f"{kind}, gram binary, at long")

    wanted = cut_lineage(grams(item_text)(items, F.lit("")).select("gram", "at").distinct())
    bits = docs.sparkSession.sparkContext.broadcast(marked(wanted, "at", GRAM_BITS))
    seen = grams(text, bits, f"key {docs.schema[key].dataType.simpleString()}")(docs, F.col(key))
    return seen.join(wanted.select("gram"), "gram", "left_semi").distinct().groupBy(F.col("key").alias(key)).agg(F.count("*").alias("hits"))


def mix_report(docs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Documents, words, bytes and share of bytes per group."""
    t = F.coalesce(F.col(text), F.lit(""))
    g = docs.groupBy(*by).agg(F.count("*").alias("docs"), F.sum(F.size(words(t))).alias("words"), F.sum(F.octet_length(t)).alias("bytes"))
    return with_totals(g, [], [F.sum("bytes").alias("_all")]).withColumn("share", F.col("bytes") / F.col("_all")).drop("_all")


def keep_rates(docs: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows that come to and stay after each stage, one pass; a stage looks at what the ones before it kept."""
    passed, cols = F.lit(True), []
    for k, (_, ok) in enumerate(stages):
        cols.append(F.count_if(passed).alias(f"i{k}"))
        passed = passed & F.coalesce(ok, F.lit(False))
        cols.append(F.count_if(passed).alias(f"o{k}"))
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.col(f"i{k}").alias("rows_in"), F.col(f"o{k}").alias("rows_out")) for k, (name, _) in enumerate(stages)])
    return docs.agg(*cols).select(F.inline(rows)).withColumn("keep_rate", F.col("rows_out") / F.greatest("rows_in", F.lit(1)))


def token_report(docs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """Words, a quarter of the characters as estimated tokens, and tokens per word."""
    t = F.coalesce(F.col(text), F.lit(""))
    g = docs.groupBy(*by).agg(F.sum(F.size(words(t))).alias("words"), F.sum(F.ceil(F.length(t) / 4)).alias("tokens"))
    return g.withColumn("fertility", F.col("tokens") / F.greatest("words", F.lit(1)))


def mixture_sample(df: DataFrame, key: str, group: str, weights: dict[str, float], other: float = 0.0) -> DataFrame:
    """Rows in so many copies as their group's weight says: whole copies, and one more by the hash of the key for the rest."""
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col(group) == name, F.lit(float(w))).otherwise(weight)
    copies = F.floor(weight) + (hash_share(F.col(key)) < weight - F.floor(weight)).cast("int")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1))))).where(F.col("copy") <= copies)


def curriculum_order(df: DataFrame, key: str, score: str, phases: int) -> DataFrame:
    """Phase by the score's rank, and a shuffled place inside the phase that the key's hash decides."""
    phased = ranked(df, [], [score, key], {"phase": f"ntile:{phases}"}).withColumn("_h", hash_share(F.col(key)))
    return ranked(phased, ["phase"], ["_h", key], {"place": "row_number"}).drop("_h")


def drop_words(docs: DataFrame, key: str, text: str, share: float, seed: int = 1) -> DataFrame:
    """Augmented text: each word goes with the given probability, by the hash of seed, key and place."""
    kept = F.filter(F.transform(words(F.col(text)), lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: hash_share(F.lit(seed), F.col(key), x["i"]) >= share)
    return docs.withColumn("augmented", F.array_join(F.transform(kept, lambda x: x["w"]), " "))


def add_noise(df: DataFrame, key: str, columns: Sequence[str], scale: float, seed: int = 1) -> DataFrame:
    """Numeric columns with uniform noise of ``scale`` standard deviations to either side, by the hash of seed, key and column."""
    spread = with_totals(df, [], [F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    return spread.withColumns({c: F.col(c) + (2 * hash_share(F.lit(seed), F.col(key), F.lit(c)) - 1) * scale * F.col(f"_s_{c}") for c in columns}).drop(*[f"_s_{c}" for c in columns])


def chat_strings(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One string per conversation with marked turns in order; a conversation is one row, as its result is one string."""
    turn = F.concat(F.lit("<|im_start|>"), F.coalesce(F.col(role), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("<|im_end|>\n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), turn.alias("t"))))
    return turns.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("chat"))


def instruction_pairs(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    w = Window.partitionBy(key).orderBy(order)
    seen = turns.select(key, order, role, F.col(text).alias("instruction"), F.lead(role).over(w).alias("_r"), F.lead(text).over(w).alias("response"))
    return seen.where((F.col(role) == "user") & (F.col("_r") == "assistant")).select(key, order, "instruction", "response")


def tuning_checks(pairs: DataFrame, least: int = 2, most: int = 400) -> DataFrame:
    """Counts over instruction pairs: too short or long answers, prompts with contradicting answers, share of distinct words."""
    n = F.size(words(F.col("response")))
    prompts = pairs.groupBy(squeezed(F.col("instruction")).alias("p")).agg(F.count_distinct(squeezed(F.col("response"))).alias("answers"))
    spoken = pairs.select(F.explode(words(F.lower("response"))).alias("w")).agg(F.count_distinct("w").alias("distinct_words"), F.count("*").alias("all_words"))
    one = pairs.agg(F.count("*").alias("pairs"), F.count_if(n < least).alias("short"), F.count_if(n > most).alias("long"))
    two = prompts.agg(F.count_if(F.col("answers") > 1).alias("contradicting"))
    return join_nullsafe(join_nullsafe(one, two, []), spoken, [])


def preference_pairs(answers: DataFrame, prompt: str, answer: str, score: str) -> DataFrame:
    """Best and worst answer of a prompt (the first of equal ones by id), if they differ in score, with the loss of ranking them by that difference."""
    g = answers.where(F.col(score).isNotNull()).groupBy(prompt).agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(answer).alias("i"))).alias("hi"), F.min(F.struct(F.col(score).alias("s"), F.col(answer).alias("i"))).alias("lo"))
    delta = -F.col("hi.s") - F.col("lo.s")
    return g.where(delta > 0).select(prompt, F.col("hi.i").alias("chosen"), F.col("lo.i").alias("rejected"), F.log1p(F.exp(-delta.cast("double"))).alias("loss"))
