"""Small language models for corpus filters: bigrams with back-off, and character profiles of languages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import words
from lumenframe.operators.scaling import ranked, split_join, spread
from lumenframe.session import scratch_path

#: Stands before the first word; no word is empty.
START = ""
#: Vocabularies of at most so many words are broadcast whole, some tens of megabytes.
SMALL_WORDS = 1_000_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bigrams(df: DataFrame, text: str, *by: str) -> DataFrame:
    """``before, word`` of every place of each text."""
    def zipped(w: Column) -> Column:
        return F.arrays_zip(F.concat(F.array(F.lit(START)), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).alias("before"), w.alias("word"))

    w = words(F.lower(F.col(text)))
    # the outer transform binds the word list, so that a text is split once
    each = F.element_at(F.transform(F.array(F.coalesce(w, F.array().cast("array<string>"))), lambda x: F.when(F.size(x) > 0, zipped(x))), 1)
    return df.select(*by, F.explode(each).alias("p")).select(*by, F.col("p.before").alias("before"), F.col("p.word").alias("word"))


def bigram_perplexity(docs: DataFrame, key: str, text: str, good: DataFrame, k: float = 10.0) -> DataFrame:
    """``key, perplexity`` of each text with words under a bigram model of the texts of ``good`` (same columns).

    A word's share behind another is (count of the pair + k * share of the word alone) / (count of the other + k); the share alone is smoothed by one, and serves for first words and after
    words that ``good`` doesn't have. A place's logarithm is that of an unseen pair, which needs the two words alone, plus a ``gain`` if ``good`` has the pair. So the words meet a small broadcast,
    and only pairs of known words are shuffled, as one number of the words' ranks beside the key; a pair at very many places is left to Spark's skew join. Rows with one key are one text.
    """
    known = _stored(_bigrams(spread(good.select(text)), text).groupBy("word").agg(F.count("*").alias("n_word")), "bigram-words")
    size = known.agg(F.sum("n_word").alias("total"), F.count("*").alias("kinds")).first()
    smooth = F.lit(float((size["total"] or 0) + size["kinds"] + 1))
    ids = _stored(ranked(known, [], ["-n_word", "word"], {"id": "row_number"}).select("word", F.col("id").cast("long").alias("id"), "n_word"), "bigram-ids")

    def numbered(rows: DataFrame, words: DataFrame, *more: str) -> DataFrame:
        """With the ids of both words and their other columns; null where ``good`` lacks the word. Of many words, the most frequent are broadcast, and only places of others are looked up by a shuffle."""
        common = words.where(F.col("id") <= SMALL_WORDS)

        def of(table: DataFrame, column: str, mark: str) -> DataFrame:
            return table.select(F.col("word").alias(column), *[F.col(c).alias(mark + c) for c in ("id", *more)])

        met = rows.join(F.broadcast(of(common, "word", "w_")), "word", "left").join(F.broadcast(of(common, "before", "b_")), "before", "left")
        if size["kinds"] <= SMALL_WORDS:
            return met
        done = F.col("w_id").isNotNull() & (F.col("b_id").isNotNull() | (F.col("before") == START))
        rare = _stored(met.where(~done).select(rows.columns), "bigram-rare")
        looked = split_join(split_join(rare, of(words, "word", "w_"), ["word"], small=SMALL_WORDS), of(words, "before", "b_"), ["before"], small=SMALL_WORDS)
        return met.where(done).unionByName(looked)

    pair = F.shiftleft("b_id", 32).bitwiseOR(F.col("w_id")).alias("pair")
    model = numbered(_bigrams(spread(good.select(text)), text), ids).where("b_id IS NOT NULL").select(pair).groupBy("pair").agg(F.count("*").alias("n_pair"))
    model = _stored(model, "bigram-model")
    behind = model.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.sum("n_pair").alias("n_before"))
    words_of = _stored(ids.join(behind, "id", "left").select("word", "id", "n_word", F.coalesce("n_before", F.lit(0)).alias("n_before")), "bigram-counts")
    share = lambda n: (F.coalesce(n, F.lit(0)) + 1) / smooth
    unseen = F.log(k * share("w_n_word") / (F.coalesce("b_n_before", F.lit(0)) + k))
    places = numbered(_bigrams(spread(docs.select(key, text)), text, key), words_of, "n_word", "n_before")
    alone = places.groupBy(key).agg(F.sum(unseen).alias("log_p"), F.count("*").alias("places"))
    counted = split_join(model.withColumn("id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), ids.select("id", "n_word"), ["id"], small=SMALL_WORDS)
    gains = counted.select("pair", F.log1p(F.col("n_pair") / (k * share("n_word"))).alias("gain"))
    gained = places.where("b_id IS NOT NULL AND w_id IS NOT NULL").select(key, pair).join(gains, "pair").groupBy(key).agg(F.sum("gain").alias("log_p"), F.lit(0).cast("long").alias("places"))
    total = alone.unionByName(gained).groupBy(key).agg(F.sum("log_p").alias("log_p"), F.sum("places").alias("places"))
    return total.select(key, F.exp(-F.col("log_p") / F.col("places")).alias("perplexity"))


# Languages by characters ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Profiles:
    """Log shares of hashed character trigrams per language."""

    names: tuple[str, ...]
    log_share: np.ndarray  # bucket by language


BUCKETS = 16_384
#: A model of more languages would not be small any more.
MOST_LANGUAGES = 1_000


def trigrams(text: str) -> np.ndarray:
    """Bucket of every three characters in a row."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS


def held_out(key: Column) -> Column:
    """A fifth of the rows, by the CRC-32 of the key as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def fit_profiles(docs: DataFrame, text: str, language: str) -> Profiles:
    """Counts trigrams of all rows with a language, add-one smoothed. A task gives a row per language and bucket at most; the driver gets as many in all."""
    names = [r[0] for r in docs.where(F.col(language).isNotNull()).select(language).distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(t) > 2:
                    total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    total[name] += np.bincount(trigrams(t), minlength=BUCKETS)
        for name, n in total.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(used), pa.string()), "bucket": pa.array(used.astype(np.int32)), "n": pa.array(n[used])})

    rows = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).cast("string").alias("name"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "name string, bucket int, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(names)
    n = np.zeros((BUCKETS, len(names)))
    if len(counted):
        n[counted["bucket"], counted["name"].map({x: k for k, x in enumerate(names)})] = counted["n"]
    return Profiles(tuple(names), np.log((n + 1) / (n.sum(0) + BUCKETS)))


def language_of(docs: DataFrame, key: str, text: str, profiles: Profiles) -> DataFrame:
    """``key, language, score, margin``: the language with the highest mean log share of a text's trigrams (the first in alphabet on ties), that share, and its lead over the next.

    Null for texts of fewer than three characters; the margin is null with one language only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                if t is None or len(t) < 3 or not p.names:
                    out.append((None, None, None))
                    continue
                mean = p.log_share[trigrams(t)].mean(0)
                order = np.argsort(-mean, kind="stable")
                out.append((p.names[order[0]], float(mean[order[0]]), float(mean[order[0]] - mean[order[1]]) if len(order) > 1 else None))
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], names=["key", "language", "score", "margin"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, language string, score double, margin double")
    return found.withColumnRenamed("key", key)
