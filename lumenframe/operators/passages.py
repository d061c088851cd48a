"""Long passages that stand at more than one place of a corpus: boilerplate, quoted and copied text.

A passage of ``n`` words is shared if the same words stand in a row at two places or more, in one text or in several. A text's spans are the maximal runs
of words that shared passages cover. They are found in two rounds that shuffle little:

* Winnowing: of the hashes of ``gram`` consecutive words, every run of ``n`` words names its smallest. Equal passages name equal grams, so a passage can
  only be shared if its gram is. About two grams in ``n - gram + 2`` are named; they are counted by hash, partial counts first.
* Around named grams that occur again, every passage that could have named them is hashed and counted; those that occur again are shared, and the
  union of a text's shared passages gives its spans.

Counts are joined back to the places by ``rows_of_keys``: hashes with very many places (a header that a third of all texts have) are few, since their counts
add up to the number of rows, and travel to the rows; the rest is joined by hash. No two texts are compared, so a passage with a million places costs a million rows.

Words are runs of other characters than space, tab and line ends, taken as written. Hashes have 64 bits; two passages that share one by chance are taken for equal (once
in about 10^19 pairs). Null, empty and short texts have no spans. Rows are told apart by id and text; repeated rows share all their passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.scaling import rows_of_keys
from lumenframe.session import scratch_path

PLACES = "_row long, at long, hash long"
MOST_WORDS = 150_000


@dataclass(frozen=True)
class Passages:
    n: int = 50
    gram: int = 10

    def __post_init__(self):
        if not 1 <= self.gram <= self.n:
            raise ValueError("a gram has at least one word and no more than a passage")


class _Hashes(dict):
    """Word to a 64-bit hash; starts anew when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def _spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` words in a row."""
    last = len(hashes) - n + 1
    out = np.full(max(last, 0), n, np.uint64)
    for k in range(n) if last > 0 else ():
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : last + k]
    return _spread_bits(out)


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest (leftmost of equal ones) of every ``width`` grams in a row."""
    if len(grams) < width:
        return np.empty(0, np.int64)
    found = []
    for k in range(0, len(grams) - width + 1, 1 << 16):  # a bounded piece of the table of windows at a time
        view = np.lib.stride_tricks.sliding_window_view(grams[k : k + (1 << 16) + width - 1], width)
        found.append(np.unique(view.argmin(1) + np.arange(k, k + len(view))))
    return np.unique(np.concatenate(found))


def _rows(rows: list[int], at: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    sizes = [len(x) for x in at]
    whole = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_pydict({
        "_row": pa.array(np.repeat(np.array(rows, np.int64), sizes)), "at": pa.array(whole(at, np.int64)), "hash": pa.array(whole(hashes, np.uint64).view(np.int64)),
    })


def _each(places: Callable[[dict], tuple[np.ndarray, np.ndarray]]):
    """Turns a function from a row to places and their hashes into one over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, hashes, size = [], [], [], 0
            for row in batch.to_pylist():
                a, h = places(row)
                rows.append(row["_row"])
                at.append(a)
                hashes.append(h)
                size += len(a)
                if size > 1 << 18:
                    yield _rows(rows, at, hashes)
                    rows, at, hashes, size = [], [], [], 0
            yield _rows(rows, at, hashes)

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _again(places: DataFrame) -> DataFrame:
    """The places whose hash has another place."""
    return rows_of_keys(places, places.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "hash", "n")


def shared_spans(docs: DataFrame, key: str, text: str, settings: Passages = Passages()) -> DataFrame:
    """``_row, spans``: spans ``[(start, stop)]`` in words for the rows that have some; ``_row`` is the hash of key and text."""
    n, gram = settings.n, settings.gram
    rows = docs.select(row_hash(key, text).alias("_row"), F.col(text).alias("text")).where(F.col("text").isNotNull())

    def named(row: dict) -> tuple[np.ndarray, np.ndarray]:
        grams = runs(word_hashes(row["text"]), gram)
        at = winnowed(grams, n - gram + 1)
        return at, grams[at]

    def around(row: dict) -> tuple[np.ndarray, np.ndarray]:
        passages = runs(word_hashes(row["text"]), n)
        starts = np.unique((np.array(row["at"], np.int64)[:, None] - np.arange(n - gram + 1)).ravel())
        starts = starts[(starts >= 0) & (starts < len(passages))]
        return starts, passages[starts]

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for starts in batch.column("starts").to_pylist():
                s = np.unique(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(s) > n)
                spans.append([{"start": int(a), "stop": int(b) + n} for a, b in zip(s[np.concatenate([[0], cut + 1])], s[np.concatenate([cut, [len(s) - 1]])])])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(spans, kind)], names=["_row", "spans"])

    grams = _kept(rows.mapInArrow(_each(named), PLACES), "passage-grams")
    candidates = _again(grams).groupBy("_row").agg(F.collect_set("at").alias("at"))
    passages = _kept(rows.join(candidates, "_row").mapInArrow(_each(around), PLACES), "passage-places")
    shared = _again(passages).groupBy("_row").agg(F.collect_set("at").alias("starts"))
    return shared.mapInArrow(union, "_row long, spans array<struct<start: long, stop: long>>")


def row_hash(key: str, text: str):
    return F.xxhash64(F.col(key), F.col(text))


def shared_passages(docs: DataFrame, key: str, text: str, settings: Passages = Passages()) -> DataFrame:
    """``key, n_words, shared_words, spans`` for every row."""
    found = shared_spans(docs, key, text, settings)
    words = F.when(F.trim(squeezed := F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(squeezed), " ")))
    out = docs.select(F.col(key), words.cast("long").alias("n_words"), row_hash(key, text).alias("_row")).join(found, "_row", "left")
    size = F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return out.select(key, "n_words", F.coalesce(size, F.lit(0)).alias("shared_words"), F.coalesce("spans", F.array().cast("array<struct<start: long, stop: long>>")).alias("spans"))


def drop_sharing(docs: DataFrame, key: str, text: str, percent: float = 50, settings: Passages = Passages()) -> DataFrame:
    """The rows of which shared passages cover at most ``percent`` of the words, with all their columns."""
    found = shared_passages(docs, key, text, settings).where(F.col("shared_words") * 100 > F.col("n_words") * percent).select(F.col(key).alias("_key")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
