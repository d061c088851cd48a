"""Importance resampling of documents towards a target collection, by hashed words and word pairs.

A text's features are its words and its pairs of consecutive words, joined by a space; a feature's bucket is the CRC-32 of its bytes modulo
the number of buckets. A bucket's gain is the log ratio of its smoothed shares in the target and in the documents, a document's weight the mean
gain of its features, and Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

Head and tail. Tasks summarise which words and pairs are frequent in what they read; the most frequent of all become the head, a table of
bounded size that is broadcast: each word with its CRC and with the CRC state behind "word ", each pair with its bucket. Words outside the head
take their CRC directly, and a pair outside it continues the state of its first word over the bytes of the second. Both ways give the same number, so the head decides
the speed and never the result, and the totals of all buckets are exact over all rows.

Three passes over the texts (head, totals, weights). What is shuffled are summaries of tasks, of bounded size each, and one small row per
document for the ranks. Scores are whole numbers: documents are counted per score, and only drawn ones are ordered, each score by itself.

Null texts have no words. A text without words has weight 0. Texts with fewer words than ``least_words`` get a score and are never drawn. A null id is hashed as an empty string and comes
last among ties; repeated rows are documents of their own. Without documents the result is empty; without target texts every target count is 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import chunks, stored, texts_of

#: A-Z becomes lower case, digits and bytes of other scripts stay, all other ASCII parts words.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Words of more bytes are never in the head, which bounds the broadcast.
MOST_WORD_BYTES = 64
#: Rows that a task gives to the choice of the head: its own most frequent words and pairs.
TASK_WORDS, TASK_PAIRS = 2_048, 4_096
SCHEMA = "doc_id long, n_words long, n_features long, weight long, score long"


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    #: Share of the documents with enough words that is drawn.
    percent: int = 25
    least_words: int = 20
    seed: int = 7
    head_words: int = 8_192
    head_pairs: int = 32_768


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _next_states(crc: np.ndarray, byte: int = 0x20) -> np.ndarray:
    """CRC of the bytes behind ``crc`` and one more."""
    return _BYTE_STEP[(~crc ^ np.uint32(byte)) & np.uint32(255)] ^ (~crc >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)


def _byte_steps() -> np.ndarray:
    """What each value of the low byte adds when a CRC moves on by a byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step.astype(np.uint32)


_BYTE_STEP = _byte_steps()


class Head:
    """Frequent words and pairs; an empty head is right too, only slower."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.index = {w: k for k, w in enumerate(words)}
        self.crc = np.array([crc32(w) for w in words] + [0], np.uint32)
        known = {(a, b) for a, b in pairs if a in self.index and b in self.index}
        coded = sorted((self.index[a] * len(words) + self.index[b], crc32(a + b" " + b) % buckets) for a, b in known)
        self.pair_codes = np.array([c for c, _ in coded], np.int64)
        self.pair_buckets = np.array([b for _, b in coded], np.int64)

    def buckets_of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and for all texts in a row: the bucket of each word, and of the pair that it begins (-1 at a text's last word)."""
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                found = words_of(t)
                sizes[k] = len(found)
                words += found
        n = len(words)
        if not n:
            return sizes, np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, n)
        crc = self.crc[ids]
        tail = ids < 0
        crc[tail] = np.fromiter(map(crc32, compress(words, tail.tolist())), np.uint32, int(tail.sum()))
        one = crc.astype(np.int64) % self.buckets

        two = np.full(n, -1, np.int64)
        begins = np.ones(n, bool)
        ends = np.cumsum(sizes)
        begins[ends[sizes > 0] - 1] = False
        direct = begins.copy()
        if len(self.pair_codes):
            both = np.flatnonzero(begins[:-1] & ~tail[:-1] & ~tail[1:])
            code = ids[both] * len(self.index) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            hit = self.pair_codes[at] == code
            two[both[hit]] = self.pair_buckets[at[hit]]
            direct[both[hit]] = False
        firsts = np.flatnonzero(direct)
        states = _next_states(crc[firsts]).tolist()
        seconds = compress(words, np.concatenate([[False], direct[:-1]]).tolist())
        two[firsts] = np.fromiter(map(crc32, seconds, states), np.int64, len(firsts)) % self.buckets
        return sizes, one, two


def _bytes_of(part: pa.RecordBatch) -> list[bytes | None]:
    return part.column("text").cast(pa.binary()).to_pylist()


def _kept(counts: Counter, most: int) -> Counter:
    return Counter(dict(counts.most_common(most))) if len(counts) > most else counts


def find_head(docs: DataFrame, settings: Resampling = Resampling()) -> Head:
    """The most frequent words and pairs of all texts, as far as the summaries of the tasks tell; at most ``head_words`` and ``head_pairs`` of them reach the driver."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for batch in batches:
            for part in chunks(batch):
                read = [words_of(t) for t in _bytes_of(part) if t]
                mine: Counter = Counter()
                for w in read:
                    mine.update(w)
                often = [w for w, n in mine.most_common(TASK_WORDS) if n > 1 and len(w) <= MOST_WORD_BYTES]
                for w in often:
                    words[w] += mine[w]
                index = {w: k for k, w in enumerate(often)}
                codes = []
                for w in read:
                    ids = np.fromiter(map(index.get, w, repeat(-1)), np.int64, len(w))
                    both = (ids[:-1] >= 0) & (ids[1:] >= 0)
                    codes.append(ids[:-1][both] * len(often) + ids[1:][both])
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    top = np.argsort(-n, kind="stable")[:TASK_PAIRS]
                    for c, k in zip(code[top].tolist(), n[top].tolist()):
                        if k > 1:
                            pairs[often[c // len(often)], often[c % len(often)]] += k
                words, pairs = (_kept(words, TASK_WORDS) if len(words) > 4 * TASK_WORDS else words), (_kept(pairs, TASK_PAIRS) if len(pairs) > 4 * TASK_PAIRS else pairs)
        words, pairs = words.most_common(TASK_WORDS), pairs.most_common(TASK_PAIRS)
        yield pa.RecordBatch.from_pydict({
            "first": pa.array([w for w, _ in words] + [a for (a, _), _ in pairs], pa.binary()),
            "second": pa.array([None] * len(words) + [b for (_, b), _ in pairs], pa.binary()),
            "n": pa.array([n for _, n in words] + [n for _, n in pairs], pa.int64()),
        })

    counted = stored(docs.select("text").mapInArrow(summarise, "first binary, second binary, n long").groupBy("first", "second").agg(F.sum("n").alias("n")), "resampling-head")
    words = [bytes(r[0]) for r in most_frequent(counted.filter("second IS NULL"), settings.head_words).select("first").collect()]
    pairs = [(bytes(a), bytes(b)) for a, b in most_frequent(counted.filter("second IS NOT NULL"), settings.head_pairs).select("first", "second").collect()]
    return Head(words, pairs, settings.buckets)


def most_frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows with the largest ``n``: those above a level of the logarithm, of which a thousand at most are counted on the way."""
    level = F.floor(F.lit(16) * F.log2("n"))
    left, least = most, None
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    return counted.filter(F.lit(False) if least is None else level >= least)


def totals(texts: DataFrame, head: Broadcast, settings: Resampling = Resampling()) -> list[int]:
    """Features per bucket over all rows; one task gives a row per bucket at most, and the driver gets as many as there are buckets."""
    n_buckets = settings.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                _, one, two = head.value.buckets_of(_bytes_of(part))
                total += np.bincount(one, minlength=n_buckets) + np.bincount(two[two >= 0], minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})

    out = [0] * n_buckets
    for bucket, n in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    ratio = [float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)) for s, t in zip(source, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, head: Broadcast, gain: Broadcast, settings: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    seed = settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                sizes, one, two = head.value.buckets_of(_bytes_of(part))
                value = gain.value[one]
                value[two >= 0] += gain.value[two[two >= 0]]
                ends = np.cumsum(sizes)
                upto = np.concatenate([[0], np.cumsum(value)])
                features = sizes + np.maximum(sizes - 1, 0)
                weight = (upto[ends] - upto[ends - sizes]) // np.maximum(features, 1)
                drawn = np.fromiter((noise(i, seed) for i in part.column("doc_id").to_pylist()), np.int64, len(sizes))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_words": pa.array(sizes), "n_features": pa.array(features), "weight": pa.array(weight), "score": pa.array(weight + drawn)})

    return docs.mapInArrow(run, SCHEMA)


def draw(weighed: DataFrame, settings: Resampling = Resampling()) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... for the drawn rows by falling score and rising id, else null.

    One row per score gives the rows above it; scores are thousandths of logarithms, so there are some ten thousand of them, however
    many documents there are, and none holds more than one in 2,700 of the documents of a weight.
    """
    fit: Column = F.col("n_words") >= settings.least_words
    per_score = weighed.filter(fit).groupBy("score").agg(F.count("*").alias("n"))
    all_scores = Window.orderBy(F.desc("score"))
    above = per_score.select("score", (F.sum("n").over(all_scores) - F.col("n")).alias("above"), F.sum("n").over(Window.partitionBy()).alias("all_rows"))
    reached = above.filter(F.col("above") < F.floor(F.col("all_rows") * F.lit(settings.percent) / F.lit(100))).select(
        F.col("score").alias("s"), "above", F.floor(F.col("all_rows") * F.lit(settings.percent) / F.lit(100)).alias("most")
    )
    found = weighed.join(F.broadcast(reached), fit & (F.col("score") == F.col("s")), "left")
    rank = F.col("above") + F.row_number().over(Window.partitionBy("s").orderBy(F.asc_nulls_last("doc_id")))
    kept = found.filter("s IS NOT NULL").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("most"), F.col("rank")))
    rest = found.filter("s IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return kept.unionByName(rest).drop("s", "above", "most")


def resample(docs: DataFrame, target: DataFrame, settings: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs``."""
    context = docs.sparkSession.sparkContext
    own = texts_of(docs, id_col, text_col)
    aimed = texts_of(target.select(F.lit(0).alias("id"), F.col("`" + target_text_col.replace("`", "``") + "`").alias("text")), "id")
    head = context.broadcast(find_head(own, settings))
    gain = context.broadcast(gains(totals(own, head, settings), totals(aimed, head, settings)))
    return draw(stored(weigh(own, head, gain, settings), "resampling-weights"), settings)
