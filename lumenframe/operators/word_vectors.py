"""Word vectors of large vocabularies: skip-gram with hierarchical softmax, without a table of words on the driver that grows by a kilobyte a word.

Words are ranked by their count, and a word's Huffman code follows from its rank alone: codes are canonical, so a row per code length describes the whole tree, and the lengths come from a histogram of the
counts. A word is told by its 64-bit hash, so the tasks get eight bytes of hash and four of rank for each word, and no text leaves the JVM. Each task trains on its texts in pieces, over the words and inner
nodes of a piece only, and the words' vectors are averaged over the pieces that held them, as MLlib does over partitions. The driver then holds ``size`` floats a word, which the tasks need to
add up a text's words.

Inside a piece, ``BATCH`` places learn at a time from the vectors as they were. A row that more than ``MOST_STEPS`` pairs of a batch push gets the mean of their pushes times ``MOST_STEPS``, so
that the top of the tree doesn't overshoot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.scaling import ranked, spread
from lumenframe.session import scratch_path

#: As in MLlib: words of a sentence at most, words on each side, first step, and scores that count as certain.
SENTENCE, WINDOW, STEP, SURE = 1_000, 5, 0.025, 6.0
#: Places that learn at a time, and pushes of one row that add up in full.
BATCH, MOST_STEPS = 512, 64
#: Words of a piece, and of a part of the texts whose vectors are added up at a time.
PIECE_WORDS, SUM_WORDS = 2_500_000, 200_000
#: Rows of words' vectors that are averaged in one call at most.
MEAN_ROWS = 500_000
#: Deepest inner node that has a number.
MOST_DEPTH = 62


@dataclass(frozen=True)
class Codes:
    """Per code length with words: the length, the first rank that has it, that rank's code."""

    length: np.ndarray
    rank: np.ndarray
    code: np.ndarray

    def of(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.rank, ranks, side="right") - 1
        return self.length[at], self.code[at] + (ranks - self.rank[at])


def code_lengths(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words have a Huffman code of each length, from how many words have each count.

    Equal subtrees are one entry with a number, so the work follows the different counts, not the words.
    """
    held = [int(n) for n in words]
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    left, parts = list(held), [()] * len(held)

    def put(weight: int, n: int, *children: tuple[int, int]) -> None:
        held.append(n)
        left.append(n)
        parts.append(children)
        heapq.heappush(heap, (weight, len(held) - 1))

    while len(heap) > 1 or left[heap[0][1]] > 1:
        weight, k = heapq.heappop(heap)
        if left[k] > 1:
            put(2 * weight, left[k] // 2, (k, 2))
            left[k] %= 2
            if left[k]:
                heapq.heappush(heap, (weight, k))
            continue
        other, j = heapq.heappop(heap)
        left[k], left[j] = 0, left[j] - 1
        if left[j]:
            heapq.heappush(heap, (other, j))
        put(weight + other, 1, (k, 1), (j, 1))
    depths = np.zeros((len(held), MOST_DEPTH + 2), np.int64)
    depths[-1, 0] = 1
    for k in range(len(held) - 1, len(words) - 1, -1):
        if depths[k, MOST_DEPTH:].any():
            raise ValueError(f"a code is longer than {MOST_DEPTH}")
        for child, times in parts[k]:
            depths[child, 1:] += times * depths[k, :-1]
    return depths[: len(words)].sum(0)


def canonical(lengths: np.ndarray) -> Codes:
    rows, rank, code, last = [], 0, 0, 0
    for length in np.flatnonzero(lengths).tolist():
        code <<= length - last
        rows.append((length, rank, code))
        rank, code, last = rank + int(lengths[length]), code + int(lengths[length]), length
    return Codes(*(np.array(c, np.int64) for c in zip(*rows)))


def first_vectors(ranks: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Even over half a step to both sides of 0, by a hash of rank and dimension: the same in every task."""
    with np.errstate(over="ignore"):
        x = ranks.astype(np.uint64)[:, None] * np.uint64(size) + np.arange(size, dtype=np.uint64)[None] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x + np.uint64(0x9E3779B97F4A7C15)) if shift == 30 else x
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)) - np.float32(0.5)) / np.float32(size)


def _push(rows: np.ndarray, at: np.ndarray, by: np.ndarray, pairs: np.ndarray) -> None:
    """Adds ``by`` to the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(start):
        n = np.add.reduceat(pairs[order], start)
        rows[at[start]] += np.add.reduceat(by[order], start) * np.minimum(1, MOST_STEPS / np.maximum(n, 1)).astype(np.float32)[:, None]


def train(ranks: np.ndarray, sentence: np.ndarray, codes: Codes, size: int, seed: int, iterations: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The different ranks of a piece and their vectors; ``sentence`` numbers the places' sentences, in order."""
    held, word = np.unique(ranks, return_inverse=True)
    length, code = codes.of(held)
    depth = np.arange(max(int(length.max(initial=0)), 1))
    inside = depth[None] < length[:, None]
    behind = np.maximum(length[:, None] - depth[None], 1)
    number = np.where(inside, (np.int64(1) << np.where(inside, depth[None], 0)) + np.where(inside, (code[:, None] >> (behind - 1)) >> 1, 0), 0)
    wish = np.where(inside, 1 - ((code[:, None] >> (behind - 1)) & 1), 0).astype(np.float32)  # right is 0
    nodes, path = np.unique(number, return_inverse=True)
    path = path.reshape(number.shape).astype(np.int32)
    vectors, inner = first_vectors(held, size, seed), np.zeros((len(nodes), size), np.float32)
    offsets = np.concatenate([np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1)])
    n = len(word)
    padded, of = np.pad(word, WINDOW), np.pad(sentence, WINDOW, constant_values=-1)
    for turn in range(iterations):
        for a in range(0, n, BATCH):
            b = min(a + BATCH, n)
            step = np.float32(STEP * max(1 - (turn + a / n) / iterations, 1e-4))
            place = np.arange(a, b)[:, None] + WINDOW + offsets[None]
            reach = WINDOW - random.integers(0, WINDOW, b - a)
            near = (of[place] == sentence[a:b, None]) & (np.abs(offsets)[None] <= reach[:, None])
            mine = word[a:b]
            steps = inside[mine]
            deep = int(length[mine].max())
            if not deep or not near.any():
                continue
            steps, at = steps[:, :deep], path[mine, :deep]
            x, y = vectors[padded[place]], inner[at]
            f = x @ y.transpose(0, 2, 1)
            counts = (np.abs(f) < SURE) & near[:, :, None] & steps[:, None, :]
            g = (wish[mine, None, :deep] - 1 / (1 + np.exp(-np.clip(f, -SURE, SURE)))) * step * counts
            to_x, to_y = g @ y, g.transpose(0, 2, 1) @ x
            moved, pairs = np.zeros((b - a + 2 * WINDOW, size), np.float32), np.zeros(b - a + 2 * WINDOW, np.int64)
            for k, o in enumerate(offsets + WINDOW):
                moved[o : o + b - a] += to_x[:, k]
                pairs[o : o + b - a] += near[:, k]
            used = np.flatnonzero(pairs)
            _push(vectors, padded[a : b + 2 * WINDOW][used], moved[used], pairs[used])
            _push(inner, at[steps], to_y[steps], np.repeat(near.sum(1), steps.sum(1)))
    return held, vectors


def _hashes(words: Column) -> Column:
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column and the rows' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


class Places:
    """The rank of a hashed word, or -1."""

    def __init__(self, hashes: np.ndarray):
        self.rank = np.argsort(hashes, kind="stable").astype(np.int32)
        self.hashes = hashes[self.rank]

    def of(self, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, self.rank[at], -1)


def known_words(df: DataFrame, words: Column, min_count: int) -> DataFrame:
    """``word, n`` of the words with at least ``min_count`` places, stored."""
    path = scratch_path(df.sparkSession, "known-words")
    spread(df.select(words.alias("w"))).select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).write.parquet(path)
    return df.sparkSession.read.schema("word string, n long").parquet(path)


def mean_vectors(df: DataFrame, words: Column, known: DataFrame, size: int, seed: int, iterations: int, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of the vectors of a row's words over the number of all its words, zeros without any."""
    spark = df.sparkSession
    classes = known.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    codes = canonical(code_lengths(classes.column("n").to_numpy(), classes.column("words").to_numpy()))
    ids = ranked(known, [], ["-n", "word"], {"rank": "row_number"}).select((F.col("rank") - 1).cast("int").alias("rank"), F.xxhash64("word").alias("hash")).toArrow()
    hashes = np.zeros(ids.num_rows, np.int64)
    hashes[ids.column("rank").to_numpy()] = ids.column("hash").to_numpy()
    del ids
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two words have one hash")
    places = spark.sparkContext.broadcast(Places(hashes))
    piece = PIECE_WORDS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        kept, held, last = [], 0, 0

        def trained() -> pa.RecordBatch:
            ranks, vectors = train(*(np.concatenate(c) for c in zip(*kept)), codes, size, seed, iterations, random)
            return pa.RecordBatch.from_arrays([pa.array(ranks.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), size).cast(pa.list_(pa.float32()))], names=["rank", "vector"])

        for batch in batches:
            found, n = _flat(batch.column(0))
            rank, row = places.value.of(found), np.repeat(np.arange(len(n)), n)
            row, rank = row[rank >= 0], rank[rank >= 0]
            if not len(rank):
                continue
            nth = np.arange(len(row)) - np.searchsorted(row, row)  # among the row's known words
            new = np.concatenate([[True], np.diff(row) != 0]) | (nth % SENTENCE == 0)
            sentence = last + np.cumsum(new)
            last = int(sentence[-1])
            for a in range(0, len(rank), piece):
                kept.append((rank[a : a + piece], sentence[a : a + piece]))
                held += len(kept[-1][0])
                if held >= piece:
                    yield trained()
                    kept, held = [], 0
        if kept:
            yield trained()

    texts = spread(df.select(words.alias("w")))
    learned = texts.select(_hashes(F.col("w")).alias("w")).mapInArrow(learn, "rank int, vector array<float>")
    pieces = sum(n * w for n, w in zip(*(classes.column(c).to_pylist() for c in ("n", "words")))) // piece + texts.rdd.getNumPartitions()
    parts = -(-len(hashes) * pieces // MEAN_ROWS)

    def mean(rows: pa.Table) -> pa.Table:
        rank, which = np.unique(rows.column("rank").to_numpy(), return_inverse=True)
        v = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
        total = np.stack([np.bincount(which, v[:, j]) for j in range(size)], 1) / np.bincount(which)[:, None]
        return pa.table([pa.array(rank), pa.FixedSizeListArray.from_arrays(pa.array(total.astype(np.float32).ravel()), size).cast(pa.list_(pa.float32()))], names=["rank", "vector"])

    path = scratch_path(spark, "word-vectors")
    learned.groupBy(F.pmod("rank", F.lit(parts)).alias("part")).applyInArrow(mean, "rank int, vector array<float>").write.parquet(path)
    vectors = first_vectors(np.arange(len(hashes)), size, seed)
    for part in spark.read.schema("rank int, vector array<float>").parquet(path).toArrow().to_batches():
        vectors[part.column("rank").to_numpy()] = part.column("vector").flatten().to_numpy().reshape(-1, size)
    table = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<double>")
    def added(found: pd.Series) -> pd.Series:
        n = found.map(len).to_numpy()
        out, ends, a = np.zeros((len(n), size)), np.cumsum(n), 0
        while a < len(n):
            b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SUM_WORDS, side="right")), a + 1)
            rank = places.value.of(np.concatenate([np.asarray(x, np.int64) for x in found.iloc[a:b]]))
            row = np.repeat(np.arange(b - a), n[a:b])[rank >= 0]
            v = table.value[rank[rank >= 0]]
            if len(row):
                start = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
                out[a + row[start]] = np.add.reduceat(v, start, dtype=np.float64)
            a = b
        return pd.Series(list(out / np.maximum(n, 1)[:, None]))

    return df.withColumn(out, added(_hashes(words)))
