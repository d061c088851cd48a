"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut_lineage, scratch_path

#: Makes A-Z lower case and leaves every other byte alone.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Text bytes that a task turns into Python objects at a time.
CHUNK_BYTES = 1 << 20


def named(name: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash."""
    return docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about ``limit`` bytes of the column, or one row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash that is equal in every process; forgets all when it holds too many."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; one hash of the whole sequence if it is shorter."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return out


# Membership filter of bounded size -------------------------------------------------------------

#: Bits held by one aggregated bitmap (4,096 bytes), a property of ``bitmap_construct_agg``.
BITMAP_BITS = 32_768
#: At most 32 MB of bits: beyond about 30 million keys the filter lets more rows pass, and stays right.
MOST_BITS = 1 << 28


def membership_bits(keys: DataFrame, column: str, n_keys: int) -> tuple[np.ndarray, int]:
    """Two-hash Bloom filter of a long column as packed bits.

    Built by native bitmap aggregation; what reaches the driver is the bit array, at most MOST_BITS / 8 bytes
    whatever the number of keys. A false positive only lets a row through to the exact join behind it.
    """
    bits = BITMAP_BITS
    while bits < MOST_BITS and bits < 16 * max(n_keys, 1):
        bits *= 2
    key = named(column)
    spots = F.array(F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)))
    rows = (
        keys.select(F.explode(spots).alias("h"))
        .select(F.pmod(F.col("h"), F.lit(bits)).alias("at"))
        .groupBy((F.col("at") / F.lit(BITMAP_BITS)).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg(F.pmod(F.col("at"), F.lit(BITMAP_BITS))).alias("bits"))
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = r["part"] * (BITMAP_BITS // 8)
        out[at : at + BITMAP_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out, bits


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _spark_hash(key: np.ndarray, last: int) -> np.ndarray:
    """``xxhash64(key, last)`` of the engine for a long column and an int literal (public XXH64 algorithm)."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P5 + np.uint64(8)
        h = h ^ (_rotl(key * _P2, 31) * _P1)
        h = _avalanche(_rotl(h, 27) * _P1 + _P4)
        h = h + _P5 + np.uint64(4)
        h = h ^ (np.uint64(last) * _P1)
        return _avalanche(_rotl(h, 23) * _P2 + _P3)


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def maybe_members(keys: np.ndarray, bits: np.ndarray, n_bits: int) -> np.ndarray:
    """True where the filter may hold the key (never false for a held one)."""
    keys = np.ascontiguousarray(keys).view(np.uint64)
    left = np.arange(len(keys))
    for last in (1, 2):
        at = (_spark_hash(keys[left], last) & np.uint64(n_bits - 1)).astype(np.int64)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    found = np.zeros(len(keys), bool)
    found[left] = True
    return found


# Connected components ---------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of an edge list ``a long, b long``.

    Alternating large-star and small-star steps: each keeps the edge list linear in the number of nodes, so a hub
    costs no more than its edges, and the number of steps grows with the logarithm of the longest path. It ends when every edge leads to
    a node that has no smaller neighbour. Returns ``id, root``; nodes without edges don't appear. Lineage is cut by reliable checkpoints; the least
    neighbours are cut too, so that the join with them deals rows out by itself and a hub's rows can be split over tasks.
    """
    def toward_smallest(e: DataFrame, both: bool) -> DataFrame:
        """Connects the neighbours of each node to the smallest of them and itself."""
        near = e.select(F.col("a").alias("n"), F.col("b").alias("x"))
        if both:
            near = near.unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("x")))
        least = cut_lineage(near.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")))
        joined = near.join(least, "n")
        spokes = joined.filter("x > n") if both else joined
        out = spokes.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def all_stars(e: DataFrame) -> bool:
        """Each node has one edge to a smaller node, or only edges from larger ones."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        return ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1").isEmpty()

    e = cut_lineage(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not all_stars(e):
        e = cut_lineage(toward_smallest(toward_smallest(e, True), False))
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared scratch folder and reads them back: nothing behind it is computed again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
