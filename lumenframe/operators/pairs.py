"""Frequent pairs of items that stand in the same baskets, with first-pass buckets that keep rare pairs out of the shuffle.

A pair that stands in ``min_support`` baskets has items that do, and falls into a bucket of pairs whose count reaches ``min_support`` too. So a first pass over the
baskets counts pairs by hashed bucket, summed inside each task before anything is shuffled; the frequent buckets become a bitmap of bounded size. The second pass
lists a pair only if both items and its bucket are marked, and counts those exactly. Hash collisions only let more pairs into the count.
With fewer than ``plain_pairs`` pairs in all, the first pass costs more than it saves and is left out.

Baskets over ``chunk_items`` items are cut by item into chunks, and each pair of chunks is a row of its own: no task holds a basket whole, and none
is left out or kept on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from lumenframe.session import scratch_path

#: Bits of one row of ``bitmap_construct_agg``.
ROW_BITS = 32_768
#: Pairs that a task holds at a time.
PIECE = 1 << 21


@dataclass(frozen=True)
class Buckets:
    chunk_items: int = 1_000
    plain_pairs: int = 50_000_000
    item_bits: int = 24
    pair_bits: int = 22


def spot(x: np.ndarray, bits: int) -> np.ndarray:
    """A place below ``2 ** bits`` for 64-bit numbers."""
    x = np.ascontiguousarray(x).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - bits)).astype(np.int64)


def marked(spots: DataFrame, column: str, bits: int) -> np.ndarray:
    """Packed bits of a column of places; the driver gets ``2 ** bits / 8`` bytes at most."""
    rows = spots.groupBy(F.floor(F.col(column) / ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.pmod(column, F.lit(ROW_BITS))).alias("bits")).collect()
    out = np.zeros(max(1 << bits, ROW_BITS) // 8, np.uint8)
    for r in rows:
        at = r["row"] * (ROW_BITS // 8)
        out[at : at + ROW_BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def holds(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chunks(items: DataFrame, settings: Buckets) -> DataFrame:
    """``basket, chunk, set``: the distinct items of each basket, cut by item where they are many."""
    sizes = items.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > settings.chunk_items)
    large = _stored(sizes.select("basket", F.ceil(F.col("n") / settings.chunk_items).cast("int").alias("cuts")), "pair-baskets")
    chunk = F.lit(0)
    if not large.isEmpty():
        items = items.join(large, "basket", "left")
        chunk = F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("item"), F.col("cuts"))).otherwise(0).cast("int")
    return _stored(items.groupBy("basket", chunk.alias("chunk")).agg(F.collect_set("item").alias("set")), "pair-chunks")


def _units(chunks: DataFrame) -> DataFrame:
    """Rows whose pairs are to be listed: those inside ``a``, or between ``a`` and ``b``."""
    own = chunks.select(F.col("set").alias("a"), F.lit(None).cast("array<bigint>").alias("b"))
    cut = _stored(chunks.where("chunk > 0").select("basket").distinct(), "pair-cut-baskets")
    if cut.isEmpty():
        return own
    some = chunks.join(cut, "basket", "left_semi")
    first, second = some.select("basket", F.col("chunk").alias("c"), F.col("set").alias("a")), some.select("basket", F.col("chunk").alias("d"), F.col("set").alias("b"))
    return own.unionByName(first.join(second, "basket").where("c < d").select("a", "b"))


def _inside(flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each of several sets that lie one after the other, in pieces."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    more = ends - np.arange(len(flat)) - 1  # partners behind each item
    upto = np.cumsum(more)
    at = 0
    while at < len(flat):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE, side="right")), at + 1)
        n = more[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield flat[left], flat[right]
        at = stop


def _pairs(batch: pa.RecordBatch, bits: np.ndarray, item_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of marked items, the smaller one first."""
    a, b = batch.column("a"), batch.column("b")
    between = np.asarray(b.is_valid())

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = np.asarray(column.flatten(), np.int64)
        sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
        keep = holds(bits, spot(flat, item_bits))
        row = np.repeat(np.arange(len(sizes)), sizes)[keep]
        return flat[keep], np.bincount(row, minlength=len(sizes))

    inside = pa.array(~between)
    for x, y in _inside(*sets(a.filter(inside))):
        yield np.minimum(x, y), np.maximum(x, y)
    for k in np.flatnonzero(between).tolist():
        left, right = sets(a.slice(k, 1))[0], sets(b.slice(k, 1))[0]
        if len(left) and len(right):
            step = max(1, PIECE // len(right))
            for at in range(0, len(left), step):
                x, y = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
                yield np.minimum(x, y), np.maximum(x, y)


def _code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + y.view(np.uint64)


def _bucket_bits(units: DataFrame, items: Broadcast, min_support: int, settings: Buckets) -> np.ndarray:
    """First pass: which buckets of pairs are frequent."""
    item_bits, pair_bits = settings.item_bits, settings.pair_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << pair_bits, np.int64)
        for batch in batches:
            for x, y in _pairs(batch, items.value, item_bits):
                total += np.bincount(spot(_code(x, y), pair_bits), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(total[used])})

    counted = units.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support)
    return marked(counted, "bucket", pair_bits)


def frequent_pairs(baskets: DataFrame, basket: str, item: str, min_support: int = 10, settings: Buckets = Buckets()) -> DataFrame:
    """``item_a, item_b, n, support_a, support_b`` of all pairs in at least ``min_support`` baskets, ``item_a`` before ``item_b``.

    Repeated rows count once; rows without basket or item are left out. Items are whole numbers or anything that can be ordered.
    """
    spark = baskets.sparkSession
    bought = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    names = None
    kind = bought.schema["item"].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        names = _stored(bought.select("item").distinct().withColumn("no", F.monotonically_increasing_id()), "pair-items")
        bought = bought.join(names, "item").select("basket", F.col("no").alias("item"))
    chunks = _chunks(bought.withColumn("item", F.col("item").cast("long")), settings)
    support = _stored(chunks.select(F.explode("set").alias("item")).groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= min_support), "pair-support")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"at": pa.array(spot(np.asarray(batch.column("item"), np.int64), settings.item_bits))})

    items = spark.sparkContext.broadcast(marked(support.select("item").mapInArrow(places, "at long"), "at", settings.item_bits))
    units = _units(chunks)
    size, other = F.size("a").cast("double"), F.size("b").cast("double")
    listed = units.agg(F.sum(F.when(F.col("b").isNull(), size * (size - 1) / 2).otherwise(size * other))).first()[0] or 0
    frequent = spark.sparkContext.broadcast(_bucket_bits(units, items, min_support, settings)) if listed > settings.plain_pairs else None

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in _pairs(batch, items.value, settings.item_bits):
                if frequent is not None:
                    keep = holds(frequent.value, spot(_code(x, y), settings.pair_bits))
                    x, y = x[keep], y[keep]
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(x)))
                yield pa.RecordBatch.from_pydict({"item_a": pa.array(x[first]), "item_b": pa.array(y[first]), "n": pa.array(n)})

    pairs = units.mapInArrow(second, "item_a long, item_b long, n long").groupBy("item_a", "item_b").agg(F.sum("n").alias("n")).where(F.col("n") >= min_support)
    side = lambda s: support.select(F.col("item").alias(f"item_{s}"), F.col("support").alias(f"support_{s}"))
    out = pairs.join(side("a"), "item_a").join(side("b"), "item_b").select("item_a", "item_b", "n", "support_a", "support_b")
    if names is None:
        return out.withColumns({c: F.col(c).cast(kind) for c in ("item_a", "item_b")})
    for s in "ab":
        out = out.join(names.select(F.col("no").alias(f"item_{s}"), F.col("item").alias(f"name_{s}")), f"item_{s}")
    turn = F.col("name_a") > F.col("name_b")
    return out.select(F.least("name_a", "name_b").alias("item_a"), F.greatest("name_a", "name_b").alias("item_b"), "n",
                      F.when(turn, F.col("support_b")).otherwise(F.col("support_a")).alias("support_a"), F.when(turn, F.col("support_a")).otherwise(F.col("support_b")).alias("support_b"))
