"""Frequent pairs against counting every pair."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import pairs
from lumenframe.operators.pairs import Buckets


def brute(rows, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    support = Counter(i for s in baskets.values() for i in s)
    counted = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return sorted((a, b, n, support[a], support[b]) for (a, b), n in counted.items() if n >= least)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(b, i) for b in range(3) for i in range(60)] + [(b, r.randint(0, 80)) for b in range(3, 200) for _ in range(r.randint(1, 7))]
    return [*out, (None, 3), (5, None), (7, -2), (8, -2), (7, 2**62), (8, 2**62), (9, 1), *out[:50]]


@pytest.mark.parametrize("settings", [Buckets(), Buckets(plain_pairs=0), Buckets(chunk_items=7, plain_pairs=0), Buckets(chunk_items=7, plain_pairs=0, item_bits=4, pair_bits=3), Buckets(chunk_items=2)])
def test_equals_counting_all_pairs(spark, rows, settings):
    df = spark.createDataFrame(rows, "b long, i long").repartition(5)
    for least in (2, 5):
        assert got(pairs.frequent_pairs(df, "b", "i", least, settings)) == brute(rows, least)


def test_names_and_small_types(spark, rows):
    named = [(b, None if i is None else f"x{i}") for b, i in rows]
    assert got(pairs.frequent_pairs(spark.createDataFrame(named, "b long, i string"), "b", "i", 3)) == brute(named, 3)
    few = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (2, 3)], "b int, i int")
    out = pairs.frequent_pairs(few, "b", "i", 2)
    assert got(out) == [(2, 3, 2, 2, 2)] and out.schema["item_a"].dataType.simpleString() == "int"
    assert got(pairs.frequent_pairs(few.limit(0), "b", "i", 2)) == []


def test_a_basket_of_twenty_thousand_items(spark):
    """Two hundred million pairs are in it; those that a small basket shares are found, at a support of two."""
    large = spark.range(20_000).select(F.lit(0).cast("long").alias("b"), F.col("id").alias("i"))
    small = [(b, i) for b in range(1, 40) for i in (b * 7, b * 7 + 1, b * 11 + 20_000)]
    out = got(pairs.frequent_pairs(large.unionByName(spark.createDataFrame(small, "b long, i long")), "b", "i", 2))
    assert [r[:3] for r in out] == [(b * 7, b * 7 + 1, 2) for b in range(1, 40)]


def test_rare_pairs_stay_out_of_the_count(spark):
    """With the buckets of the first pass, few of the pairs are listed."""
    r = random.Random(3)
    rows = [(b, r.randint(0, 3000)) for b in range(400) for _ in range(30)] + [(b, i) for b in range(400, 420) for i in (1, 2)]
    df = spark.createDataFrame(rows, "b long, i long")
    chunks = pairs._chunks(df.selectExpr("b AS basket", "i AS item"), Buckets())
    every = spark.sparkContext.broadcast(np.full(1 << 21, 255, "uint8"))
    bits = pairs._bucket_bits(pairs._units(chunks), every, 5, Buckets(pair_bits=20))
    assert 0 < int(np.bitwise_count(bits).sum()) < 50
    assert got(pairs.frequent_pairs(df, "b", "i", 5, Buckets(plain_pairs=0, pair_bits=20))) == brute(rows, 5)
