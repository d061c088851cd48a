import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lumenframe.llm import target_resampling
from lumenframe.llm.target_resampling import Head, Resampling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, s=Resampling()):
    """Rows from the definition: every feature's CRC taken by itself."""
    bucket = lambda g: crc32(g.encode()) % s.buckets
    own = [(i, *features(t)) for i, t in docs]
    source, aimed = Counter(bucket(g) for _, _, f in own for g in f), Counter(bucket(g) for t in target for g in features(t)[1])
    n_source, n_aimed = sum(source.values()), sum(aimed.values())
    gain = [math.floor(1000 * math.log((aimed[b] + 1) * (n_source + s.buckets) / ((source[b] + 1) * (n_aimed + s.buckets)))) for b in range(s.buckets)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(fit[: s.percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tables(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))


def test_equals_the_definition_with_any_head(tables):
    docs, target = tables
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    for settings in (Resampling(), Resampling(head_words=0, head_pairs=0), Resampling(head_words=5, head_pairs=3)):
        assert rows_of(target_resampling.resample(docs, target, settings)) == want


def test_head_and_tail_give_one_number():
    texts = ["the cat saw The cat, the 1st cat ünd der Kätzchen".encode(), None, b"", b"cat", b"the", " \t.".encode(), b"zz the cat"]
    heads = [Head([], [], 97), Head([b"the", b"cat", b"\xc3\xbcnd"], [(b"the", b"cat"), (b"cat", b"the"), (b"gone", b"cat")], 97), Head([b"cat"], [], 97)]
    plain = [tuple(x.tolist() for x in h.buckets_of(texts)) for h in heads]
    assert plain[0] == plain[1] == plain[2]
    sizes, one, two = plain[0]
    want = [features(t.decode()) if t else (0, []) for t in texts]
    assert sizes == [n for n, _ in want]
    assert one == [crc32(g.encode()) % 97 for n, f in want for g in f[:n]]
    assert [b for b in two if b >= 0] == [crc32(g.encode()) % 97 for n, f in want for g in f[n:]]


def test_head_holds_what_is_frequent(spark):
    docs = spark.createDataFrame([(k, f"of the house of the word{k} " + "x" * 70) for k in range(50)], "doc_id long, text string").repartition(5)
    head = target_resampling.find_head(docs, Resampling(head_words=3, head_pairs=2))
    assert set(head.index) == {b"of", b"the", b"house"} and len(head.pair_codes) == 1
    assert set(target_resampling.find_head(docs, Resampling(head_words=2)).index) == {b"of", b"the"}
    assert not any(len(w) > target_resampling.MOST_WORD_BYTES for w in target_resampling.find_head(docs).index)


def test_odd_rows(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, None), (2, "one tie"), (3, "")], "item_id long, text string")
    settings = Resampling(least_words=1, percent=60)
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], [None, "one tie", ""], settings)
    assert rows_of(target_resampling.resample(odd_docs, target, settings)) == want
    assert rows_of(target_resampling.resample(odd_docs, target.limit(0), settings)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], [], settings)
    assert target_resampling.resample(no_docs, target).collect() == []


def test_ties_go_to_the_smaller_id(spark):
    rows = [(k, 30, 59, 0, 5 if k % 2 else 9) for k in range(40)] + [(99, 3, 5, 0, 100)]
    weighed = spark.createDataFrame(rows, target_resampling.SCHEMA)
    got = {r.doc_id: r["rank"] for r in target_resampling.draw(weighed, Resampling(percent=75)).collect()}
    order = [*range(0, 40, 2), *range(1, 40, 2)]
    assert got == {i: k + 1 if k < 30 else None for k, i in enumerate(order)} | {99: None}


def test_drawn_documents_look_like_the_target(spark):
    source = [(k, " ".join([f"w{(k * 7 + j) % 50}" for j in range(30)] if k % 4 else [f"t{(k + j) % 20}" for j in range(30)])) for k in range(400)]
    docs = spark.createDataFrame(source, "doc_id long, text string")
    target = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(20))) for k in range(300)], "item_id long, text string")
    drawn = [r.doc_id for r in target_resampling.resample(docs, target, Resampling(buckets=500)).filter("rank is not null").collect()]
    assert len(drawn) == 100 and np.mean([i % 4 == 0 for i in drawn]) > 0.8
