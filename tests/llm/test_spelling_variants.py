import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from lumenframe.llm import spelling_variants
from lumenframe.llm.spelling_variants import Box, Tree, Variants

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    """One inserted, deleted or replaced letter apart, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(docs, s=Variants()):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if s.typos and h % s.typos == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= s.least_letters and n >= s.least_n}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    friends = {w: [x for d in (-1, 0, 1) for x in by_length.get(len(w) + d, []) if near(w, x)] for w in words}
    form = {}
    for w, found in friends.items():
        if found:
            best = min(found, key=lambda x: (-words[x], x))
            if words[best] >= s.ratio * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(friends[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("n,settings", [(60, Variants()), (60, Variants(cell_words=40, sample_words=700)), (20, Variants(least_letters=2, least_n=1, ratio=1.5, cell_words=200))])
def test_equals_trying_all_pairs(spark, n, settings):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id < {n}")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], settings)
    assert rows_of(spelling_variants.group(docs, settings)) == want and any(r[1] for r in want)


def test_chains_of_forms_end_at_the_root(spark):
    chain = ["abcde", "abcdx", "abcyx", "abzyx", "awzyx", "vwzyx"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k)).upper()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = rows_of(spelling_variants.group(docs, Variants(typos=0)))
    assert [r[:3] for r in got if r[0] == "abcde"] == [("abcde", "abcdx", "vwzyx")]
    assert got == brute([(1, text)], Variants(typos=0)) and all(r[2] == "vwzyx" for r in got)


def test_ties_go_to_the_first_in_code_point_order(spark):
    text = "house " * 3 + "houze houze houze houze houze houze " + "horse " * 6 + "hoüse " * 6 + "hou×e " * 6
    docs = spark.createDataFrame([(None, text)], "doc_id long, text string")
    got = rows_of(spelling_variants.group(docs, Variants(typos=0)))
    assert [r for r in got if r[0] == "house"] == [("house", "horse", "horse", 3, 4, 6)]
    assert got == brute([(None, text)], Variants(typos=0))


def test_odd_rows(spark, odd_docs, no_docs):
    few = Variants(least_letters=1, least_n=1)
    assert rows_of(spelling_variants.group(odd_docs, few)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], few)
    long = spark.createDataFrame([(1, "q" * 5000 + " " + "q" * 4999 + " " + "q" * 2500 + "r" + "q" * 2499)], "doc_id long, text string")
    one = Variants(least_n=1, typos=0)
    assert rows_of(spelling_variants.group(long, one)) == brute([tuple(r) for r in long.collect()], one)
    assert spelling_variants.group(no_docs).collect() == []


def test_box_finds_all_pairs_and_prunes():
    r = random.Random(5)
    words = sorted({"".join(r.choice("aaaeeinstrlñç") for _ in range(7)) for _ in range(3000)})
    box = Box([w.encode("latin-1") for w in words])
    assert len(box.tree.leaves) > 40
    q, p = box.near([w.encode("latin-1") for w in words[:400]], True)
    assert {(words[a], words[b]) for a, b in zip(q, p)} == {(a, b) for a in words[:400] for b in words if a < b and near(a, b)}
    shorter = sorted({w[:3] + w[4:] for w in words[:300]})
    q, p = box.near([w.encode("latin-1") for w in shorter], False)
    assert sorted(zip(q.tolist(), p.tolist())) == [(a, b) for a, x in enumerate(shorter) for b, w in enumerate(words) if near(x, w)]
    counts = spelling_variants.counts_of(spelling_variants.matrix_of([w.encode("latin-1") for w in words]))
    visited = sum(len(rows) * len(box.tree.leaves[leaf]) for leaf, rows in box.tree.reach(counts, 1, 1))
    assert visited < 0.35 * len(words) ** 2


def test_reach_is_the_boxes_within_one_edit():
    counts = np.random.default_rng(1).integers(0, 4, (500, spelling_variants.DIMENSIONS)).astype(np.int32)
    counts[:, 6:] = 0
    tree = Tree(counts, 10)
    boxes = {leaf: (counts[rows].min(0), counts[rows].max(0)) for leaf, rows in enumerate(tree.leaves)}
    found = {(leaf, k) for leaf, rows in tree.reach(counts, 1, 1) for k in rows.tolist()}
    for leaf, (low, high) in boxes.items():
        up, down = np.maximum(low - counts, 0).sum(1), np.maximum(counts - high, 0).sum(1)
        assert {(leaf, k) for k in np.flatnonzero((up <= 1) & (down <= 1)).tolist()} <= found
    assert all((leaf, k) in found for leaf, rows in enumerate(tree.leaves) for k in rows.tolist())
    assert (tree.home(counts) == [next(leaf for leaf, rows in enumerate(tree.leaves) if k in rows) for k in range(500)]).all()
    same = Tree(np.ones((100, spelling_variants.DIMENSIONS), np.int32), 10)
    assert len(same.leaves) == 1
