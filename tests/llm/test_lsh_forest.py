import random

import numpy as np

from lumenframe.llm import lsh_forest
from lumenframe.llm.common import components


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = lowered(text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def made(seed, originals=12, copies=25, size=60):
    """Groups of copies with more and more edits: many pairs stand near the threshold."""
    r = random.Random(seed)
    rows = []
    shared = " ".join(f"s{k}" for k in range(30))
    for _ in range(originals):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(size + r.randint(0, size))]
        for _ in range(r.randint(1, copies)):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = f"e{r.randint(0, 10**6)}"
            rows.append(" ".join(words) + (" " + shared if r.random() < 0.3 else ""))
    r.shuffle(rows)
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


def found(spark, rows, forest=lsh_forest.Forest()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in lsh_forest.components_of(df, forest=forest).collect()}


def test_components_match_brute_force(spark):
    rows = made(1)
    want = brute(rows)
    assert found(spark, rows) == want
    assert 10 < sum(kept for _, _, kept in want.values()) < len(rows)


def test_crowded_regions_and_split_groups(spark):
    """Regions of more than 3 classes are entered again at greater depth, groups of more than 16 are verified block by block."""
    rows = made(2, originals=4, copies=60)
    assert found(spark, rows, lsh_forest.Forest(region=3, depths=(2, 4, 6), group_rows=16)) == brute(rows)


def test_identical_signatures_at_the_last_depth(spark):
    rows = [(k, "a b c d e f g h " + ("x" if k % 2 else "y") + f"{'' if k < 20 else ' z'}") for k in range(40)]
    assert found(spark, rows, lsh_forest.Forest(region=1, depths=(1, 2))) == brute(rows)


def test_linked_sets_matches_brute_force():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 30, 20, dtype=np.uint64)) for _ in range(60)]
    label = lsh_forest.linked_sets(sets, 60)
    root = list(range(60))
    for x in range(60):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y]))
            if 100 * both >= 60 * (len(sets[x]) + len(sets[y]) - both):
                root = [root[y] if r == root[x] else r for r in root]
    assert [[i for i in range(60) if label[i] == v] for v in dict.fromkeys(label)] == [[i for i in range(60) if root[i] == v] for v in dict.fromkeys(root)]


def test_orders_grow_with_depth():
    f = lsh_forest.Forest()
    assert [f.orders_for(d) for d in f.depths] == sorted(f.orders_for(d) for d in f.depths)
    assert all((1 - 0.85**d) ** f.orders_for(d) <= f.miss for d in f.depths)


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(1000, 1400)]
    rows = components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()
    assert {r.id: r.root for r in rows} == {**{k: 100 for k in range(100, 161)}, **{k: 5 for _, k in star}, 5: 5}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(odd_docs, no_docs):
    rows = lsh_forest.components_of(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is not None}
    assert by_id == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 5, True), 6: (1, 6, True), 7: (1, 7, True)}
    assert {(r.component_id, r.kept) for r in rows if r.doc_id is None} == {(None, True)}
    assert lsh_forest.components_of(no_docs).collect() == []


def test_one_of_each_group_stays_with_its_columns(spark, odd_docs):
    more = odd_docs.sparkSession.createDataFrame([(8, "One", "q", False, 0, None), (9, "ONE", "q", False, 0, None)], odd_docs.schema)
    left = lsh_forest.drop_near_duplicates(odd_docs.unionByName(more))
    assert left.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 6, 7]


def test_orders_of_the_same_hashes_miss_no_more_than_stated():
    """Simulated: two signatures agree in some of the 128 places; every order is a permutation of those places."""
    f = lsh_forest.Forest()
    r = np.random.default_rng(3)
    for depth in f.depths:
        orders = lsh_forest._orders(f, depth)
        agree = r.random((4000, f.hashes)) < f.percent / 100
        shares = np.zeros(len(agree), bool)
        for order in orders:
            shares |= agree[:, order].all(axis=1)
        assert (~shares).sum() == 0
        assert f.miss_of(depth, len(orders)) <= f.miss < f.miss_of(depth, len(orders) - 1)
