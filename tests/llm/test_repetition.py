import random
import re
from collections import Counter

from lumenframe.llm import repetition

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def covered(words, n):
    times = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {i + k for i in range(len(words) - n + 1) if times[tuple(words[i : i + n])] > 1 for k in range(n)}
    return len(inside)


def longest(words, least):
    best = 0
    for a in range(len(words)):
        for b in range(a):
            k = 0
            while a + k < len(words) and words[a + k] == words[b + k]:
                k += 1
            best = max(best, k)
    return best if best >= least else 0


def maximal(words, least):
    places = {}
    for i in range(len(words)):
        for n in range(least, len(words) - i + 1):
            places.setdefault(tuple(words[i : i + n]), []).append(i)
    out = set()
    for w, at in places.items():
        left = {words[i - 1] if i else None for i in at}
        right = {words[i + len(w)] if i + len(w) < len(words) else None for i in at}
        if len(at) > 1 and len(left) > 1 and (len(right) > 1 or None in right):
            out.add((at[0], len(w), len(at)))
    return out


def expected(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    window, three, most = covered(words, 5), covered(words, 3), longest(words, 3)
    failed = len(words) < 10 or 100 * window > 20 * len(words)
    kept = not failed and 100 * three <= 30 * len(words) and most <= 50
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), window, failed, kept, three, most, len(maximal(words, 3)))


def made(seed):
    r = random.Random(seed)
    words = [r.choice("a b c dd é #x".split()[: r.randint(1, 6)]) for _ in range(r.randint(0, 40))]
    if r.random() < 0.5 and words:
        cut = r.randint(0, len(words) - 1)
        words += words[cut : cut + r.randint(1, 20)]
    return "".join(w + r.choice([" ", "\n", "\t", "  "]) for w in words)


def test_measure_matches_brute_force(spark):
    texts = [made(k) for k in range(150)]
    rows = repetition.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert got == {k: expected(t) for k, t in enumerate(texts)}


def test_repeats_are_the_maximal_ones(spark):
    texts = [made(k) for k in range(60)]
    rows = repetition.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k, t in enumerate(texts):
        words = WORDS.findall(t)
        assert {(r.first_word, r.n_words, r.n_times) for r in rows if r.doc_id == k} == maximal(words, 3)
        assert all(r.words == " ".join(words[r.first_word : r.first_word + r.n_words]) for r in rows if r.doc_id == k)


def test_long_repeat_is_rejected(spark):
    r = random.Random(1)
    passage = " ".join(f"w{k}" for k in range(60))
    filler = " ".join(f"f{r.random()}" for _ in range(2000))
    rows = repetition.measure(spark.createDataFrame([(1, f"{passage} {filler} {passage}"), (2, f"{passage} {filler}")], "doc_id long, text string"))
    assert {r.doc_id: (r.base_failed, r.kept, r.longest_repeat) for r in rows.collect()} == {1: (False, False, 60), 2: (False, True, 0)}


def test_odd_rows(odd_docs, no_docs):
    rows = repetition.measure(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[k].n_words for k in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 1, 60_000, 2]
    assert by_id[5].n_repeat_words == 60_000 and by_id[5].base_failed and by_id[5].longest_repeat == 59_999
    assert repetition.measure(no_docs).collect() == [] and repetition.keep(no_docs).collect() == []


def test_keep_leaves_rows_as_they_are(spark, odd_docs):
    good = odd_docs.sparkSession.createDataFrame([(9, "a b c d e f g h i j k", "n", None, 3, None)], odd_docs.schema)
    kept = repetition.keep(odd_docs.unionByName(good)).collect()
    assert [tuple(r) for r in kept] == [(9, "a b c d e f g h i j k", "n", None, 3, None)]
