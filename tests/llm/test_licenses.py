import random
import re
import textwrap

import pytest

from lumenframe.llm import license_texts, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(text, scan):
    words = WORD.findall(lowered(text))
    starts, base = [], set()
    for phrase, label in scan.phrases:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    labels, best = set(base), 0.0
    for label, template in scan.templates:
        wanted = WORD.findall(lowered(template))
        size = scan.block_words
        while size < 2 * len(wanted):
            size *= 2
        wanted = set(wanted)
        for k in range(0, max(len(words) - size // 2, 1), size // 2):
            block = set(words[k : k + size])
            if block and 100 * len(block & wanted) >= scan.percent * len(wanted):
                labels.add(label)
                best = max(best, len(block & wanted) / len(wanted))
    score = 1.0 if starts else best
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def wrapped(text, width, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(" ".join(text.split()), width))


@pytest.mark.parametrize("width,mark", [(75, ""), (75, " * "), (40, "# "), (20, "// ")])
def test_notices_are_found_at_any_width(spark, width, mark):
    filler = " ".join(f"w{k}" for k in range(77))
    rows = [(k, f"{filler}\n{wrapped(text, width, mark)}\n\n{filler}") for k, (_, text) in enumerate(licenses.Scan().templates)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, (label, _) in enumerate(licenses.Scan().templates))


def test_full_texts_with_a_few_changes_and_parts_of_them(spark):
    words = license_texts.MIT.split()
    changed = " ".join("AUTHOR" if w == "AUTHORS" else w for k, w in enumerate(words) if k % 37)
    docs = spark.createDataFrame([(1, changed), (2, " ".join(words[60:110])), (3, " ".join(words[:90]))], "doc_id long, text string")
    only = licenses.Scan(templates=(("mit text", license_texts.MIT),))
    assert {r.doc_id: r.labels for r in licenses.scan(docs, only).collect()} == {1: "mit text", 2: "", 3: ""}


def made(seed):
    r = random.Random(seed)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["other", "näher", "7"]
    lines = []
    for _ in range(r.randint(0, 5)):
        words = r.choice(licenses.TEMPLATES)[1].split() if r.random() < 0.6 else []
        words = [w for w in words if r.random() < 0.95] + [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        lines.append(r.choice([" ", "-", ", "]).join(words))
    return "\n".join(lines)


def test_scan_matches_brute_force(spark):
    for percent in (60, 90):
        scan = licenses.Scan(percent=percent)
        texts = [made(k) for k in range(120)] + ["cc by cc by", "All Rights. Reserved all rights reserved"]
        rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scan).collect()
        assert {r.doc_id: tuple(r)[1:] for r in rows} == {k: expected(t, scan) for k, t in enumerate(texts)}


def test_global_order_puts_rare_words_first(spark):
    docs = spark.createDataFrame([(k, "the license the") for k in range(5)] + [(9, "mozilla")], "doc_id long, text string")
    frequency = licenses.word_frequency(docs)
    assert frequency == {"the": 5, "license": 5, "mozilla": 1}
    index = licenses.indexes(licenses.Scan(templates=licenses.TEMPLATES), frequency)[0]
    assert index.rank[b"granted"] < index.rank[b"mozilla"] < index.rank[b"license"]


def test_matching_blocks_give_their_place(spark):
    text = "one two three\nfour five\nReleased under the MIT License."
    rows = licenses.matching_blocks(spark.createDataFrame([(3, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_word, r.n_words, r.label, r.containment) for r in rows] == [(3, 0, 10, "mit", 1.0)]


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: r.n_words for r in rows if r.doc_id in (1, 2, 3, 5)} == {1: 0, 2: 0, 3: 0, 5: 60_000}
    assert all(r.n_base == 0 and r.first_word is None and r.labels == "" and r.score == 0.0 for r in rows)
    assert licenses.scan(no_docs).collect() == []
