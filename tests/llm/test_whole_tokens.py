import random

import public_tokenizers
import pytest
import sentencepiece

from lumenframe.llm import whole_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return whole_tokens.Counter(open(PATH, "rb").read())


def made(seed):
    r = random.Random(seed)
    if seed % 2:
        return "".join(r.choice(["the", "  ", " ", "ing", "a", "\n", "<s>", "</s>", "<unk>", "<0x0A>", "é", "ß", "▁", "\t", "foo", "\r\n", "''", "日本"]) for _ in range(r.randint(0, 30)))
    kinds = [lambda: r.randint(0, 126), lambda: r.randint(0, 0x2FF), lambda: r.randint(0, 0xD7FF), lambda: r.randint(0xE000, 0x1FFFF), lambda: r.choice([10, 32, 0x2581, 97])]
    return "".join(chr(r.choice(kinds)()) for _ in range(r.randint(0, 50)))


def test_counts_are_those_of_the_library(library, counter):
    texts = [made(k) for k in range(6000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_shortcut_is_proved_by_the_library(library, counter):
    """Each string of the table is one token behind a space; what isn't in the table is not."""
    assert len(counter.shortcut) > 30_000
    some = random.Random(1).sample(sorted(p for p in counter.shortcut if p[0] == "▁" and p.strip("▁")), 2000)
    assert all(len(library.encode(p[1:])) == 1 for p in some)
    assert all(counter.merged(p) == 1 for p in some)


def test_both_ways_of_merging_agree(counter):
    r = random.Random(2)
    for _ in range(1500):
        word = "".join(r.choice("abcdeéßtionhr▁") for _ in range(r.randint(1, 150)))
        assert counter.merged_short(word) == counter.merged_long(word)


def test_words_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(whole_tokens, "MOST_WORDS", 20)
    counter = whole_tokens.Counter(open(PATH, "rb").read())
    texts = [made(k) for k in range(300)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts)] and len(counter) <= 20


def test_query_over_its_table_and_odd_rows(spark, library, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    key = lambda r: (r[0] is None, r[0], r[1])
    for df in (docs, odd_docs):
        rows = whole_tokens.count_tokens(df, PATH).collect()
        want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in df.select("doc_id", "text").collect()]
        assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert whole_tokens.count_tokens(no_docs, PATH).collect() == []


def test_other_models_are_refused():
    with pytest.raises(Exception):
        whole_tokens.Counter(b"not a model")
