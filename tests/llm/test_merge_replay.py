import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lumenframe.llm import merge_replay

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made(seed):
    r = random.Random(seed)
    kinds = [lambda: r.randint(32, 126), lambda: r.randint(0, 0x2FF), lambda: r.randint(0, 0xD7FF), lambda: r.randint(0xE000, 0x1FFFF), lambda: r.choice([10, 32, 0x85, 0xA0, 97])]
    text = "".join(chr(r.choice(kinds)()) for _ in range(r.randint(0, 80)))
    return text + r.choice(["", "a" * r.randint(0, 90), "ab" * 20, "\n" * 9, " don't we'll <|endoftext|> 12345"])


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_ids_are_those_of_the_library(spark, library):
    texts = [made(k) for k in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = merge_replay.encode(df, PATH, public_tokenizers.PATTERN)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.bytes).decode() for r in merge_replay.decode(encoded, PATH).collect()} == dict(enumerate(texts))


def test_replay_equals_merging_one_by_one():
    vocabulary = merge_replay.Vocabulary(open(PATH, "rb").read())
    r = random.Random(3)
    words = [bytes(r.choice(b"abcdetionrs \xc3\xa9") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, sizes = merge_replay.replay(words, vocabulary)
    want = [merge_replay.merge_alone(w, vocabulary) if w else [] for w in words]
    assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == list(map(len, want))


def test_a_vocabulary_where_late_merges_form_early_pairs():
    """'abc' comes before 'ab' in rank and is made of 'ab' and 'c': after the later merge the earlier pair goes first."""
    tokens = [bytes([k]) for k in range(256)] + [b"abc", b"cd", b"ab", b"abcab"]
    lines = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens))
    vocabulary = merge_replay.Vocabulary(lines)
    library = tiktoken.Encoding("t", pat_str=r"\S+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    r = random.Random(8)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 14))) for _ in range(500)]
    ids, sizes = merge_replay.replay([w.encode() for w in words], vocabulary)
    assert ids.tolist() == [x for w in words for x in library.encode_ordinary(w)]


def test_both_ways_of_splitting_agree():
    import regex

    encoder = merge_replay.Encoder(merge_replay.Vocabulary(open(PATH, "rb").read()), public_tokenizers.PATTERN)
    texts = ["".join(c for c in made(k) if ord(c) < 0x10000 and not encoder.has_new(c)) for k in range(800)]
    assert encoder.split_low is not encoder.split
    assert [encoder.split_low(t) for t in texts] == [encoder.split_new(t) for t in texts] == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert merge_replay.explicit_classes(r"\p{Lu}+") is None and merge_replay.explicit_classes(r"a++") is None


def test_characters_that_only_some_libraries_know(spark, library):
    new = merge_replay.character_classes()[1]
    assert new
    texts = [f"a{c} 1{c}{c} -{c}b" for c in new[:: max(1, len(new) // 400)]]
    rows = merge_replay.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_table_of_known_words_starts_anew(monkeypatch, library):
    import pyarrow as pa

    monkeypatch.setattr(merge_replay, "MOST_WORDS", 50)
    encoder = merge_replay.Encoder(merge_replay.Vocabulary(open(PATH, "rb").read()), public_tokenizers.PATTERN)
    for k in range(20):
        texts = [made(100 * k + j) for j in range(5)]
        assert list(encoder.encode(pa.array(texts))) == [library.encode_ordinary(t) for t in texts]


def test_query_over_its_table_and_odd_rows(spark, library, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, odd_docs):
        rows = merge_replay.digests(df, PATH, public_tokenizers.PATTERN).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
        key = lambda r: (r[0] is None, r[0], r[2])
        assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert merge_replay.digests(no_docs, PATH, public_tokenizers.PATTERN).collect() == []
