import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as wire
from sentencepiece import sentencepiece_pb2

from lumenframe.llm import aligned_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(PATH, "rb").read()
PARTS = [
    "the", "  ", " ", "ing", "a", "\n", "<s>", "</s>", "<unk>", "<0x0A>", "é", "é", "Á", "ﬁ", "①", "½", "Å", "　", "\xa0", "¨",
    "ß", "▁", "\t", "foo", "\r\n", "''", "日本", "ｶﾞ", "가", "2024", "!", ".\n", "\x00",
]


def made(seed):
    r = random.Random(seed)
    if seed % 2:
        return "".join(r.choice(PARTS) for _ in range(r.randint(0, 30)))
    kinds = [lambda: r.randint(0, 126), lambda: r.randint(0, 0x2FF), lambda: r.randint(0, 0xD7FF), lambda: r.randint(0xE000, 0x1FFFF), lambda: r.choice([10, 32, 0x2581, 97])]
    return "".join(chr(r.choice(kinds)()) for _ in range(r.randint(0, 50)))


TEXTS = [made(k) for k in range(3000)] + ["▁", " ", "  ▁ ", "▁▁", "a ▁", " a", "　 ", "x" * 5000, "ab " * 3000, "日本" * 700]


def with_rules(rule, squeeze, prefix=True):
    """The public model under another normaliser of the library."""
    rules = wire.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model = wire.ModelProto()
    model.ParseFromString(RAW)
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.name = rule
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    model.normalizer_spec.add_dummy_prefix = prefix
    return model.SerializeToString()


def expected(library, text):
    """Ids and byte spans as the library writes them."""
    m = sentencepiece_pb2.SentencePieceText()
    m.ParseFromString(library.encode(text, out_type="serialized_proto"))
    return [p.id for p in m.pieces], [p.begin for p in m.pieces], [p.end for p in m.pieces]


@pytest.mark.parametrize("rule,squeeze,prefix", [(None, False, True), ("identity", True, True), ("nmt_nfkc", False, True), ("nmt_nfkc", True, True), ("nmt_nfkc_cf", True, False), ("nfkc", False, False)])
def test_ids_spans_and_decoding_are_the_library_s(rule, squeeze, prefix):
    raw = with_rules(rule, squeeze, prefix) if rule else RAW
    library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), aligned_pieces.Model(raw)
    assert bool(model.map.rules) == (rule not in (None, "identity"))
    for text in TEXTS:
        ids, begins, ends = model.encode(text)
        assert (ids, begins.tolist(), ends.tolist()) == expected(library, text), text
        assert model.decode(ids) == library.decode(ids), text
        assert aligned_pieces.digest(model, text)[2] == hashlib.sha256(library.decode(ids).encode()).hexdigest(), text


def test_spans_tile_the_text_and_give_it_back():
    model = aligned_pieces.Model(RAW)
    for text in TEXTS:
        raw = text.encode()
        ids, begins, ends = model.encode(text)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        assert model.decode(ids) == text.replace("▁", " ")
    ids, begins, ends = model.encode("un café")
    at = aligned_pieces.covering(begins, ends, len("un caf"))
    assert begins[at] <= 6 < ends[at] and aligned_pieces.covering(begins, ends, 100) == -1


def test_random_ids_decode_as_in_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PATH), aligned_pieces.Model(RAW)
    r = random.Random(3)
    for _ in range(2000):
        ids = [r.choice([r.randint(0, 2), r.randint(3, 258), r.randint(3, 258), r.randint(259, 31_999)]) for _ in range(r.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_merges_by_queue_and_by_list_agree():
    model = aligned_pieces.Model(RAW)
    r = random.Random(2)
    for _ in range(1500):
        word = "".join(r.choice("abcdeéßtionhr▁") for _ in range(r.randint(1, aligned_pieces.LONG_WORD)))
        assert model.merged(word) == model._merged_by_queue(word)


def test_words_are_forgotten():
    model, library = aligned_pieces.Model(RAW, most_words=20), sentencepiece.SentencePieceProcessor(model_proto=RAW)
    assert all(model.encode(t)[0] == library.encode(t) for t in TEXTS[:400]) and len(model) <= 20


def test_other_models_are_refused():
    model = wire.ModelProto()
    model.ParseFromString(RAW)
    model.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        aligned_pieces.Model(model.SerializeToString())


def test_query_over_its_table_and_odd_rows(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for df in (docs, odd_docs):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "")
            want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)), len((r.text or "").encode())))
        got = [tuple(r)[:5] for r in aligned_pieces.digests(df, PATH).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert aligned_pieces.digests(no_docs, PATH).collect() == []


def test_encoded_table_decodes(spark, odd_docs):
    encoded = aligned_pieces.encode(odd_docs, PATH)
    texts = aligned_pieces.decode(encoded, PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, texts), key=key) == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=key)
    assert all(len(r.ids) == len(r.begins) == len(r.ends) for r in encoded.collect())
    none = encoded.sparkSession.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert aligned_pieces.decode(none, PATH).collect()[0].text == ""
