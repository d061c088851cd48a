"""The registered queries against their SQL, and the pipeline against its stages done by hand."""

import hashlib
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, oracle_connection
from lumenframe.llm import credentials, queries, reparameterised

FOLDER = "/root/testdata/sf0.001"


def test_thirteen_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, oracle_connection(FOLDER), queries.QUERIES[name], queries.ORACLES[name], FOLDER) == ""


def test_sql_names_columns_as_the_query_does(spark):
    con = oracle_connection(FOLDER)
    for name, sql in queries.ORACLES.items():
        kinds = {c: str(t) for c, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
        types = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}
        assert kinds == {c: types[t] for c, t in queries.QUERIES[name](spark, FOLDER).dtypes}, name


def test_pipeline_equals_its_stages_by_hand(spark):
    import base64

    import public_tokenizers
    import tiktoken
    from test_credentials import brute_links
    from test_lsh_forest import brute as near_copies
    from test_repetition import expected as repetition
    from test_reparameterised import brute as leaking

    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{FOLDER}/benchmark.parquet'").fetchall()
    docs = [(i, t) for i, t in docs if len((t or "").split()) <= 1500 and repetition(t)[6] or len((t or "").split()) > 1500]
    kept = near_copies(docs)
    docs = [(i, t) for i, t in docs if kept[i][2]]
    leaks = {i for i, _ in leaking(docs, items, reparameterised.Search())}
    docs = [(i, t) for i, t in docs if i not in leaks]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in docs:
        at, clean = 0, ""
        for a, b, _ in brute_links(t or ""):
            clean += t[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        clean += (t or "")[at:]
        ids = library.encode_ordinary(clean)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest()))
    assert sorted(map(tuple, entry.queries()["pipeline"](spark, FOLDER).collect())) == want
    assert credentials.KINDS


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.simpleString() == docs.schema.simpleString()


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f g h i j k l", None, None, None), (3, "a b c d e f g h i j k l m n o", "en", "s", 29)],
        "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() >= 2
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
