"""The operators of this folder as registered queries: each reads its whole table and returns its full result."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import (
    aligned_pieces, chat_template, credentials, fixity, licenses, lsh_forest, merge_replay, reparameterised, repetition, rule_ensemble, spelling_variants, target_resampling, whole_tokens,
)
from lumenframe.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``fn(tables)``, where ``tables(name)`` reads a given table, under its own name."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: the folder named by LUMENFRAME_VOCABULARIES, else the installed package."""
    folder = os.environ.get("LUMENFRAME_VOCABULARIES")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _covered(n: int) -> str:
    """Words inside windows of n words that stand in the text twice, per document."""
    return f"""
      SELECT doc_id, count(DISTINCT i + k) AS n FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (
          SELECT doc_id, i, list_slice(ws, i, i + {n - 1}) AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM words))), range(0, {n}) AS t(k)
      WHERE times > 1 GROUP BY doc_id"""


REPETITION_SQL = rf"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
five AS ({_covered(5)}), three AS ({_covered(3)}),
long AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, hash(list_slice(ws, i, i + 50)) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 49)) AS i FROM words))
  GROUP BY doc_id, g HAVING count(*) > 1),
counted AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(five.n, 0) AS n_repeat_words, coalesce(three.n, 0) AS covered_words, long.doc_id IS NOT NULL AS too_long
  FROM words LEFT JOIN five USING (doc_id) LEFT JOIN three USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * covered_words <= 30 * n_words AND NOT too_long AS kept,
  covered_words::BIGINT AS covered_words
FROM counted"""


@query(REPETITION_SQL)
def op1_repetition_rules(t):
    return repetition.measure(t("documents")).drop("longest_repeat", "n_maximal_repeats")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_TEMPLATE_ROWS = ", ".join(
    f"({licenses.block_size(text, 64)}, '{label}', {_list(sorted({w.decode() for w in licenses.words_of(text.encode())}))})" for label, text in licenses.Scan().templates
)
_PHRASE_ROWS = ", ".join(f"('{label}', {_list(phrase.split())})" for phrase, label in licenses.PHRASES)
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LICENSES_SQL = rf"""
WITH templates(block_words, label, ws) AS (VALUES {_TEMPLATE_ROWS}),
phrases(label, ws) AS (VALUES {_PHRASE_ROWS}),
words AS (SELECT doc_id, {_LOWERED} AS text, regexp_extract_all({_LOWERED}, '{_LICENSE_WORD}') AS ws FROM documents),
places AS (
  SELECT doc_id, label, i - 1 AS place
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words) w JOIN phrases p ON w.ws[i] = p.ws[1]
  WHERE list_slice(w.ws, i, i + len(p.ws) - 1) = p.ws),
based AS (
  SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
blocks AS (
  SELECT doc_id, block_words, list_distinct(list_slice(ws, s + 1, s + block_words)) AS block
  FROM (
    SELECT doc_id, ws, block_words, unnest(range(0, greatest(len(ws) - block_words // 2, 1), block_words // 2)) AS s
    FROM words, (SELECT DISTINCT block_words FROM templates) WHERE len(ws) > 0)),
matches AS (
  SELECT doc_id, label, common / size AS share
  FROM (SELECT doc_id, label, len(list_intersect(block, ws)) AS common, len(ws) AS size FROM blocks JOIN templates USING (block_words))
  WHERE 100 * common >= 90 * size),
matched AS (SELECT doc_id, max(share) AS best FROM matches GROUP BY doc_id),
labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM matches UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(based.labels, '') AS base_labels, coalesce(labelled.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM words LEFT JOIN based USING (doc_id) LEFT JOIN matched USING (doc_id) LEFT JOIN labelled USING (doc_id)"""


@query(LICENSES_SQL)
def op2_license_scan(t):
    return licenses.scan(t("documents"))


_ESCAPED = chat_template._ESCAPE.pattern.replace("'", "''")

CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
written AS (
  SELECT *, regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '{_ESCAPED}', '\1\2\\\3', 'g') AS r,
    regexp_replace(text, '{_ESCAPED}', '\1\2\\\3', 'g') AS x
  FROM turns)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(r) + 1 + length(x) + 11)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id"""


@query(CHAT_SQL)
def op3_chat_format(t):
    turns = t("conversations").select("conv_id", "turn", "role", "text")
    told = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    told = turns.sparkSession.createDataFrame(told, "conv_id long, turn long, role string, text string")
    return chat_template.format_digests(turns.unionByName(told))


FIXITY_SQL = r"""
WITH numbered AS (
  SELECT page_id, page_id // 1000 AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html,
    'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '')
      || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
  FROM pages, (SELECT chr(13) || chr(10) AS e)),
records AS (
  SELECT page_id, archive, record, coalesce(sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM numbered),
other AS (
  SELECT page_id, archive, place, CASE WHEN page_id % 97 = 13 THEN left(record, length(record) - 5) || '~' || right(record, 4) ELSE record END AS record
  FROM records WHERE page_id % 211 <> 1
  UNION ALL SELECT page_id, archive, place + 1, record FROM records WHERE page_id % 307 = 2)
SELECT coalesce(a.archive, b.archive)::VARCHAR AS archive, coalesce(a.place, b.place) AS "offset",
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' ELSE 'changed' END AS kind,
  coalesce(a.page_id, b.page_id) AS record_id, sha256(a.record) AS left_digest, sha256(b.record) AS right_digest
FROM records a FULL JOIN other b ON a.archive = b.archive AND a.place = b.place
WHERE a.record IS DISTINCT FROM b.record"""


@query(FIXITY_SQL)
def op4_merkle_audit(t):
    records = fixity.warc_records(t("pages"))
    return fixity.audit(records, fixity.decayed(records))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN found USING (doc_id)"""


@query(NEAR_DUPLICATES_SQL)
def op5_lsh_forest(t):
    return lsh_forest.components_of(t("documents"))


@query()
def op6_reparameterised_leaks(t):
    return reparameterised.leaks(t("documents"), t("benchmark"))


@query()
def op7_merge_replay(t):
    return merge_replay.digests(t("documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), split_pattern())


@query()
def op8_whole_token_counts(t):
    return whole_tokens.count_tokens(t("documents"), vocabulary("piece_bpe_32k.model"))


@query()
def op9_rule_ensemble(t):
    docs = t("documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, t("labels")))


@query()
def op10_multipart_credentials(t):
    return credentials.digest(credentials.find(t("documents")))


@query()
def op11_aligned_pieces(t):
    return aligned_pieces.digests(t("documents"), vocabulary("piece_bpe_32k.model"))


def _crc_steps() -> list[int]:
    """What the low four bits of a CRC-32 become when they are shifted out."""
    steps = list(range(16))
    for _ in range(4):
        steps = [(x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1 for x in steps]
    return steps


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    nibbles = f"list_transform(range(0, 2 * strlen({text})), lambda k: instr('123456789ABCDEF', substr(hex(encode({text})), (k + 2 - 2 * (k % 2))::INT, 1))::BIGINT)"
    return f"xor(list_reduce({nibbles}, lambda c, b: xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c, b) & 15) + 1]), 4294967295::BIGINT), 4294967295)"


RESAMPLING_SQL = rf"""
WITH source AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_LICENSE_WORD}') AS ws FROM documents),
target AS (SELECT row_number() OVER () AS row, regexp_extract_all({_LOWERED}, '{_LICENSE_WORD}') AS ws FROM benchmark),
features AS (
  SELECT from_source, row, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g
  FROM (SELECT true AS from_source, row, ws FROM source UNION ALL SELECT false, row, ws FROM target)),
buckets AS (SELECT g, {_crc32("g")} % 10000 AS bucket FROM (SELECT DISTINCT g FROM features)),
placed AS (SELECT from_source, row, bucket FROM features JOIN buckets USING (g)),
totals AS (
  SELECT range AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t
  FROM range(10000) LEFT JOIN (
    SELECT bucket, count(*) FILTER (from_source) AS s, count(*) FILTER (NOT from_source) AS t FROM placed GROUP BY bucket) counted ON bucket = range),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE)) AS gain FROM totals),
weights AS (
  SELECT row, count(*) AS n_features, floor(sum(gain) / count(*)) AS weight FROM placed JOIN gains USING (bucket) WHERE from_source GROUP BY row),
scored AS (
  SELECT source.row, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM source LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_words::BIGINT AS n_words, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)"""


@query(RESAMPLING_SQL)
def op12_target_resampling(t):
    return target_resampling.resample(t("documents"), t("benchmark"))


SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY ALL),
hashed AS (SELECT run, times, {_crc32("run_key")} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || run AS run_key FROM runs)),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
shorter AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 2 * n),
chain AS (
  SELECT word, form AS root FROM forms UNION SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM forms))
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM words LEFT JOIN best USING (word) LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)"""


@query(SPELLING_SQL)
def op13_spelling_variants(t):
    return spelling_variants.group(t("documents"))
