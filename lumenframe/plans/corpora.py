"""Corpus and tuning-data operators over documents, labels, benchmark and conversations."""

from pyspark.sql import functions as F

from lumenframe.operators import corpus as cp
from lumenframe.operators import language_models as lm
from lumenframe.operators import learning as ml
from lumenframe.operators import passages
from lumenframe.plans.hashing import crc32
from lumenframe.plans.registry import plan

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
LOW_WORDS = WORDS.replace("(text,", "(lower(text),")


def share(*parts):
    """SQL twin of ``hash_share``."""
    return f"(('0x' || substr(md5({chr(32).join(' || $|$ || '.join(f'{p}::VARCHAR' for p in parts).split())}), 1, 8))::BIGINT / 4294967296.0)".replace("$", "'")


def sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@plan("T01", r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')")
def exact_dedup(t):
    return cp.exact_dedup(t.documents, "doc_id", "text")


@plan("T03", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), x AS (SELECT *, trim(raw, ' ') AS line FROM l),
  o AS (SELECT line FROM x WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3)
  SELECT doc_id, md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (line NOT IN (SELECT line FROM o)), '')) AS digest, count(*) FILTER (line IN (SELECT line FROM o)) AS dropped FROM x GROUP BY doc_id""")
def line_dedup(t):
    return cp.line_dedup(t.documents, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"), "dropped")


@plan("T03", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT doc_id, i - 1 AS p, hash(list_slice(ws, i, i + 49)) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
  s AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY h) > 1),
  e AS (SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM s)),
  u AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM e GROUP BY doc_id, span),
  l AS (SELECT doc_id, sum(b - a)::BIGINT AS shared_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM u GROUP BY doc_id)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(shared_words, 0) AS shared_words, coalesce(spans, '') AS spans FROM w LEFT JOIN l USING (doc_id)""")
def shared_passages(t):
    p = passages.shared_passages(t.documents, "doc_id", "text")
    return p.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ","))


_HITS = ", ".join(f"len(list_filter(w, lambda x: list_contains({sql_list(ms)}, x))) AS {name}" for name, ms in cp.STOP_WORDS.items())


@plan("T04", rf"""WITH w AS (SELECT doc_id, lang, list_transform({LOW_WORDS}, lambda x: regexp_replace(x, '[.,;:!?]+$', '')) AS w FROM documents), h AS (SELECT doc_id, lang, {_HITS} FROM w),
  b AS (SELECT *, greatest(de, en, es, fr) AS hits FROM h), l AS (SELECT *, CASE WHEN hits = 0 THEN NULL WHEN de = hits THEN 'de' WHEN en = hits THEN 'en' WHEN es = hits THEN 'es' ELSE 'fr' END AS language FROM b)
  SELECT lang, language, count(*) AS n FROM l GROUP BY ALL""")
def language_bucket(t):
    got = cp.language_bucket(t.documents, "doc_id", "text")
    return got.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang", "language").agg(F.count("*").alias("n"))


@plan("T04", f"""WITH d AS (SELECT doc_id, lang, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c, {crc32("doc_id::VARCHAR")} % 5 = 0 AS held_out FROM documents),
  g AS (SELECT doc_id, lang, held_out, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 961 + c[i + 1] * 31 + c[i + 2]) % 16384)) AS b FROM d),
  n AS (SELECT lang AS language, b, count(*) AS n FROM g WHERE NOT held_out GROUP BY ALL), z AS (SELECT language, sum(n) + 16384 AS total FROM n GROUP BY 1),
  s AS (SELECT doc_id, z.language, avg(ln((coalesce(n, 0) + 1) / total)) AS score FROM g CROSS JOIN z LEFT JOIN n ON n.language = z.language AND n.b = g.b GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS place, score - lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS margin FROM s)
  SELECT doc_id, lang, held_out, language, round(score, 6) AS score, round(margin, 6) AS margin FROM d LEFT JOIN (SELECT * FROM r WHERE place = 1) USING (doc_id)""")
def language_profiles(t):
    """Learned from four fifths of the rows."""
    d = t.documents
    out = lm.held_out(F.col("doc_id"))
    found = lm.language_of(d, "doc_id", "text", lm.fit_profiles(d.where(~out), "text", "lang"))
    return found.join(d.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", out.alias("held_out"), "language", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@plan("T05", f"""WITH w AS (SELECT doc_id, {LOW_WORDS} AS ws FROM documents), p AS (SELECT doc_id, CASE WHEN i = 1 THEN '' ELSE ws[i - 1] END AS v, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
  g AS (SELECT p.* FROM p JOIN labels USING (doc_id) WHERE quality = 1), u AS (SELECT w, count(*) AS c FROM g GROUP BY w), z AS (SELECT sum(c) + count(*) + 1 AS total FROM u),
  c AS (SELECT v, count(*) AS cv FROM g WHERE v <> '' GROUP BY v), b AS (SELECT v, w, count(*) AS cvw FROM g WHERE v <> '' GROUP BY ALL),
  x AS (SELECT doc_id, round(exp(-avg(ln((coalesce(cvw, 0) + 10 * (coalesce(c, 0) + 1) / total) / (coalesce(cv, 0) + 10)))), 4) AS perplexity FROM p LEFT JOIN b USING (v, w) LEFT JOIN u USING (w) LEFT JOIN c USING (v), z GROUP BY doc_id)
  SELECT doc_id, perplexity, perplexity BETWEEN (SELECT quantile_cont(perplexity, 0.05) FROM x) AND (SELECT quantile_cont(perplexity, 0.95) FROM x) AS keep FROM x""")
def bigram_perplexity_filter(t):
    good = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    p = lm.bigram_perplexity(t.documents, "doc_id", "text", good).withColumn("perplexity", F.round("perplexity", 4))
    return cp.two_sided(p, "perplexity", 0.05, 0.95)


@plan("T07")
def toxicity_classifier(t):
    """Scores of all documents by a model of the labelled ones but a fifth, which is held out."""
    out = lm.held_out(F.col("doc_id"))
    known = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id").where(~out)
    return ml.text_scores(ml.text_classifier(known, "text", "toxic"), t.documents, "doc_id", "text").select("doc_id", out.alias("held_out"), "score")


@plan("T05", f"""WITH w AS (SELECT doc_id, unnest({LOW_WORDS}) AS word FROM documents), m AS (SELECT word, count(*) AS seen FROM w JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY word),
  s AS (SELECT sum(seen) + count(*) + 1 AS d FROM m), p AS (SELECT doc_id, round(exp(-avg(ln((coalesce(seen, 0) + 1) / d))), 4) AS perplexity FROM w LEFT JOIN m USING (word), s GROUP BY doc_id)
  SELECT doc_id, perplexity, perplexity BETWEEN (SELECT quantile_cont(perplexity, 0.05) FROM p) AND (SELECT quantile_cont(perplexity, 0.95) FROM p) AS keep FROM p""")
def perplexity_filter(t):
    good = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    p = cp.perplexity(t.documents, "doc_id", "text", good).withColumn("perplexity", F.round("perplexity", 4))
    return cp.two_sided(p, "perplexity", 0.05, 0.95)


_RULES = rf"""f AS (SELECT doc_id, source, lang, text, len({WORDS}) AS n_words, (length(text) - length(regexp_replace(text, '[#*$%&|<>{{}}]', '', 'g'))) / greatest(length(text), 1) AS special_share,
  coalesce(list_sum(list_transform({WORDS}, lambda x: length(x))), 0) / greatest(len({WORDS}), 1) AS mean_word, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS lines, len(list_distinct({WORDS})) / greatest(len({WORDS}), 1) AS distinct_words FROM documents),
  h AS (SELECT *, 1 - len(list_distinct(lines)) / greatest(len(lines), 1) AS repeated_lines FROM f),
  k AS (SELECT *, n_words >= 10 AND special_share <= 0.1 AND mean_word BETWEEN 2 AND 12 AND repeated_lines <= 0.3 AND (distinct_words >= 0.2 OR n_words > 2000) AS keep FROM h)"""


@plan("T06", f"WITH {_RULES} SELECT doc_id, n_words, round(special_share, 9) AS special_share, round(mean_word, 9) AS mean_word, round(repeated_lines, 9) AS repeated_lines, round(distinct_words, 9) AS distinct_words, keep FROM k")
def heuristic_filter(t):
    f = cp.heuristic_filter(t.documents, "doc_id", "text")
    return f.select("doc_id", "n_words", *[F.round(c, 9).alias(c) for c in ("special_share", "mean_word", "repeated_lines", "distinct_words")], "keep")


def _redacted():
    text, counts = "text", []
    for kind, (pattern, tag) in cp.PERSONAL.items():
        pattern = pattern.replace("'", "''")
        counts.append(f"len(regexp_extract_all({text}, '{pattern}')) AS {kind}")
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return f"SELECT doc_id, md5({text}) AS digest, {', '.join(counts)} FROM documents"


@plan("T08", _redacted())
def redact_personal(t):
    return cp.redact_personal(t.documents, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"), *cp.PERSONAL)


def _grams(source, key):
    return f"SELECT DISTINCT {key}array_to_string(list_slice(w, i, i + 7), ' ') AS gram FROM (SELECT {key}w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}{LOW_WORDS} AS w FROM {source}))"


@plan("T09", f"""WITH g AS ({_grams('documents', 'doc_id, ')}), b AS ({_grams('benchmark', '')}) SELECT doc_id, count(*) AS hits FROM g JOIN b USING (gram) GROUP BY doc_id""")
def decontaminate_ngrams(t):
    return cp.ngram_hits(t.documents, "doc_id", "text", t.benchmark, "text", 8)


@plan("T10", f"SELECT source, lang, count(*) AS docs, sum(len({WORDS}))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / sum(sum(strlen(text))) OVER (), 9) AS share FROM documents GROUP BY source, lang")
def corpus_mix_report(t):
    return cp.mix_report(t.documents, ["source", "lang"], "text").withColumn("share", F.round("share", 9))


@plan("T11", f"""WITH {_RULES}, d AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') ORDER BY doc_id) = 1 AS first FROM k),
  c AS (SELECT count(*) AS a, count_if(first) AS b, count_if(first AND keep) AS e, count_if(first AND keep AND lang = 'en') AS g FROM d)
  SELECT step, stage, rows_in, rows_out, round(rows_out / greatest(rows_in, 1), 9) AS keep_rate FROM (SELECT 0 AS step, 'exact copies' AS stage, a AS rows_in, b AS rows_out FROM c UNION ALL SELECT 1, 'heuristics', b, e FROM c UNION ALL SELECT 2, 'language', e, g FROM c)""")
def keep_rate_report(t):
    d = t.documents.select("doc_id", "lang").join(cp.heuristic_filter(t.documents, "doc_id", "text").select("doc_id", "keep"), "doc_id")
    first = cp.exact_dedup(t.documents, "doc_id", "text").select("doc_id", F.lit(True).alias("first"))
    r = cp.keep_rates(d.join(first, "doc_id", "left"), [("exact copies", F.col("first")), ("heuristics", F.col("keep")), ("language", F.col("lang") == "en")])
    return r.withColumn("keep_rate", F.round("keep_rate", 9))


@plan("T12", f"SELECT lang, sum(len({WORDS}))::BIGINT AS words, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(sum(ceil(length(text) / 4)) / greatest(sum(len({WORDS})), 1), 9) AS fertility FROM documents GROUP BY lang")
def token_report(t):
    return cp.token_report(t.documents, ["lang"], "text").withColumn("fertility", F.round("fertility", 9))


@plan("F12", f"""WITH w AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 2.25 WHEN 'fr' THEN 1.0 ELSE 0.0 END AS w, {share('doc_id')} AS h FROM documents)
  SELECT doc_id, lang, unnest(range(1, (floor(w) + (h < w - floor(w))::INT + 1)::BIGINT)) AS copy FROM w""")
def mixture_sample(t):
    return cp.mixture_sample(t.documents.select("doc_id", "lang"), "doc_id", "lang", {"en": 0.5, "de": 2.25, "fr": 1.0})


@plan("F13", f"""WITH p AS (SELECT doc_id, ntile(4) OVER (ORDER BY n_chars, doc_id)::INT AS phase, {share('doc_id')} AS h FROM documents)
  SELECT doc_id, phase, row_number() OVER (PARTITION BY phase ORDER BY h, doc_id)::INT AS place FROM p""")
def curriculum_order(t):
    return cp.curriculum_order(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 4).drop("n_chars")


@plan("M30", f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) - 1 AS i FROM documents), k AS (SELECT *, {share('1', 'doc_id', 'i')} >= 0.1 AS stays FROM w)
  SELECT d.doc_id, md5(coalesce(x, '')) AS digest FROM documents d LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) FILTER (stays) AS x FROM k GROUP BY doc_id) USING (doc_id)""")
def augment_texts(t):
    return cp.drop_words(t.documents, "doc_id", "text", 0.1).select("doc_id", F.md5("augmented").alias("digest"))


@plan("M30", f"""WITH s AS (SELECT stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey, round(o_totalprice + (2 * {share('1', 'o_orderkey', "'o_totalprice'")} - 1) * 0.1 * s, 4) AS noisy FROM orders, s""")
def augment_numbers(t):
    n = cp.add_noise(t.orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), "o_orderkey", ["o_totalprice"], 0.1)
    return n.select("o_orderkey", F.round("o_totalprice", 4).alias("noisy"))


@plan("T27", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
def chat_template(t):
    return cp.chat_strings(t.conversations, "conv_id", "turn", "role", "text")


_PAIRS = """p AS (SELECT conv_id, turn, role, text AS instruction, lead(role) OVER w AS r, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT conv_id, turn, instruction, response FROM p WHERE role = 'user' AND r = 'assistant')"""


@plan("T28", f"WITH {_PAIRS} SELECT * FROM q")
def instruction_triples(t):
    return cp.instruction_pairs(t.conversations, "conv_id", "turn", "role", "text")


@plan("T29", rf"""WITH {_PAIRS}, w AS (SELECT {WORDS.replace('text', 'response')} AS w, {LOW_WORDS.replace('text', 'response')} AS l, trim(regexp_replace(lower(instruction), '\s+', ' ', 'g'), ' ') AS p, trim(regexp_replace(lower(response), '\s+', ' ', 'g'), ' ') AS a FROM q),
  s AS (SELECT unnest(l) AS x FROM w)
  SELECT count(*) AS pairs, count_if(len(w) < 2)::BIGINT AS short, count_if(len(w) > 400)::BIGINT AS long, (SELECT count(*) FROM (SELECT p FROM w GROUP BY p HAVING count(DISTINCT a) > 1)) AS contradicting,
  (SELECT count(DISTINCT x) FROM s) AS distinct_words, (SELECT count(*) FROM s) AS all_words FROM w""")
def sft_quality_checks(t):
    return cp.tuning_checks(cp.instruction_pairs(t.conversations, "conv_id", "turn", "role", "text"))


@plan("T30", """WITH a AS (SELECT conv_id, turn, length(text) / 100.0 AS score FROM conversations WHERE role = 'assistant'), g AS (SELECT conv_id, max(score) AS hi, min(score) AS lo FROM a GROUP BY conv_id)
  SELECT conv_id, (SELECT min(turn) FROM a WHERE a.conv_id = g.conv_id AND score = hi) AS chosen, (SELECT min(turn) FROM a WHERE a.conv_id = g.conv_id AND score = lo) AS rejected, round(ln(1 + exp(-(hi - lo))), 9) AS loss FROM g WHERE hi > lo""")
def preference_pairs(t):
    a = t.conversations.where(F.col("role") == "assistant").select("conv_id", "turn", (F.length("text") / F.lit(100.0)).alias("score"))
    return cp.preference_pairs(a, "conv_id", "turn", "score").withColumn("loss", F.round("loss", 9))
