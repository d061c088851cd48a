"""Documents, pages and transcripts over the given tables."""

from pyspark.sql import functions as F

from lumenframe.operators import bookkeeping as bk
from lumenframe.operators import content as ct
from lumenframe.operators import joins
from lumenframe.operators.scaling import spread
from lumenframe.plans.registry import plan


def _r(df, digits, *keep):
    return df.select(*[c if c in keep else F.round(c, digits).alias(c) for c in df.columns])


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@plan("T15", f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(ceil((len(w) - 20) / 180), 1)::INT))::INT AS chunk, w FROM w WHERE len(w) > 0)
  SELECT doc_id, chunk, len(w[chunk * 180 + 1: chunk * 180 + 200]) AS n_words, length(array_to_string(w[chunk * 180 + 1: chunk * 180 + 200], ' ')) AS chars FROM c""")
def chunk_documents(t):
    c = ct.chunk_fixed(t.documents, "doc_id", "text", 200, 20)
    return c.select("doc_id", "chunk", "n_words", F.length("text").alias("chars"))


@plan("T15 J04")
def chunk_recursive(t):
    c = ct.chunk_recursive(t.documents, "doc_id", "text", 1000)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@plan("T15", r"""WITH RECURSIVE ss AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, ' ') <> '') AS s FROM documents),
  pack AS (SELECT doc_id, s, 1 AS i, 0 AS chunk, length(s[1]) AS n FROM ss WHERE len(s) > 0
    UNION ALL SELECT doc_id, s, i + 1, CASE WHEN n + 1 + length(s[i + 1]) <= 1000 THEN chunk ELSE chunk + 1 END, CASE WHEN n + 1 + length(s[i + 1]) <= 1000 THEN n + 1 + length(s[i + 1]) ELSE length(s[i + 1]) END FROM pack WHERE i < len(s))
  SELECT doc_id, chunk, max(n) AS chars FROM pack GROUP BY doc_id, chunk""")
def chunk_sentences(t):
    c = ct.chunk_sentences(t.documents, "doc_id", "text", 1000)
    return c.select("doc_id", "chunk", F.length("text").alias("chars"))


@plan("T16")
def html_extract(t):
    e = ct.html_extract(t.pages, "page_id", "html")
    return e.select("page_id", "title", F.size("sections").alias("sections"), F.size("code_blocks").alias("code_blocks"), F.size("metadata").alias("meta"),
                    F.length("raw_text").alias("chars"))


def built_pages(t):
    """One page per document with a head, hidden parts, two sections and a code block around its words."""
    plain = F.trim(F.regexp_replace("text", r"[^A-Za-z]+", " "))
    return t.documents.select("doc_id", F.concat(
        F.lit("<html><head><title>doc "), "doc_id", F.lit('</title><meta name="Lang" content="'), "lang", F.lit('"><meta content="no key"><style>p {}</style></head><body><nav>menu</nav><h1>First</h1><p>'),
        plain, F.lit("</p><script>var x = 1;</script><h2>Second &amp; last</h2><p>code below</p><pre><code class=\"language-python\">import os\nprint(1)</code></pre><pre>short</pre><p>end "), "source",
        F.lit("</p><footer>foot</footer></body></html>")).alias("html"))


@plan("T16", r"""WITH d AS (SELECT doc_id, lang, source, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ') AS x FROM documents)
  SELECT doc_id, 'doc ' || doc_id AS title, lang, 2 AS sections, x AS first, 'Second & last' AS heading, 2 AS level, 'code below' || chr(10) || chr(10) || 'end ' || source AS second, 'import os' || chr(10) || 'print(1)' AS code, 'python' AS language, 'code below' AS context, 1 AS code_blocks, 1 AS meta FROM d""")
def html_sections(t):
    e = ct.html_extract(built_pages(t), "doc_id", "html")
    two, code = F.col("sections")[1], F.col("code_blocks")[0]
    return e.select("doc_id", "title", F.col("metadata")["lang"].alias("lang"), F.size("sections").alias("sections"), F.col("sections")[0]["content"].alias("first"), two["heading"].alias("heading"),
                    two["level"].alias("level"), two["content"].alias("second"), code["code"].alias("code"), code["language"].alias("language"), code["context"].alias("context"),
                    F.size("code_blocks").alias("code_blocks"), F.size("metadata").alias("meta"))


@plan("T16", r"SELECT page_id, regexp_matches(html, '(?i)<title>') AS titled FROM pages")
def html_titles(t):
    return ct.html_extract(t.pages, "page_id", "html").select("page_id", (F.col("title") != "").alias("titled"))


@plan("T17", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"''#]+)', 1)) AS h FROM pages),
  r AS (SELECT page_id, url, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h
  WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE CASE WHEN length(regexp_extract(url, '^(https?://[^?#]*/)', 1)) > 8 THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END || h END AS target FROM l)
  SELECT page_id, count(*) AS links, count(DISTINCT target) AS targets FROM r WHERE target IS NOT NULL GROUP BY page_id""")
def extract_links(t):
    links = ct.extract_links(t.pages, "page_id", "url", "html")
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


@plan("T17", r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href=["'']([^"''#]+)', 1)) AS h FROM pages),
  r AS (SELECT url, CASE WHEN regexp_matches(h, '^https?://') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h
  WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE CASE WHEN length(regexp_extract(url, '^(https?://[^?#]*/)', 1)) > 8 THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' END || h END AS target FROM l),
  k AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS a, lower(regexp_extract(target, '^https?://([^/?#:]+)', 1)) AS b FROM r WHERE target IS NOT NULL),
  o AS (SELECT a AS host, count(*) AS out_links, count_if(a = b)::BIGINT AS internal_links FROM k GROUP BY a), i AS (SELECT b AS host, count(*) AS in_links FROM k GROUP BY b)
  SELECT coalesce(o.host, i.host) AS host, coalesce(out_links, 0) AS out_links, coalesce(internal_links, 0) AS internal_links, coalesce(in_links, 0) AS in_links FROM o FULL JOIN i ON o.host = i.host""")
def link_degrees(t):
    return ct.link_degrees(ct.extract_links(t.pages, "page_id", "url", "html"))


def markdown(t):
    """Documents written as Markdown: front matter, headings and a fenced block around the text."""
    return t.documents.select("doc_id", F.concat(
        F.lit("---\ntitle: doc "), "doc_id", F.lit("\nlang: "), "lang", F.lit("\n---\n# First\n"), F.regexp_replace("text", "[#`]", ""),
        F.lit("\n## Second\ncode below\n```python\nimport os\nprint(1)\n```\nend "), "source").alias("md"))


@plan("T18", "SELECT doc_id, 'doc ' || doc_id AS title, 2 AS sections, 1 AS code_blocks, lang, 'code below' || chr(10) || '[code block]' || chr(10) || 'end ' || source AS second, 'python' AS language FROM documents")
def markdown_extract(t):
    e = ct.markdown_extract(markdown(t), "doc_id", "md")
    return e.select("doc_id", "title", F.size("sections").alias("sections"), F.size("code_blocks").alias("code_blocks"), F.col("metadata")["lang"].alias("lang"),
                    F.col("sections")[1]["content"].alias("second"), F.col("code_blocks")[0]["language"].alias("language"))


def notebooks(t):
    """One notebook per document: lines become cells, every third a Markdown cell, some with outputs."""
    lines = F.split("text", "\n")
    cells = F.transform(lines, lambda x, i: F.struct(
        F.when(i % 3 == 0, "markdown").otherwise("code").alias("cell_type"),
        F.array(F.when(i % 3 == 0, F.concat(F.lit("# "), x)).when(i % 3 == 1, F.concat(F.lit("import pandas\n"), x)).otherwise(x)).alias("source"),
        F.when(i % 4 == 1, F.array(F.struct(F.lit("stream").alias("output_type")))).otherwise(F.array().cast("array<struct<output_type:string>>")).alias("outputs")))
    return t.documents.select("doc_id", F.to_json(F.struct(cells.alias("cells"))).alias("nb"))


@plan("T19", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
  SELECT doc_id, count(*) AS cells, count_if(i % 3 <> 0) AS code_cells, count_if(i % 4 = 1) AS with_outputs FROM l GROUP BY doc_id""")
def notebook_table(t):
    c = ct.notebook_cells(notebooks(t), "doc_id", "nb")
    return c.groupBy("doc_id").agg(F.count("*").alias("cells"), F.count_if(F.col("cell_type") == "code").alias("code_cells"), F.count_if("has_outputs").alias("with_outputs"))


@plan("T19", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  c AS (SELECT doc_id, i, i % 3 <> 0 AS code, i % 4 = 1 AS shown, CASE i % 3 WHEN 0 THEN '# ' || x WHEN 1 THEN 'import pandas' || chr(10) || x ELSE x END AS s FROM l),
  f AS (SELECT *, regexp_extract_all(s, '(?m)^(?:from|import)\s+(\w+)', 1) AS names, len(list_filter(string_split(s, chr(10)), lambda x: starts_with(x, '#'))) AS heads,
    regexp_matches(s, '["''][/~][^"'']+\.(csv|json|parquet|xlsx)') AS path, regexp_matches(s, 'random_state|seed') AS seed FROM c),
  g AS (SELECT doc_id, count(*) AS n, count_if(code) AS code, count_if(NOT code) AS md, count_if(code AND trim(s, ' ') = '') AS empty, count_if(code AND shown) AS outputs,
    coalesce(sum(heads) FILTER (NOT code), 0) AS heads, count_if(code AND len(names) > 0) AS importing, min(i) FILTER (code) AS first, min(i) FILTER (code AND len(names) > 0) AS first_import,
    coalesce(bool_or(path) FILTER (code), false) AS path, coalesce(bool_or(seed) FILTER (code), false) AS seed, list_distinct(flatten(list(names) FILTER (code))) AS names FROM f GROUP BY doc_id),
  i AS (SELECT *, list_filter([CASE WHEN empty > 0 THEN 'empty code cells' END, CASE WHEN outputs > 0 THEN 'stale outputs' END, CASE WHEN importing > 1 AND first_import <> first THEN 'scattered imports' END,
    CASE WHEN heads = 0 THEN 'no section headers' END, CASE WHEN md = 0 THEN 'no markdown cells' END, CASE WHEN code > 0 AND md / code < 0.2 THEN 'low documentation ratio' END, CASE WHEN path THEN 'hardcoded paths' END,
    CASE WHEN list_has_any(names, ['sklearn', 'torch', 'tensorflow', 'xgboost', 'lightgbm']) AND NOT seed THEN 'no random seed' END], lambda x: x IS NOT NULL) AS issues FROM g)
  SELECT doc_id, n AS n_cells, code AS code_cells, empty, outputs, array_to_string(issues, ';') AS issues, greatest(0, 10 - len(issues)) AS score FROM i""")
def notebook_quality(t):
    q = ct.notebook_quality(notebooks(t), "doc_id", "nb")
    return q.select("doc_id", "n_cells", "code_cells", "empty", "outputs", F.array_join("issues", ";").alias("issues"), "score")


MARKED = "(" + " OR ".join(f"contains(lower(trim(line, ' ')), '{m}')" for m in ct.CODE_MARKS) + r" OR regexp_matches(line, '^(    |\t)') OR regexp_matches(trim(line, ' '), '[=+\-*/]{2,}') OR regexp_matches(trim(line, ' '), '[(){}\[\];]') OR regexp_matches(trim(line, ' '), '^\d+[.)]\s+'))"


@plan("T20", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), c AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run, length(line) AS n FROM l WHERE trim(line, ' ') <> '' AND {MARKED})
  SELECT doc_id, min(pos) AS line_number, count(*) AS n_lines, (sum(n) + count(*) - 1)::BIGINT AS chars FROM c GROUP BY doc_id, run HAVING count(*) >= 2""")
def code_block_detect(t):
    b = ct.code_blocks(t.documents, "doc_id", "text", min_lines=2)
    return b.select("doc_id", "line_number", "n_lines", F.length("code").alias("chars"))


@plan("T20")
def code_languages(t):
    """Votes for pages' code blocks and for code-like runs in documents."""
    a = ct.html_extract(t.pages, "page_id", "html").select(F.explode("code_blocks").alias("c")).select(ct.vote(F.lower("c.code"), ct.LANGUAGE_MARKS, "none").alias("language"))
    b = ct.code_blocks(t.documents, "doc_id", "text", min_lines=1).select(F.coalesce("language", F.lit("none")).alias("language"))
    return a.unionByName(b).groupBy("language").agg(F.count("*").alias("n"))


def _dom(text):
    scores = [f"({' + '.join(f'contains({text}, {chr(39)}{m}{chr(39)})::INT' for m in ms)})" for ms in ct.DOMAINS.values()]
    best = f"greatest({', '.join(scores)})"
    return "CASE WHEN " + best + " = 0 THEN 'general_programming' " + " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in zip(ct.DOMAINS, scores)) + " END"


@plan("T21", f"SELECT domain, count(*) AS n FROM (SELECT {_dom('lower(text)')} AS domain FROM documents) GROUP BY domain")
def domain_classify(t):
    return spread(t.documents.select("text")).groupBy(ct.domain(F.col("text")).alias("domain")).agg(F.count("*").alias("n"))


TECH = " + ".join(f"contains(lower(text), '{m}')::INT" for m in ct.TECHNICAL)
LEVEL = f"""(CASE WHEN n > 10 THEN 2 WHEN n > 5 THEN 1 ELSE 0 END + CASE WHEN length(text) > 10000 THEN 2 WHEN length(text) > 5000 THEN 1 ELSE 0 END + {TECH})"""


@plan("T22 T23", rf"""WITH d AS (SELECT doc_id, text, len(string_split(text, chr(10))) AS n, len(string_split(text, '|')) - 1 AS bars,
    regexp_matches(text, '(?i)(?:algorithm|procedure|method)\s') AS algorithm, contains(lower(text), 'the') AS architecture FROM documents),
  l AS (SELECT doc_id, {LEVEL} + CASE WHEN bars > 5 THEN 2 WHEN bars > 2 THEN 1 ELSE 0 END AS s, {_dom('lower(text)')} AS domain, algorithm, architecture FROM d)
  SELECT doc_id, CASE WHEN s >= 6 THEN 'complex' WHEN s >= 3 THEN 'moderate' ELSE 'simple' END AS complexity,
    round(least(1, 0.5 + CASE WHEN algorithm THEN 0.2 ELSE 0 END + CASE WHEN architecture THEN 0.1 ELSE 0 END + CASE WHEN domain <> 'general_programming' THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence FROM l""")
def complexity_and_confidence(t):
    """Lines stand for sections, table bars for code blocks, a frequent word for a named architecture."""
    x = F.col("text")
    c = ct.concept_confidence(x.rlike(r"(?i)(?:algorithm|procedure|method)\s"), F.lower(x).contains("the"), ct.domain(x))
    level = ct.complexity(x, F.size(F.split(x, "\n")), F.size(F.split(x, r"\|")) - 1)
    return spread(t.documents.select("doc_id", "text")).select("doc_id", level.alias("complexity"), F.round(c, 2).alias("confidence"))


def noted(t):
    """Texts with a phrase by rule on the key, so that patterns occur."""
    k = F.col("doc_id")
    phrase = (F.when(k % 4 == 0, " We run an Event-Driven system with a data pipeline. ").when(k % 4 == 1, " Algorithm 3: fast merge\n1. split\n2) sort\n- join\n\nIt is O(n log n). ")
              .when(k % 4 == 2, " import numpy.linalg\npip install scikit-learn\nfrom pandas import x ").otherwise(" plain "))
    return t.documents.select("doc_id", F.concat("text", phrase, "source").alias("text"))


NOTED = """n AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' We run an Event-Driven system with a data pipeline. ' WHEN 1 THEN ' Algorithm 3: fast merge' || chr(10) || '1. split' || chr(10) || '2) sort' || chr(10) || '- join' || chr(10) || chr(10) || 'It is O(n log n). '
  WHEN 2 THEN ' import numpy.linalg' || chr(10) || 'pip install scikit-learn' || chr(10) || 'from pandas import x ' ELSE ' plain ' END || source AS text FROM documents)"""


def _arch():
    parts = []
    for name, marks in ct.ARCHITECTURES.items():
        word = "coalesce(" + ", ".join(f"CASE WHEN contains(t, '{m}') THEN '{m}' END" for m in marks) + ")"
        parts.append(f"SELECT doc_id, t, '{name}' AS pattern, {word} AS keyword FROM (SELECT doc_id, lower(text) AS t FROM n)")
    return " UNION ALL ".join(parts)


@plan("T24", f"""WITH {NOTED}, a AS (SELECT *, instr(t, keyword) - 1 AS p FROM ({_arch()}) WHERE keyword IS NOT NULL)
  SELECT doc_id, pattern, keyword, trim(substr(t, greatest(0, p - 100) + 1, least(length(t), p + length(keyword) + 100) - greatest(0, p - 100)), ' ') AS context FROM a""")
def architecture_mentions(t):
    return ct.architecture_mentions(noted(t), "doc_id", "text")


@plan("T25 J04", rf"""WITH {NOTED}, d AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:algorithm|procedure|method)\s+(\d+)?[:\s]+([^\n]+?)(?:\n|$)')) AS m FROM n)
  SELECT doc_id, CASE WHEN num = '' THEN 'Algorithm' ELSE 'Algorithm ' || num END AS name, description, CASE WHEN num = '3' THEN 3 ELSE 0 END AS n_steps, CASE WHEN num = '3' THEN 'O(n log n)' END AS big_o
  FROM (SELECT doc_id, regexp_extract(m, '(?i)(?:algorithm|procedure|method)\s+(\d+)?[:\s]+([^\n]+)', 1) AS num, trim(regexp_extract(m, '(?i)(?:algorithm|procedure|method)\s+(\d+)?[:\s]+([^\n]+)', 2), ' ') AS description FROM d)""")
def algorithm_mentions(t):
    return ct.algorithm_mentions(noted(t), "doc_id", "text").select("doc_id", "name", "description", "n_steps", "big_o")


_CODE = [f"contains(lower(text), '{m}')::INT" for m in ct.ALGORITHM_MARKS]


@plan("T25", f"""SELECT conv_id, turn, left(text, 50) AS name, md5(text) AS digest, {" + ".join(_CODE)} AS n_marks FROM conversations WHERE {" + ".join(_CODE)} >= 3""")
def algorithms_in_code(t):
    """Turns that read like code."""
    b = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "text")
    return ct.algorithms_in_code(b, "k", F.col("text"), F.col("text")).select("k.conv_id", "k.turn", "name", F.md5("pseudocode").alias("digest"), "n_marks")


LIBRARY_SQL = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS m FROM n" for p in ct.LIBRARY)


@plan("T26", rf"""WITH {NOTED}, m AS ({LIBRARY_SQL}) SELECT library, count(*) AS docs FROM (SELECT DISTINCT doc_id, string_split(m, '.')[1] AS library FROM m) WHERE length(library) > 1 GROUP BY library""")
def dependency_mentions(t):
    return ct.dependency_mentions(noted(t), "doc_id", "text").groupBy("library").agg(F.count("*").alias("docs"))


SENT = r"len(list_filter(string_split(regexp_replace(text, '[?!]', '.', 'g'), '.'), lambda x: trim(x, ' ') <> ''))"


@plan("T31", f"""SELECT conv_id, count(*) AS segments, sum(len({WORDS}))::BIGINT AS word_count, round(sum(len({WORDS})) / greatest(sum({SENT}), 1), 1) AS words_per_sentence FROM conversations GROUP BY conv_id""")
def transcript_rollup(t):
    return ct.transcript_rollup(t.conversations, "conv_id", "turn", "text").select("conv_id", "segments", "word_count", "words_per_sentence")


@plan("T31", "SELECT conv_id, 0 AS part, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def transcript_text(t):
    return joins.ordered_concat(t.conversations, ["conv_id"], ["turn"], "text")


@plan("T31", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations QUALIFY rank <= 2")
def top_comments(t):
    c = t.conversations.withColumn("likes", F.length("text"))
    return ct.top_comments(c, "conv_id", "likes", "turn", 2).select("conv_id", "turn", "rank")


@plan("T32", """WITH m AS (SELECT conv_id, turn, ceil(length(CASE WHEN length(text) > 400 THEN '[output ' || md5(text) || ']' ELSE text END) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations),
  s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN pos <= 1 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS h, sum(CASE WHEN pos > 1 THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m)
  SELECT conv_id, turn, tokens, total > 160 AS over_budget, total <= 160 OR pos <= 1 OR back + h <= 160 AS keep FROM s""")
def compact_history(t):
    return ct.compact_history(t.conversations, "conv_id", "turn", "text", 200, long_output=400).drop("text")


@plan("V13", """WITH u AS (SELECT role, ceil(length(text) / 4)::BIGINT AS tin, CASE WHEN role = 'assistant' THEN ceil(length(text) / 4)::BIGINT ELSE 0 END AS tout FROM conversations)
  SELECT role, count(*) AS n, sum(tin)::BIGINT AS tokens_in, sum(tout)::BIGINT AS tokens_out, round(sum(tin * 3.0 / 1e6 + tout * 15.0 / 1e6), 8) AS cost FROM u GROUP BY role""")
def cost_rollup(t):
    tin = F.ceil(F.length("text") / 4)
    tout = F.when(F.col("role") == "assistant", tin).otherwise(F.lit(0))
    return bk.cost_rollup(t.conversations, "role", tin, tout, 3.0, 15.0).select("role", "n", "tokens_in", "tokens_out", F.round("cost", 8).alias("cost"))
