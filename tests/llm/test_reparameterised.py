import random
import re
from collections import Counter

from lumenframe.llm import reparameterised
from lumenframe.llm.reparameterised import NUMBER_WORDS, UNITS

QUESTION = "Alice bought 12 apples and 3 pears for 5 kg of fruit while Bob sold 12 oranges near the old market yesterday afternoon"
OTHER = "So Carol Smith bought 40 apples and 7 pears for 9 kg of fruit while Dave sold 40 oranges near the old market yesterday afternoon ok"
INCONSISTENT = OTHER.replace("40 oranges", "41 oranges")
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def canonical(text, with_names):
    """[(code, first written word, last + 1, value)], word by word."""
    tokens, opens = [], True
    for line in (text or "").replace("\x00", " ").split("\n"):
        opens = True
        for w in re.split(r"[ \t\r\x0b\x0c]+", line):
            if not w:
                continue
            bare = w.strip(STRIP)
            if bare:
                tokens.append((bare, opens))
                opens = False
            opens = opens or w.rstrip("\"')]}").endswith((".", "!", "?"))
    out = []
    for k, (bare, opening) in enumerate(tokens):
        low = bare.lower()
        number = low in NUMBER_WORDS or re.fullmatch(r"[+-]?[0-9][0-9.,]*(st|nd|rd|th)?", low)
        measure = re.fullmatch(r"([+-]?[0-9][0-9.,]*)([a-z]+)", low)
        if number or measure and measure[2] in UNITS:
            code = "<num>"
        elif low in UNITS and out and out[-1][0] == "<num>":
            code = "<unit>"
        elif with_names and low not in UNITS and bare[0].isupper() and bare[1:] != bare[1:].upper() and not opening:
            code = "<name>"
            if out and out[-1][0] == "<name>":
                c, a, _, v = out[-1]
                out[-1] = (c, a, k + 1, v + " " + low)
                continue
        else:
            code = low
        out.append((code, k, k + 1, low))
    return out, len(tokens)


def windows(text, search, short):
    found = []
    for with_names in (True, False):
        words, _ = canonical(text, with_names)
        n = search.window if not short or len(words) >= search.window else len(words)
        for k in range(len(words) - n + 1) if n else ():
            w = words[k : k + n]
            literal = sum(not c.startswith("<") for c, *_ in w)
            if literal >= search.least_literal and (not with_names or any(c == "<name>" for c, *_ in w)):
                slots = tuple((a, v) for c, a, _, v in w if c.startswith("<"))
                found.append((tuple(c for c, *_ in w), w[0][1], w[-1][2], slots))
    return found


def brute(docs, items, search):
    out = {}
    for item, item_text in items:
        mine = windows(item_text, search, True)
        total = canonical(item_text, False)[1]
        for doc, text in docs:
            hits = [(w[1] - m[1], m, w) for w in windows(text, search, False) for m in mine if m[0] == w[0]]
            for m in mine:
                if len(m[0]) < search.window:
                    own = windows(text, reparameterised.Search(window=len(m[0]), least_literal=search.least_literal), False)
                    whole = {len(canonical(text, names)[0]) for names in (True, False)}
                    hits += [(w[1] - m[1], m, w) for w in own if m[0] == w[0] and (len(m[0]) >= search.least_words or len(m[0]) in whole and len(own) <= 2)]
            hits.sort(key=lambda h: h[0])
            covered, group = set(), []
            for h in [*hits, None]:
                if group and (h is None or h[0] - group[-1][0] > search.window):
                    pairs = {(a, s, b, t) for _, m, w in group for (a, s), (b, t) in zip(m[3], w[3])}
                    by = {}
                    for _, s, _, t in pairs:
                        by.setdefault(s, Counter())[t] += 1
                    share = sum(max(c.values()) for c in by.values()) / len(pairs) if pairs else 1
                    if share >= search.consistency:
                        for _, m, _ in group:
                            covered.update(range(m[1], m[2]))
                    group = []
                group.append(h)
            if covered and len(covered) >= min(search.coverage * total, search.most_words):
                out[doc, item] = (total, len(covered))
    return out


def found(spark, docs, items, search=reparameterised.Search()):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = reparameterised.leaks(df, spark.createDataFrame(items, "item_id long, text string"), search=search).collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    return {(r.doc_id, r.item_id): (r.item_words, r.covered_words) for r in rows}


DOCS = [
    (1, f"x y z {QUESTION} more"), (2, f"Hello. {OTHER}"), (3, INCONSISTENT), (4, "nothing here to see my good friend of mine really"), (5, None), (6, ""),
    (8, QUESTION.lower()), (9, QUESTION.upper()), (10, " ".join(QUESTION.split()[:9])), (11, f"{OTHER}\n{QUESTION}"),
]


def test_reparameterised_questions(spark):
    items = [(1, QUESTION), (2, None), (3, ""), (4, "one two three"), (5, "what is the capital of France"), (None, "an item without an id that has quite enough words")]
    docs = [*DOCS, (12, "tell me what is the capital of Spain please"), (None, "say: an item without an id that has quite enough words")]
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (8, 1), (9, 1), (11, 1), (12, 5), (None, None)}
    assert got == brute(docs, items, reparameterised.Search())


def test_slots_decide(spark):
    loose = reparameterised.Search(consistency=0.5)
    assert (3, 1) in found(spark, DOCS, [(1, QUESTION)], loose) and (3, 1) not in found(spark, DOCS, [(1, QUESTION)])


def test_random_texts_match_brute_force(spark):
    r = random.Random(6)
    vocabulary = "the a of cat dog ran sat Berlin Anna Karl 3 14 kg hours two big. red, now! (so) ** -".split()
    made = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, made(r.randint(3, 14))) for k in range(25)]
    docs = []
    for k in range(80):
        parts = [made(r.randint(0, 15))]
        for _ in range(r.randint(0, 2)):
            words = r.choice(items)[1].split()
            words = [r.choice(["Oslo", "Eva", "99", "5", w]) if w[0].isupper() or w[0].isdigit() else w for w in words]
            parts += [r.choice([" ", "\n", ". "]).join([" ".join(words)]), made(r.randint(0, 6))]
        docs.append((k, r.choice([" ", "\n"]).join(parts)))
    search = reparameterised.Search(window=4, least_literal=2, consistency=0.8, least_words=0)
    got = found(spark, docs, items, search)
    assert got == brute(docs, items, search) and len(got) > 20


def test_query_matches_brute_force_on_its_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(spark, docs, items) == brute(docs, items, reparameterised.Search())


def test_verbatim_passages_are_all_found(spark):
    folder = "/root/testdata/sf0.01"
    squeeze = lambda t: " ".join((t or "").split())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {(i, j) for i, t in docs for j, u in items if squeeze(u) in squeeze(t)}
    assert whole and whole <= set(found(spark, docs, items))


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "no id here at all ok")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in reparameterised.leaks(odd_docs, items).collect()] == [(None, 1)]
    assert reparameterised.leaks(odd_docs, none).collect() == [] and reparameterised.leaks(no_docs, items).collect() == []
    left = reparameterised.drop_leaking(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 1


def test_leaking_rows_go(spark):
    df = spark.createDataFrame([(i, t, "src") for i, t in DOCS], "doc_id long, text string, source string")
    left = reparameterised.drop_leaking(df, spark.createDataFrame([(1, QUESTION)], "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 10] and left.columns == df.columns


def test_copies_of_items_that_repeat_themselves(spark):
    """An exact copy stays a leak where it also matches itself, or variants that follow it, at other distances."""
    flour = "add 2 bags of flour and 3 bags of flour and 4 bags of flour and 5 bags of flour"
    total = "what is the sum of 12 and 7"
    listed = total + "".join(f" what is the sum of {a} and {b}" for a, b in ((15, 9), (31, 4), (8, 26)))
    got = found(spark, [(1, flour), (2, listed), (3, f"so {flour}. Then rest"), (4, "add flour")], [(1, flour), (2, total)])
    assert got == {(1, 1): (20, 20), (2, 2): (8, 8), (3, 1): (20, 20)}


def test_distances_that_agree_alone_but_not_together(spark):
    """A name of other length shifts the second half; the halves give one value two meanings, so only one of them counts."""
    item = "we saw 12 red boats leave the small harbour with Anna while 12 more boats came back from the sea at night"
    text = item.replace("12 red", "40 red").replace("12 more", "50 more").replace("Anna", "Anna Maria Berg")
    loose = reparameterised.Search(consistency=0.5)
    strict = reparameterised.Search(coverage=0.9)
    assert (1, 1) in found(spark, [(1, text)], [(1, item)], loose) and found(spark, [(1, text)], [(1, item)], strict) == {}


def test_items_of_few_literal_words_are_found_as_written(spark):
    sequence = "Find the next number: " + " ".join(str(k * k) for k in range(1, 21))
    units = "5 kg 3 km 12 hours 7 days 9 miles 2 pounds"
    short = "What is 12 times 7?"
    docs = [
        (1, f"Quiz. {sequence} and so on"), (2, sequence.replace(" 100 ", " 101 ").replace(" 36 ", " 37 ").replace(" 225 ", " 226 ").replace(" 324 ", " 325 ")),
        (3, f"take {units} of it"), (4, units.replace("12", "13").replace("9", "8")), (5, "Tell me: what is 12 times 7"), (6, "What is 13 times 7?"), (7, f"{short} {short} {short}"),
    ]
    got = found(spark, docs, [(1, sequence), (2, units), (3, short)], reparameterised.WHOLE)
    assert got == {(1, 1): (24, 24), (3, 2): (12, 12), (5, 3): (5, 5), (7, 3): (5, 5)}


CLEAN = [
    (1, "Yes. She said that the harbour would open again, and yes it did."), (2, "The 12 boats of the old town came back at 12 sharp."), (3, "Ask what is 12 in the book of sums."),
    (4, "What is the capital city of the next country on the list?"), (5, "no yes no 7"), (6, "12 12"), (7, "yes yes."),
]
TINY = [(1, "Yes."), (2, "the"), (3, "12"), (4, "What is 12"), (5, "What is the capital"), (6, "7 kg")]


def test_items_of_a_few_words_leave_ordinary_texts_alone(spark):
    assert found(spark, CLEAN, TINY, reparameterised.WHOLE) == {} == found(spark, CLEAN, TINY)
    df = spark.createDataFrame(CLEAN, "doc_id long, text string")
    assert reparameterised.drop_leaking(df, spark.createDataFrame(TINY, "item_id long, text string")).count() == len(CLEAN)


def test_items_of_a_few_words_are_found_as_whole_texts(spark):
    docs = [(1, "yes"), (2, " Yes!\n"), (3, "12"), (4, "13"), (5, "what is 12?"), (6, "What is 13"), (7, "What is the capital?"), (8, "7 kg"), (9, "8 kg"), (10, "Yes yes")]
    got = found(spark, docs, TINY, reparameterised.WHOLE)
    assert set(got) == {(1, 1), (2, 1), (3, 3), (5, 4), (7, 5), (8, 6)} and all(a == b for a, b in got.values())


def test_rows_go_for_their_own_text(spark):
    rows = [(1, QUESTION, "a"), (1, "an innocent text under the same id that stays", "b"), (None, QUESTION, "c"), (None, "an innocent text without any id that stays", "d"), (2, QUESTION, "e"), (2, QUESTION, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    left = reparameterised.drop_leaking(df, items)
    assert sorted(r.key for r in left.collect()) == ["b", "d"] and left.columns == df.columns
    assert sorted(((r.doc_id, r.n_windows) for r in reparameterised.leaks(df, items).collect()), key=str) == sorted([(i, reparameterised.leaks(df.limit(1), items).first().n_windows) for i in (1, 2, None)], key=str)
    other = items.withColumnsRenamed({"item_id": "no", "text": "question"})
    assert reparameterised.drop_leaking(df, other, item_col="no", item_text_col="question").count() == 2
