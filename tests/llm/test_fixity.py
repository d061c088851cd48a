import random

from pyspark.sql import functions as F

from lumenframe.llm import fixity

SCHEMA = "record_id long, archive string, offset long, length long, digest string"


def made(seed, n):
    r = random.Random(seed)
    rows, at = [], {}
    for k in range(n):
        a, size = r.choice("abc"), r.randint(1, 300_000)
        rows.append((k, a, at.get(a, 0), size, f"d{k}"))
        at[a] = at.get(a, 0) + size
    return rows


def brute(left, right):
    sides = []
    for rows in (left, right):
        by = {}
        for _, a, o, n, d in rows:
            by.setdefault((a or "", -1 if o is None else o), set()).add((n or 0, d or ""))
        sides.append(by)
    out = set()
    for key in sides[0].keys() | sides[1].keys():
        one, two = (s.get(key, set()) for s in sides)
        if one != two:
            only = [one - two, two - one]
            kind = "changed" if all(only) else "missing" if only[0] else "extra"
            out.add((*key, kind, *(min((d for _, d in x), default=None) for x in only)))
    return out


def found(spark, left, right, **limits):
    rows = fixity.audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), **limits).collect()
    return {(r.archive, r.offset, r.kind, r.left_digest, r.right_digest) for r in rows}


def test_damage_is_located(spark):
    left = made(1, 300)
    right = [(i, a, o, n, d + "!" if i % 50 == 3 else d) for i, a, o, n, d in left if i % 70 != 5] + [(900, "a", 17, 5, "stray"), (901, "z", 0, 5, "new archive")]
    for limits in ({}, {"range_bytes": 1000, "fanout": 2}):
        assert found(spark, left, right, **limits) == brute(left, right)


def test_equal_replicas_agree(spark):
    left = made(2, 100)
    assert found(spark, left, left[::-1] + left[:10]) == set()


def test_odd_rows(spark):
    left = [(1, None, None, None, None), (2, "a", None, 5, "x"), (3, "a", 0, 1, "y"), (4, "a", 0, 1, "z"), (4, "a", 0, 1, "z"), (5, "b", 10**12, 1, "far")]
    right = [(1, None, None, None, "now"), (2, "a", None, 5, "x"), (3, "a", 0, 1, "y"), (5, "b", 10**12, 1, "near")]
    assert found(spark, left, right) == brute(left, right)
    assert found(spark, left, []) == brute(left, []) and found(spark, [], left) == brute([], left) and found(spark, [], []) == set()


def test_records_of_pages(spark):
    pages = spark.createDataFrame([(2, "u", "<p>é</p>", 1), (1, None, None, 2), (None, "v", "", 3)], "page_id long, url string, html string, offset int")
    rows = {r.record_id: r for r in fixity.warc_records(pages).collect()}
    assert rows[1].offset == 0 and rows[2].offset == rows[1].length == len(rows[1].record.encode())
    assert "Content-Length: 9\r\n\r\n<p>é</p>\r\n\r\n" in rows[2].record and rows[None].archive is None
    damaged = fixity.decayed(fixity.warc_records(spark.range(0, 3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("text").alias("html"))))
    kinds = fixity.audit(fixity.warc_records(spark.range(0, 3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("text").alias("html"))), damaged)
    got = {(r.record_id, r.kind) for r in kinds.collect()}
    gone = {k for k in range(3000) if k % 211 == 1}
    assert got == {(k, "missing") for k in gone} | {(k, "changed") for k in range(3000) if k % 97 == 13 and k not in gone} | {(k, "extra") for k in range(3000) if k % 307 == 2}


def test_what_is_read_below_the_roots_follows_the_damage(spark, monkeypatch):
    left = [(k, f"a{k % 3}", (k // 3) * 1000, 900, f"d{k}") for k in range(6000)]
    counts = []
    for damaged in (0, 1, 10):
        seen = []
        right = [(i, a, o, n, d + "!" if i in range(0, 600 * damaged, 600) else d) for i, a, o, n, d in left]
        sides = [spark.createDataFrame(x, SCHEMA) for x in (left, right)]
        assert fixity.audit(*sides, range_bytes=4000, fanout=4, seen=seen).count() == damaged
        counts.append(seen)
    none, one, ten = counts
    assert none[0] == one[0] == ten[0] == 6 and sum(none[1:]) == 0
    assert all(n <= 2 * 4 for n in one[1:]) and sum(one[1:]) < sum(ten[1:]) <= 10 * sum(one[1:]) < 600
    monkeypatch.setattr(fixity, "NAMED_ARCHIVES", 1)
    sides = [spark.createDataFrame(x, SCHEMA) for x in (left, left[6:])]
    assert fixity.audit(*sides, range_bytes=4000, fanout=4).count() == 6
