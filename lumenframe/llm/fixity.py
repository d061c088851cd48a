"""Merkle fixity audit of archive replicas.

A replica is a table of records: archive, byte offset, length, digest of the record's bytes. Level 0 of its tree has one node for each
range of ``range_bytes`` bytes of an archive, hashing the offsets, lengths and digests of the records that begin there, in order; a node of the next
level hashes the numbers and hashes of ``fanout`` neighbouring nodes, up to one root per archive. The audit compares roots, descends only below nodes
that differ, and compares records only in the ranges that are left: what it reads below the roots grows with the damage.

Ranges are fixed by offset, not by record number, so no numbering of records is needed, a missing record disturbs one range, and a huge archive is many
groups of bounded size: a range holds at most ``range_bytes`` records, a node at most ``fanout`` children. The records' digests and each level are written once, so a step down reads
the stored nodes below the differing ones, and the last step reads the stored digests of the archives and offsets that are left.

Null archives form one archive named ``''``; records without an offset are put at -1 of their archive; null lengths and digests count as 0 and
``''``. Repeated records count once; several different records at one offset are compared as a set. An empty replica lacks every archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import named, stored

RANGE_BYTES = 64 << 10
FANOUT = 16


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_archive: int = 1000) -> DataFrame:
    """Pages as WARC response records: ``record_id, archive, offset, length, digest, rotten_digest, record``.

    An archive holds the pages of ``per_archive`` consecutive ids, one record behind the other in the order of ids and digests. Nulls are written as empty.
    ``rotten_digest`` is the digest of the record with its last content character replaced, for planted damage.
    """
    text = {c: F.coalesce(named(n).cast("string"), F.lit("")) for c, n in (("url", url_col), ("html", html_col))}
    rows = pages.select(named(id_col).cast("long").alias("record_id"), *(v.alias(k) for k, v in text.items()))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("record_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"),
    )
    rows = rows.withColumn("record", F.concat(head, F.col("html"), F.lit("\r\n\r\n")))
    # lengths and digests are taken here, so that the window below moves no text unless ``record`` itself is asked for
    rows = rows.select(
        "record_id", F.floor(F.col("record_id") / per_archive).cast("long").alias("archive"), F.octet_length("record").cast("long").alias("length"),
        F.sha2("record", 256).alias("digest"), F.sha2(F.concat(F.expr("left(record, length(record) - 5)"), F.lit("~\r\n\r\n")), 256).alias("rotten_digest"), "record")
    before = Window.partitionBy("archive").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return rows.select("record_id", "archive", "offset", "length", "digest", "rotten_digest", "record")


def records_of(replica: DataFrame) -> DataFrame:
    """The columns that the audit uses, without nulls."""
    return replica.select(
        F.coalesce(F.col("archive").cast("string"), F.lit("")).alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"), F.coalesce(F.col("digest").cast("string"), F.lit("")).alias("digest"),
        F.col("record_id"),
    )


def _place(column: str, size: int) -> Column:
    return F.floor(F.col(column) / F.lit(size)).cast("long")


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Level 0: ``archive, node, hash``."""
    record = F.struct("offset", "length", "digest")
    parts = F.transform(F.sort_array(F.collect_set(record)), lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"]))
    return records.groupBy("archive", _place("offset", range_bytes).alias("node")).agg(F.sha2(F.array_join(parts, ","), 256).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level of a level."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda r: F.concat_ws(":", r["node"], r["hash"]))
    return level.groupBy("archive", _place("node", fanout).alias("node")).agg(F.sha2(F.array_join(parts, ","), 256).alias("hash"))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.withColumn("side", F.lit(side))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """``archive, node`` of the nodes that differ or stand on one side only."""
    both = _side(left, "a").unionByName(_side(right, "b")).groupBy("archive", "node")
    one, two = (F.max(F.when(F.col("side") == s, F.col("hash"))) for s in "ab")
    return both.agg(one.alias("one"), two.alias("two")).filter(~F.col("one").eqNullSafe(F.col("two"))).select("archive", "node")


#: Archives with differing ranges that are named one by one to the reader of the records; with more of them the join alone picks the rows.
NAMED_ARCHIVES = 200


def _within(bad: DataFrame, range_bytes: int) -> Column:
    """What the reader of the records can skip by: the archives that are left, each from its first to its last differing range."""
    spans = bad.groupBy("archive").agg(F.min("node").alias("a"), F.max("node").alias("b")).limit(NAMED_ARCHIVES + 1).collect()
    if len(spans) > NAMED_ARCHIVES:
        return F.lit(True)
    found = F.lit(False)
    for r in spans:
        found |= (F.col("archive") == r["archive"]) & F.col("offset").between(r["a"] * range_bytes, (r["b"] + 1) * range_bytes - 1)
    return found


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT, seen: list[int] | None = None) -> DataFrame:
    """Records of two replicas that differ: ``archive, offset, kind, record_id, left_digest, right_digest``.

    ``kind`` is changed (both have a record there), missing (only the left) or extra (only the right). ``seen`` gets the number of nodes that are compared at each
    level from the roots down, and last the number of records.
    """
    records = [stored(records_of(r), "records") for r in (left, right)]
    levels = [[stored(leaves(r, range_bytes), "leaves") for r in records]]
    span = levels[0][0].unionByName(levels[0][1]).agg(F.min("node"), F.max("node")).first()
    low, high = (span[0] or 0), (span[1] or 0)
    while low != high or low not in (0, -1):  # up to the level where an archive has one node
        levels.append([stored(parents(x, fanout), "level") for x in levels[-1]])
        low, high = low // fanout, high // fanout
        if (low, high) == (-1, 0):  # records without an offset keep a root of their own
            break
    def noted(sides: list[DataFrame]) -> list[DataFrame]:
        if seen is not None:
            seen.append(sum(x.count() for x in sides))
        return sides

    bad = stored(_differing(*noted(levels[-1])), "roots")
    for level in reversed(levels[:-1]):
        above = bad.withColumnRenamed("node", "above")
        below = [x.withColumn("above", _place("node", fanout)).join(above, ["archive", "above"], "left_semi").drop("above") for x in level]
        bad = stored(_differing(*noted(below)), "nodes")
    within = _within(bad, range_bytes)
    inside = noted([r.filter(within).withColumn("node", _place("offset", range_bytes)).join(bad, ["archive", "node"], "left_semi") for r in records])
    rows = _side(inside[0], "a").unionByName(_side(inside[1], "b"))
    one_sided = rows.groupBy("archive", "offset", "length", "digest").agg(
        F.min("side").alias("side"), F.max("side").alias("other"), F.min("record_id").alias("record_id")).filter("side = other")
    def of(side):
        return F.min(F.when(F.col("side") == side, F.col("digest")))

    found = one_sided.groupBy("archive", "offset").agg(of("a").alias("left_digest"), of("b").alias("right_digest"), F.min("record_id").alias("record_id"))
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return found.select("archive", "offset", kind.alias("kind"), "record_id", "left_digest", "right_digest")


def decayed(records: DataFrame) -> DataFrame:
    """A replica with planted damage, for showing and testing the audit.

    By record id: every 97th record has its last content character replaced, every 211th is missing, and every 307th is followed by a stray one.
    """
    n = F.col("record_id")
    rows = records.filter(F.coalesce(n % 211 != 1, F.lit(True)))
    rows = rows.withColumn("digest", F.when(n % 97 == 13, F.col("rotten_digest")).otherwise(F.col("digest")))
    return rows.unionByName(records.filter(n % 307 == 2).withColumn("offset", F.col("offset") + 1))
