"""Merges into a table of key ranges: results, files rewritten, crashes and replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import keyed_table
from lumenframe.sources.keyed_table import KeyedTable

SCHEMA = "id long, v long, ts timestamp_ntz"


def rows(spark, ids, v=0, day=1):
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(i)) for i in ids]) if len(ids) < 500 else F.sequence(F.lit(int(min(ids))), F.lit(int(max(ids))), F.lit(int(ids[1] - ids[0])))).alias("id")).select(
        F.col("id").cast("long").alias("id"), F.lit(v).cast("long").alias("v"), F.expr(f"timestamp_ntz'2024-01-{day:02d} 00:00:00'").alias("ts"))


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["id"], "ts", file_rows=100)
    t.merge(rows(spark, range(0, 20_000, 2)))
    return t


def files(t):
    return {r.path for r in t.manifest().select("path").collect()}


def held(t, version=None):
    return {r.id: r.v for r in t.read(version).collect()}


def test_a_small_update_rewrites_files_in_proportion(spark, table):
    before = files(table)
    assert len(before) >= 90
    table.merge(rows(spark, range(10_000, 10_200, 2), v=7, day=2))  # one in a hundred, side by side
    assert len(before - files(table)) <= 4
    want = {i: 7 if 10_000 <= i < 10_200 else 0 for i in range(0, 20_000, 2)}
    assert held(table) == want and table.versions() == [1, 2] and held(table, 1) == dict.fromkeys(want, 0)
    assert str(table.high()) == "2024-01-02 00:00:00"


def test_new_keys_between_old_ones_touch_few_files(spark, table):
    before = files(table)
    fresh = [i * 199 + 1 for i in range(0, 100, 2)]  # odd: in the range of most files, in none of them
    table.merge(rows(spark, fresh, v=3))
    assert len(before - files(table)) <= 3
    assert held(table) == dict.fromkeys(range(0, 20_000, 2), 0) | dict.fromkeys(fresh, 3)
    table.merge(rows(spark, fresh[:5], v=4))  # found again where ranges overlap
    assert held(table) == dict.fromkeys(range(0, 20_000, 2), 0) | dict.fromkeys(fresh, 3) | dict.fromkeys(fresh[:5], 4)
    assert table.read().count() == 10_000 + len(fresh)


def test_a_merge_that_breaks_off_leaves_the_old_version(spark, table, monkeypatch):
    want = held(table)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_commit", broken)
    with pytest.raises(RuntimeError):
        table.merge(rows(spark, [2, 4, 6], v=9))
    monkeypatch.undo()
    again = KeyedTable(spark, table.root, ["id"], "ts", 100)
    assert held(again) == want and again.versions() == [1]
    again.merge(rows(spark, [2, 4, 6], v=9))
    assert held(again) == want | {2: 9, 4: 9, 6: 9}
    spark.createDataFrame([], "path string").write.parquet(f"{table.root}/manifests/v000009")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/manifests/v000009/_SUCCESS")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).rename(hadoop, spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/manifests/v000009/unfinished"))
    assert again.versions() == [1, 2]


def test_tags_are_merged_once_and_order_decides(spark, table):
    table.merge(rows(spark, [2], v=5, day=5).unionByName(rows(spark, [2], v=4, day=4)), ["-ts"], True, tag=1)
    table.merge(rows(spark, [2], v=1, day=1), ["-ts"], True, tag=2)
    assert held(table)[2] == 5 and table.tag() == 2
    table.merge(rows(spark, [2], v=8, day=9), ["-ts"], True, tag=2)
    assert held(table)[2] == 5 and len(table.versions()) == 3


def test_small_files_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_table, "MANY_SMALL", 4)
    t = KeyedTable(spark, str(tmp_path / "s"), ["k", "id"], file_rows=50)
    for k in range(7):
        t.merge(spark.createDataFrame([(f"k{k}", k, k)], "k string, id long, v long"))
    assert len(files(t)) <= 5 and t.read().count() == 7
    t.merge(spark.createDataFrame([("k3", 3, 30), ("k3", 4, 31)], "k string, id long, v long"))
    assert {(r.k, r.id, r.v) for r in t.read().collect()} == {(f"k{k}", k, k if k != 3 else 30) for k in range(7)} | {("k3", 4, 31)}


def test_filters_hold_their_keys():
    r = np.random.default_rng(1)
    own, other = r.integers(-(2**63), 2**63 - 1, 5000), r.integers(-(2**63), 2**63 - 1, 5000)
    bits = keyed_table.build_filter(own)
    assert keyed_table.may_hold(bits, own).all() and keyed_table.may_hold(bits, other).mean() < 0.05
