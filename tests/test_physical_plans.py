"""The physical plan is the wanted one: pruned scans, pushed filters, no nested-loop or cross joins."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenframe.sources import writers
from lumenframe.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


def explained(df):
    return df._jdf.queryExecution().toString()


def test_filter_and_columns_reach_the_scan(spark):
    text = explained(entry.queries()["read_parquet_filtered"](spark, FOLDER))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"l_extendedprice", "l_returnflag", "l_shipdate"}


@pytest.mark.parametrize("name", ["snapshot_totals", "product_affinity", "asof_last_purchase", "entity_date_spine", "sessionize", "cohort_retention", "rfm",
                                  "merge_back_group_stats", "ks_two_samples", "roc_auc", "stream_static_join", "range_frame"])
def test_no_nested_loops(spark, name):
    text = explained(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_partition_pruning(spark):
    path = scratch_path(spark, "pruned")
    writers.write_partitioned(spark.read.parquet(f"{FOLDER}/orders.parquet"), path, "o_orderdate", ["o_custkey"], grain="month")
    df = spark.read.parquet(path).where(F.col("dt") == F.lit("2000-01-01").cast("date"))
    assert "PartitionFilters: [isnotnull(dt" in explained(df)
    assert df.select(F.col("_metadata.file_path")).distinct().where(~F.col("file_path").contains("dt=2000-01-01")).count() == 0


def test_top_n_per_group_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in explained(entry.queries()["top_n_per_group"](spark, FOLDER))


def test_code_lines_are_marked_once(spark):
    """No filter at the scan marks a text's lines anew for each of its lines, and a long text is done at once."""
    from lumenframe.operators import content

    docs = spark.createDataFrame([(1, "x = {};\n\nplain words\n" * 20_000 + "y = [1]\n  z = [2] \nend"), (2, "plain"), (3, None), (4, ""), (5, "words before \nf(x)\ng(y)")], "id long, text string")
    blocks = content.code_blocks(docs, "id", "text", min_lines=2)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(lower(trim(lambda") == len(content.CODE_MARKS)
    assert sorted(map(tuple, blocks.select("id", "line_number", "n_lines", "context", "code").collect())) == [(1, 60_000, 2, "plain words", "y = [1]\n  z = [2] "), (5, 1, 2, "words before", "f(x)\ng(y)")]
    assert content.code_blocks(docs, "id", "text", min_lines=1).count() == 20_002
