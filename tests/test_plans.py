"""Every registered query with SQL gives DuckDB's rows; the others give rows (their results are tested in test_model_properties)."""

import os

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as entry
from lumenframe.plans import registry

FOLDER = os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.callables(), registry.oracles()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, oracle, name):
    if name in SQL:
        assert compare(spark, oracle, QUERIES[name], SQL[name], FOLDER) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


HOT = ["rank_functions", "running_sum_count", "rolling_rows", "range_frame", "first_last_nth", "ntile_percent_rank", "distinct_in_window", "consecutive_runs",
       "quantile_table", "describe_numeric", "asof_last_purchase", "sessionize", "scd2_status", "mann_whitney_u", "ks_two_samples", "roc_auc", "fraud_features",
       "timeseries_features", "rolling_feature_panel", "rfm", "compact_history", "stopping_rule"]


@pytest.mark.parametrize("name", HOT)
def test_plan_with_hot_keys(spark, oracle, split_small_keys, name):
    assert compare(spark, oracle, QUERIES[name], SQL[name], FOLDER) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cohort", "age", "users", "retention"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
