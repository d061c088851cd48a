"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenframe.sources.tables import Tables


@dataclass(frozen=True)
class Plan:
    ops: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(ops: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under its own name for the inventory ids in ``ops``."""

    def register(fn):
        name = fn.__name__
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = Plan(tuple(ops.split()), fn, sql)
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(p: Plan):
        return lambda spark, folder: p.build(Tables(spark, folder))

    return {name: bind(p) for name, p in PLANS.items()}


# Columns that DuckDB would return as 128-bit sums.
BIGINT_COLUMNS = {
    "binary_metrics": "tp fp fn tn",
    "classification_report": "support tp predicted",
    "cte_steps": "orders_n",
    "custom_sql_tests": "failing",
    "exact_match_eval": "correct",
    "magnitude_checks": "bad_negatives outside_0_100",
    "nan_inf_check": "nan infinite",
    "nested_items": "chars",
    "notebook_quality": "code_cells empty outputs",
    "notebook_table": "code_cells with_outputs",
    "pivot_counts": "view click purchase",
    "rate_extremes": "zeros ones",
    "read_json_lines": "k_total",
    "read_text_corpus": "chars line_breaks",
    "read_xml_pairs": "answer_chars",
    "results_summary": "keep discard crash",
    "rule_tests": "failing",
    "semantic_cache": "hits",
    "sentinel_flags": "n",
    "sessionize": "purchases",
    "shadow_compare": "disagreements",
    "subgroup_metrics": "tp fp fn tn",
    "threshold_sweep": "tp fp fn tn",
    "time_consistency": "future",
}


def oracles() -> dict[str, str]:
    out = {}
    for name, p in PLANS.items():
        if p.sql and name in BIGINT_COLUMNS:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in BIGINT_COLUMNS[name].split())
            out[name] = f"SELECT * REPLACE ({casts}) FROM ({p.sql})"
        elif p.sql:
            out[name] = p.sql
    return out
