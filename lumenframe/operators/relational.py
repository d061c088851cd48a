"""Projection, filter, set and hierarchy operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.scaling import with_totals
from lumenframe.session import cut_lineage


def staged(df: DataFrame, columns: dict[str, tuple[str, str]], keep: Column | None = None) -> DataFrame:
    """Staging model: ``columns[new] = (old, type)``, rows outside ``keep`` dropped."""
    df = df if keep is None else df.where(keep)
    return df.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in columns.items()])


def filter_by_label(df: DataFrame, col: str, label, metric: str) -> DataFrame:
    return df.where((F.col(col) == F.lit(label)) & F.col(metric).isNotNull())


def null_rates(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return {c: row[c] or 0.0 for c in df.columns}


def drop_sparse_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns with a larger null share than ``threshold``."""
    return df.drop(*[c for c, r in null_rates(df).items() if r > threshold])


def select_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    return df.select(*[df.columns[i] for i in positions])


def case_status(days: Column, at_risk: int = 30, churned: int = 90) -> Column:
    return F.when(days > churned, "churned").when(days > at_risk, "at_risk").otherwise("active")


def binary_label(x: Column, threshold: float) -> Column:
    return (x >= threshold).cast("int")


def above_key_average(df: DataFrame, key: str, value: str, latest: str) -> DataFrame:
    """Rows above their key's average that also carry the key's latest date."""
    stats = [F.avg(value).alias("_avg"), F.max(latest).alias("_latest")]
    return with_totals(df, [key], stats).where(
        (F.col(value) > F.col("_avg")) & (F.col(latest) == F.col("_latest"))).drop("_avg", "_latest")


def in_ranges(ranges: dict[str, tuple[float | None, float | None]]) -> Column:
    """All given bounds hold (null fails)."""
    ok = F.lit(True)
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
    return ok


def map_values(df: DataFrame, col: str, lookup: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Code to label by a lookup table; unknown codes give null. Spark picks the join by size."""
    return df.join(lookup.select(F.col(key).alias(col), F.col(value).alias(out)), col, "left")


def walk_hierarchy(nodes: DataFrame, id_col: str, parent_col: str, name_col: str,
                   max_depth: int = 64) -> DataFrame:
    """Depth and ``a > b > c`` path of every node below the roots (null parent), level by level."""
    level = nodes.where(F.col(parent_col).isNull()).select(
        id_col, name_col, F.lit(0).alias("depth"), F.col(name_col).alias("path"))
    out = level
    children = nodes.where(F.col(parent_col).isNotNull())
    for depth in range(1, max_depth + 1):
        parents = level.select(F.col(id_col).alias("_pid"), F.col("path").alias("_path"))
        level = cut_lineage(
            children.join(parents, children[parent_col] == F.col("_pid"))
            .select(children[id_col], children[name_col], F.lit(depth).alias("depth"),
                    F.concat_ws(" > ", "_path", children[name_col]).alias("path")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise RuntimeError("hierarchy deeper than max_depth, or a cycle")
    return out


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in set(before.columns)]


def population_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Which keys are missing and which are new."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return (e.join(a, key, "left_anti").withColumn("side", F.lit("missing"))
            .unionByName(a.join(e, key, "left_anti").withColumn("side", F.lit("new"))))
