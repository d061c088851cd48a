"""Sinks and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", na: str = "") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", na).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_report(df: DataFrame, name: str = "report") -> DataFrame:
    """Every row as one JSON string."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, date_col: str, cluster_cols: Sequence[str],
                      grain: str = "day") -> None:
    """One folder per day (or month), rows clustered inside.

    Rows are ranged over tasks by date and cluster columns, so files keep tight min/max values and
    a busy date is spread over several tasks.
    """
    if len(cluster_cols) > 4:
        raise ValueError("at most four cluster columns")
    dated = df.withColumn("dt", F.to_date(F.date_trunc(grain, date_col)))
    (dated.repartitionByRange("dt", *cluster_cols)
     .sortWithinPartitions("dt", *cluster_cols)
     .write.mode("overwrite").partitionBy("dt").parquet(path))


def export_training_set(features: DataFrame, labels: DataFrame, keys: Sequence[str], date_col: str,
                        start: str, end: str) -> DataFrame:
    """Features and labels of the same entity and day inside ``[start, end]``."""
    inside = F.col(date_col).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return features.where(inside).join(labels.where(inside), [*keys, date_col], "inner")
