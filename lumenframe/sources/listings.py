"""Dataset manifests, merged listings and tag lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.scaling import top_per_group


def data_manifest(df: DataFrame, name: str, created: str) -> DataFrame:
    """Row count, column count and an order-free checksum (md5 prefix of every row, summed)."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]))
    part = F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(part).alias("checksum")).select(
        F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "checksum",
        F.lit(created).alias("created"))


def merge_listings(parts: list[DataFrame], title: str, priority: str, tie: str, n: int) -> DataFrame:
    """Union of result lists; a title counts once, ignoring case and outer spaces."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keyed = whole.withColumn("_title", F.lower(F.trim(title))).where(F.col("_title") != "")
    first = top_per_group(keyed, ["_title"], [priority, tie], 1).drop("_title")
    return first.orderBy(priority, tie).limit(n)


def tag_value(tags: Column, prefix: str) -> Column:
    """Value of the last tag ``prefix:value`` or an empty string."""
    hits = F.filter(tags, lambda t: t.startswith(prefix + ":"))
    return F.coalesce(F.regexp_replace(F.try_element_at(hits, F.lit(-1)), f"{prefix}:", ""), F.lit(""))


def tag_values(tags: Column, prefix: str, n: int = 5) -> Column:
    """The first ``n`` values of tags ``prefix:value``."""
    hits = F.filter(tags, lambda t: t.startswith(prefix + ":"))
    return F.slice(F.transform(hits, lambda t: F.regexp_replace(t, f"{prefix}:", "")), 1, n)
