"""A corpus pipeline of five of the operators; each stage works on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes each stage's rows as Parquet to the shared scratch
folder and rereads them as the next stage's ``docs``, so a lost executor costs one stage's tasks at most. All stages but the last
return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import credentials, lsh_forest, merge_replay, queries, reparameterised, repetition
from lumenframe.llm.common import stored
from lumenframe.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected texts go."""
    ship_package(spark)
    return repetition.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies stays."""
    ship_package(spark)
    return lsh_forest.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that leak a benchmark item go."""
    ship_package(spark)
    return reparameterised.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every row stays."""
    ship_package(spark)
    return credentials.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    ship_package(spark)
    return merge_replay.digests(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), queries.split_pattern())


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("byte BPE", tokens),
]

#: Merges and LCP intervals have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
