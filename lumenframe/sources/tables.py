"""The given parquet tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.session import ship_package

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet`` on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self.__dict__[name] = df
        return df
