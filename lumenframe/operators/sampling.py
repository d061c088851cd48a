"""Seeded samples, splits and folds; a row's place depends on its key and the seed only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import hash_unit
from lumenframe.operators.scaling import attach_row, ranked


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.withColumn("_u", hash_unit(F.lit(seed), F.col(key))).orderBy("_u", key).limit(n).drop("_u")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    return df.where(hash_unit(F.lit(seed), F.col(key)) < fraction)


def random_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Column ``split``; the last part takes what rounding leaves."""
    u = hash_unit(F.lit(seed), F.col(key))
    names, edge, out = list(shares), 0.0, None
    for name in names[:-1]:
        edge = round(edge + shares[name], 12)
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def _class_rank(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_u", hash_unit(F.lit(seed), F.col(key)))
    return ranked(hashed, [label], ["_u", key], {"_rn": "row_number"}).drop("_u")


def _class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("_n"))


def stratified_split(df: DataFrame, key: str, label: str, train: float, seed: int = 0) -> DataFrame:
    """Exactly ``ceil(train * n)`` rows of each class go to train."""
    sized = _class_rank(df, key, label, seed).join(_class_sizes(df, label), label)
    return sized.withColumn("split", F.when(F.col("_rn") <= F.ceil(F.round(F.lit(train) * F.col("_n"), 9)), "train")
                            .otherwise("test")).drop("_rn", "_n")


def temporal_split(df: DataFrame, ts: str, val_from: str, test_from: str) -> DataFrame:
    c = F.col(ts)
    return df.withColumn("split", F.when(c < F.lit(val_from).cast("timestamp_ntz"), "train")
                         .when(c < F.lit(test_from).cast("timestamp_ntz"), "val").otherwise("test"))


def _fold(key: Column, k: int, seed: int) -> Column:
    return F.floor(hash_unit(F.lit(seed), key) * k).cast("int")


def kfold(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Fold by key hash: with a group column as key, a group never spans folds."""
    return df.withColumn("fold", _fold(F.col(key), k, seed))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    return _class_rank(df, key, label, seed).withColumn("fold", (F.col("_rn") - 1) % k).drop("_rn")


def nested_kfold(df: DataFrame, key: str, outer: int, inner: int, seed: int = 0) -> DataFrame:
    return df.withColumn("outer_fold", _fold(F.col(key), outer, seed)).withColumn("inner_fold", _fold(F.col(key), inner, seed + 1))


def time_series_split(df: DataFrame, ts: str, k: int) -> DataFrame:
    """Expanding folds: dates are cut into k+1 blocks; fold i trains on blocks 1..i and tests on i+1."""
    dates = ranked(df.select(ts).distinct(), [], [ts], {"_b": f"ntile:{k + 1}"})
    placed = df.join(dates, ts)
    roles = F.transform(F.sequence(F.greatest(F.col("_b") - 1, F.lit(1)), F.lit(k)), lambda f: F.struct(
        f.cast("int").alias("fold"), F.when(F.col("_b") <= f, "train").otherwise("test").alias("role")))
    return placed.select(*df.columns, F.inline(roles))


def undersample(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Every class down to about the size of the smallest one."""
    n = _class_sizes(df, label)
    sized = df.join(attach_row(n, n.agg(F.min("_n").alias("_s"))), label)
    return sized.where(hash_unit(F.lit(seed), F.col(key)) < F.col("_s") / F.col("_n")).drop("_n", "_s")


def oversample(df: DataFrame, label: str) -> DataFrame:
    """Whole copies of minority rows, ``floor(largest / own)`` each."""
    n = _class_sizes(df, label)
    sized = df.join(attach_row(n, n.agg(F.max("_n").alias("_m"))), label)
    copies = F.sequence(F.lit(1), F.floor(F.col("_m") / F.col("_n")).cast("int"))
    return sized.withColumn("copy", F.explode(copies)).drop("_n", "_m")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``rows / (classes * class rows)`` and the positive-class scale against the largest class."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = attach_row(n, n.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"), F.max("n").alias("_m")))
    return whole.select(label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"),
                        (F.col("_m") / F.col("n")).alias("scale_pos_weight"))
