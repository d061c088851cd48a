"""The user-function surface: Arrow functions, mergeable aggregates, feature definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar(fn: Callable[[pd.Series], pd.Series], returns: str):
    """Arrow-batched scalar function."""
    return F.pandas_udf(fn, returnType=returns)


def custom_aggregate(df: DataFrame, by: Sequence[str], columns: Sequence[str], partial: Callable[[pd.DataFrame], dict],
                     merge: Callable[[pd.DataFrame], dict], finish: Callable[[pd.DataFrame], dict], state: str, result: str,
                     salts: int = 64) -> DataFrame:
    """A user aggregate that never sees a whole group.

    ``partial`` turns a batch of one group into a state row, ``merge`` turns state rows into one, ``finish``
    a state row into the result. States are merged in salted steps, then per group.
    """
    by = list(by)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    states = f"{kinds}, {state}" if by else state

    def each_group(pdf, fn):
        if not by:
            return pd.DataFrame([fn(pdf)])
        rows = []
        for key, part in pdf.groupby(by, dropna=False, sort=False):
            named = {c: None if pd.isna(k) else k for c, k in zip(by, key)}
            rows.append({**named, **fn(part)})
        return pd.DataFrame(rows)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if len(pdf):
                got = each_group(pdf, partial)
                held = got if held is None else each_group(pd.concat([held, got]), merge)
        if held is not None:
            yield held

    parts = df.select(*by, *[c for c in columns if c not in by]).mapInPandas(local, states)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in parts.columns]), F.lit(salts)))
    some = salted.groupBy(*by, "_salt").applyInPandas(lambda pdf: each_group(pdf.drop(columns="_salt"), merge), states)
    out = f"{kinds}, {result}" if by else result
    return some.groupBy(*by).applyInPandas(lambda pdf: each_group(each_group(pdf, merge), finish), out)


def rolling_macros(fn: Callable[[Column], Column], column: str, sizes: Sequence[int], prefix: str) -> dict[str, Callable]:
    """One aggregate over several row windows, as named expressions for ``neighbours``."""
    return {f"{prefix}_{n}": (lambda w, n=n: fn(F.col(column)).over(w.rowsBetween(-(n - 1), 0))) for n in sizes}


@dataclass(frozen=True)
class Feature:
    name: str
    build: Callable[[DataFrame], DataFrame]
    owner: str
    description: str
    fresh_hours: int


class FeatureBook:
    """Named feature definitions with owner and freshness; ``compute`` joins the chosen ones on the key."""

    def __init__(self, key: str):
        self.key, self.features = key, {}

    def feature(self, name: str, owner: str, description: str, fresh_hours: int = 24):
        def register(fn):
            if name in self.features:
                raise ValueError(f"feature {name} exists")
            self.features[name] = Feature(name, fn, owner, description, fresh_hours)
            return fn
        return register

    def listing(self, spark) -> DataFrame:
        rows = [(f.name, f.owner, f.description, f.fresh_hours) for f in self.features.values()]
        return spark.createDataFrame(rows, "feature string, owner string, description string, fresh_hours int")

    def compute(self, facts: DataFrame, names: Sequence[str]) -> DataFrame:
        out = None
        for n in names:
            got = self.features[n].build(facts).select(self.key, n)
            out = got if out is None else out.join(got, self.key, "full")
        return out
