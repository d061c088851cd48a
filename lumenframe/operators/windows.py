"""Ordered analytics: frames, islands, running bests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import safe_divide
from lumenframe.operators.scaling import hot_keys, join_nullsafe, neighbours, ranked, running, top_per_group, trailing


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``order`` names the newest-first sort, for example ``["-ts", "-id"]``."""
    return top_per_group(df, keys, order, 1)


def lag_lead(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int = 1) -> DataFrame:
    return neighbours(df, keys, order, {
        f"prev_{value}": lambda w: F.lag(value, n).over(w), f"next_{value}": lambda w: F.lead(value, n).over(w)}, n, n)


def rolling_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                 aggs: dict[str, Column], full_only: bool = False) -> DataFrame:
    """Aggregates over the last ``n`` rows; ``full_only`` gives null until ``n`` rows exist."""
    def over(c):
        def build(w):
            frame = w.rowsBetween(-(n - 1), 0)
            out = c.over(frame)
            return F.when(F.count(F.lit(1)).over(frame) == n, out) if full_only else out
        return build

    return neighbours(df, keys, order, {name: over(c) for name, c in aggs.items()}, before=n - 1)


def range_counts(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: str, prefix: str) -> DataFrame:
    """Count and sum over ``[ts - seconds, ts]`` per row."""
    us = seconds * 1_000_000
    return trailing(df, keys, ts, seconds, {
        f"{prefix}_n": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-us, 0)),
        f"{prefix}_sum": lambda w: F.sum(value).over(w.rangeBetween(-us, 0))})


def first_last_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """First, last and nth value of the whole partition on every row."""
    asc = top_per_group(df.select(*keys, *order, value), keys, order, n, "_rn")
    heads = asc.groupBy(*keys).agg(F.max(F.when(F.col("_rn") == 1, F.col(value))).alias("first"),
                                   F.max(F.when(F.col("_rn") == n, F.col(value))).alias("nth"))
    back = top_per_group(df.select(*keys, *order, value), keys, ["-" + c for c in order], 1).select(
        *keys, F.col(value).alias("last"))
    return join_nullsafe(join_nullsafe(df, heads, keys), back, keys)


def ratio_of_frames(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, short: int, long: int) -> DataFrame:
    """Mean of the last ``short`` rows over the mean of the last ``long`` rows."""
    two = neighbours(df, keys, order, {
        "_s": lambda w: F.avg(value).over(w.rowsBetween(-(short - 1), 0)),
        "_l": lambda w: F.avg(value).over(w.rowsBetween(-(long - 1), 0))}, before=long - 1)
    return two.withColumn("momentum", safe_divide(F.col("_s"), F.col("_l"))).drop("_s", "_l")


def distinct_trailing(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, value: str, out: str,
                      hot_rows: int | None = None) -> DataFrame:
    """Distinct values in ``[ts - seconds, ts]``.

    A value is new in the frame unless the same value occurred within the frame before; counting
    value changes needs no set per row: a row's value expires only if no later one replaces it.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    reach = seconds * 1_000_000
    seen = df.withColumn("_us", us).groupBy(*keys, value, "_us").agg(F.lit(1).alias("_one"))
    spans = neighbours(seen, [*keys, value], ["_us"], {"_next": lambda w: F.lead("_us").over(w)}, after=1, hot_rows=hot_rows)
    # a value is counted from its time until it expires or the next occurrence takes over
    end = F.least(F.col("_us") + reach, F.coalesce(F.col("_next") - 1, F.col("_us") + reach))
    changes = spans.select(*keys, F.explode(F.array(
        F.struct(F.col("_us").alias("at"), F.lit(1).alias("step")),
        F.struct((end + 1).alias("at"), F.lit(-1).alias("step")))).alias("c")).select(*keys, "c.at", "c.step")
    steps = changes.groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    level = running(steps, keys, ["at"], {out: ("sum", "step")}, hot_rows)
    want = df.withColumn("at", us)
    return join_nullsafe(want, level.select(*keys, "at", out), [*keys, "at"]).drop("at")


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: start, end and length of each run."""
    hot = hot_keys(df, keys) if keys else None
    marked = neighbours(df, keys, order, {"_prev": lambda w: F.lag(value).over(w),
                                          "_rn1": lambda w: F.lag(F.lit(1)).over(w)}, before=1, hot=hot)
    new = (F.col("_rn1").isNull() | ~F.col("_prev").eqNullSafe(F.col(value))).cast("int")
    runs = running(marked.withColumn("_new", new), keys, order, {"run": ("sum", "_new")}, hot=hot)
    return runs.groupBy(*keys, "run", value).agg(
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("length"))


def running_best(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str) -> DataFrame:
    """``keep`` where the score beats every earlier score (the first row keeps)."""
    best = running(df, keys, order, {"best_before": ("max", score, "before")})
    return best.withColumn("keep", F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))


def rank_columns(df: DataFrame, keys: Sequence[str], order: Sequence[str], deciles: int = 10) -> DataFrame:
    return ranked(df, keys, order, {"pct_rank": "percent_rank", "cume": "cume_dist", "decile": f"ntile:{deciles}"})


