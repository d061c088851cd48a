"""Joins beyond the built-in types, and checks around joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import safe_divide, seconds_between
from lumenframe.operators.pairs import Buckets, frequent_pairs
from lumenframe.operators.scaling import ranked, running

SMALL_ROWS = 200_000


def join_small(df: DataFrame, dim: DataFrame, on, how: str = "inner", max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``dim`` only if it is checked to have at most ``max_rows`` rows; else Spark decides."""
    small = dim.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(dim) if small else dim, on, how)


def with_date_spine(keys: DataFrame, start: str, end: str, out: str = "day", step: str = "1 day") -> DataFrame:
    """Every key with every date of the range, without a cross join."""
    dates = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step}"))
    return keys.select("*", F.explode(dates).alias(out))


def co_purchase(items: DataFrame, basket: str, item: str, min_support: int = 10, top: int | None = 100, settings: Buckets = Buckets()) -> DataFrame:
    """Item pairs bought together in at least ``min_support`` baskets: the ``top`` most frequent, or all if it is None."""
    best = frequent_pairs(items, basket, item, min_support, settings)
    return best if top is None else best.orderBy(F.desc("n"), "item_a", "item_b").limit(top)


def accumulate_to_snapshots(facts: DataFrame, key: str, ts: str, value: str, snapshots: Sequence[str]) -> DataFrame:
    """Totals up to and including each snapshot date, per key.

    Each fact counts from its first snapshot on, so facts are summed per (key, snapshot) before the
    running sum; the inequality join never happens.
    """
    dates = F.array(*[F.lit(s).cast("date") for s in sorted(snapshots)])
    first = F.array_min(F.filter(dates, lambda d: F.to_date(F.col(ts)) <= d))
    sums = facts.withColumn("snapshot", first).groupBy(key, "snapshot").agg(
        F.count("*").alias("_n"), F.sum(value).alias("_v"))
    spine = facts.select(key).distinct().select(key, F.explode(dates).alias("snapshot"))
    whole = spine.join(sums, [key, "snapshot"], "left")
    return running(whole, [key], ["snapshot"], {"n": ("sum", "_n"), "total": ("sum", "_v")}).select(
        key, "snapshot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def count_explosion(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows before and after an inner join on ``key``, from key counts; the join is not built."""
    ca = a.groupBy(key).agg(F.count("*").alias("na"))
    cb = b.groupBy(key).agg(F.count("*").alias("nb"))
    both = ca.join(cb, key, "full").agg(
        F.sum("na").alias("rows_before"),
        F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("rows_after"))
    return both.select("rows_before", "rows_after",
                       F.round(safe_divide(F.col("rows_after"), F.col("rows_before")), 4).alias("factor"),
                       (F.col("rows_after") > F.col("rows_before")).alias("explodes"))


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_ts: str, columns: Sequence[str],
              tolerance_seconds: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Latest right row of the same key with ``right_ts <= ts``; nothing from the future.

    Both sides share one time line; the last right row before each left row is carried along.
    """
    payload = F.struct(F.col(right_ts).alias("_rts"), *columns)
    r = right.where(F.col(right_ts).isNotNull()).select(F.col(key), F.col(right_ts).alias(ts), F.lit(0).alias("_side"), payload.alias("_hit"))
    line = left.withColumn("_side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    carried = running(line, [key], [ts, "_side"], {"_last": ("last", "_hit")}, hot_rows)
    ok = F.col("_last").isNotNull()
    if tolerance_seconds is not None:
        ok = ok & (seconds_between(F.col(ts), F.col("_last._rts")) <= tolerance_seconds)
    return carried.where(F.col("_side") == 1).select(
        *left.columns, *[F.when(ok, F.col(f"_last.{c}")).alias(c) for c in columns])


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = " ",
                   part_rows: int = 1_000) -> DataFrame:
    """Texts of a group joined in order; a long group gives several parts instead of one huge cell."""
    numbered = ranked(df, keys, order, {"_rn": "row_number"})
    part = F.floor((F.col("_rn") - 1) / part_rows).cast("int")
    listed = numbered.withColumn("part", part).groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_rn", F.col(text).alias("_t")))).alias("_l"))
    return listed.select(*keys, "part", F.array_join("_l._t", sep).alias("text"))


def into_intervals(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, title: str) -> DataFrame:
    """Each point with the interval it falls in: ``start <= at < next start``; the last one is open."""
    marks = starts.select(key, F.col(start).alias("_start"), F.col(title).alias("_title"))
    return asof_join(points, marks, key, at, "_start", ["_title"]).withColumnRenamed("_title", title)


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a parent row, with their row counts."""
    missing = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return missing.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def coverage(expected: DataFrame, actual: DataFrame, key: str, minimum: float = 0.95) -> DataFrame:
    """Share of expected keys that are present."""
    e = expected.select(key).distinct()
    a = actual.select(key).distinct().withColumn("_hit", F.lit(1))
    c = e.join(a, key, "left").agg(F.count("*").alias("expected"), F.count("_hit").alias("covered"))
    share = safe_divide(F.col("covered"), F.col("expected"))
    return c.select("expected", "covered", F.round(share, 4).alias("share"), (share >= minimum).alias("passed"))


def merge_group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group mean, sd, min and max on every row, and the distance from the mean; a null group has none."""
    p = f"{group}_{value}"
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(value).alias(f"{p}_mean"), F.stddev_samp(value).alias(f"{p}_std"),
        F.min(value).alias(f"{p}_min"), F.max(value).alias(f"{p}_max"))
    return df.join(stats, group, "left").withColumn(f"{value}_dev_from_{group}", F.col(value) - F.col(f"{p}_mean"))


def merge_views(batch: DataFrame, speed: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Totals of the finished batch view plus the recent view."""
    return batch.unionByName(speed).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


