"""Idempotent writes, versions, experiment logs. Targets are parquet folders; every write makes new files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.scalars import safe_divide
from lumenframe.operators.scaling import attach_row, neighbours, ranked, running, top_per_group
from lumenframe.operators.windows import running_best
from lumenframe.sources.keyed_table import FILE_ROWS, KeyedTable


def overwrite_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``; running it twice gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def version_path(root: str, version: int) -> str:
    return f"{root}/v={version:06d}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions, found by their success marks."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    out = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
        if name.startswith("v=") and fs.exists(mark):
            out.append(int(name[2:]))
    return sorted(out)


def write_version(df: DataFrame, root: str) -> int:
    known = versions(df.sparkSession, root)
    v = (known[-1] + 1) if known else 1
    df.write.mode("overwrite").parquet(version_path(root, v))
    return v


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Latest or given version."""
    return spark.read.parquet(version_path(root, version if version is not None else versions(spark, root)[-1]))


def merge_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key; the newest source row wins."""
    newest = top_per_group(source, keys, order, 1)
    return target.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def incremental(spark: SparkSession, root: str, source: DataFrame, keys: Sequence[str], ts: str, lookback: str = "3 days", order: Sequence[str] = (), file_rows: int = FILE_ROWS) -> KeyedTable:
    """Merge source rows newer than the high-water mark minus the lookback into the keyed table at ``root``; the first run takes all.

    The mark comes from the table's manifest, and only files that hold a key of those rows are rewritten.
    """
    table = KeyedTable(spark, root, keys, ts, file_rows)
    listed = table.manifest()
    if listed is not None:
        high = listed.agg(F.max("mark").alias("_high"))
        source = attach_row(source, high).where(F.col(ts) >= F.col("_high") - F.expr(f"interval {lookback}")).drop("_high")
    table.merge(source, [*order, "-" + ts])
    return table


def backfill(days: Sequence[str], build: Callable[[str], DataFrame], path: str, partition: str) -> None:
    """Rebuild one partition per date; each date can be run again on its own."""
    for day in days:
        overwrite_partition(build(day).withColumn(partition, F.lit(day)), path, partition)


def materialize(df: DataFrame, how: str, name: str, root: str, keys: Sequence[str] = (), ts: str | None = None) -> DataFrame:
    """view, table, incremental or ephemeral."""
    spark = df.sparkSession
    if how == "ephemeral":
        return df
    if how == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if how == "table":
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")
    if how == "incremental":
        return incremental(spark, f"{root}/{name}", df, keys, ts).read()
    raise ValueError(how)


class ModelGraph:
    """Named table functions and what they read: ``add(name, fn, refs)``."""

    def __init__(self):
        self.models: dict[str, tuple[Callable, tuple[str, ...]]] = {}

    def add(self, name: str, fn: Callable[..., DataFrame], refs: Sequence[str] = ()) -> ModelGraph:
        self.models[name] = (fn, tuple(refs))
        return self

    def order(self) -> list[str]:
        return [m for m in TopologicalSorter({n: r for n, (_, r) in self.models.items()}).static_order() if m in self.models]

    def downstream(self, name: str) -> list[str]:
        hit = {name}
        for m in self.order():
            if hit & set(self.models[m][1]):
                hit.add(m)
        return [m for m in self.order() if m in hit]

    def build(self, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = dict(sources)
        for m in self.order():
            fn, refs = self.models[m]
            out[m] = fn(*[out[r] for r in refs])
        return out


def scd2(changes: DataFrame, key: str, ts: str, tracked: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Validity periods of the tracked columns; repeated equal states are one period, the last one is open."""
    state = F.struct(*tracked)
    marked = neighbours(changes.withColumn("_s", state), [key], [ts, *tie], {"_p": lambda w: F.lag("_s").over(w)}, before=1)
    starts = marked.where(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(F.col("_s")))
    closed = neighbours(starts, [key], [ts, *tie], {"valid_to": lambda w: F.lead(ts).over(w)}, after=1)
    return closed.select(key, *tracked, F.col(ts).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("is_current"))


def valid_at(periods: DataFrame, ts: Column) -> DataFrame:
    return periods.where((F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)))


# Scores where less is better.
LOWER_IS_BETTER = ("val_bpb", "loss", "rmse", "mae", "mse")


def results_summary(log: DataFrame, metric: str = "val_score") -> DataFrame:
    """Runs by status, baseline and best kept score, improvement, best run."""
    low = metric in LOWER_IS_BETTER
    status, s = F.upper("status"), F.col(metric)
    ok = (status == "KEEP") & (s > 0)
    worst, best = (F.max, F.min) if low else (F.min, F.max)
    pick = F.min_by if low else F.max_by
    g = log.agg(F.count("*").alias("total"), *[F.count_if(status == x).alias(x.lower()) for x in ("KEEP", "DISCARD", "CRASH")],
                worst(F.when(ok, s)).alias("baseline"), best(F.when(ok, s)).alias("best"), pick("id", F.when(ok, F.struct(s, F.col("id")))).alias("best_id"))
    return g.withColumn("improvement", F.abs(F.col("best") - F.col("baseline")))


def top_runs(log: DataFrame, metric: str = "val_score", n: int = 5) -> DataFrame:
    s = F.col(metric)
    order = s.asc() if metric in LOWER_IS_BETTER else s.desc()
    return log.where((F.upper("status") == "KEEP") & (s > 0)).orderBy(order, "id").limit(n)


def keep_discard(log: DataFrame, keys: Sequence[str], order: Sequence[str], score: str) -> DataFrame:
    """CRASH on null or NaN; KEEP if the score beats every earlier one; else DISCARD."""
    clean = log.withColumn("_v", F.when(~F.isnan(score), F.col(score)))
    b = running_best(clean, keys, order, "_v")
    return b.withColumn("decision", F.when(F.col("_v").isNull(), "CRASH").when(F.col("keep"), "KEEP").otherwise("DISCARD")).drop("_v", "keep", "best_before")


def stopping_rule(log: DataFrame, keys: Sequence[str], order: Sequence[str], score: str, decision: str = "decision") -> DataFrame:
    """Per run: three discards in a row, less than 0.1% over the last three kept, less than 0.05% per step over five."""
    d = neighbours(log, keys, order, {"_d": lambda w: F.sum((F.col(decision) == "DISCARD").cast("int")).over(w.rowsBetween(-2, 0)),
                                      "_first": lambda w: F.lag(score, 4).over(w), "_max": lambda w: F.max(score).over(w.rowsBetween(-4, 0))}, before=4)
    kept = neighbours(log.where(F.col(decision) == "KEEP"), keys, order, {"_k2": lambda w: F.lag(score, 2).over(w)}, before=2).select(
        *keys, *order, safe_divide(F.col(score) - F.col("_k2"), F.col("_k2")).alias("_gain3"))
    j = d.join(kept, [*keys, *order], "left")
    small5 = safe_divide(F.col("_max") - F.col("_first"), F.col("_first")) < 0.0005 * 5
    reason = (F.when(F.col("_d") == 3, "three_discards").when(F.coalesce(F.col("_gain3") < 0.001, F.lit(False)), "flat_keeps")
              .when(F.coalesce(small5, F.lit(False)), "flat_window"))
    return j.select(*log.columns, reason.alias("stop_reason"))


def stage_promotion(runs: DataFrame, model: str, version: str, score: str, passed: Column) -> DataFrame:
    """Best run that passed is production (one per model), the next staging, other passed runs archived."""
    r = ranked(runs.where(passed), [model], ["-" + score, version], {"_rn": "row_number"})
    stage = F.when(F.col("_rn") == 1, "production").when(F.col("_rn") == 2, "staging").otherwise("archived")
    rest = runs.where(~F.coalesce(passed, F.lit(False))).withColumn("stage", F.lit("registered"))
    return r.withColumn("stage", stage).drop("_rn").unionByName(rest)


def cost_rollup(usage: DataFrame, by: str, tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> DataFrame:
    """Token cost per group, per row and per 1000 rows."""
    cost = tokens_in * price_in / 1e6 + tokens_out * price_out / 1e6
    g = usage.groupBy(by).agg(F.count("*").alias("n"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.sum(cost).alias("cost"))
    return g.withColumns({"per_row": safe_divide(F.col("cost"), F.col("n")), "per_1000": safe_divide(F.col("cost"), F.col("n")) * 1000})


def cumulative_cost(usage: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str) -> DataFrame:
    return running(usage, keys, order, {"spent": ("sum", cost)})
