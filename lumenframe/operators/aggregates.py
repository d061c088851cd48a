"""Grouped summaries, frequency tables and chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.scalars import pearson_r, safe_divide
from lumenframe.operators.scaling import attach_row, exact_quantiles, join_nullsafe, quantile_values, top_per_group


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def group_summary(df: DataFrame, group: str, value: str, digits: int = 2) -> DataFrame:
    """count, mean, median, total, sd per group; null groups are left out."""
    d = df.where(F.col(group).isNotNull())
    s = d.groupBy(group).agg(F.count(value).alias("count"), F.avg(value).alias("mean"),
                             F.sum(value).alias("total"), F.stddev_samp(value).alias("std"))
    m = exact_quantiles(d, [value], [0.5], [group]).select(group, F.col(value)[0].alias("median"))
    return s.join(m, group).select(group, "count", *[F.round(c, digits).alias(c) for c in ("mean", "median", "total", "std")])


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, min, quartiles, max."""
    cols = list(cols or numeric_columns(df))
    q = quantile_values(df, cols, [0.25, 0.5, 0.75])
    one = df.agg(*[F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s"),
                              F.lit(q[c][0]).cast("double").alias("q25"), F.lit(q[c][1]).cast("double").alias("q50"),
                              F.lit(q[c][2]).cast("double").alias("q75")) for c in cols])
    return one.select(F.inline(rows)).select("column", "s.*", "q25", "q50", "q75")


def skew_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns whose mean and median differ by more than a tenth of the mean."""
    q = quantile_values(df, cols, [0.5])
    one = df.agg(*[F.avg(c).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean"), F.lit(q[c][0]).cast("double").alias("median"))
                     for c in cols])
    return one.select(F.inline(rows)).withColumn(
        "skewed", F.abs(F.col("mean") - F.col("median")) > 0.1 * F.abs("mean"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each non-null value."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_all"))
    return attach_row(c, total).select(col, "n", (F.col("n") / F.col("_all")).alias("share"))


def mode_per_group(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Most frequent value, the smallest on ties; counted per value first."""
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("n"), F.col(col))).alias("mode"), F.max("n").alias("n"))


def labelled_rollup(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column], cube: bool = False) -> DataFrame:
    """Subtotals with the label ALL; a real null stays null."""
    grouped = df.cube(*dims) if cube else df.rollup(*dims)
    out = grouped.agg(*aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    return out.select(*[F.when(F.col(f"_g_{d}") == 1, "ALL").otherwise(F.col(d).cast("string")).alias(d) for d in dims],
                      *[c for c in out.columns if c not in dims and not c.startswith("_g_")])


def pivot_sum(df: DataFrame, index: str, col: str, values: Sequence, value: str, fill=0) -> DataFrame:
    return df.groupBy(index).pivot(col, list(values)).agg(F.sum(value)).fillna(fill)


def reached_flags(df: DataFrame, key: str, col: str, steps: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max((F.col(col) == s).cast("int")).alias(s) for s in steps])


def top_items_array(df: DataFrame, key: str, value: str, item: str, n: int = 10) -> DataFrame:
    """The ``n`` best items per key as an ordered array of structs."""
    best = top_per_group(df, [key], ["-" + value, item], n, "rank")
    arr = F.array_sort(F.collect_list(F.struct("rank", item, value)))  # at most n per key
    return best.groupBy(key).agg(F.transform(arr, lambda s: F.struct(s[item].alias(item), s[value].alias(value))).alias("top"))


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair (upper triangle), all in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[pearson_r(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], limit: float = 0.7) -> DataFrame:
    return corr_pairs(df, cols).where(F.abs("r") > limit)


def first_last_change(df: DataFrame, order: str, value: str) -> DataFrame:
    """First and last value by ``order`` and the change in percent (0 if the first is 0)."""
    s = df.agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return s.withColumn("change_pct", F.coalesce(
        F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, F.lit(0.0)))


def top_entities(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """All rows of the ``n`` entities with the largest totals."""
    best = df.groupBy(key).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), key).limit(n).select(key)
    return df.join(best, key, "left_semi")


def sign_flip(df: DataFrame, metric: str, group: str, a, b, segment: str) -> DataFrame:
    """Overall and per-segment sign of mean(a) - mean(b); ``flips`` marks segments against the whole."""
    part = df.where(F.col(group).isin(a, b)).groupBy(segment).agg(
        *[F.sum(F.when(F.col(group) == g, F.col(metric))).alias(f"s_{i}") for i, g in enumerate((a, b))],
        *[F.count(F.when(F.col(group) == g, F.col(metric))).alias(f"n_{i}") for i, g in enumerate((a, b))])
    total = part.agg(*[F.sum(f"{k}_{i}").alias(f"t{k}_{i}") for k in "sn" for i in (0, 1)])
    diff = safe_divide(F.col("s_0"), F.col("n_0")) - safe_divide(F.col("s_1"), F.col("n_1"))
    whole = safe_divide(F.col("ts_0"), F.col("tn_0")) - safe_divide(F.col("ts_1"), F.col("tn_1"))
    return attach_row(part, total).select(segment, diff.alias("diff"), whole.alias("overall"),
                                          (F.signum(diff) != F.signum(whole)).alias("flips"))


def average_of_averages(df: DataFrame, group: str, value: str) -> DataFrame:
    """Weighted mean next to the mean of group means."""
    g = df.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.agg((F.sum("s") / F.sum("n")).alias("weighted"), F.avg(safe_divide(F.col("s"), F.col("n"))).alias("of_averages"))


# Name parts that mark a pre-computed average.
AVERAGE_NAMES = ("avg", "average", "mean")


def average_like_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(a in c.lower() for a in AVERAGE_NAMES)]


def subtotals_reconcile(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Does the sum over the parts equal the whole?"""
    r = df.rollup(dim).agg(F.sum(value).alias("s"), F.grouping(dim).alias("g"))
    return r.agg(F.sum(F.when(F.col("g") == 0, F.col("s"))).alias("parts"),
                 F.sum(F.when(F.col("g") == 1, F.col("s"))).alias("whole")).withColumn(
        "reconciles", F.abs(F.col("parts") - F.col("whole")) <= 1e-9 * F.abs("whole"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins from min to max, the maximum in the last bin; empty bins have 0."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    width = (hi - lo) / bins
    at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    counts = df.where(F.col(col).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def mean_with_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean per group with a normal 95% interval, as a bar chart shows."""
    s = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    half = F.lit(1.96) * F.col("sd") / F.sqrt("n")
    return s.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, number of outliers."""
    q = exact_quantiles(df, [value], [0.25, 0.5, 0.75], [by]).select(
        by, F.col(value)[0].alias("q1"), F.col(value)[1].alias("median"), F.col(value)[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return join_nullsafe(df, q, [by]).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"),
        F.count_if(~inside).alias("outliers"))


def fit_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                               pearson_r(F.col(x), F.col(y)).alias("r"))


def top_k_other(df: DataFrame, col: str, value: str, k: int = 7) -> DataFrame:
    """Totals of the ``k`` largest categories and one row Other for the rest."""
    totals = df.groupBy(col).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    best = totals.orderBy(F.desc("total"), col).limit(k).select(col, F.lit(True).alias("_top"))
    return (join_nullsafe(totals, best, [col]).withColumn(col, F.when(F.col("_top"), F.col(col)).otherwise("Other"))
            .groupBy(col).agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def per_period(df: DataFrame, ts: str, freq: str, aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(F.to_date(F.date_trunc(freq, ts)).alias("period")).agg(*aggs)


def period_spine(periods: DataFrame, freq: str, col: str = "period") -> DataFrame:
    """All periods from the first to the last, gaps filled with nulls."""
    ends = periods.agg(F.min(col).alias("a"), F.max(col).alias("b"))
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {freq}"))).alias(col))
    return spine.join(periods, col, "left")


def period_over_period(df: DataFrame, ts: str, value: str, freq: str = "month", back: int = 1) -> DataFrame:
    """Total per period and its change against ``back`` periods earlier; a missing period gives null."""
    spine = period_spine(per_period(df, ts, freq, [F.sum(value).alias("total")]), freq)
    w = Window.orderBy("period")  # one row per calendar period
    prev = F.lag("total", back).over(w)
    return spine.select("period", "total", prev.alias("previous"), safe_divide(F.col("total") - prev, prev).alias("growth"))


def dominant_values(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """Most frequent values with their share of all rows."""
    return value_counts(df, col).orderBy(F.desc("n"), col).limit(k)
