"""Series operators. A series is first reduced to one row per period (and key), which bounds every window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import safe_divide
from lumenframe.operators.aggregates import fit_line
from lumenframe.operators.scaling import attach_row, neighbours, ranked


def daily_series(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.sum(value).alias("v"))


def centered_average(series: DataFrame, order: str, value: str, window: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over a full centred window; an even window reaches one row further back."""
    back, ahead = window // 2, (window - 1) // 2

    def build(w):
        frame = w.rowsBetween(-back, ahead)
        return F.when(F.count(value).over(frame) == window, F.avg(value).over(frame))

    return neighbours(series, keys, [order], {"moving_average": build}, before=back, after=ahead)


def pct_change(series: DataFrame, order: str, value: str, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    def build(w):
        prev = F.lag(value, periods).over(w)
        return safe_divide(F.col(value) - prev, prev) * 100

    return neighbours(series, keys, [order], {"pct_change": build}, before=periods)


def seasonal_decompose(series: DataFrame, order: str, value: str, period: int) -> DataFrame:
    """Additive trend (centred average, half end weights if even), seasonal part by phase, residual."""
    if series.count() < 2 * period:
        raise ValueError("need at least two full periods")
    half = period // 2

    def trend(w):
        frame = w.rowsBetween(-half, half)
        full = F.count(value).over(frame) == 2 * half + 1
        if period % 2:
            return F.when(full, F.avg(value).over(frame))
        inner = F.sum(value).over(w.rowsBetween(-half + 1, half - 1))
        ends = (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
        return F.when(full, (inner + ends) / period)

    t = neighbours(series, [], [order], {"trend": trend}, before=half, after=half)
    t = ranked(t, [], [order], {"_rn": "row_number"}).withColumn("phase", (F.col("_rn") - 1) % period)
    by_phase = t.groupBy("phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    centred = attach_row(by_phase, by_phase.agg(F.avg("_s").alias("_m"))).select("phase", (F.col("_s") - F.col("_m")).alias("seasonal"))
    return t.join(centred, "phase").withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_rn")


def forecast(series: DataFrame, order: str, value: str, horizon: int, season: int, window: int) -> DataFrame:
    """Naive, seasonal naive, linear trend and moving average for the next ``horizon`` days, with a 95% range
    from each method's one-step (or fit) residuals."""
    lagged = neighbours(series, [], [order], {
        "_naive": lambda w: F.lag(value, 1).over(w), "_season": lambda w: F.lag(value, season).over(w),
        "_avg": lambda w: F.avg(value).over(w.rowsBetween(-window, -1))}, before=max(season, window))
    x = F.datediff(F.col(order), F.lit("1970-01-01").cast("date"))
    xs = lagged.withColumn("_x", x.cast("double"))
    line = fit_line(xs, "_x", value).first()
    last = xs.agg(F.max(order).alias("end"), F.max_by(value, order).alias("v"),
                  F.stddev_samp(F.col(value) - F.col("_naive")).alias("sd_naive"), F.stddev_samp(F.col(value) - F.col("_season")).alias("sd_seasonal"),
                  F.stddev_samp(F.col(value) - F.col("_avg")).alias("sd_average"),
                  F.stddev_samp(F.col(value) - (F.lit(line["slope"]) * F.col("_x") + F.lit(line["intercept"]))).alias("sd_trend")).first()
    tail = series.orderBy(F.desc(order)).limit(max(season, window)).select(F.col(value).alias("v")).collect()  # the last few periods
    recent = [r["v"] for r in tail]
    mean = sum(recent[:window]) / len(recent[:window])
    cycle = list(reversed(recent[:season]))
    steps = series.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("step"))
    day = F.date_add(F.lit(last["end"]), F.col("step"))
    trend = F.lit(line["slope"]) * F.datediff(day, F.lit("1970-01-01").cast("date")) + F.lit(line["intercept"])
    values = F.array(*[F.lit(float(v)) for v in cycle])
    methods = [("naive", F.lit(last["v"]), "sd_naive"), ("seasonal_naive", values[(F.col("step") - 1) % season], "sd_seasonal"),
               ("linear_trend", trend, "sd_trend"), ("moving_average", F.lit(mean), "sd_average")]
    rows = F.array(*[F.struct(F.lit(n).alias("method"), v.cast("double").alias("forecast"),
                              (v - 1.96 * (last[s] or 0.0)).cast("double").alias("low"), (v + 1.96 * (last[s] or 0.0)).cast("double").alias("high"))
                     for n, v, s in methods])
    return steps.select("step", day.alias("day"), F.inline(rows))


def year_over_year(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Monthly total next to the same month one year earlier and the mean of that calendar month."""
    m = df.groupBy(F.to_date(F.date_trunc("month", ts)).alias("month")).agg(F.sum(value).alias("total"))
    prior = m.select(F.add_months("month", 12).alias("month"), F.col("total").alias("last_year"))
    base = m.groupBy(F.month("month").alias("_m")).agg(F.avg("total").alias("seasonal_mean"))
    j = m.join(prior, "month", "left").withColumn("_m", F.month("month")).join(base, "_m")
    return j.select("month", "total", "last_year", safe_divide(F.col("total") - F.col("last_year"), F.col("last_year")).alias("yoy"),
                    safe_divide(F.col("total"), F.col("seasonal_mean")).alias("vs_season"))


def lag_features(series: DataFrame, order: str, value: str, lags: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    return neighbours(series, keys, [order], {f"lag_{n}": (lambda w, n=n: F.lag(value, n).over(w)) for n in lags}, before=max(lags))


def entity_trend(df: DataFrame, key: str, ts: str, value: str | Column) -> DataFrame:
    """Least-squares slope per entity and day."""
    x = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    return fit_line(df.withColumn("_x", x), "_x", value, [key]).select(key, "slope")


def on_spine(series: DataFrame, day: str, value: str) -> DataFrame:
    """Missing days filled with 0."""
    ends = series.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias(day)).join(series, day, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


