"""Sessions, funnels, cohorts, RFM and business ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.scalars import month_index, safe_divide, seconds_between
from lumenframe.operators.aggregates import per_period, period_spine, reached_flags
from lumenframe.operators.scaling import attach_row, hot_keys, join_nullsafe, neighbours, quantile_values, running


def sessionize(events: DataFrame, user: str, ts: str, gap_seconds: int = 1800, tie: str | None = None,
               hot_rows: int | None = None) -> DataFrame:
    """``session_id`` per user; a gap longer than ``gap_seconds`` starts a new session."""
    order = [ts] + ([tie] if tie else [])
    hot = hot_keys(events, [user], hot_rows)  # counted once for both steps
    marked = neighbours(events, [user], order, {"_prev": lambda w: F.lag(ts).over(w)}, before=1, hot=hot)
    new = (F.col("_prev").isNull() | (seconds_between(F.col(ts), F.col("_prev")) > gap_seconds)).cast("int")
    return running(marked.withColumn("_new", new), [user], order, {"session_id": ("sum", "_new")}, hot=hot).drop("_prev", "_new")


def session_stats(sessions: DataFrame, user: str, ts: str, extra: Sequence[Column] = ()) -> DataFrame:
    s = sessions.groupBy(user, "session_id").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"), *extra)
    return s.withColumn("seconds", seconds_between(F.col("end"), F.col("start")))


def funnel(events: DataFrame, user: str, step_col: str, steps: Sequence[str]) -> DataFrame:
    """Users that reached each step (in any order), rate against the previous and the first step."""
    flags = reached_flags(events, user, step_col, steps)
    one = flags.agg(*[F.sum(s).alias(s) for s in steps])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("step"), F.col(s).alias("users"),
                              (F.col(steps[i - 1]) if i else F.lit(None).cast("bigint")).alias("previous"),
                              F.col(steps[0]).alias("first")) for i, s in enumerate(steps)])
    out = one.select(F.inline(rows))
    return out.select("position", "step", "users", safe_divide(F.col("users"), F.col("previous")).alias("step_rate"),
                      safe_divide(F.col("users"), F.col("first")).alias("overall_rate"))


def funnel_dropoff(funnel_table: DataFrame) -> DataFrame:
    """Users lost at each step and the share of the previous step."""
    w = Window.orderBy("position")  # one row per step
    lost = F.lag("users").over(w) - F.col("users")
    out = funnel_table.select("position", "step", "users", lost.alias("lost"), safe_divide(lost, F.lag("users").over(w)).alias("lost_share"))
    worst = out.agg(F.max("lost").alias("_ml"), F.max("lost_share").alias("_ms"))
    return attach_row(out, worst).select("position", "step", "users", "lost", "lost_share",
                                         F.coalesce(F.col("lost") == F.col("_ml"), F.lit(False)).alias("largest_loss"),
                                         F.coalesce(F.col("lost_share") == F.col("_ms"), F.lit(False)).alias("largest_share"))


def ordered_funnel(events: DataFrame, user: str, step_col: str, ts: str, steps: Sequence[str]) -> DataFrame:
    """Users that reached step k after the time they first reached step k-1."""
    state = events.where(F.col(step_col) == steps[0]).groupBy(user).agg(F.min(ts).alias("_t0"))
    for i, s in enumerate(steps[1:], start=1):
        at = events.where(F.col(step_col) == s).select(user, F.col(ts).alias("_t"))
        state = state.join(at, user, "left").groupBy(user, *[f"_t{j}" for j in range(i)]).agg(
            F.min(F.when(F.col("_t") > F.col(f"_t{i - 1}"), F.col("_t"))).alias(f"_t{i}"))
    one = state.agg(*[F.count(f"_t{i}").alias(f"_n{i}") for i in range(len(steps))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(s).alias("step"), F.col(f"_n{i}").alias("users"))
                                         for i, s in enumerate(steps)])))


def period_index(d: Column, freq: str) -> Column:
    """Whole number that grows by one per calendar period (D, W, M, Q, Y)."""
    if freq == "D":
        return F.datediff(d, F.lit("1970-01-01").cast("date"))
    if freq == "W":
        return F.floor((F.datediff(d, F.lit("1970-01-05").cast("date"))) / 7)
    if freq == "M":
        return month_index(d)
    if freq == "Q":
        return F.year(d) * 4 + F.quarter(d)
    return F.year(d)


TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def cohort_retention(events: DataFrame, user: str, date: str, freq: str = "M") -> DataFrame:
    """Distinct users and retention rate per first period and age in periods."""
    active = events.select(user, F.to_date(F.date_trunc(TRUNC[freq], date)).alias("period")).distinct()
    # a user has one row per calendar period here, a cohort one per age: both windows are small
    aged = active.withColumn("cohort", F.min("period").over(Window.partitionBy(user))).withColumn(
        "age", (period_index(F.col("period"), freq) - period_index(F.col("cohort"), freq)).cast("int"))
    cells = aged.groupBy("cohort", "age").agg(F.count("*").alias("users"))
    size = F.max(F.when(F.col("age") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return cells.select("cohort", "age", "users", F.round(F.col("users") / size, 3).alias("retention"))


def cohort_matrix(retention: DataFrame, ages: Sequence[int], value: str = "retention") -> DataFrame:
    return retention.groupBy("cohort").pivot("age", list(ages)).agg(F.max(value))


def quantile_score(x: Column, edges: Sequence[float], reverse: bool = False) -> Column:
    """1..k by right-closed quantile bins (k shrinks if edges collapse); reversed if small is good."""
    cuts = sorted(set(edges))
    k = max(len(cuts) - 1, 1)
    code = F.lit(1)
    for e in cuts[1:-1]:
        code = code + (x > F.lit(e)).cast("int")
    return F.lit(k + 1) - code if reverse else code


def rfm(facts: DataFrame, customer: str, date: str, value: str, n: int = 4) -> DataFrame:
    """Recency (days to the day after the last date), frequency, monetary and their scores."""
    per = facts.groupBy(customer).agg(F.max(F.to_date(date)).alias("_last"), F.count(date).alias("frequency"), F.sum(value).alias("monetary"))
    last = facts.agg(F.max(F.to_date(date))).first()[0]
    per = per.select(customer, (F.datediff(F.lit(last), "_last") + 1).alias("recency"), "frequency", "monetary")
    probs = [i / n for i in range(n + 1)]
    q = quantile_values(per, ["recency", "frequency", "monetary"], probs)
    scored = per.withColumns({"recency_score": quantile_score(F.col("recency"), q["recency"], True),
                              "frequency_score": quantile_score(F.col("frequency"), q["frequency"]),
                              "monetary_score": quantile_score(F.col("monetary"), q["monetary"])})
    return scored.withColumn("rfm_score", F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score"))


def monthly_kpis(facts: DataFrame, customer: str, date: str, value: str) -> DataFrame:
    """Revenue, customers, revenue per customer, growth, churn and retention per month."""
    month = F.to_date(F.date_trunc("month", date)).alias("month")
    per = facts.groupBy(customer, month).agg(F.sum(value).alias("v"))
    back = neighbours(per, [customer], ["month"], {"_next": lambda w: F.lead("month").over(w)}, after=1)
    kept = (F.col("_next") == F.add_months("month", 1)).cast("int")
    m = back.groupBy("month").agg(F.sum("v").alias("revenue"), F.count("*").alias("customers"), F.sum(kept).alias("kept"))
    m = period_spine(m, "month", "month")
    w = Window.orderBy("month")  # one row per month
    prev = F.lag("revenue").over(w)
    kept_n, base = F.coalesce(F.lag("kept").over(w), F.lit(0)), F.lag("customers").over(w)
    return m.select("month", "revenue", "customers", safe_divide(F.col("revenue"), F.col("customers")).alias("arpu"),
                    safe_divide(F.col("revenue") - prev, prev).alias("growth"), safe_divide(kept_n, base).alias("retention"),
                    (1 - safe_divide(kept_n, base)).alias("churn"))


def dau_mau(events: DataFrame, user: str, ts: str) -> DataFrame:
    """Mean daily users over monthly users."""
    seen = events.select(user, F.to_date(ts).alias("day")).distinct()
    daily = seen.groupBy("day").agg(F.count("*").alias("dau"))
    monthly = seen.select(user, F.to_date(F.date_trunc("month", "day")).alias("month")).distinct().groupBy("month").agg(F.count("*").alias("mau"))
    mean = daily.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.avg("dau").alias("dau"))
    return mean.join(monthly, "month").withColumn("stickiness", safe_divide(F.col("dau"), F.col("mau")))


def unit_economics(revenue: Column, customers: Column, margin: float, churn: Column, spend: Column, new: Column) -> dict[str, Column]:
    """Acquisition cost, lifetime value and their ratio."""
    cac = safe_divide(spend, new)
    ltv = safe_divide(safe_divide(revenue, customers) * F.lit(margin), churn)
    return {"cac": cac, "ltv": ltv, "ltv_cac": safe_divide(ltv, cac)}


def growing_entities(facts: DataFrame, key: str, ts: str, factor: float = 2.0, at_least: int = 10) -> DataFrame:
    """Entity months with at least ``factor`` times the previous calendar month's rows, from a base of ``at_least``."""
    m = facts.groupBy(key, F.to_date(F.date_trunc("month", ts)).alias("month")).agg(F.count("*").alias("n"))
    prev = neighbours(m, [key], ["month"], {"previous": lambda w: F.lag("n").over(w), "_pm": lambda w: F.lag("month").over(w)}, before=1)
    ok = (F.col("_pm") == F.add_months("month", -1)) & (F.col("previous") >= at_least) & (F.col("n") >= factor * F.col("previous"))
    return prev.where(ok).select(key, "month", "previous", "n")


def declining_entities(facts: DataFrame, key: str, ts: str, value: str, as_of: str, days: int = 30, drop: float = 0.2) -> DataFrame:
    """Entities whose last ``days`` are down by more than ``drop`` against the days before."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(ts))
    g = facts.where((age >= 0) & (age < 2 * days)).groupBy(key).agg(
        F.sum(F.when(age < days, F.col(value)).otherwise(0.0)).alias("recent"),
        F.sum(F.when(age >= days, F.col(value)).otherwise(0.0)).alias("previous"))
    return g.withColumn("change", safe_divide(F.col("recent") - F.col("previous"), F.col("previous"))).where(F.col("change") < -drop)


def drilldown(facts: DataFrame, dims: Sequence[str], in_first: Column, in_second: Column, value: str) -> DataFrame:
    """Change per segment between two periods and its share of the total change."""
    g = facts.groupBy(*dims).agg(F.sum(F.when(in_first, F.col(value)).otherwise(0.0)).alias("before"),
                                 F.sum(F.when(in_second, F.col(value)).otherwise(0.0)).alias("after")).withColumn(
        "change", F.col("after") - F.col("before"))
    return attach_row(g, g.agg(F.sum("change").alias("_t"))).withColumn("contribution", safe_divide(F.col("change"), F.col("_t"))).drop("_t")


def interarrival(facts: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Mean and sd of the days between an entity's rows."""
    g = neighbours(facts, [key], order, {"_d": lambda w: F.datediff(order[0], F.lag(order[0]).over(w))}, before=1)
    return g.groupBy(key).agg(F.count("_d").alias("gaps"), F.avg("_d").alias("mean_days"), F.stddev_samp("_d").alias("sd_days"))


def new_and_active(facts: DataFrame, key: str, ts: str, month: str, as_of: str, days: int = 30) -> DataFrame:
    """Entities first seen in ``month`` (yyyy-MM) and active in the last ``days``."""
    g = facts.groupBy(key).agg(F.min(F.to_date(ts)).alias("first"), F.max(F.to_date(ts)).alias("last"))
    return g.where((F.date_format("first", "yyyy-MM") == month) & (F.datediff(F.lit(as_of).cast("date"), "last") < days))


def boundary_report(facts: DataFrame, key: str, ts: str, freq: str, universe: DataFrame) -> DataFrame:
    """Per entity: periods without activity between its first and last period; entities without rows at all."""
    idx = period_index(F.to_date(ts), {"day": "D", "month": "M"}[freq])
    seen = facts.select(key, idx.alias("_p")).distinct()
    span = seen.groupBy(key).agg((F.max("_p") - F.min("_p") + 1 - F.count("*")).alias("empty_periods"), F.count("*").alias("active_periods"))
    return universe.select(key).distinct().join(span, key, "left").select(
        key, F.coalesce("active_periods", F.lit(0)).alias("active_periods"), F.coalesce("empty_periods", F.lit(0)).alias("empty_periods"),
        F.col("active_periods").isNull().alias("no_rows"))


def transition_matrix(events: DataFrame, user: str, order: Sequence[str], state: str) -> DataFrame:
    """Count and share of the next state given the state."""
    nxt = neighbours(events, [user], order, {"next_state": lambda w: F.lead(state).over(w)}, after=1)
    c = nxt.where(F.col("next_state").isNotNull()).groupBy(state, "next_state").agg(F.count("*").alias("n"))
    return join_nullsafe(c, c.groupBy(state).agg(F.sum("n").alias("_t")), [state]).select(
        state, "next_state", "n", (F.col("n") / F.col("_t")).alias("share"))


def users_per_period(events: DataFrame, user: str, ts: str, freq: str) -> DataFrame:
    return per_period(events, ts, freq, [F.count_distinct(user).alias("users")])
