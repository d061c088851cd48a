"""Profiling and data-quality checks; all per-column figures of a table come from one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.scalars import parsed_datetime, pearson_r, safe_divide
from lumenframe.operators.aggregates import numeric_columns, per_period, period_spine
from lumenframe.operators.scaling import attach_row

# Suspicious placeholders.
SENTINELS = (0, -1, 999, 9999, 99999)
PLACEHOLDERS = ("n/a", "tbd", "test", "xxx", "unknown", "null", "none")
NON_NEGATIVE_NAMES = ("revenue", "price", "cost", "amount", "quantity", "count", "age")
RATE_NAMES = ("pct", "rate", "percent")
DATE_NAMES = ("date", "time", "created", "updated")
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_report(df: DataFrame, cols: Sequence[str], stats: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row per column with the given aggregates, computed in a single pass; ``n_rows`` is added."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.struct(*[fn(c).alias(s) for s, fn in stats.items()]).alias(f"_c{i}") for i, c in enumerate(cols)]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"),
                              *[F.col(f"_c{i}.{s}").alias(s) for s in stats]) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.inline(rows))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and the number of columns per type."""
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    text = ", ".join(f"{k}:{n}" for k, n in sorted(kinds.items()))
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(text).alias("types"))


def _nulls(c: str) -> Column:
    return F.count_if(F.col(c).isNull())


def classify_columns(df: DataFrame, unique_words: int = 50, long_text: float = 20) -> DataFrame:
    """numeric, datetime, text or categorical; a string column is datetime if every value parses."""
    texts, out = string_columns(df), []
    stats = {
        "distinct": lambda c: F.approx_count_distinct(c, 0.01),
        "mean_len": lambda c: F.avg(F.length(c)),
        "unparsed": lambda c: F.count_if(F.col(c).isNotNull() & parsed_datetime(F.col(c), DATE_FORMATS).isNull()),
        "filled": lambda c: F.count(c),
    }
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out.append((f.name, "numeric"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append((f.name, "datetime"))
        elif f.name not in texts:
            out.append((f.name, "categorical"))
    spark = df.sparkSession
    known = spark.createDataFrame(out, "column string, kind string")
    if not texts:
        return known
    kind = (F.when((F.col("unparsed") == 0) & (F.col("filled") > 0), "datetime")
            .when((F.col("distinct") > unique_words) & (F.col("mean_len") > long_text), "text").otherwise("categorical"))
    return known.unionByName(column_report(df, texts, stats).select("column", kind.alias("kind")))


def missing_report(df: DataFrame) -> DataFrame:
    r = column_report(df, df.columns, {"missing": _nulls}).where(F.col("missing") > 0)
    return r.select("column", "missing", F.round(100 * F.col("missing") / F.col("n_rows"), 2).alias("percent")).orderBy(
        F.desc("missing"), "column")


def completeness_grade(df: DataFrame) -> DataFrame:
    r = column_report(df, df.columns, {"missing": _nulls})
    pct = 100 * (1 - F.col("missing") / F.col("n_rows"))
    grade = F.when(pct > 99, "GREEN").when(pct >= 95, "YELLOW").when(pct >= 80, "ORANGE").otherwise("RED")
    return r.where(F.col("missing") > 0).select("column", F.round(pct, 1).alias("percent"), grade.alias("grade"))


def numeric_flags(df: DataFrame) -> DataFrame:
    r = column_report(df, numeric_columns(df), {"zeros": lambda c: F.count_if(F.col(c) == 0),
                                                "negatives": lambda c: F.count_if(F.col(c) < 0)})
    return r.select("column", (F.col("zeros") > 0.5 * F.col("n_rows")).alias("mostly_zero"), (F.col("negatives") > 0).alias("has_negative"))


def long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, most frequent value and cardinality flags; values are counted before any grouping by column."""
    cols = list(cols or string_columns(df))
    counts = long_form(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))
    filled = F.col("value").isNotNull()
    r = counts.groupBy("column").agg(
        F.count("value").alias("n_unique"), F.sum("n").alias("n_rows"),
        F.min_by("value", F.when(filled, F.struct(-F.col("n"), F.col("value")))).alias("top"))
    return r.select("column", "n_unique", "top", (F.col("n_unique") > 50).alias("high_cardinality"),
                    (F.col("n_unique") == F.col("n_rows")).alias("likely_id"))


def target_classes(df: DataFrame, target: str) -> DataFrame:
    n = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("_t")
    w = attach_row(n, n.agg(F.sum("n").alias("_t"), F.min("n").alias("_m")))
    return w.select(target, F.round(share, 3).alias("share"), (F.col("_m") / F.col("_t") < 0.1).alias("imbalanced"))


def target_numeric(df: DataFrame, target: str) -> DataFrame:
    return df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"))


def imbalance_ratio(df: DataFrame, target: str, limit: float = 10) -> DataFrame:
    n = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.min("n")).alias("ratio")).withColumn("extreme", F.col("ratio") > limit)


def duplicate_rows(df: DataFrame) -> DataFrame:
    g = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    s = g.agg(F.sum("_n").alias("n_rows"), (F.sum("_n") - F.count("*")).alias("duplicates"))
    return s.select("duplicates", F.round(100 * safe_divide(F.col("duplicates"), F.col("n_rows")), 2).alias("percent"))


def id_columns(df: DataFrame, whole_word: bool = False) -> list[str]:
    """Names containing "id"; ``whole_word`` asks for an id part between underscores."""
    if whole_word:
        return [c for c in df.columns if "id" in c.lower().split("_")]
    return [c for c in df.columns if "id" in c.lower()]


def duplicate_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null values minus distinct values per id column."""
    counts = long_form(df, cols).where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg((F.sum("n") - F.count("*")).alias("duplicates")).where(F.col("duplicates") > 0)


def sentinel_flags(df: DataFrame, sentinels: Sequence = SENTINELS, share: float = 0.01) -> DataFrame:
    r = column_report(df, numeric_columns(df), {f"s{i}": (lambda c, v=v: F.count_if(F.col(c) == v)) for i, v in enumerate(sentinels)})
    hits = F.array(*[F.struct(F.lit(float(v)).alias("sentinel"), F.col(f"s{i}").alias("n")) for i, v in enumerate(sentinels)])
    return r.select("column", "n_rows", F.inline(hits)).where(F.col("n") > share * F.col("n_rows")).drop("n_rows")


def round_number_bias(df: DataFrame, step: int = 5, share: float = 0.8) -> DataFrame:
    r = column_report(df, numeric_columns(df), {"filled": lambda c: F.count(c), "rounded": lambda c: F.count_if(F.col(c) % step == 0)})
    rate = safe_divide(F.col("rounded"), F.col("filled"))
    return r.where(F.col("filled") > 100).select("column", F.round(100 * rate, 2).alias("percent"), (rate > share).alias("biased"))


def text_placeholders(df: DataFrame) -> DataFrame:
    r = column_report(df, string_columns(df), {f"p{i}": (lambda c, p=p: F.count_if(F.lower(c) == p)) for i, p in enumerate(PLACEHOLDERS)})
    hits = F.array(*[F.struct(F.lit(p).alias("placeholder"), F.col(f"p{i}").alias("n")) for i, p in enumerate(PLACEHOLDERS)])
    return r.select("column", F.inline(hits)).where(F.col("n") > 0)


def magnitude_checks(df: DataFrame) -> DataFrame:
    """Negative amounts, rates outside 0-100, mostly exact thousands with few distinct values."""
    r = column_report(df, numeric_columns(df), {
        "negatives": lambda c: F.count_if(F.col(c) < 0),
        "outside": lambda c: F.count_if((F.col(c) < 0) | (F.col(c) > 100)),
        "thousands": lambda c: F.count_if(F.col(c) % 1000 == 0),
        "few": lambda c: F.approx_count_distinct(c) < 10})
    low = F.lower("column")
    is_rate = reduce(lambda a, b: a | b, [low.contains(p) for p in RATE_NAMES])
    return r.select(
        "column", F.when(low.isin(*NON_NEGATIVE_NAMES), F.col("negatives")).otherwise(0).alias("bad_negatives"),
        F.when(is_rate, F.col("outside")).otherwise(0).alias("outside_0_100"),
        ((F.col("thousands") > 0.5 * F.col("n_rows")) & F.col("few")).alias("placeholder_thousands"))


def time_consistency(df: DataFrame, as_of: str) -> DataFrame:
    """Range and number of future values of date-like columns (by name)."""
    cols = [c for c in df.columns if any(p in c.lower() for p in DATE_NAMES) and not isinstance(df.schema[c].dataType, T.NumericType)]
    now = F.lit(as_of).cast("timestamp_ntz")
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    return column_report(df, cols, {"first": lambda c: F.min(stamp(c)), "last": lambda c: F.max(stamp(c)),
                                    "future": lambda c: F.count_if(stamp(c) > now)}).drop("n_rows")


def red_flags(df: DataFrame, updated: str | None = None, as_of: str | None = None, stale_days: int = 30) -> DataFrame:
    """Constant, empty, numeric-stored-as-text columns; stale table if ``updated`` is given."""
    texts = set(string_columns(df))
    r = column_report(df, df.columns, {
        "distinct": lambda c: F.approx_count_distinct(c), "filled": lambda c: F.count(c),
        "as_number": lambda c: F.count(F.col(c).try_cast("double")) if c in texts else F.lit(None).cast("bigint") + F.count(F.lit(1)) * 0})
    out = r.select("column", (F.col("distinct") <= 1).alias("constant"), (F.col("filled") == 0).alias("all_null"),
                   F.coalesce((F.col("as_number") >= 0.95 * F.col("filled")) & (F.col("filled") > 0), F.lit(False)).alias("numeric_as_string"))
    if updated is None:
        return out.withColumn("stale", F.lit(False))
    last = df.agg((F.datediff(F.lit(as_of).cast("date"), F.to_date(F.max(updated))) > stale_days).alias("stale"))
    return attach_row(out, last)


def time_gaps(df: DataFrame, ts: str, freq: str, value: str, jump: float = 0.5) -> DataFrame:
    """Periods without rows, and periods whose total moves by more than ``jump``."""
    spine = period_spine(per_period(df, ts, freq, [F.sum(value).alias("total"), F.count("*").alias("n")]), freq)
    w = Window.orderBy("period")  # one row per calendar period
    change = safe_divide(F.col("total") - F.lag("total").over(w), F.lag("total").over(w))
    return spine.select("period", F.col("n").isNull().alias("missing"), change.alias("change"),
                        F.coalesce(F.abs(change) > jump, F.lit(False)).alias("jump"))


def full_periods(df: DataFrame, ts: str, freq: str) -> DataFrame:
    """Rows without the first and last period if the data does not cover them from end to end (by day)."""
    d = F.to_date(ts)
    ends = df.agg(F.min(d).alias("a"), F.max(d).alias("b")).select(
        F.to_date(F.date_trunc(freq, "a")).alias("p0"), "a", "b", F.to_date(F.date_trunc(freq, "b")).alias("p1")).withColumn(
        "next", F.to_date(F.col("p1") + F.expr(f"interval 1 {freq}"))).first()
    start = ends["a"] if ends["a"] == ends["p0"] else None
    period = F.to_date(F.date_trunc(freq, ts))
    out = df if start is not None else df.where(period > F.lit(ends["p0"]))
    last_day = out.sparkSession.range(1).select(F.date_sub(F.lit(ends["next"]), 1)).first()[0]
    return out if ends["b"] == last_day else out.where(period < F.lit(ends["p1"]))


def denominator_check(df: DataFrame, ts: str, freq: str, numerator: Column, denominator: Column, shift: float = 0.5) -> DataFrame:
    """Rate per period, zero denominators, and denominators that move by more than ``shift``."""
    p = per_period(df, ts, freq, [F.sum(numerator.cast("double")).alias("num"), F.sum(denominator.cast("double")).alias("den")])
    w = Window.orderBy("period")  # one row per calendar period
    prev = F.lag("den").over(w)
    return p.select("period", F.try_divide("num", "den").alias("rate"), (F.col("den") == 0).alias("zero"),
                    F.coalesce(F.abs(safe_divide(F.col("den") - prev, prev)) > shift, F.lit(False)).alias("shifted"))


def rate_extremes(rates: DataFrame, rate: str) -> DataFrame:
    """How many rates are exactly 0 or 1, and whether all segments show the same value."""
    return rates.agg(F.count_if(F.col(rate) == 0).alias("zeros"), F.count_if(F.col(rate) == 1).alias("ones"),
                     ((F.count_distinct(rate) == 1) & (F.count(rate) > 1)).alias("identical"))


# rules

def not_null(c: str) -> tuple[str, Column]:
    return f"not_null:{c}", F.col(c).isNull()


def accepted_values(c: str, values: Sequence) -> tuple[str, Column]:
    return f"accepted_values:{c}", F.col(c).isNotNull() & ~F.col(c).isin(list(values))


def accepted_range(c: str, lo=None, hi=None) -> tuple[str, Column]:
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (F.col(c) < lo)
    if hi is not None:
        bad = bad | (F.col(c) > hi)
    return f"accepted_range:{c}", bad


def expression(name: str, ok: Column) -> tuple[str, Column]:
    return name, ~ok


def run_rules(df: DataFrame, rules: Sequence[tuple[str, Column]], unique: Sequence[Sequence[str]] = (),
              rows: tuple[int, int] | None = None) -> DataFrame:
    """Failing rows per rule: all row rules share one scan; each unique key costs one grouping."""
    aggs = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"_r{i}") for i, (_, bad) in enumerate(rules)]
    one = df.agg(F.count("*").alias("_n"), *aggs)
    items = [F.struct(F.lit(n).alias("rule"), F.col(f"_r{i}").alias("failing")) for i, (n, _) in enumerate(rules)]
    if rows:
        items.append(F.struct(F.lit("row_count").alias("rule"), (~F.col("_n").between(*rows)).cast("bigint").alias("failing")))
    out = one.select(F.inline(F.array(*items)))
    for key in unique:
        filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
        g = df.where(filled).groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
        out = out.unionByName(g.agg(F.lit("unique:" + ",".join(key)).alias("rule"), F.coalesce(F.sum("_n"), F.lit(0)).alias("failing")))
    return out.withColumn("passed", F.col("failing") == 0)


def assert_sql(views: dict[str, DataFrame], checks: dict[str, str]) -> DataFrame:
    """Each SQL text returns failing rows; passing means it returns none."""
    spark = next(iter(views.values())).sparkSession
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    parts = [spark.sql(sql).agg(F.lit(n).alias("rule"), F.count("*").alias("failing")) for n, sql in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("failing") == 0)


def schema_check(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [(c, t, have.get(c), "missing" if c not in have else "ok" if have[c] == t else "type") for c, t in expected.items()]
    rows += [(c, None, t, "extra") for c, t in have.items() if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, status string")


class QualityGateError(ValueError):
    """Some check fell below its threshold."""


def quality_gate(checks: DataFrame, strict: bool = True) -> DataFrame:
    """``checks(check, value, threshold)``; raises with the failed names if strict."""
    out = checks.withColumn("passed", F.col("value") >= F.col("threshold"))
    if strict:
        failed = [r["check"] for r in out.where(~F.col("passed")).orderBy("check").limit(50).collect()]
        if failed:
            raise QualityGateError(", ".join(failed))
    return out


def dimension_report(df: DataFrame, key: str, valid: Column, ts: str, as_of: str, consistent: Column) -> DataFrame:
    """Completeness, uniqueness, validity, timeliness and consistency as shares."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("double") for c in df.columns]) / len(df.columns)
    one = df.agg(F.avg(filled).alias("completeness"), F.avg(F.coalesce(valid, F.lit(False)).cast("double")).alias("validity"),
                 F.avg(F.coalesce(consistent, F.lit(False)).cast("double")).alias("consistency"),
                 F.avg((F.col(ts) <= F.lit(as_of).cast("timestamp_ntz")).cast("double")).alias("timeliness"))
    u = df.groupBy(key).agg(F.count("*").alias("_n")).agg((F.count("*") / F.sum("_n")).alias("uniqueness"))
    return attach_row(one, u).unpivot([], ["completeness", "uniqueness", "validity", "timeliness", "consistency"], "dimension", "share")


def split_overlap(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    a, b = train.select(key).distinct(), test.select(key).distinct()
    return a.join(b, key, "left_semi").agg(F.count("*").alias("shared_keys"))


def leaking_features(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.95) -> DataFrame:
    one = df.agg(*[pearson_r(F.col(c), F.col(target)).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "r").withColumn("leaks", F.coalesce(F.abs("r") > limit, F.lit(False)))


def future_dated(df: DataFrame, feature_ts: str, event_ts: str) -> DataFrame:
    return df.agg(F.count_if(F.col(feature_ts) > F.col(event_ts)).alias("future_rows"))


def nan_inf_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    inf = float("inf")
    return column_report(df, cols, {"nan": lambda c: F.count_if(F.isnan(c)),
                                    "infinite": lambda c: F.count_if(F.col(c).isin(inf, -inf))})


def cross_validate_metric(df: DataFrame, key: str, value: str) -> DataFrame:
    """Total directly, and as mean per entity times entities."""
    per = df.groupBy(key).agg(F.sum(value).alias("s"))
    two = per.agg(F.sum("s").alias("by_entity"), (F.avg("s") * F.count("*")).alias("mean_times_n"))
    out = attach_row(two, df.agg(F.sum(value).alias("direct")))
    return out.withColumn("agrees", (F.abs(F.col("direct") - F.col("by_entity")) <= 1e-9 * F.abs("direct"))
                          & (F.abs(F.col("direct") - F.col("mean_times_n")) <= 1e-9 * F.abs("direct")))
