"""Column helpers built from Spark functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """Null when the denominator is zero or null."""
    return F.try_divide(a, b)


def clip(x: Column, lo, hi) -> Column:
    """Null stays null."""
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def is_weekend(d: Column) -> Column:
    return (F.weekday(d) >= 5).cast("int")


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def part_of_day(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").otherwise("evening")


def is_month_end(d: Column) -> Column:
    return (F.to_date(d) == F.last_day(d)).cast("int")


def is_quarter_end(d: Column) -> Column:
    return ((F.to_date(d) == F.last_day(d)) & (F.month(d) % 3 == 0)).cast("int")


def is_holiday(d: Column, days: Sequence[str]) -> Column:
    """``days`` as ``MM-dd``."""
    return F.date_format(d, "MM-dd").isin(list(days)).cast("int")


def words(x: Column) -> Column:
    """Whitespace-separated words; an empty or blank text has none."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != "")


def text_length(x: Column) -> Column:
    return F.length(F.coalesce(x, F.lit("")))


def word_count(x: Column) -> Column:
    return F.size(words(x))


def unique_words(x: Column) -> Column:
    return F.size(F.array_distinct(words(F.lower(x))))


def has_numbers(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"\d").cast("int")


def normalize_text(x: Column) -> Column:
    return F.lower(F.trim(x))


def format_number(v: Column, kind: str = "number") -> Column:
    """``12.3K`` style labels; kind is currency, percent or number."""
    if kind == "percent":
        return F.format_string("%.1f%%", v)
    sign = "$" if kind == "currency" else ""
    size = F.abs(v)

    def scaled(by: float, unit: str) -> Column:
        return F.format_string(f"{sign}%.1f{unit}", v / F.lit(by))

    return (F.when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M"))
            .when(size >= 1e3, scaled(1e3, "K")).otherwise(F.concat(F.lit(sign), F.format_number(v, 0))))


def md5_bucket(x: Column, n: int) -> Column:
    """Sticky bucket from the first eight hex digits of md5."""
    return F.conv(F.substring(F.md5(x.cast("string")), 1, 8), 16, 10).cast("bigint") % n


def hash_bucket(x: Column, n: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(n))


def hash_unit(*xs: Column) -> Column:
    """Uniform number in [0, 1) fixed by the arguments (md5, the same on every engine)."""
    text = F.concat_ws(":", *[x.cast("string") for x in xs])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return safe_divide(dot(a, b), norm(a) * norm(b))


def url_host(u: Column) -> Column:
    return F.try_parse_url(u, F.lit("HOST"))


def is_web_url(u: Column) -> Column:
    scheme = F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & url_host(u).isNotNull(), F.lit(False))


def parsed_datetime(x: Column, formats: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1_000_000.0)


def month_index(d: Column) -> Column:
    """Months since year 0; differences are whole calendar months."""
    return F.year(d) * 12 + F.month(d)


def pearson_r(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are set; null if one side is constant."""
    a, b = x.cast("double"), y.cast("double")
    both = a.isNotNull() & b.isNotNull()
    return safe_divide(F.covar_samp(a, b), F.stddev_samp(F.when(both, a)) * F.stddev_samp(F.when(both, b)))
