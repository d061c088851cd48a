"""Cleaning steps. Statistics are learned by one bounded aggregation, then applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import clip, parsed_datetime
from lumenframe.operators.aggregates import mode_per_group, numeric_columns
from lumenframe.operators.quality import DATE_FORMATS, string_columns
from lumenframe.operators.scaling import quantile_values, top_per_group
from lumenframe.session import cut_lineage


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Whole rows, or the first row per subset in the given order."""
    return df.dropDuplicates() if not subset else top_per_group(df, subset, order, 1)


def datetime_columns(df: DataFrame) -> list[str]:
    """String columns in which every non-null value parses as a date."""
    texts = string_columns(df)
    if not texts:
        return []
    row = df.agg(*[(F.count_if(F.col(c).isNotNull() & parsed_datetime(F.col(c), DATE_FORMATS).isNull()) == 0) & (F.count(c) > 0)
                   for c in texts]).first()
    return [c for c, ok in zip(texts, row) if ok]


def fix_types(df: DataFrame) -> tuple[DataFrame, list[str]]:
    found = datetime_columns(df)
    return df.withColumns({c: parsed_datetime(F.col(c), DATE_FORMATS) for c in found}), found


def null_counts(df: DataFrame) -> dict[str, int]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return row.asDict()


def learn_fill(df: DataFrame, cols: Sequence[str], how: str = "median") -> dict:
    """Fill values for numeric columns (median or mean); an all-null column gets none."""
    if not cols:
        return {}
    if how == "mean":
        got = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    else:
        got = {c: v[0] for c, v in quantile_values(df, cols, [0.5]).items()}
    return {c: v for c, v in got.items() if v is not None}


def learn_modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest on ties."""
    if not cols:
        return {}
    long = df.select(*cols).unpivot([], list(cols), "column", "value")
    return {r["column"]: r["mode"] for r in mode_per_group(long, ["column"], "value").collect()}  # one row per column


def fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v)) for c, v in values.items()})


def missing_indicators(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in cols})


def iqr_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Bounds per column; a column without values or with IQR 0 has none."""
    out = {}
    for c, (q1, q3) in quantile_values(df, cols, [0.25, 0.75]).items():
        if q1 is not None and q3 != q1:
            out[c] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def remove_outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5, one_pass: bool = False) -> DataFrame:
    """Column after column, bounds from the rows left so far; ``one_pass`` takes all bounds from the start.

    A null in a column with bounds fails them, as an empty cell does in the comparison.
    """
    cols = list(cols or numeric_columns(df))
    for step in ([cols] if one_pass else [[c] for c in cols]):
        for c, (lo, hi) in iqr_bounds(df, step, k).items():
            df = df.where(F.col(c).between(lo, hi))
    return df


def remove_outliers_zscore(df: DataFrame, cols: Sequence[str], limit: float = 3) -> DataFrame:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    for c in cols:
        if row[f"s_{c}"]:
            df = df.where(F.abs(F.col(c) - row[f"m_{c}"]) <= limit * row[f"s_{c}"])
    return df


def cap_quantile(df: DataFrame, col: str, q: float = 0.999, drop: bool = False) -> DataFrame:
    cap = quantile_values(df, [col], [q])[col][0]
    return df.where(F.col(col) <= cap) if drop else df.withColumn(col, F.least(F.col(col), F.lit(cap)))


def winsorize(df: DataFrame, cols: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    q = quantile_values(df, cols, [low, high])
    return df.withColumns({c: clip(F.col(c), *q[c]) for c in cols})


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 2) -> DataFrame:
    """Start from medians, then regress every column with gaps on the others, a few rounds."""
    gaps = {c: f"_gap_{c}" for c, n in null_counts(df.select(*cols)).items() if n}
    marked = df.withColumns({g: F.col(c).isNull() for c, g in gaps.items()})
    current = fill(marked, learn_fill(df, cols))
    for _ in range(rounds):
        for c, g in gaps.items():
            others = [o for o in cols if o != c]
            rows = VectorAssembler(inputCols=others, outputCol="_x").transform(current)
            model = LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_p").fit(rows.where(~F.col(g)))
            current = model.transform(rows).withColumn(c, F.when(F.col(g), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
        current = cut_lineage(current)
    return current.drop(*gaps.values())


@dataclass
class CleanConfig:
    """Steps and limits of ``clean_table``."""

    subset: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    fix_types: bool = True
    numeric_fill: str = "median"
    categorical_fill: str | None = "mode"
    outliers: str | None = "iqr"
    iqr_k: float = 1.5
    normalize: list[str] = field(default_factory=list)
    ranges: dict[str, tuple] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)

    @classmethod
    def from_dict(cls, values: dict) -> CleanConfig:
        unknown = set(values) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)


def clean_table(df: DataFrame, cfg: CleanConfig | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """duplicates, types, missing, outliers, text form, ranges; the report counts rows or cells per step."""
    cfg = cfg or CleanConfig()
    missing = [c for c in cfg.required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    start = df.count()
    report = [("original_rows", start)]
    out = cut_lineage(drop_duplicates(df, cfg.subset, cfg.order))  # several statistics passes follow
    rows = out.count()
    report.append(("duplicates_removed", start - rows))
    if cfg.fix_types:
        out, found = fix_types(out)
        report.append(("columns_to_datetime", len(found)))
    holes = null_counts(out)
    numeric, texts = set(numeric_columns(out)), set(string_columns(out))
    nums = [c for c, n in holes.items() if n and c in numeric]
    cats = [c for c, n in holes.items() if n and c in texts]
    values = learn_fill(out, nums, cfg.numeric_fill)
    if cfg.categorical_fill == "mode":
        values.update(learn_modes(out, cats))
    elif cfg.categorical_fill is not None:
        values.update({c: cfg.categorical_fill for c in cats})
    out = fill(out, values)
    report.append(("cells_filled", sum(holes[c] for c in values)))
    if cfg.outliers == "iqr":
        out = remove_outliers_iqr(out, k=cfg.iqr_k)
    elif cfg.outliers == "zscore":
        out = remove_outliers_zscore(out, numeric_columns(out))
    out = out.withColumns({c: F.lower(F.trim(c)) for c in cfg.normalize}) if cfg.normalize else out
    for c, (lo, hi) in cfg.ranges.items():
        out = out.where(F.col(c).between(lo, hi))
    end = out.count()
    report += [("outliers_removed", rows - end), ("final_rows", end)]
    return out, report
