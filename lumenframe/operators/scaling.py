"""Ordered and ranked computations that stay exact when one key holds a large share of the rows.

A plain window sends every row of a key to one task. The functions here first look for keys with
more than ``hot_rows`` rows. Without such keys they are the plain window. With them, the rows of all hot
keys are range-partitioned by key and the whole order list, about ``lumenframe.blockRows`` rows to a partition, so that keys and ties on the first
order column are cut alike; a partition's rows of one key are a block. Windows run inside a block, and a table of block totals (or the few
border rows) carries the rest. The number of blocks follows the number of rows; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import cut_lineage

BLK = "_blk"
HOT = "_hot"
HOT_ROWS_KEY = "lumenframe.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
BLOCK_ROWS_KEY = "lumenframe.blockRows"
BLOCK_ROWS_DEFAULT = 2_000_000
LEAST_BLOCKS = 4


def hot_rows_of(df: DataFrame, hot_rows: int | None) -> int:
    if hot_rows is not None:
        return hot_rows
    return int(df.sparkSession.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def blocks_for(df: DataFrame, rows: int) -> int:
    """Number of blocks for so many hot rows."""
    return max(LEAST_BLOCKS, math.ceil(rows / int(df.sparkSession.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT)))))


def sort_cols(order: Sequence[str]) -> list[Column]:
    """``["-ts", "id"]`` means ts descending, then id ascending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                  broadcast: bool = False) -> DataFrame:
    """Join that treats null keys as equal and keeps the left key columns only."""
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_k{i}")
    if broadcast:
        renamed = F.broadcast(renamed)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(renamed[f"_k{i}"])
    return left.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


#: Plan nodes of a plain scan; anything else may hold a shuffle, whose stages would run just to count partitions.
SCAN_NODES = ("Project", "Filter", "Relation", "LogicalRDD", "LocalRelation")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row work on a small scan: a single file would otherwise be one task.

    Inputs with at least as many splits as cores, and inputs that are not plain scans, stay as they are, so large data is never shuffled here.
    """
    if df.isStreaming:
        return df
    nodes = [line.lstrip(" :+-").split(" ", 1)[0].split("[", 1)[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    cores = df.sparkSession.sparkContext.defaultParallelism
    if any(n and not n.startswith(SCAN_NODES) for n in nodes) or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row as fixed values."""
    row = one.first()
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one.schema.fields])


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """The keys with more than ``hot_rows`` rows and their ``count``, counted map-side first; a table, as there may be many."""
    counted = df.groupBy(*keys).count().where(F.col("count") > hot_rows_of(df, hot_rows))
    return df.sparkSession.createDataFrame([], counted.schema) if counted.isEmpty() else cut_lineage(counted)


def split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              hot_rows: int | None = None, hot: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add block number ``_blk`` (ascending along the order) and flag ``_hot`` if some key is hot.

    ``hot`` takes the result of an earlier ``hot_keys`` on the same rows and saves the counting pass. The cut rows are kept by a
    reliable checkpoint: a range partitioning that is computed twice could cut elsewhere.
    """
    hot_rows = hot_rows_of(df, hot_rows)
    if keys:
        found = hot_keys(df, keys, hot_rows) if hot is None else hot
        if found.isEmpty():
            return df, False
        rows = found.agg(F.sum("count")).first()[0]
        only = found.select(*keys)
        crowded, rest = join_nullsafe(df, only, keys, "left_semi"), join_nullsafe(df, only, keys, "left_anti")
    else:
        rows = df.count()
        if rows <= hot_rows:
            return df, False
        crowded, rest = df, None
    ranges = crowded.repartitionByRange(blocks_for(df, rows), *keys, *sort_cols(order))
    cut = cut_lineage(ranges.withColumn(BLK, F.spark_partition_id()).withColumn(HOT, F.lit(True)))
    if rest is None:
        return cut, True
    return cut.unionByName(rest.withColumn(BLK, F.lit(0)).withColumn(HOT, F.lit(False))), True


_TOTAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _over(kind: str, col: Column, frame) -> Column:
    if kind in _TOTAL:
        return _TOTAL[kind](col).over(frame)
    if kind == "last":
        return F.last(col, ignorenulls=True).over(frame)
    raise ValueError(kind)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + local
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            aggs: dict[str, tuple], hot_rows: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Running aggregates from the first row of a key to the current row.

    ``aggs[name] = (kind, column[, "before"])``; kind is sum, count, max, min or last (not null);
    ``"before"`` leaves the current row out.
    """
    base, split = split_hot(df, keys, order, hot_rows, hot=hot)
    part = [*keys, BLK] if split else list(keys)
    w = Window.partitionBy(*part).orderBy(*sort_cols(order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    def col_of(spec):
        return F.col(spec[1]) if isinstance(spec[1], str) else spec[1]

    out = base.select(
        "*",
        *[_over(s[0], col_of(s), before if len(s) > 2 else upto).alias(n) for n, s in aggs.items()],
    )
    if not split:
        return out
    if any(s[0] == "last" for s in aggs.values()) and any(c.startswith("-") for c in order):
        raise ValueError("'last' needs ascending order")
    rank_of = F.struct(*[F.col(c.lstrip("-")) for c in order])
    totals = []
    for n, s in aggs.items():
        c = col_of(s)
        t = F.max_by(c, F.when(c.isNotNull(), rank_of)) if s[0] == "last" else _TOTAL[s[0]](c)
        totals.append(t.alias(f"_t_{n}"))
    blocks = base.where(F.col(HOT)).groupBy(*part).agg(*totals)
    wb = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        *part,
        *[_over("sum" if s[0] == "count" else s[0], F.col(f"_t_{n}"), wb).alias(f"_c_{n}")
          for n, s in aggs.items()],
    )
    joined = join_nullsafe(out, carry, part, "left")
    return joined.select(
        *[c for c in df.columns],
        *[_merge(s[0], F.col(f"_c_{n}"), F.col(n)).alias(n) for n, s in aggs.items()],
    )


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               exprs: dict[str, Callable], before: int = 0, after: int = 0,
               hot_rows: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``exprs[name] = fn(window) -> Column``. Blocks of a hot key get copies of the border rows.
    """
    base, split = split_hot(df, keys, order, hot_rows, hot=hot)
    if not split:
        w = Window.partitionBy(*keys).orderBy(*sort_cols(order))
        return base.select("*", *[f(w).alias(n) for n, f in exprs.items()])
    part = [*keys, BLK]
    inner = Window.partitionBy(*part)
    asc = sort_cols(order)
    flip = sort_cols([c[1:] if c.startswith("-") else "-" + c for c in order])
    crowded = base.where(F.col(HOT))
    along = Window.partitionBy(*keys).orderBy(BLK)
    blocks = crowded.groupBy(*part).agg(F.count("*").alias("_rows")).select(
        *part, "_rows", F.row_number().over(along).alias("_nth"), F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_cum"),
        F.count("*").over(Window.partitionBy(*keys)).alias("_blocks"))
    pieces = [base.withColumn("_halo", F.lit(False))]

    def halo(n: int, edge_order, forward: bool):
        """Copies of a block's ``n`` outermost rows for the blocks that lie within ``n`` rows of them; each block between holds a row at least."""
        tail = crowded.withColumn("_rn", F.row_number().over(inner.orderBy(*edge_order))).where(F.col("_rn") <= n)
        placed = join_nullsafe(tail, blocks, part, "inner")
        nth, far = F.col("_nth"), F.lit(n + 1) - F.col("_rn")
        targets = (F.when(nth < F.col("_blocks"), F.sequence(nth + 1, F.least(nth + far, F.col("_blocks")))) if forward
                   else F.when(nth > 1, F.sequence(F.greatest(nth - far, F.lit(1)), nth - 1)))
        moved = placed.withColumn("_to", F.explode(targets))
        there = blocks.select(*keys, F.col("_nth").alias("_to"), F.col(BLK).alias("_tb"), F.col("_cum").alias("_tc"), F.col("_rows").alias("_tr"))
        between = F.col("_tc") - F.col("_cum") - F.col("_rows") if forward else F.col("_cum") - F.col("_tc") - F.col("_tr")
        near = join_nullsafe(moved, there, [*keys, "_to"], "inner").where(between + F.col("_rn") <= n)
        return near.withColumn(BLK, F.col("_tb")).select(*base.columns).withColumn("_halo", F.lit(True))

    if before:
        pieces.append(halo(before, flip, True))
    if after:
        pieces.append(halo(after, asc, False))
    whole = pieces[0]
    for p in pieces[1:]:
        whole = whole.unionByName(p)
    w = inner.orderBy(*asc)
    return (whole.select("*", *[f(w).alias(n) for n, f in exprs.items()])
            .where(~F.col("_halo")).drop("_halo", BLK, HOT))


def trailing(df: DataFrame, keys: Sequence[str], ts: str, seconds: int,
             exprs: dict[str, Callable], hot_rows: int | None = None) -> DataFrame:
    """Window columns over ``(ts - seconds, ts]`` style RANGE frames.

    ``exprs[name] = fn(window)`` with the window ordered by epoch microseconds in ``_us``. Rows of a
    hot key are cut into time blocks at least ``seconds`` long; a row also goes to the next block
    only if a frame there can reach it.
    """
    hot_rows = hot_rows_of(df, hot_rows)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = df.withColumn("_us", us)
    sizes = base.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min("_us").alias("_from"), F.max("_us").alias("_to")).where(F.col("_rows") > hot_rows)
    if sizes.isEmpty():
        w = Window.partitionBy(*keys).orderBy("_us")
        return base.select("*", *[f(w).alias(n) for n, f in exprs.items()]).drop("_us")
    pieces = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("_rows") / F.lit(int(df.sparkSession.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT))))))
    widths = cut_lineage(sizes.select(*keys, F.greatest(F.lit(seconds * 1_000_000 + 1), F.floor((F.col("_to") - F.col("_from")) / pieces) + 1).alias("_width")))
    marked = join_nullsafe(base, widths, keys, "left").withColumn(HOT, F.col("_width").isNotNull())
    width = F.col("_width")
    own = F.when(F.col(HOT), F.floor(F.col("_us") / width)).otherwise(F.lit(0)).cast("long")
    reach = F.col(HOT) & ((own + 1) * width - F.col("_us") <= seconds * 1_000_000)
    copies = F.when(F.coalesce(reach, F.lit(False)), F.array(own, own + 1)).otherwise(F.array(own))
    spread = (marked.withColumn("_own", own).withColumn(BLK, F.explode(copies)))
    w = Window.partitionBy(*keys, BLK).orderBy("_us")
    return (spread.select("*", *[f(w).alias(n) for n, f in exprs.items()])
            .where(F.col("_own") == F.col(BLK)).drop("_us", "_own", "_width", BLK, HOT))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: dict[str, str],
           hot_rows: int | None = None) -> DataFrame:
    """Rank columns; ``names[column]`` is row_number, rank, dense_rank, percent_rank, cume_dist or
    ``ntile:<n>``. ``rank``-like functions compare the full order list."""
    base, split = split_hot(df, keys, order, hot_rows)
    native = {
        "row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank,
        "percent_rank": F.percent_rank, "cume_dist": F.cume_dist,
    }
    if not split:
        w = Window.partitionBy(*keys).orderBy(*sort_cols(order))
        return base.select("*", *[
            (F.ntile(int(k[6:])) if k.startswith("ntile:") else native[k]()).over(w).alias(n)
            for n, k in names.items()])
    part = [*keys, BLK]
    w = Window.partitionBy(*part).orderBy(*sort_cols(order))
    out = base.select("*", F.row_number().over(w).alias("_rn"), F.rank().over(w).alias("_rk"),
                      F.dense_rank().over(w).alias("_dr"),
                      F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0)
                                             if len(order) == 1 else w.rowsBetween(Window.unboundedPreceding, 0)
                                             ).alias("_le"))
    ordered = F.struct(*[F.col(c.lstrip("-")) for c in order])
    blocks = (base.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(ordered).alias("_d")))
    wk = Window.partitionBy(*keys)
    wb = wk.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*part, F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_cn"),
                          F.coalesce(F.sum("_d").over(wb), F.lit(0)).alias("_cd"),
                          F.sum("_n").over(wk).alias("_all"))
    j = join_nullsafe(out, carry, part, "left")
    rn, rk = F.col("_rn") + F.col("_cn"), F.col("_rk") + F.col("_cn")
    n = F.col("_all")

    def expr(kind: str) -> Column:
        if kind == "row_number":
            return rn.cast("int")
        if kind == "rank":
            return rk.cast("int")
        if kind == "dense_rank":
            return (F.col("_dr") + F.col("_cd")).cast("int")
        if kind == "percent_rank":
            return F.when(n > 1, (rk - 1) / (n - 1)).otherwise(F.lit(0.0))
        if kind == "cume_dist":
            return (F.col("_le") + F.col("_cn")) / n
        k = int(kind[6:])
        size, extra = F.floor(n / k), n % k
        cut = extra * (size + 1)
        return F.when(rn <= cut, F.floor((rn - 1) / (size + 1)) + 1).otherwise(
            extra + F.floor((rn - 1 - cut) / F.greatest(size, F.lit(1))) + 1).cast("int")

    return j.select(*df.columns, *[expr(k).alias(c) for c, k in names.items()])


def with_totals(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Group aggregates joined back to every row (partial sums first, no whole group in one task)."""
    if not keys:
        return attach_row(df, df.agg(*aggs))
    return join_nullsafe(df, df.groupBy(*keys).agg(*aggs), keys, "left")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
                  rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*sort_cols(order))
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def value_counts_prefix(df: DataFrame, keys: Sequence[str], value: str, weights: dict[str, Column],
                        hot_rows: int | None = None, down: bool = False) -> DataFrame:
    """Per distinct value: the weights' sums, and ``cum_<name>`` running sums in value order."""
    counts = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    return running(counts, keys, [("-" if down else "") + value],
                   {f"cum_{n}": ("sum", n) for n in weights}, hot_rows)


EXACT_VALUES_KEY = "lumenframe.exactValues"
EXACT_VALUES_DEFAULT = 1_000_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    max_values: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Interpolated quantiles as ``array<double>`` per column.

    ``percentile`` holds one counter per distinct value of a group, so it is used only where the
    number of values is checked to be small; beyond that the quantile is read off running counts.
    """
    by = list(by)
    if max_values is None:
        max_values = int(df.sparkSession.conf.get(EXACT_VALUES_KEY, str(EXACT_VALUES_DEFAULT)))
    sized = df.groupBy(*by).agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    most = sized.agg(F.max(F.greatest(*[F.col(c) for c in cols], F.lit(0)))).first()[0] or 0
    if most <= max_values:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*by).agg(*[F.percentile(c, arr).alias(c) for c in cols])
    out = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    for c in cols:
        vals = df.select(*by, c).where(F.col(c).isNotNull())
        cum = value_counts_prefix(vals, by, c, {"n": F.lit(1)}, hot_rows)
        tot = with_totals(cum, by, [F.sum("n").alias("_all")])
        picks = []
        for i, p in enumerate(probs):
            h = (F.col("_all") - 1) * F.lit(float(p))
            lo = F.floor(h)
            picks += [F.min(F.when(F.col("cum_n") > lo, F.col(c))).alias(f"_l{i}"),
                      F.min(F.when(F.col("cum_n") > F.least(lo + 1, F.col("_all") - 1), F.col(c))).alias(f"_h{i}"),
                      F.max(h - lo).alias(f"_f{i}")]
        one = tot.groupBy(*by).agg(*picks).select(*by, F.array(*[
            (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).cast("double")
            for i in range(len(probs))]).alias(c))
        out = join_nullsafe(out, one, by, "left") if by else attach_row(out, one)
    return out


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list]:
    """Quantiles of whole columns as driver values (one row)."""
    row = exact_quantiles(df, cols, probs).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}


#: Keys that are sent to the rows at most; each of them holds at least one in so many of the counted rows.
MOST_SENT_KEYS = 20_000


def rows_of_keys(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """The rows whose key stands in ``counted`` (one row per key, with its number of rows ``n``).

    Keys with more than one in ``MOST_SENT_KEYS`` of the counted rows are fewer than that, so they are broadcast and their rows stay where they are; the rows of other
    keys are joined by key, and none of those fills a task.
    """
    counted = cut_lineage(counted.select(key, n))
    total = counted.agg(F.sum(n)).first()[0]
    if not total:
        return rows.limit(0)
    hot = counted.where(F.col(n) > max(total // MOST_SENT_KEYS, hot_rows_of(rows, None) // 100)).select(key)
    if hot.isEmpty():
        return rows.join(counted.select(key), key, "left_semi")
    rest = counted.join(F.broadcast(hot), key, "left_anti").select(key)
    crowded, others = rows.join(F.broadcast(hot), key, "left_semi"), rows.join(F.broadcast(hot), key, "left_anti")
    return crowded.unionByName(others.join(rest, key, "left_semi"))


def split_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], n: str | None = None, small: int = 200_000) -> DataFrame:
    """Left join with a table of one row per key. Keys are not null.

    A table that is counted to have at most ``small`` rows is broadcast whole. Else, keys that hold more than one in ``MOST_SENT_KEYS`` of the rows are fewer than that; their part of the table is
    broadcast, and their rows stay in their tasks. The others are joined by a shuffle in which no key is large. ``n`` names a column of the table with each key's number of rows, if it is known and
    every row has its key in the table.
    """
    keys = list(keys)
    if table.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table), keys, "left")
    counted = table.select(*keys, F.col(n).alias("_n")) if n else cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("_n")))
    least = max((counted.agg(F.sum("_n")).first()[0] or 0) // MOST_SENT_KEYS, hot_rows_of(rows, None) // 100)
    hot = cut_lineage(counted.where(F.col("_n") > least).select(*keys))
    if hot.isEmpty():
        return rows.join(table, keys, "left")
    crowded = rows.join(F.broadcast(hot.join(table, keys, "left")), keys)
    return crowded.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left"))
