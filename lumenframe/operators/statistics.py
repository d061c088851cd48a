"""Hypothesis tests and information measures. Spark reduces the data to one row of sums; the p-value is finished there."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import pvalues as pv
from lumenframe.functions.scalars import pearson_r, safe_divide
from lumenframe.operators.scaling import BLOCK_ROWS_DEFAULT, BLOCK_ROWS_KEY, attach_row, exact_quantiles, quantile_values, value_counts_prefix
from lumenframe.session import cut_lineage


def _one(df: DataFrame, values: dict) -> DataFrame:
    """One-row result table; every figure is a double, text stays text."""
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in values.items())
    return df.sparkSession.createDataFrame([tuple(v if isinstance(v, (str, bool)) or v is None else float(v) for v in values.values())], kinds)


def moments(df: DataFrame, group: str, value: str, a, b) -> dict:
    """n, sum, mean and variance of both groups (null values are left out)."""
    v = F.col(value).cast("double")
    got = df.where(F.col(group).isin(a, b) & v.isNotNull()).groupBy(group).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.avg(v).alias("m"), F.var_samp(v).alias("v"),
        F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt")).collect()
    rows = {r[group]: r for r in got}
    if a not in rows or b not in rows:
        raise ValueError(f"empty group: {[g for g in (a, b) if g not in rows]}")
    return {f"{k}{i}": rows[g][k] or 0.0 for i, g in ((1, a), (2, b)) for k in ("n", "s", "m", "v", "skew", "kurt")}


def z_test_proportions(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    m = moments(df, group, value, a, b)
    p = (m["s1"] + m["s2"]) / (m["n1"] + m["n2"])
    se = math.sqrt(p * (1 - p) * (1 / m["n1"] + 1 / m["n2"]))
    z = (m["m2"] - m["m1"]) / se if se > 0 else 0.0
    return _one(df, {"p1": m["m1"], "p2": m["m2"], "z": z, "p_value": pv.normal_two_sided(z)})


def _t(m: dict, welch: bool) -> tuple[float, float]:
    n1, n2, v1, v2 = m["n1"], m["n2"], m["v1"], m["v2"]
    if welch:
        a, b = v1 / n1, v2 / n2
        se2 = a + b
        dof = se2**2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) if se2 > 0 else n1 + n2 - 2
    else:
        dof = n1 + n2 - 2
        se2 = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof * (1 / n1 + 1 / n2)
    return ((m["m1"] - m["m2"]) / math.sqrt(se2) if se2 > 0 else 0.0), dof


def t_test(df: DataFrame, group: str, value: str, a, b, welch: bool = False) -> DataFrame:
    t, dof = _t(moments(df, group, value, a, b), welch)
    return _one(df, {"t": t, "dof": dof, "p_value": pv.t_two_sided(t, dof)})


def t_test_paired(df: DataFrame, first: Column, second: Column) -> DataFrame:
    d = first.cast("double") - second.cast("double")
    r = df.where(d.isNotNull()).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    t = r["m"] / (r["s"] / math.sqrt(r["n"])) if r["s"] else 0.0
    return _one(df, {"mean_diff": r["m"], "t": t, "dof": r["n"] - 1, "p_value": pv.t_two_sided(t, max(r["n"] - 1, 1))})


def mann_whitney(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """U of the first group, average ranks for ties, tie-corrected normal p with continuity correction.

    Ranks come from running counts over distinct values, not from sorting all rows in one task.
    """
    d = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    cum = value_counts_prefix(d, [], value, {"n": F.lit(1), "na": (F.col(group) == F.lit(a)).cast("long")})
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    r = cum.agg(F.sum("n").alias("n"), F.sum("na").alias("na"), F.sum(F.col("na") * rank).alias("ra"),
                F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties")).first()
    n, n1 = r["n"], r["na"]
    n2 = n - n1
    u = r["ra"] - n1 * (n1 + 1) / 2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - r["ties"] / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd if sd > 0 else 0.0
    return _one(df, {"u": u, "n1": n1, "n2": n2, "z": z, "p_value": min(1.0, pv.normal_two_sided(z)) if z > 0 else 1.0})


def _anova_row(df: DataFrame, group: str, value: Column):
    g = df.where(F.col(group).isNotNull() & value.isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    whole = attach_row(g, g.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm")))
    return whole.agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2.0))).alias("between"),
                     F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.count("*").alias("k"), F.sum("n").alias("n")).first()


def anova(df: DataFrame, group: str, value: str | Column) -> DataFrame:
    r = _anova_row(df, group, F.col(value).cast("double") if isinstance(value, str) else value)
    d1, d2 = r["k"] - 1, r["n"] - r["k"]
    f = (r["between"] / d1) / (r["within"] / d2) if r["within"] else 0.0
    return _one(df, {"f": f, "d1": d1, "d2": d2, "p_value": pv.f_upper(f, d1, d2)})


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equal variances: ANOVA on the distance from the group median."""
    d = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    med = exact_quantiles(d, [value], [0.5], [group]).select(group, F.col(value)[0].alias("_med"))
    return anova(d.join(med, group), group, F.abs(F.col(value) - F.col("_med")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    o = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = o.groupBy(a).agg(F.sum("o").alias("ra")), o.groupBy(b).agg(F.sum("o").alias("rb"))
    cells = attach_row(o.join(ra, a).join(rb, b), o.agg(F.sum("o").alias("n")))
    e = F.col("ra") * F.col("rb") / F.col("n")
    # an empty cell adds e; over all cells sum((o-e)^2/e) = sum(o^2/e) - n
    r = cells.agg((F.sum(F.col("o") * F.col("o") / e) - F.max("n")).alias("x2"), F.count_distinct(a).alias("ka"),
                  F.count_distinct(b).alias("kb")).first()
    dof = (r["ka"] - 1) * (r["kb"] - 1)
    return _one(df, {"chi2": r["x2"], "dof": dof, "p_value": pv.chi2_upper(r["x2"], dof)})


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r of average ranks; ranks are looked up per distinct value."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = d.groupBy(x, y).agg(F.count("*").alias("_w"))

    def ranks(c):
        cum = value_counts_prefix(cells, [], c, {"n": F.col("_w")})
        return cum.select(c, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(f"_r{c}"))

    j = cells.join(ranks(x), x).join(ranks(y), y)
    w, rx, ry = F.col("_w"), F.col(f"_r{x}"), F.col(f"_r{y}")
    j = attach_row(j, j.agg((F.sum(w * rx) / F.sum(w)).alias("mx"), (F.sum(w * ry) / F.sum(w)).alias("my")))
    dx, dy = rx - F.col("mx"), ry - F.col("my")
    r = j.agg((F.sum(w * dx * dy) / F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))).alias("rho"), F.sum(w).alias("n")).first()
    rho, n = r["rho"], r["n"]
    t = rho * math.sqrt((n - 2) / (1 - rho * rho)) if abs(rho) < 1 else math.inf
    return _one(df, {"rho": rho, "n": n, "p_value": pv.t_two_sided(t, n - 2) if math.isfinite(t) else 0.0})


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    row = d.agg(F.coalesce(pearson_r(F.col(x), F.col(y)), F.lit(0.0)).alias("r"), F.count("*").alias("n")).first()
    r, n = row["r"], row["n"]
    t = r * math.sqrt((n - 2) / (1 - r * r)) if abs(r) < 1 else math.inf
    return _one(df, {"r": r, "n": n, "p_value": pv.t_two_sided(t, n - 2) if math.isfinite(t) else 0.0})


def inversions(y: np.ndarray, n: np.ndarray) -> int:
    """Weight of the pairs that stand in falling order, ``y`` before a smaller ``y``: halves of doubling size are merged, counting what stands in front."""
    found, place, step = 0, np.arange(len(y)), 1
    while step < len(y):
        group, right = place // (2 * step), (place // step) % 2
        order = np.lexsort((right, y, group))
        g, r, w = group[order], right[order], n[order]
        left = np.where(r == 0, w, 0)
        upto = np.cumsum(left)
        total = np.bincount(group, weights=np.where(right == 0, n, 0)).astype(np.int64)
        before = upto - np.concatenate([[0], np.cumsum(total)])[g]
        above = (total[g] - before) * (r == 1)
        found += int((w * above).sum()) if float(w.max()) * float(above.max()) * len(w) < 9e18 else sum(int(a) * int(b) for a, b in zip(w, above))
        step *= 2
    return found


def discordant_pairs(cells: DataFrame) -> int:
    """Weight of the pairs of rows ``x, y, n`` with a larger ``x`` and a smaller ``y``.

    The rows are cut by ``x`` and ``y`` into blocks of about ``lumenframe.blockRows`` rows, and a task counts inside its block. Pairs of different blocks are told by block and ``y``: the rows are cut
    once more, by ``y`` and block, into as many bands, and a task counts inside its band. For pairs that differ in both, the weights of block and band are enough. So rows move twice, however many there are.
    """
    rows = int(cells.sparkSession.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT)))
    blocks = max(1, -(-cells.count() // rows))
    cut = cut_lineage(cells.repartitionByRange(blocks, "x", "y").sortWithinPartitions("x", "y").withColumn("block", F.spark_partition_id()))

    def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
        held = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(held) if held else None

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        found = inversions(table["y"].to_numpy(), table["n"].to_numpy()) if table else 0
        yield pa.RecordBatch.from_pydict({"found": [str(found)]})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs found in a band, beside the weight of each block in it."""
        table = whole(batches)
        if table:
            block, n = table["block"].to_numpy(), table["n"].to_numpy()
            names, place = np.unique(block, return_inverse=True)
            weight = np.zeros(len(names), np.int64)
            np.add.at(weight, place, n)
            found = [str(inversions(block, n)), *["0"] * (len(names) - 1)]
            yield pa.RecordBatch.from_pydict({"block": names.astype(np.int64), "band": np.full(len(names), table["band"][0].as_py(), np.int64), "n": weight, "found": found})

    exact = "decimal(38,0)"
    total = int(cut.select("y", "n").mapInArrow(inside, "found string").agg(F.sum(F.col("found").cast(exact))).first()[0] or 0)
    if blocks > 1:
        bands = cut.select("y", "block", "n").repartitionByRange(blocks, "y", "block").sortWithinPartitions("y", "block").withColumn("band", F.spark_partition_id())
        met = cut_lineage(bands.mapInArrow(across, "block bigint, band bigint, n bigint, found string"))
        total += int(met.agg(F.sum(F.col("found").cast(exact))).first()[0] or 0)
        every = cells.sparkSession.range(blocks * blocks).select(F.floor(F.col("id") / blocks).alias("block"), (F.col("id") % blocks).alias("band"))
        grid = every.join(met.select("block", "band", "n"), ["block", "band"], "left").na.fill(0, ["n"])
        ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        above = grid.withColumn("above", F.sum("n").over(ahead(Window.partitionBy("block").orderBy(F.desc("band")))))
        worse = above.withColumn("worse", F.sum("above").over(ahead(Window.partitionBy("band").orderBy("block"))))
        total += int(worse.agg(F.sum(F.col("n").cast(exact) * F.col("worse"))).first()[0] or 0)
    return total


def kendall_tau_b(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of two columns of any number of levels; nulls are left out."""
    kept = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = cut_lineage(kept.groupBy("x", "y").agg(F.count("*").alias("n")))

    def ties(*by: str) -> int:
        n = F.col("n").cast("decimal(19,0)")
        return int((cells.groupBy(*by).agg(F.sum("n").alias("n")) if by else cells.agg(F.sum("n").alias("n"))).agg(F.sum(n * (n - 1))).first()[0] or 0) // 2

    disc = discordant_pairs(cells)
    n0, tx, ty, both = ties(), ties("x"), ties("y"), ties("x", "y")
    conc = n0 - tx - ty + both - disc
    base = math.sqrt(n0 - tx) * math.sqrt(n0 - ty)
    return _one(df, {"tau_b": (conc - disc) / base if base else 0.0, "concordant": conc, "discordant": disc})


def normality(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Jarque-Bera from moments, for both groups."""
    m = moments(df, group, value, a, b)
    rows = []
    for i, g in ((1, a), (2, b)):
        jb = m[f"n{i}"] / 6 * (m[f"skew{i}"] ** 2 + m[f"kurt{i}"] ** 2 / 4)
        rows.append((str(g), float(jb), pv.chi2_upper(jb, 2)))
    return df.sparkSession.createDataFrame(rows, "sample string, jb double, p_value double")


EFFECTS = ((0.2, "Negligible"), (0.5, "Small"), (0.8, "Medium"))


def effect_label(d: float) -> str:
    return next((name for limit, name in EFFECTS if abs(d) < limit), "Large")


def cohens_d(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    m = moments(df, group, value, a, b)
    sd = math.sqrt((m["v1"] + m["v2"]) / 2)
    d = (m["m1"] - m["m2"]) / sd if sd > 0 else 0.0
    return _one(df, {"d": d, "effect": effect_label(d)})


def ci_diff_means(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    m = moments(df, group, value, a, b)
    diff, half = m["m1"] - m["m2"], 1.96 * math.sqrt(m["v1"] / m["n1"] + m["v2"] / m["n2"])
    return _one(df, {"diff": diff, "low": diff - half, "high": diff + half})


def auto_test(df: DataFrame, group: str, value: str, a, b, alpha: float = 0.05) -> DataFrame:
    """Normal samples: t or Welch (by Levene); otherwise Mann-Whitney."""
    normal = all(r["p_value"] > alpha for r in normality(df, group, value, a, b).collect())
    if normal:
        equal = levene(df.where(F.col(group).isin(a, b)), group, value).first()["p_value"] > alpha
        r = t_test(df, group, value, a, b, welch=not equal).first()
        name, stat = ("t" if equal else "welch"), r["t"]
    else:
        r = mann_whitney(df, group, value, a, b).first()
        name, stat = "mann_whitney", r["u"]
    return _one(df, {"test": name, "statistic": stat, "p_value": r["p_value"]})


def ab_test(df: DataFrame, group: str, value: str, control, treatment, conversion: bool, alpha: float = 0.05) -> DataFrame:
    """Means, lift in percent (null if the base is 0), p-value, 95% interval, verdict."""
    m = moments(df, group, value, control, treatment)
    test = z_test_proportions if conversion else t_test
    p = test(df, group, value, control, treatment).first()["p_value"]
    diff, half = m["m2"] - m["m1"], 1.96 * math.sqrt(m["v1"] / m["n1"] + m["v2"] / m["n2"])
    return _one(df, {"metric": value, "control": m["m1"], "treatment": m["m2"], "n_control": m["n1"], "n_treatment": m["n2"],
                     "lift": diff / m["m1"] * 100 if m["m1"] else None, "p_value": p, "low": diff - half, "high": diff + half,
                     "significant": bool(p < alpha)})


def ab_multi(df: DataFrame, group: str, metrics: Sequence[str], control, treatment, alpha: float = 0.05) -> DataFrame:
    """t statistic per metric from one aggregation; significant at ``alpha / number of metrics``."""
    aggs = [f(c).alias(f"{n}_{c}") for c in metrics for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    rows = {r[group]: r for r in df.where(F.col(group).isin(control, treatment)).groupBy(group).agg(*aggs).collect()}
    a, b = rows[control], rows[treatment]
    out = []
    for c in metrics:
        m = {f"{k}{i}": float(r[f"{k}_{c}"] or 0) for i, r in ((1, b), (2, a)) for k in "nmv"}
        t, dof = _t(m, False)
        p = pv.t_two_sided(t, dof)
        out.append((c, m["m1"] - m["m2"], t, p, p < alpha / len(metrics)))
    return df.sparkSession.createDataFrame(out, "metric string, diff double, t double, p_value double, significant boolean")


def sample_size(p: float, mde: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows per variant to detect a change of ``mde`` from rate ``p``."""
    z = pv.normal_quantile(1 - alpha / 2) + pv.normal_quantile(power)
    q = p + mde
    return math.ceil(z * z * (p * (1 - p) + q * (1 - q)) / (mde * mde))


def sample_adequacy(df: DataFrame, group: str, value: str, mde: float) -> DataFrame:
    """Needed rows for the observed base rate next to the rows of each variant."""
    base = df.agg(F.avg(F.col(value).cast("double"))).first()[0]
    need = sample_size(base, mde)
    return df.groupBy(group).agg(F.count("*").alias("n")).select(group, "n", F.lit(need).alias("needed"), (F.col("n") >= need).alias("enough"))


def bootstrap_sums(df: DataFrame, value: str, by: Sequence[str], rounds: int, seed: int = 0) -> DataFrame:
    """Poisson bootstrap: per round and group the weighted count and sum.

    Equal values are counted first (the weights of c copies add up to Poisson(c)); each distinct value
    draws all its weights from a generator keyed by the value, so a retried task draws the same.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    keyed = counts.withColumn("_h", F.xxhash64(F.lit(seed), "_x", *by))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            w = np.stack([np.random.Generator(np.random.Philox(key=int(h) & (2**64 - 1))).poisson(c, rounds)
                          for h, c in zip(pdf["_h"], pdf["_c"])])
            groups = pdf.groupby(by, dropna=False, sort=False).indices.items() if by else [((), np.arange(len(pdf)))]
            for key, at in groups:
                part = pd.DataFrame({"round": np.arange(rounds), "n": w[at].sum(0).astype(float),
                                     "s": (w[at] * pdf["_x"].to_numpy()[at, None]).sum(0)})
                key = key if isinstance(key, tuple) else (key,)
                for c, k in zip(by, key):
                    part[c] = k
                yield part[[*by, "round", "n", "s"]]

    schema = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by) + "round int, n double, s double"
    return keyed.mapInPandas(draw, schema).groupBy(*by, "round").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def bootstrap_ci(df: DataFrame, value: str, by: Sequence[str] = (), rounds: int = 500, seed: int = 0) -> DataFrame:
    """2.5 and 97.5 percentiles of the bootstrap means."""
    m = bootstrap_sums(df, value, by, rounds, seed).withColumn("mean", safe_divide(F.col("s"), F.col("n")))
    return m.groupBy(*by).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))  # one value per round


def paired_bootstrap(df: DataFrame, first: str, second: str, rounds: int = 500, seed: int = 0) -> DataFrame:
    """Interval of mean(first - second) and the share of rounds at or below 0."""
    d = df.select((F.col(first).cast("double") - F.col(second).cast("double")).alias("diff"))
    m = bootstrap_sums(d, "diff", [], rounds, seed).withColumn("mean", safe_divide(F.col("s"), F.col("n")))
    return m.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"),
                 F.avg((F.col("mean") <= 0).cast("double")).alias("p_value"))


def both_sides(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, is_ref, is_cur) rows of both tables."""
    def side(df, r):
        long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value")
        return long.where(F.col("value").isNotNull()).select("feature", "value", F.lit(r).alias("r"), F.lit(1 - r).alias("c"))

    return side(ref, 1).unionByName(side(cur, 0))


def ks_distance(ref: DataFrame, cur: DataFrame, features: Sequence[str]) -> DataFrame:
    """Largest gap of the two distribution functions per feature, from running counts over distinct values."""
    cum = value_counts_prefix(both_sides(ref, cur, features), ["feature"], "value", {"nr": F.col("r"), "nc": F.col("c")})
    sums = cum.groupBy("feature").agg(F.sum("nr").alias("n_ref"), F.sum("nc").alias("n_cur"))
    gap = F.abs(safe_divide(F.col("cum_nr"), F.col("n_ref")) - safe_divide(F.col("cum_nc"), F.col("n_cur")))
    return cum.join(sums, "feature").groupBy("feature").agg(F.max(gap).alias("ks"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))


def psi(ref: DataFrame, cur: DataFrame, features: Sequence[str], bins: int = 10, floor: float = 0.001) -> DataFrame:
    """Population stability index on reference quantile bins (left-closed, open ends)."""
    q = quantile_values(ref, features, [i / bins for i in range(1, bins)])
    edges = F.create_map(*[x for c in features for x in (F.lit(c), F.array(*[F.lit(float(e)) for e in q[c]]))])
    at = F.size(F.filter(edges[F.col("feature")], lambda e: e <= F.col("value")))
    counts = both_sides(ref, cur, features).groupBy("feature", at.alias("bin")).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    grid = ref.sparkSession.createDataFrame([(c, b) for c in features for b in range(bins)], "feature string, bin int")
    sums = counts.groupBy("feature").agg(F.sum("nr").alias("tr"), F.sum("nc").alias("tc"))
    j = grid.join(counts, ["feature", "bin"], "left").join(sums, "feature")
    p = F.greatest(F.coalesce("nr", F.lit(0)) / F.col("tr"), F.lit(floor))
    c = F.greatest(F.coalesce("nc", F.lit(0)) / F.col("tc"), F.lit(floor))
    return j.groupBy("feature").agg(F.round(F.sum((c - p) * F.log(c / p)), 4).alias("psi"))


def distribution_entropy(df: DataFrame, p: str, q: str) -> DataFrame:
    """Entropy, cross-entropy and KL divergence of columns with shares that sum to 1."""
    a, b = F.col(p), F.col(q)
    h = -F.sum(F.when(a > 0, a * F.log(a)).otherwise(0.0))
    x = -F.sum(F.when(a > 0, a * F.log(b)).otherwise(0.0))
    return df.agg(h.alias("entropy"), x.alias("cross_entropy"), (x - h).alias("kl"))


def split_gain(df: DataFrame, label: str, left: Column) -> DataFrame:
    """Gini impurity and information gain of a yes/no split, from class counts."""
    c = df.where(F.col(label).isNotNull() & left.isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"), F.count_if(left).alias("l")).withColumn("r", F.col("n") - F.col("l"))
    w = attach_row(c, c.agg(F.sum("n").alias("tn"), F.sum("l").alias("tl"), F.sum("r").alias("tr")))

    def gini(x, t):
        return 1 - F.sum(F.pow(F.coalesce(safe_divide(F.col(x), F.col(t)), F.lit(0.0)), F.lit(2.0)))

    def ent(x, t):
        s = safe_divide(F.col(x), F.col(t))
        return -F.sum(F.when(s > 0, s * F.log2(s)).otherwise(0.0))

    share = F.max(F.col("tl") / F.col("tn"))
    return w.agg(gini("n", "tn").alias("gini"), (share * gini("l", "tl") + (1 - share) * gini("r", "tr")).alias("gini_split"),
                 (ent("n", "tn") - share * ent("l", "tl") - (1 - share) * ent("r", "tr")).alias("information_gain"))


def segment_intervals(df: DataFrame, by: str, hit: Column) -> DataFrame:
    """Rate per segment with a normal 95% interval."""
    s = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return s.select(by, "n", "rate", (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))
