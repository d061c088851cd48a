"""Nearest neighbours without comparing all pairs: vectors are parted by pivots, and distances to the pivots tell where neighbours can lie.

The items are cut into cells, one for each pivot, a vector belonging to its nearest pivot. Pivots are means fitted on a sample of bounded size, about one for
``cell_rows`` distinct items up to ``most_pivots``; the sample only shapes the cells. Each cell knows how near and how far its items are from the pivot.

Exact search runs in two rounds. First a query looks into the nearest cells that hold enough items; its ``k``-th best there bounds the distance of a neighbour. Then it is copied only
to the cells that the triangle inequality allows: those with items near enough to the pivot, and not wholly beyond the plane between the query's pivot and theirs. Inside a cell only
items whose distance to the pivot fits are compared. Nothing is lost: the rest is proved to be farther. On data without any structure most cells stay possible, and the
work is that of comparing blocks. Approximate search stops after a number of ``probes``, the nearest cells.

Cells that lie together form groups of about ``item_block`` items. A query travels once to a group, with the list of its cells there, not once to each cell, so that even where all cells stay
possible the copies are one for some ten thousand items. Pairs are compared in short floats first, and those that can come up to the best found so far are scored in doubles.

A few queries need no cells: they go to all items, in one pass over them.

Skew: of equal vectors only the ``k + 1`` smallest ids can be neighbours, so the others leave the items first; groups are cut into blocks of items and of queries, and a task compares
one of each. Vectors without length have no direction: under ``cosine`` they score 0 with everything, and again only the ``k + 1`` smallest such ids count.

Inputs have ``id`` (unique and not null) and ``vector``, of one length and without nulls. Results are ``query_id, item_id, score, rank``; cosine scores, or negative Euclidean distances; ties go
to the smaller id. Empty inputs give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.scaling import top_per_group
from lumenframe.session import cut_lineage, scratch_path

NEAR = "query_id bigint, item_id bigint, score double"
SLACK = 1e-6
#: Lengths of vectors between which short floats hold all products.
SHORT_SIZES = (1e-15, 1e15)
#: Queries that meet items at a time, pairs that are scored in doubles at a time, parts of the queries by id, and products that a scan holds.
QUERY_ROWS, HIT_ROWS, ID_BANDS, SCAN_PAIRS = 256, 32_768, 8, 2_000_000
#: So many queries go to all items: to place an item among the cells of a large table costs as much as to compare it with them.
FEW_QUERIES = 512


@dataclass(frozen=True)
class Cells:
    cell_rows: int = 1_024
    most_pivots: int = 16_384
    sample_rows: int = 65_536
    item_block: int = 32_768
    query_block: int = 32_768


def matrix(vectors) -> np.ndarray:
    """Rows of an Arrow list column, or a series of arrays."""
    if isinstance(vectors, (pa.ListArray, pa.LargeListArray, pa.FixedSizeListArray)):
        return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _directed(df: DataFrame, metric: str) -> DataFrame:
    """``id, vector`` as doubles; under cosine of length one, and null where there is no direction."""
    v = F.col("vector").cast("array<double>")
    if metric == "euclidean":
        return df.select("id", F.transform(v, lambda x: x + F.lit(0.0)).alias("vector"))  # one zero only
    if metric != "cosine":
        raise ValueError("metric is cosine or euclidean")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the outer transform binds the length, which the inner one would work out for each number
    return df.select("id", F.element_at(F.transform(F.array(length), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n + F.lit(0.0)))), 1).alias("vector"))


def fit_pivots(items: DataFrame, cells: Cells = Cells(), seed: int = 0) -> tuple[np.ndarray, int]:
    """Means of a hash-drawn sample of about ``sample_rows`` rows at most, and the number of rows."""
    n = items.count()
    if not n:
        return np.zeros((0, 0)), 0
    share = min(1.0, cells.sample_rows / n)
    drawn = items.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("vector").toArrow()
    sample = matrix(drawn.column("vector").combine_chunks()) if drawn.num_rows else matrix([items.first()["vector"]])
    wanted = min(math.ceil(n / cells.cell_rows), cells.most_pivots, len(sample))
    pivots = sample[np.random.default_rng(seed).permutation(len(sample))[:wanted]]
    for _ in range(4):
        home = np.concatenate([distances(sample[k : k + 4096], pivots).argmin(1) for k in range(0, len(sample), 4096)])
        size = np.bincount(home, minlength=wanted)
        total = np.zeros_like(pivots)
        np.add.at(total, home, sample)
        pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], pivots)
    return pivots, n


def grouped_cells(pivots: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """A group for each cell: cells are halved across the direction in which their pivots differ most until a part has ``rows`` items or one cell."""
    group, parts, count = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while parts:
        part = parts.pop()
        if len(part) < 2 or n[part].sum() <= rows:
            group[part] = count
            count += 1
            continue
        away = pivots[part] - pivots[part].mean(0)
        order = part[np.argsort(away @ np.linalg.eigh(away.T @ away)[1][:, -1], kind="stable")]
        half = min(max(int(np.searchsorted(np.cumsum(n[order]), n[order].sum() / 2)), 1), len(order) - 1)
        parts += [order[:half], order[half:]]
    return group


class _Map:
    """Pivots with what is known of their cells, for the tasks."""

    def __init__(self, pivots: np.ndarray, rows: list, group_rows: int):
        self.pivots = pivots
        self.n = np.zeros(len(pivots), np.int64)
        self.least, self.most = np.full(len(pivots), np.inf), np.zeros(len(pivots))
        for r in rows:
            self.n[r["cell"]], self.least[r["cell"]], self.most[r["cell"]] = r["n"], r["least"], r["most"]
        self.between = distances(pivots, pivots)
        self.group = grouped_cells(pivots, self.n, group_rows)
        self.scale = 1 + float(np.linalg.norm(pivots, axis=1).max(initial=0)) + float(self.most.max(initial=0))  # rounding grows with it

    def nearest_cells(self, far: np.ndarray, need: int, probes: int) -> np.ndarray:
        """Marks, per query, the nearest cells: ``probes`` of them that have items, and as many more as it takes to hold ``need`` items."""
        order = np.argsort(np.where(self.n > 0, far, np.inf), axis=1, kind="stable")
        held = self.n[order]
        taken = np.cumsum(held, axis=1) - held < need
        taken |= np.arange(len(self.n))[None] < probes
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, taken & (held > 0), axis=1)
        return out

    def possible(self, far: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells that can hold an item within ``reach`` of the query."""
        home = far.argmin(1)
        nearest = far[np.arange(len(far)), home]
        bound = np.maximum(far - self.most, self.least - far)
        gap = self.between[home]
        wide = gap > 1e-4 * self.scale
        beyond = np.where(wide, (far**2 - nearest[:, None] ** 2) / (2 * np.where(wide, gap, 1)), 0)
        return (np.maximum(bound, beyond) <= reach[:, None] + SLACK * self.scale) & (self.n > 0)


def _placed(df: DataFrame, pivots, name: str) -> DataFrame:
    """``id, vector, cell, d``: each row's cell and its distance to the pivot, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                far = distances(matrix(part.column("vector")), pivots.value)
                home = far.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(home.astype(np.int64)), pa.array(far[np.arange(len(far)), home])], names=["id", "vector", "cell", "d"])

    path = scratch_path(df.sparkSession, name)
    schema = "id bigint, vector array<double>, cell bigint, d double"
    df.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _sent(queries: DataFrame, known, need: int, probes: int, second: bool) -> DataFrame:
    """Queries copied to the groups of their cells of the first round, or with their ``reach`` to those of all others that are possible; ``cells`` and ``far``, the distances to the pivots, lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                far = distances(matrix(part.column("vector")), m.pivots)
                first = m.nearest_cells(far, need, probes)
                reach = np.asarray(part.column("reach"), np.float64)
                q, c = np.nonzero(m.possible(far, reach) & ~first if second else first)
                order = np.lexsort((c, m.group[c], q))
                q, c = q[order], c[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(q) != 0) | (np.diff(m.group[c]) != 0)])[: len(q)])
                ends = pa.array(np.concatenate([new, [len(q)]]).astype(np.int32))
                whole = part.take(pa.array(q[new]))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(far[q, c]))]
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(m.group[c[new]]), *lists], names=["id", "vector", "reach", "group", "cells", "far"])

    return queries.select("id", "vector", "reach").mapInArrow(run, "id bigint, vector array<double>, reach double, group bigint, cells array<int>, far array<double>")


class Items:
    """Vectors to compare with, and their form for a first comparison by halves of doubles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, metric: str, marks: np.ndarray | None = None):
        self.ids, self.vectors, self.marks = ids, vectors, marks
        size = np.linalg.norm(vectors, axis=1)
        self.most, self.least = float(size.max(initial=0)), float(size[size > 0].min(initial=np.inf))
        self.form = vectors if metric == "cosine" else np.column_stack([vectors, size**2 / -2])
        self.short = self.form.astype(np.float32) if self.most < SHORT_SIZES[1] else None

    def part(self, at) -> Items:
        out = object.__new__(Items)
        out.most, out.least = self.most, self.least
        for name in ("ids", "vectors", "form", "short", "marks"):
            setattr(out, name, None if (x := getattr(self, name)) is None else x[at])
        return out


class Search:
    """The best ``k`` items of each query among those it meets.

    A product of short floats says which pairs can come up to the query's ``k``-th best so far, or to its reach; only those are scored in doubles. With ``marks``, a row of numbers for each query, only
    pairs count that have the same mark in one column at least.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, skip_self: bool, earlier_only: bool, reach: np.ndarray, compared=None, marks: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.metric, self.skip_self, self.earlier_only, self.compared, self.marks = ids, vectors, k, metric, skip_self, earlier_only, compared, marks
        self.size = np.linalg.norm(vectors, axis=1)
        self.bound = np.array(reach, np.float64)
        form = vectors if metric == "cosine" else np.column_stack([vectors, np.ones(len(ids))])
        some = self.size[self.size > 0]
        self.fits = len(some) == 0 or (some.min() > SHORT_SIZES[0] and some.max() < SHORT_SIZES[1])
        self.form, self.short = form, form.astype(np.float32) if self.fits else None
        self.best = np.full((len(ids), k), -np.inf)
        self.out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def meet(self, mine: np.ndarray, items: Items) -> None:
        """``mine`` are places of queries, none twice."""
        k, dim = self.k, self.vectors.shape[1]
        if self.earlier_only:
            early = items.ids < self.ids[mine].max()
            if not early.all():
                items = items.part(np.flatnonzero(early))
        n = len(items.ids)
        if not n:
            return
        if self.compared is not None:
            self.compared.add(len(mine) * n)
        brief = self.fits and items.short is not None and items.least > SHORT_SIZES[0]
        s = self.short[mine] @ items.short.T if brief else self.form[mine] @ items.form.T
        size, bound = self.size[mine], self.bound[mine]
        slack = SLACK * (1 + size.max() + items.most)
        error = (dim + 8) * (2.0**-23 if brief else 2.0**-51) * items.most * (size + items.most)
        floor = 1 - (bound + slack) ** 2 / 2 - slack if self.metric == "cosine" else (size**2 - (bound + slack) ** 2) / 2
        floor = floor - error
        if np.isinf(bound).any():  # the best of these, that later ones must come up to
            if self.skip_self:
                s[self.ids[mine][:, None] == items.ids[None]] = -np.inf
            if self.earlier_only:
                s[self.ids[mine][:, None] <= items.ids[None]] = -np.inf
            if self.marks is not None:
                same = np.zeros(s.shape, bool)
                for a, b in zip(self.marks[mine].T, items.marks.T):
                    same |= a[:, None] == b[None]
                s[~same] = -np.inf
            if n > k:
                floor = np.maximum(floor, np.partition(s, n - k, axis=1)[:, n - k] - 2 * error)
        floor = np.maximum(floor, -np.finfo(s.dtype).max)  # -inf is for pairs that don't count
        hit = np.flatnonzero(s >= np.nextafter(floor.astype(s.dtype), s.dtype.type(-np.inf))[:, None]) if brief else np.flatnonzero(s >= floor[:, None])
        for a in range(0, len(hit), HIT_ROWS):
            self._score(mine, items, *np.divmod(hit[a : a + HIT_ROWS], n), slack)

    def _score(self, mine: np.ndarray, items: Items, r: np.ndarray, c: np.ndarray, slack: float) -> None:
        who = mine[r]
        keep = np.ones(len(r), bool)
        if self.skip_self:
            keep &= self.ids[who] != items.ids[c]
        if self.earlier_only:
            keep &= self.ids[who] > items.ids[c]
        if self.marks is not None:
            keep &= (self.marks[who] == items.marks[c]).any(1)
        who, c = who[keep], c[keep]
        x, near = self.vectors[who], items.vectors[c]
        exact = (near * x).sum(1) + 0.0 if self.metric == "cosine" else -np.sqrt(((near - x) ** 2).sum(1))
        bound = self.bound[who] + slack
        keep = exact >= (1 - bound**2 / 2 - slack if self.metric == "cosine" else -bound)
        who, c, exact = who[keep], c[keep], exact[keep]
        if not len(who):
            return
        order = np.lexsort((items.ids[c], -exact, who))
        who, c, exact = who[order], c[order], exact[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < self.k
        who, c, exact, nth = who[keep], c[keep], exact[keep], nth[keep]
        self.out.append((who, items.ids[c], exact))
        self.held += len(who)
        some, at = np.unique(who, return_inverse=True)
        new = np.full((len(some), self.k), -np.inf)
        new[at, nth] = exact
        both = np.concatenate([self.best[some], new], 1)
        self.best[some] = np.partition(both, self.k, axis=1)[:, self.k :]
        last = self.best[some].min(1)
        self.bound[some] = np.minimum(self.bound[some], np.sqrt(np.maximum(2 - 2 * last, 0)) if self.metric == "cosine" else -last)
        if self.held > 4 * self.k * len(self.ids) + HIT_ROWS:
            self._cut(np.arange(len(self.ids)))

    def _cut(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the best of each, by ``of`` of its place."""
        if self.out:
            who, ids, exact = (np.concatenate(c) for c in zip(*self.out))
            group = of[who]
            order = np.lexsort((ids, -exact, group))
            group = group[order]
            order = order[np.arange(len(group)) - np.searchsorted(group, group) < self.k]
            self.out = [(who[order], ids[order], exact[order])]
            self.held = len(order)
            return self.out[0]
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def result(self) -> pa.Table:
        who, ids, exact = self._cut(self.ids)
        return pa.table([pa.array(self.ids[who].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(exact)], names=["query_id", "item_id", "score"])

    @staticmethod
    def of_nothing() -> pa.Table:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "item_id", "score"])


def _compared(sent: DataFrame, placed: DataFrame, groups: DataFrame, k: int, metric: str, skip_self: bool, earlier_only: bool, cells: Cells, compared) -> DataFrame:
    """The best ``k`` items of each query in each block of a group of cells that it was sent to."""
    asked = cut_lineage(sent.groupBy("group").agg(F.count("*").alias("asked")))
    sizes = groups.groupBy("group").agg(F.sum("n").alias("n")).join(asked, "group", "left")
    count = lambda n, block: F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(0)) / block), F.lit(1)).cast("int")
    blocks = cut_lineage(sizes.select("group", count("n", cells.item_block).alias("i_blocks"), count("asked", cells.query_block).alias("q_blocks")))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    on = ["group", "i_block", "q_block"]
    q = sent.join(F.broadcast(blocks), "group").withColumn("q_block", own("q_blocks")).withColumn("i_block", upto("i_blocks")).select("id", "vector", "reach", "cells", "far", *on)
    i = placed.join(F.broadcast(groups.select("cell", "group")), "cell").join(F.broadcast(blocks), "group")
    i = i.withColumn("i_block", own("i_blocks")).withColumn("q_block", upto("q_blocks")).select("id", "vector", "cell", "d", *on)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return Search.of_nothing()
        column = lambda t, c: t.column(c).combine_chunks()
        search = Search(column(left, "id").to_numpy(), matrix(column(left, "vector")), k, metric, skip_self, earlier_only, column(left, "reach").to_numpy(), compared)
        lists = column(left, "cells")
        at = np.repeat(np.arange(len(left)), np.diff(lists.offsets.to_numpy()))
        wanted, far = lists.flatten().to_numpy(), column(left, "far").flatten().to_numpy()
        # with earlier items only, queries of like ids go together, so that later items can be left out for all of them
        band = np.argsort(np.argsort(search.ids)) * ID_BANDS // len(left) if earlier_only else np.zeros(len(left), np.int64)
        order = np.lexsort((far, band[at], wanted))
        at, wanted, far = at[order], wanted[order], far[order]
        all_d, cell_of = column(right, "d").to_numpy(), column(right, "cell").to_numpy()
        order = np.lexsort((all_d, cell_of))
        all_d, cell_of, all_ids, all_items = all_d[order], cell_of[order], column(right, "id").to_numpy()[order], matrix(column(right, "vector"))[order]
        for cell in np.unique(cell_of):
            s0, s1 = np.searchsorted(cell_of, [cell, cell + 1])
            q0, q1 = np.searchsorted(wanted, [cell, cell + 1])
            items, d = Items(all_ids[s0:s1], all_items[s0:s1], metric), all_d[s0:s1]
            for first in range(q0, q1, QUERY_ROWS):
                mine, of = at[first : min(first + QUERY_ROWS, q1)], far[first : min(first + QUERY_ROWS, q1)]
                bound = search.bound[mine] + SLACK * (1 + search.size[mine].max() + items.most)
                a, b = int(np.searchsorted(d, of - bound).min()), int(np.searchsorted(d, of + bound, side="right").max())
                if a < b:
                    search.meet(mine, items.part(slice(a, b)))
        return search.result()

    return q.groupBy(*on).cogroup(i.groupBy(*on)).applyInArrow(nearest, NEAR)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _widest(least: float | None, metric: str) -> float:
    return math.inf if least is None else math.sqrt(max(0.0, 2 - 2 * least)) if metric == "cosine" else -least


def _scanned(some: pa.Table, q: DataFrame, i: DataFrame, k: int, metric: str, skip_self: bool, earlier_only: bool, least: float | None, compared) -> DataFrame:
    """The best ``k`` of every task's items for each of a few queries: one pass over the items, which stay where they are. Under cosine, an item without direction scores 0 as a vector of zeros."""
    directed = some.filter(pc.is_valid(some.column("vector")))
    ids, vectors = directed.column("id").to_numpy(), matrix(directed.column("vector").combine_chunks())
    asked = i.sparkSession.sparkContext.broadcast((ids, vectors))
    reach = _widest(least, metric)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked.value
        search = Search(ids, vectors, k, metric, skip_self, earlier_only, np.full(len(ids), reach), compared)
        for batch in batches:
            for a in range(0, batch.num_rows if len(ids) else 0, rows := max(1, SCAN_PAIRS // max(len(ids), 1))):
                part = batch.slice(a, rows)
                held = part.column("vector").is_valid().to_numpy(zero_copy_only=False)
                m = np.zeros((part.num_rows, vectors.shape[1]))
                m[held] = matrix(part.column("vector").drop_null()) if held.any() else 0
                items = Items(part.column("id").to_numpy(), m, metric)
                for first in range(0, len(ids), QUERY_ROWS):
                    search.meet(np.arange(first, min(first + QUERY_ROWS, len(ids))), items)
        yield from search.result().to_batches()

    found = (i if metric == "cosine" else i.where("vector IS NOT NULL")).mapInArrow(scan, NEAR)
    if metric == "cosine" and directed.num_rows < some.num_rows:
        found = found.unionByName(_without_direction(q.where("vector IS NULL"), i, k + 1, skip_self, earlier_only))
    return found


def nearest(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", skip_self: bool = True, earlier_only: bool = False, least: float | None = None,
            probes: int | None = None, cells: Cells = Cells(), compared=None) -> DataFrame:
    """The ``k`` nearest items of each query, exact, or among the ``probes`` nearest cells.

    ``earlier_only`` takes only items with a smaller id than the query's, ``least`` only scores of at least that, which spares cells. ``compared``, an accumulator, counts the
    pairs whose scores were computed.
    """
    spark: SparkSession = queries.sparkSession
    extra = k + 1
    of = lambda df: _directed(df.select(F.col("id").cast("long").alias("id"), "vector"), metric)
    q, i = of(queries), of(items)
    if probes is None and (some := q.limit(FEW_QUERIES + 1).toArrow()).num_rows <= FEW_QUERIES:
        found = _scanned(some, q, i, k, metric, skip_self, earlier_only, least, compared)
        if least is not None:
            found = found.where(F.col("score") >= least)
        return cut_lineage(top_per_group(found, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank"))
    few = _stored(top_per_group(i.where("vector IS NOT NULL"), ["vector"], ["id"], extra), "neighbour-vectors")  # of equal vectors the smallest ids
    pivots, n = fit_pivots(few, cells)
    found = spark.createDataFrame([], NEAR)
    if n:
        shared = spark.sparkContext.broadcast(pivots)
        placed = _placed(few, shared, "neighbour-items")
        sizes = cut_lineage(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most")))
        held = sizes.collect()  # a row per pivot
        cell_map = _Map(pivots, held, cells.item_block)
        known = spark.sparkContext.broadcast(cell_map)
        groups = spark.createDataFrame([(r["cell"], r["n"], int(cell_map.group[r["cell"]])) for r in held], "cell bigint, n bigint, `group` bigint")
        widest = _widest(least, metric)
        asking = q.where("vector IS NOT NULL").withColumn("reach", F.lit(widest))
        first = cut_lineage(_compared(_sent(asking, known, extra, probes or 1, False), placed, groups, k, metric, skip_self, earlier_only, cells, compared))
        found = first
        if probes is None:
            edge = first.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False)[k - 1].alias("kth"))  # k for each block of the first cells
            reach = F.sqrt(F.greatest(F.lit(2.0) - 2 * F.col("kth"), F.lit(0.0))) if metric == "cosine" else -F.col("kth")
            edge = edge.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, reach).alias("kth"))
            again = q.where("vector IS NOT NULL").join(edge, "id", "left").withColumn("reach", F.least(F.coalesce("kth", F.lit(math.inf)), F.lit(widest)))
            found = first.unionByName(_compared(_sent(again, known, extra, 1, True), placed, groups, k, metric, skip_self, earlier_only, cells, compared))
    if metric == "cosine":
        found = found.unionByName(_without_direction(q, i, extra, skip_self, earlier_only))
    if least is not None:
        found = found.where(F.col("score") >= least)
    return cut_lineage(top_per_group(found, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank"))  # not searched again by whoever reads it twice


def _without_direction(q: DataFrame, i: DataFrame, extra: int, skip_self: bool, earlier_only: bool) -> DataFrame:
    """Pairs of score 0: every query with the smallest ids that have no direction, and queries without one with the smallest ids of all."""
    none = [r[0] for r in i.where("vector IS NULL").orderBy("id").limit(extra).select("id").collect()] if not q.where("vector IS NOT NULL").isEmpty() else []
    low = [r[0] for r in i.orderBy("id").limit(extra).select("id").collect()] if not q.where("vector IS NULL").isEmpty() else []
    some = lambda ids: F.array(*[F.lit(x).cast("long") for x in ids]).cast("array<long>")
    pairs = q.select(F.col("id").alias("query_id"), F.explode(F.when(F.col("vector").isNull(), some(low)).otherwise(some(none))).alias("item_id"), F.lit(0.0).alias("score"))
    if skip_self:
        pairs = pairs.where("query_id <> item_id")
    return pairs.where("item_id < query_id") if earlier_only else pairs
