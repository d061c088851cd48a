"""Near duplicates by an LSH forest: Jaccard similarity of word shingles, exact links, connected components.

1. Texts with the same shingle set form a class; everything below works on one text per class.
2. Each class gets ``hashes`` MinHash values. An order is a fixed permutation of them; sorting the classes by an order puts
   similar ones next to each other, and the longer the common prefix of two neighbours, the more similar they are.
3. Classes with a common prefix of the current depth form a region. Regions of at most ``region`` classes are searched: each pair
   whose signatures agree well enough joins the coarse graph (as a spanning forest, never as a pair list). A crowded region is
   not searched but entered again at the next depth, in more orders. ``orders_for`` gives as many orders as a depth needs so that two
   texts at the threshold share a prefix in one of them but for ``miss``. All orders permute the same MinHash values, so a pair whose signatures agree
   in few places by chance fails in all of them; the chance is taken over the number of places that agree. So a pair that is not found at a depth is
   either one of ``miss``, or both of its texts go to the next depth; one that goes through all depths pays ``miss`` at each. What is
   crowded at the last depth joins the coarse graph as a whole.
4. Coarse groups are verified on the full shingle sets: every pair of a group is counted through an inverted list of the
   group's shingles, and links become a spanning forest. A group beyond ``group_bytes`` is verified in pairs of blocks, each in its own
   task, so that no task holds more than two blocks.
5. Verified links give the components; every text of a class gets the component of its class.

The coarse graph only has to hold true links; it may hold false ones, which step 4 removes.

Texts without words have no shingles and are linked with nothing; fewer words than a shingle make one shingle of
all of them. Null texts count as empty. Rows without an id are linked with nothing, have a null component and are kept; rows that
share an id are one document. Extra columns are ignored by ``components_of`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import LOWER, WordHashes, chunks, components, maybe_members, membership_bits, mixed, named, stored, texts_of, windows


@dataclass(frozen=True)
class Forest:
    words: int = 5
    percent: int = 85  # 100 * intersection >= percent * union
    hashes: int = 128
    depths: tuple[int, ...] = (4, 8, 12, 16)
    miss: float = 1e-6  # chance that a pair at the threshold shares no prefix of a depth
    sigmas: float = 5.0  # how far below its mean the agreement of two signatures may fall
    region: int = 1024  # classes searched together
    group_bytes: int = 48 << 20  # shingle sets verified together
    group_rows: int = 4096
    seed: int = 7

    def miss_of(self, depth: int, orders: int) -> float:
        """Chance that a pair at the threshold shares no prefix of that depth in so many orders of the same hashes."""
        j, h = self.percent / 100, self.hashes
        alike = (math.comb(h, m) * j**m * (1 - j) ** (h - m) for m in range(h + 1))
        return sum(p * (1 - math.comb(m, depth) / math.comb(h, depth)) ** orders for m, p in enumerate(alike))

    def orders_for(self, depth: int) -> int:
        """The least number of orders whose ``miss_of`` is at most ``miss``."""
        high = 1
        while self.miss_of(depth, high) > self.miss:
            high *= 2
        low = high // 2
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.miss_of(depth, middle) > self.miss else (low, middle)
        return high

    def least_agreement(self) -> int:
        j = self.percent / 100
        return math.floor(self.hashes * j - self.sigmas * math.sqrt(self.hashes * j * (1 - j)))


_HASHES = WordHashes()

#: Prefixes that a task holds at a time.
_KEYS = 1 << 17


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    return np.unique(windows(_HASHES.of(text.translate(LOWER).split()), words)) if text else np.empty(0, np.uint64)


def signature(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set, as 32-bit numbers."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 2048):
        low = np.minimum(low, (values[k : k + 2048, None] * factors).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def _factors(forest: Forest) -> np.ndarray:
    return np.random.default_rng(forest.seed).integers(1, 2**63, forest.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _orders(forest: Forest, depth: int) -> np.ndarray:
    """The first ``depth`` hash functions of each order; an order stays the same at every depth."""
    return np.array([np.random.default_rng((forest.seed, k)).permutation(forest.hashes)[:depth] for k in range(forest.orders_for(depth))])


def _sketches(docs: DataFrame, forest: Forest) -> DataFrame:
    """Size, class key and signature of every row's shingle set; no class and no signature for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(forest)
        for batch in batches:
            for part in chunks(batch):
                n, one, two, signatures = [], [], [], []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingles(t, forest.words)
                    n.append(len(s))
                    if len(s):
                        place = np.arange(1, len(s) + 1, dtype=np.uint64)
                        one.append(int(mixed(s + place).sum(dtype=np.uint64).view(np.int64)))
                        two.append(int((mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * (place * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64).view(np.int64)))
                        signatures.append(signature(s, factors).tobytes())
                    else:
                        one.append(None), two.append(None), signatures.append(None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()), "k1": pa.array(one, pa.int64()),
                    "k2": pa.array(two, pa.int64()), "signature": pa.array(signatures, pa.binary()),
                })

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, signature binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def _prefixes(classes: DataFrame, forest: Forest, depth: int) -> DataFrame:
    """``prefix, id`` for every order: equal prefixes of one order have equal hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(forest, depth)
        for batch in batches:
            m = _matrix(batch.column("signature"), forest.hashes)
            ids = np.asarray(batch.column("id"), np.int64)
            step = max(_KEYS // len(orders), 1)
            for k in range(0, len(m), step):
                part = m[k : k + step].astype(np.uint64)
                key = np.empty((len(part), len(orders)), np.uint64)
                for t, order in enumerate(orders):
                    key[:, t] = windows_of_rows(part[:, order], t)
                yield pa.RecordBatch.from_pydict({
                    "prefix": pa.array(key.ravel().view(np.int64)), "id": pa.array(np.repeat(ids[k : k + step], len(orders)))})

    return classes.select("id", "signature").mapInArrow(run, "prefix long, id long")


def windows_of_rows(values: np.ndarray, start: int) -> np.ndarray:
    """One hash for each row of numbers."""
    out = np.full(len(values), start + 1, np.uint64)
    for k in range(values.shape[1]):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return out


def _groups(linked: np.ndarray) -> np.ndarray:
    """Number of the connected component of each node of a small graph given as a square matrix."""
    label = np.full(len(linked), -1)
    for root in range(len(linked)):
        todo = [root] if label[root] < 0 else []
        label[todo] = root
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & (label < 0))
            label[near] = root
            todo += near.tolist()
    return label


def _stars(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from every node to the smallest id of its component."""
    order = np.lexsort((ids, label))
    first = np.concatenate(([True], label[order][1:] != label[order][:-1])) if len(ids) else np.empty(0, bool)
    least = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))] if len(ids) else ids
    apart = ids[order] != least
    return ids[order][apart], least[apart]


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.empty(0, np.int64)]
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})


def _search(forest: Forest):
    """Edges that connect the pairs of each region whose sizes and signatures allow the threshold."""
    least = forest.least_agreement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members"):
                rows = members.as_py()
                ids = np.array([r["id"] for r in rows], np.int64)
                size = np.array([r["n"] for r in rows], np.int64)
                sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
                linked = 100 * np.minimum.outer(size, size) >= forest.percent * np.maximum.outer(size, size)
                for k in range(0, len(rows), 64):
                    linked[k : k + 64] &= (sketch[k : k + 64, None, :] == sketch[None, :, :]).sum(axis=2) >= least
                x, y = _stars(ids, _groups(linked))
                a.append(x), b.append(y)
            yield _edges(a, b)

    return run


def coarse_edges(classes: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``a, b`` of a graph that connects every pair at the threshold, but for ``forest.miss``.

    ``classes``: ``id, n, signature``, one row per id.
    """
    def low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("signature"), forest.hashes).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": batch.column("n"), "sketch": pa.array([r.tobytes() for r in m], pa.binary())})

    edges, todo = None, classes
    for level, depth in enumerate(forest.depths):
        prefixes = _prefixes(todo, forest, depth)
        sizes = stored(prefixes.groupBy("prefix").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1"), "regions")
        calm = sizes.filter(F.col("size") <= forest.region).select("prefix")
        sketches = todo.mapInArrow(low_bytes, "id long, n long, sketch binary")
        members = prefixes.join(calm, "prefix").join(sketches, "id")
        regions = members.groupBy("prefix").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("members"))
        found = regions.select("members").mapInArrow(_search(forest), "a long, b long")
        crowded = sizes.filter(F.col("size") > forest.region)
        more = not crowded.isEmpty()
        if more and level == len(forest.depths) - 1:  # crowded to the end: verified as one group
            found = found.unionByName(prefixes.join(crowded, "prefix").select(F.col("id").alias("a"), F.col("least").alias("b")).filter("a != b"))
        found = stored(found.distinct(), "coarse")
        edges = found if edges is None else edges.unionByName(found)
        if not more:
            break
        again = prefixes.join(crowded.select("prefix"), "prefix").select("id").distinct()
        todo = stored(todo.join(again, "id", "left_semi"), "crowded")
    return edges


def linked_sets(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> np.ndarray:
    """Component of each set over the pairs at the threshold; with ``block`` only over pairs from different blocks."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    new = np.concatenate(([True], values[order][1:] != values[order][:-1]))
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate((start, [len(order)])))
    number = np.empty(len(order), np.int64)  # which distinct shingle stands at each place of ``values``
    number[order] = np.cumsum(new) - 1
    first = np.cumsum(size) - size
    label = np.arange(n)
    for x in range(n - 1):
        mine = number[first[x] : first[x] + size[x]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        c = count[mine]
        at = np.repeat(start[mine] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        common = np.bincount(owner[at], minlength=n)
        near = 100 * common >= percent * (size[x] + size - common)
        near[: x + 1] = False
        if block is not None:
            near &= block != block[x]
        for other in np.unique(label[near]).tolist():
            if other != label[x]:
                label[label == other] = label[x]
    return label


def _verify(forest: Forest):
    def links(ids: list, sets: list, blocks: list, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        label = linked_sets([np.frombuffer(s, np.uint64) for s in sets], forest.percent, None if alone else np.array(blocks))
        return _stars(np.array(ids, np.int64), label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [])

        def close(a: list, b: list) -> None:
            if len(held[0]) > 1:
                x, y = links(*held, key[1] == key[2])
                a.append(x), b.append(y)

        for batch in batches:
            a, b = [], []
            for group, i, j, block, id_, values in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "block", "id", "values"))):
                if (group, i, j) != key:
                    close(a, b)
                    key, held = (group, i, j), ([], [], [])
                for k, v in zip(held, (id_, values, block)):
                    k.append(v)
            yield _edges(a, b)
        a, b = [], []
        close(a, b)
        yield _edges(a, b)

    return run


def verified_edges(texts: DataFrame, groups: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``a, b`` that connect what is linked inside coarse groups; ``groups``: ``id, group, n``, one row per id."""
    size = groups.groupBy("group").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    parts = F.greatest(F.ceil(F.col("total") * 8 / F.lit(forest.group_bytes)), F.ceil(F.col("rows") / F.lit(forest.group_rows)))
    groups = groups.select("id", "group").join(size.select("group", parts.cast("long").alias("parts")), "group")
    groups = stored(groups, "groups")
    bits, n_bits = membership_bits(groups, "id", groups.count())
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                part = part.filter(part.column("doc_id").is_valid())
                part = part.filter(pa.array(maybe_members(np.asarray(part.column("doc_id"), np.int64), shared.value, n_bits)))
                values = [shingles(t, forest.words).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": part.column("doc_id"), "values": pa.array(values, pa.binary())})

    rows = texts.mapInArrow(sets, "id long, values binary").filter(F.length("values") > 0).join(groups, "id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "values")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return rows.mapInArrow(_verify(forest), "a long, b long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``; kept is the smallest id of its component."""
    texts = texts_of(docs, id_col, text_col)
    sketches = stored(_sketches(texts, forest), "sketches")
    of_class = sketches.filter("k1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("k1", "k2")
    classes = stored(of_class.agg(F.min("doc_id").alias("id"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature")), "classes")
    one_per_id = classes.dropDuplicates(["id"]).select("id", "n", "signature")
    groups = components(coarse_edges(one_per_id, forest)).withColumnRenamed("root", "group")
    groups = groups.join(one_per_id.select("id", "n"), "id")
    roots = components(verified_edges(texts, groups, forest))
    found = classes.select("k1", "k2", "id").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = sketches.select("doc_id", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest = Forest()) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all their columns."""
    gone = components_of(docs, id_col, text_col, forest).filter("NOT kept").select(F.col("doc_id").alias("dropped id")).distinct()
    return docs.join(gone, named(id_col).cast("long") == F.col("dropped id"), "left_anti")
