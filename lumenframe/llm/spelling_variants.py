"""Groups spelling variants: words one inserted, deleted or replaced letter apart, each led to its most frequent spelling.

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case, counted over all texts; those with enough letters and occurrences
are kept. A word is a point in the space of its letter counts. One edit moves a point by at most two: a replacement takes one letter and
adds one (equal lengths), an insertion adds one (lengths L and L + 1). So for each pair of lengths the neighbours of a word lie in a small box
around its point, and a k-d tree finds them without looking at most of the others:

1. For each length with more than ``cell_words`` words, a tree over a bounded sample of its words cuts the space into boxes of about that many words
   (shorter lists are one box). The sample, about ``sample_words`` words with small hashes, only decides where the cuts are.
2. Each word goes to its own box as a point, and as a query to every box of its length and of the next that one edit can reach; boxes out of
   reach are pruned while the tree is walked down. Each pair of words is met once: from the shorter one, or from the one that sorts first.
3. A task has the points of one box at a time, under a k-d tree of their own, and takes its queries in batches. Leaves compare bit patterns of
   letter counts first; the letters' order is then verified for every pair that is left. No pair is lost or capped, and no list of pairs exists but the verified ones.

A word's form is its near word with most occurrences, if it has at least ``ratio`` times its own; forms grow by that factor from step to step, so following them ends.
Roots are found by doubling the steps, with the rows cut by reliable checkpoints.

Occurrences may be garbled on purpose by ``typos``: with h the CRC-32 of ``<doc_id>:<run>``, every ``typos``-th hash loses the letter at h modulo its length (a test
of the grouping on known variants); 0 leaves all runs alone. Null texts have no words; a null id is written as an empty string; repeated rows count again; without words the result is empty. Words of any length are
handled; a text is held whole by its task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import chunks, stored, texts_of
from lumenframe.session import cut_lineage

#: In Latin-1, one byte to a letter: A-Z becomes lower case, other letters stay, everything else parts words.
LETTER_BYTES = bytes(
    b if 0x61 <= b <= 0x7A or b >= 0xC0 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
#: Dimension of each letter: a-z, then U+00C0 to U+00FF.
_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
DIMENSIONS = len(_LETTERS)
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[_LETTERS] = np.arange(DIMENSIONS)
#: Levels of a letter's count that the bit pattern tells apart: four for a-z, one for the others; the most telling ones stand in the first 64 bits.
_LEVELS = sorted(((d, level) for d in range(DIMENSIONS) for level in range(4 if d < 26 else 1)), key=lambda x: x[1] if x[0] < 26 else 1.5)
#: Distinct words that a task adds up before it hands them on.
MOST_WORDS = 200_000
LEAF_POINTS = 48
#: Pairs, and letters of pairs, that are compared at a time.
PAIR_BLOCK, LETTER_BLOCK = 1 << 20, 1 << 24
POINT, SAME, SHORTER = 0, 1, 2
ROUTED = "cell long, role int, word string, n long"


@dataclass(frozen=True)
class Variants:
    least_letters: int = 5
    least_n: int = 3
    ratio: int = 2
    typos: int = 97
    cell_words: int = 4_096
    sample_words: int = 65_536


# Words ---------------------------------------------------------------------------------------------


def runs_of(text: str) -> list[bytes]:
    """Latin-1 bytes of the runs; a character beyond Latin-1 becomes a question mark and parts runs like one."""
    return text.encode("latin-1", "replace").translate(LETTER_BYTES).split()


def written(run: bytes, state: int, typos: int) -> bytes:
    """The run as it counts; ``state`` is the CRC-32 of what stands in front of it."""
    if typos:
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), state)
        if h % typos == 0:
            k = h % len(run)
            return run[:k] + run[k + 1 :]
    return run


def count_words(docs: DataFrame, settings: Variants = Variants(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of all words with enough letters and occurrences."""
    least, typos = settings.least_letters, settings.typos

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in chunks(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    state = crc32(b":" if doc_id is None else b"%d:" % doc_id)
                    for run, n in Counter(runs_of(text or "")).items():
                        if len(run) >= least:
                            word = written(run, state, typos)
                            if len(word) >= least:
                                total[word] += n
                if len(total) > MOST_WORDS:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    found = texts_of(docs, id_col, text_col).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= settings.least_n)


# K-d trees over letter counts ----------------------------------------------------------------------


def latin(words: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in words.to_pylist()]


def matrix_of(words: list[bytes]) -> np.ndarray:
    """Letters of words of one length, a row to a word."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts, a row to a word."""
    n = len(letters)
    flat = _DIMENSION[letters] + np.arange(n)[:, None] * DIMENSIONS
    return np.bincount(flat.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.int32)


def patterns_of(counts: np.ndarray) -> np.ndarray:
    """One bit for each level of a count that is passed: words one edit apart differ in two bits at most."""
    bits = np.zeros((len(counts), -(-len(_LEVELS) // 64) * 64), bool)
    for k, (d, level) in enumerate(_LEVELS):
        bits[:, k] = counts[:, d] > level
    return np.packbits(bits, axis=1).view(np.uint64)


class Tree:
    """K-d tree: nodes are ``(dimension, threshold, low child, high child)`` or a leaf's number; counts up to the threshold go low."""

    def __init__(self, counts: np.ndarray, leaf_points: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []
        self.leaves: list[np.ndarray] = []
        self._grow(counts, np.arange(len(counts)), leaf_points)

    def _grow(self, counts: np.ndarray, rows: np.ndarray, most: int) -> int:
        at = len(self.nodes)
        self.nodes.append(len(self.leaves))
        cut = self._cut(counts[rows]) if len(rows) > most else None
        if cut is None:
            self.leaves.append(rows)
            return at
        d, threshold = cut
        low = counts[rows, d] <= threshold
        self.nodes[at] = (d, threshold, self._grow(counts, rows[low], most), self._grow(counts, rows[~low], most))
        return at

    @staticmethod
    def _cut(counts: np.ndarray) -> tuple[int, int] | None:
        """The most even cut of all letters; none if all points are equal."""
        best, most, n = None, 0, len(counts)
        for threshold in range(int(counts.max())):
            low = (counts <= threshold).sum(0)
            even = np.minimum(low, n - low)
            d = int(even.argmax())
            if even[d] <= most and (best is not None or not even[d]):
                if best is not None:
                    break
                continue
            best, most = (d, threshold), int(even[d])
        return best

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(counts), np.int64)
        todo = [(0, np.arange(len(counts)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            d, threshold, a, b = node
            low = counts[rows, d] <= threshold
            todo += [(child, part) for child, part in ((a, rows[low]), (b, rows[~low])) if len(part)]
        return out

    def reach(self, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the rows that come into their box when at most ``more`` letters are added and ``less`` taken away."""
        n = len(counts)
        todo = [(0, np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), {})]
        while todo:
            at, rows, up, down, box = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                yield node, rows
                continue
            d, threshold, a, b = node
            value = counts[rows, d]
            low, high = box.get(d, (0, 1 << 30))
            # What the box asks of this letter already is replaced by what the half of it asks.
            for child, new_low, new_high in ((a, low, min(high, threshold)), (b, max(low, threshold + 1), high)):
                u = up + np.maximum(new_low - value, 0) - np.maximum(low - value, 0)
                v = down + np.maximum(value - new_high, 0) - np.maximum(value - high, 0)
                near = (u <= more) & (v <= less)
                if near.any():
                    todo.append((child, rows[near], u[near], v[near], box | {d: (new_low, new_high)}))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place, where ``b`` has the later letter."""
    other = a != b
    place = other.argmax(1)[:, None]
    return (other.sum(1) == 1) & (np.take_along_axis(a, place, 1) < np.take_along_axis(b, place, 1))[:, 0]


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``long`` that become those of ``short`` when one letter goes: what agrees in front and behind covers the shorter word."""
    n = short.shape[1]
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return front + behind >= n


class Box:
    """The points of one box under a tree of their own."""

    def __init__(self, words: list[bytes]):
        self.letters = matrix_of(words)
        counts = counts_of(self.letters)
        self.tree = Tree(counts, LEAF_POINTS)
        self.patterns = patterns_of(counts)

    def near(self, words: list[bytes], same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of queries (all of the points' length, or all one letter shorter) and of the points that are one edit away.

        Among words of equal length only points that sort behind the query are given.
        """
        letters = matrix_of(words)
        counts = counts_of(letters)
        patterns = patterns_of(counts)
        most = 2 if same else 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf, rows in self.tree.reach(counts, 1, 1 if same else 0):
            points = self.tree.leaves[leaf]
            step = max(1, PAIR_BLOCK // len(points))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                q, p = np.nonzero(np.bitwise_count(patterns[part, 0][:, None] ^ self.patterns[points, 0]) <= most)
                q, p = part[q], points[p]
                close = np.bitwise_count(patterns[q] ^ self.patterns[p]).sum(1) <= most
                found.append((q[close], p[close]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, p = (np.concatenate(x) for x in zip(*found))
        step, kept = max(1, LETTER_BLOCK // self.letters.shape[1]), []
        for k in range(0, len(q), step):
            a, b = letters[q[k : k + step]], self.letters[p[k : k + step]]
            kept.append(one_replaced(a, b) if same else one_inserted(a, b))
        right = np.concatenate(kept) if kept else np.zeros(0, bool)
        return q[right], p[right]


# Routing and search --------------------------------------------------------------------------------


def cuts_of(words: DataFrame, settings: Variants = Variants()) -> dict[int, Tree]:
    """The tree of each length with more words than a box holds, over a sample of about ``sample_words`` words, drawn by hash so that no task sends more than its share.

    With more words than a sixteenth of the sample has boxes for, boxes grow in proportion.
    """
    length = F.length("word")
    many = {r[0]: r[1] for r in words.groupBy(length.alias("l")).count().filter(F.col("count") > settings.cell_words).collect()}
    if not many:
        return {}
    total = sum(many.values())
    share = min(1.0, settings.sample_words / total)
    sample = words.filter(length.isin(list(many)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))).select("word")
    by_length: dict[int, list[bytes]] = {}
    for (word,) in sample.collect():
        by_length.setdefault(len(word), []).append(word.encode("latin-1"))
    return {l: Tree(counts_of(matrix_of(found)), max(16, int(settings.cell_words * share))) for l, found in by_length.items()}


def cell(length: int, leaf: np.ndarray | int) -> np.ndarray | int:
    return leaf + (length << 24)


def near_words(words: DataFrame, settings: Variants = Variants()) -> DataFrame:
    """``word, n, near, near_n``: every pair of words one edit apart, both ways. ``words`` holds distinct ``word`` with ``n``."""
    trees = words.sparkSession.sparkContext.broadcast(cuts_of(words, settings))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.fromiter(map(len, text), np.int64, len(text))
            ways: list[tuple[int, int, np.ndarray]] = []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                counts = counts_of(matrix_of([text[k].encode("latin-1") for k in rows]))
                for role, goal, less in ((POINT, length, 0), (SAME, length, 1), (SHORTER, length + 1, 0)):
                    tree = trees.value.get(goal)
                    if tree is None:
                        parts = [(0, np.arange(len(rows)))]
                    elif role == POINT:
                        home = tree.home(counts)
                        parts = [(leaf, np.flatnonzero(home == leaf)) for leaf in np.unique(home).tolist()]
                    else:
                        parts = tree.reach(counts, 1, less)
                    ways += [(cell(goal, leaf), role, rows[part]) for leaf, part in parts]
            if ways:
                at, sizes = np.concatenate([x[2] for x in ways]), [len(x[2]) for x in ways]
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(np.repeat(np.array([x[0] for x in ways], np.int64), sizes)), "role": pa.array(np.repeat(np.array([x[1] for x in ways], np.int32), sizes)),
                    "word": batch.column("word").take(pa.array(at)), "n": pa.array(n[at]),
                })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by box, its points first."""
        points: list[pa.RecordBatch] = []
        now, box = None, None
        for batch in batches:
            cells, roles = batch.column("cell").to_numpy(), batch.column("role").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                part, role = batch.slice(a, b - a).select(["word", "n"]), int(roles[a])
                if cells[a] != now:
                    now, box, points = cells[a], None, []
                if role == POINT:
                    points.append(part)
                elif points:
                    if box is None:
                        points = [pa.concat_batches(points)]
                        box = Box(latin(points[0].column("word")))
                    q, p = box.near(latin(part.column("word")), role == SAME)
                    left, right = part.take(pa.array(q)), points[0].take(pa.array(p))
                    for x, y in ((left, right), (right, left)):
                        yield pa.RecordBatch.from_arrays([*x.columns, *y.columns], names=["word", "n", "near", "near_n"])

    routed = words.select("word", "n").mapInArrow(route, ROUTED)
    return routed.repartition("cell").sortWithinPartitions("cell", "role").mapInArrow(search, "word string, n long, near string, near_n long")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain of forms. Chains must end; every round doubles the steps taken."""
    ways = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not ways.filter("open").isEmpty():
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("after"))
        ways = cut_lineage(ways.join(on, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("open")))
    return ways.select("word", "root")


def group(docs: DataFrame, settings: Variants = Variants(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts."""
    words = stored(count_words(docs, settings, id_col, text_col), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words, settings).groupBy(F.col("word").alias("w"), F.col("n").alias("m")).agg(F.count("*").alias("n_near"), best)
    near = stored(near.select("w", "n_near", F.when(-F.col("best.less") >= settings.ratio * F.col("m"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")), "variant-forms")
    near = near.select("w", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n"))
    roots = follow(near.filter("form IS NOT NULL").select(F.col("w").alias("word"), "form"))
    out = words.join(near, F.col("word") == F.col("w"), "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
