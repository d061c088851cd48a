"""Repetition inside a text, by suffix array and longest-common-prefix intervals over its words.

A suffix array of the word sequence puts equal stretches next to each other; the longest common prefix (LCP) of
neighbours tells how long they are. An LCP interval whose suffixes are preceded by different words is a maximal
repeated substring: it can't be made longer on either side. The union of the spans of all maximal repeats of at least
``min_words`` words is the repeated part of the text. A text is rejected when that part or its longest repeat is too large.

Words are runs of anything but ASCII white space, compared as they stand. Everything about a text is found inside one
task, over the whole text; no shuffle takes place, so neither a hot source nor groups of copies matter.

Null texts and texts without words have no words and count 0 everywhere. Repeated rows give repeated result rows, ids may
be null, other columns are ignored by ``measure`` and kept by ``keep``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenframe.llm.common import chunks, texts_of

SYMBOLS = b"#*$%&|<>"
ASCII_SPACE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Limits:
    """A text is kept if it passes all of these."""

    least_words: int = 10
    window: int = 5  # words; the base rule counts words in windows that occur twice
    most_window_percent: int = 20
    min_words: int = 3  # shortest maximal repeat that counts for the two limits below
    most_covered_percent: int = 30
    longest_repeat: int = 50  # words


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array by prefix doubling, and the ranks of all substrings of 1, 2, 4, … symbols.

    Only suffixes that are still tied are sorted again, so ordinary prose needs a few rounds over few rows.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    rank = starts[inverse]
    tied = np.flatnonzero(counts[inverse] > 1)
    levels, step = [rank.astype(np.int32)], 1
    while len(tied):
        ahead = tied + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[tied]))
        tied, second = tied[order], second[order]
        old = rank[tied]
        place = np.arange(len(tied))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        first_of_old = np.maximum.accumulate(np.where(new_old, place, 0))
        new_run = new_old | np.concatenate(([True], second[1:] != second[:-1]))
        first_of_run = np.maximum.accumulate(np.where(new_run, place, 0))
        rank = rank.copy()
        rank[tied] = old + first_of_run - first_of_old
        levels.append(rank.astype(np.int32))
        run_size = np.diff(np.concatenate((np.flatnonzero(new_run), [len(tied)])))
        tied = tied[np.repeat(run_size > 1, run_size)]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """LCP of each suffix with the one before it in the array, where it reaches ``least``; else 0."""
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    sure = min(least.bit_length() - 1, len(levels) - 1)
    at = np.flatnonzero(levels[sure][order[1:]] == levels[sure][order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    length = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << k
    out[at] = np.where(length >= least, length, 0)
    return out


def lcp_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, first, last) of every interval of the suffix array whose suffixes share a prefix that ends there."""
    found = []
    live = np.flatnonzero(lcp)
    if not len(live):
        return found
    cuts = np.flatnonzero(np.diff(live) > 1)
    for first, last in zip(live[np.concatenate(([0], cuts + 1))].tolist(), live[np.concatenate((cuts, [len(live) - 1]))].tolist()):
        values = lcp[first : last + 1].tolist()
        if len(values) == 1:
            found.append((values[0], first - 1, first))
            continue
        stack: list[tuple[int, int]] = []
        for k, v in enumerate((*values, 0), first):
            left = k - 1
            while stack and stack[-1][0] > v:
                length, left = stack.pop()
                found.append((length, left, k - 1))
            if v and (not stack or stack[-1][0] < v):
                stack.append((v, left))
    return found


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """The LCP intervals that can't be extended to the left either."""
    before = np.where(order > 0, symbols[order - 1], -1)
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    return [(n, a, b) for n, a, b in lcp_intervals(lcp) if changes[a] != changes[b]]


def covered(order: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """True for each position inside the union of the spans [p, p + reach of p)."""
    edge = np.zeros(len(order) + 1, np.int64)
    live = np.flatnonzero(reach)
    np.add.at(edge, live, 1)
    np.add.at(edge, live + reach[live], -1)
    return np.cumsum(edge[:-1]) > 0


class _Words:
    """The words of several texts as one sequence of symbols that never match across texts."""

    def __init__(self, texts: list[bytes | None]):
        ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.split = [t.split() if t else [] for t in texts]
        self.sizes = np.fromiter(map(len, self.split), np.int64, len(texts))
        flat = np.fromiter((ids[w] for ws in self.split for w in ws), np.int64, int(self.sizes.sum()))
        self.text = np.repeat(np.arange(len(texts)), self.sizes)
        self.symbols = self.text * (len(ids) + 1) + flat


def _profile(texts: list[bytes | None], limits: Limits) -> dict[str, np.ndarray]:
    words = _Words(texts)
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_repeat_words", "covered_words", "longest_repeat", "n_maximal_repeats")}
    out["n_words"] = words.sizes
    if len(words.symbols) < 2:
        return out
    order, levels = suffix_array(words.symbols)
    for name, least in (("n_repeat_words", limits.window), ("covered_words", limits.min_words)):
        lcp = common_prefixes(order, levels, least)
        reach = np.zeros(len(order), np.int64)
        reach[order] = np.maximum(lcp[:-1], lcp[1:])  # the longest repeat that starts at each word
        # Where that repeat isn't maximal, the maximal one that holds it starts further left and covers it too.
        out[name] = np.bincount(words.text[covered(order, reach)], minlength=n)
    np.maximum.at(out["longest_repeat"], words.text, reach)
    found = maximal_repeats(words.symbols, order, lcp[:-1])
    np.add.at(out["n_maximal_repeats"], words.text[order[np.array([a for _, a, _ in found], np.int64)]], 1)
    return out


def _base(text: bytes | None, chars: int) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    if not text:
        return 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    blank = len(text) - len(text.translate(None, ASCII_SPACE))
    return chars - blank, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines))


def _measured(texts: pa.Array, limits: Limits) -> dict[str, pa.Array]:
    raw = texts.cast(pa.binary()).to_pylist()
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    got = _profile(raw, limits)
    base = np.array([_base(t, c) for t, c in zip(raw, chars)], np.int64).reshape(-1, 3)
    words = got["n_words"]
    failed = (words < limits.least_words) | (100 * got["n_repeat_words"] > limits.most_window_percent * words)
    kept = ~failed & (100 * got["covered_words"] <= limits.most_covered_percent * words) & (got["longest_repeat"] <= limits.longest_repeat)
    return {
        "n_words": pa.array(words), "word_chars": pa.array(base[:, 0]), "n_symbols": pa.array(base[:, 1]),
        "n_dup_lines": pa.array(base[:, 2]), "n_repeat_words": pa.array(got["n_repeat_words"]),
        "base_failed": pa.array(failed), "kept": pa.array(kept), "covered_words": pa.array(got["covered_words"]),
        "longest_repeat": pa.array(got["longest_repeat"]), "n_maximal_repeats": pa.array(got["n_maximal_repeats"]),
    }


MEASURED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_words long, longest_repeat long, n_maximal_repeats long"
)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``docs``: counts, the repeated part, the longest repeat (words), and whether the text is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **_measured(part.column("text"), limits)})

    return texts_of(docs, id_col, text_col).mapInArrow(run, MEASURED)


def keep(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                yield part.filter(_measured(part.column(text_col).cast(pa.string()), limits)["kept"])

    return docs.mapInArrow(run, docs.schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 3) -> DataFrame:
    """Every maximal repeat of every text: first occurrence (word number), length in words, number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = _Words(part.column("text").cast(pa.binary()).to_pylist())
                if len(words.symbols) < 2:
                    continue
                order, levels = suffix_array(words.symbols)
                found = maximal_repeats(words.symbols, order, common_prefixes(order, levels, min_words)[:-1])
                starts = np.concatenate(([0], np.cumsum(words.sizes)))
                first = [int(order[a : b + 1].min()) for _, a, b in found]
                ids = part.column("doc_id").to_pylist()
                at = words.text[np.array(first, np.int64)].tolist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([ids[t] for t in at], pa.int64()),
                    "first_word": pa.array([p - int(starts[t]) for p, t in zip(first, at)], pa.int64()),
                    "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                    "n_times": pa.array([b - a + 1 for _, a, b in found], pa.int64()),
                    "words": pa.array([b" ".join(words.split[t][p - int(starts[t]) : p - int(starts[t]) + n]).decode() for (n, _, _), p, t in zip(found, first, at)], pa.string()),
                })

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, first_word long, n_words long, n_times long, words string")
