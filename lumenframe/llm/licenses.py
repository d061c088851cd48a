"""License scan: exact set-similarity join of text blocks with license templates.

A text is cut into blocks of consecutive words that overlap by half, whatever lines they stand on, so a notice wrapped at any width is met whole. A template's blocks
have ``block_words`` words, doubled until they hold twice the template: a copy of it lies inside some block. A block matches a template if
it holds at least ``percent`` of the template's distinct words. Only words of templates can matter; they are ordered by the number
of texts that hold them, over the whole corpus, rare ones first. Templates are sentences and the full texts of ``license_texts``.

* Prefix filter: a block that misses all of a template's ``size - needed + 1`` rarest words can't reach ``needed``.
* Length filter: neither can a block with fewer than ``needed`` template words.
* Positional filter: from the place of the first common word in both orders, the words that follow bound the overlap.

What passes is counted. The filters lose nothing: every matching block is found. Templates are a parameter of bounded size and
travel with the tasks; one count per template word comes back to the driver. No text meets another, so there is no skew.

Besides, fixed phrases are counted wherever their words stand consecutively.

Words are runs of digits, ASCII letters (made lower case) and all characters beyond ASCII. Null texts count as empty. Texts without words have no places,
no labels and score 0. Repeated rows give repeated result rows; ids may be null; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import license_texts
from lumenframe.llm.common import chunks, texts_of

# Wording of public license notices, and the label of each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
)

# Phrases counted by place, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Keeps 0-9, a-z and bytes beyond ASCII, lowers A-Z, turns the rest into spaces.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@dataclass(frozen=True)
class Scan:
    percent: int = 90  # of a template's distinct words
    block_words: int = 64  # for templates of up to half as many words
    templates: tuple[tuple[str, str], ...] = TEMPLATES + license_texts.TEXTS
    phrases: tuple[tuple[str, str], ...] = field(default=PHRASES)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def block_size(template: str, least: int) -> int:
    size = least
    while size < 2 * len(words_of(template.encode())):
        size *= 2
    return size


def blocks_of(words: list[bytes], size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of each block."""
    for k in range(0, max(len(words) - size // 2, 1), size // 2) if words else ():
        yield k, words[k : k + size]


class Index:
    """Templates of one block size with their words in the global order, and the prefix lists that lead to them."""

    def __init__(self, scan: Scan, size: int, rank: dict[bytes, int]):
        self.size, self.rank = size, rank
        self.numbers = [k for k, (_, t) in enumerate(scan.templates) if block_size(t, scan.block_words) == size]
        self.labels = [scan.templates[k][0] for k in self.numbers]
        self.sets = [sorted(rank[w] for w in set(words_of(scan.templates[k][1].encode()))) for k in self.numbers]
        self.needed = [-(-scan.percent * len(s) // 100) for s in self.sets]
        self.lists: dict[int, list[tuple[int, int]]] = {}
        for k, (s, needed) in enumerate(zip(self.sets, self.needed)):
            for place, r in enumerate(s[: len(s) - needed + 1]):
                self.lists.setdefault(r, []).append((k, place))
        self.prefix = frozenset(w for w, r in rank.items() if r in self.lists)

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template by place in this index, number of its words in the block) of every template that the block reaches."""
        held = sorted(self.rank[w] for w in set(words) if w in self.rank)
        out, seen = [], set()
        for q, r in enumerate(held):
            for k, p in self.lists.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)  # r is the first common word: none before it is in both
                mine, needed = self.sets[k], self.needed[k]
                if len(held) < needed or min(len(mine) - p, len(held) - q) < needed:
                    continue
                common = len(set(mine).intersection(held))
                if common >= needed:
                    out.append((k, common))
        return out


def indexes(scan: Scan, frequency: dict[str, int]) -> list[Index]:
    """One for each block size; the words of all templates are ranked together, rare ones first."""
    vocabulary = sorted({w for _, t in scan.templates for w in words_of(t.encode())}, key=lambda w: (frequency.get(w.decode(), 0), w))
    rank = {w: k for k, w in enumerate(vocabulary)}
    return [Index(scan, size, rank) for size in sorted({block_size(t, scan.block_words) for _, t in scan.templates})]


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Numbers of the words where the phrase starts."""
    out, at = [], -1
    for _ in range(words.count(phrase[0])):
        at = words.index(phrase[0], at + 1)
        if words[at : at + len(phrase)] == phrase:
            out.append(at)
    return out


def word_frequency(docs: DataFrame, scan: Scan = Scan(), text_col: str = "text") -> dict[str, int]:
    """In how many rows each template word stands; summed per task, then over all tasks."""
    vocabulary = frozenset(w for _, t in scan.templates for w in words_of(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                if text.is_valid:
                    n.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    rows = texts_of(docs, text_col, text_col).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # one row per template word at most


def _indexed(docs: DataFrame, scan: Scan, id_col: str, text_col: str):
    return texts_of(docs, id_col, text_col), indexes(scan, word_frequency(docs, scan, text_col))


def matching_blocks(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every block that reaches a template: first word, number of words, label, template number, share of the template."""
    texts, sizes = _indexed(docs, scan, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for id_, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    words = words_of(text) if text else []
                    there = set(words)
                    for index in sizes:
                        if not index.prefix.isdisjoint(there):
                            for first, block in blocks_of(words, index.size):
                                rows += [(id_, first, len(block), index.labels[k], index.numbers[k], c / len(index.sets[k])) for k, c in index.matches(block)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())
                names = ("doc_id", "first_word", "n_words", "label", "template", "containment")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))

    return texts.mapInArrow(run, "doc_id long, first_word long, n_words long, label string, template long, containment double")


def scan(docs: DataFrame, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: words, phrase places, labels, and a score: 1 with a phrase, else the best containment of a match."""
    texts, sizes = _indexed(docs, scan, id_col, text_col)
    phrases = [(p.encode().split(), label) for p, label in scan.phrases]

    def one(text: bytes | None) -> tuple:
        words = words_of(text) if text else []
        there = set(words)
        starts, base = [], set()
        for phrase, label in phrases:
            if there.issuperset(phrase):
                places = phrase_places(words, phrase)
                starts += places
                base.update([label] if places else [])
        best, labels = 0.0, set(base)
        for index in sizes:
            for _, block in () if index.prefix.isdisjoint(there) else blocks_of(words, index.size):
                for k, common in index.matches(block):
                    labels.add(index.labels[k])
                    best = max(best, common / len(index.sets[k]))
        score = 1.0 if starts else best
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            for part in chunks(batch):
                rows = [one(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
