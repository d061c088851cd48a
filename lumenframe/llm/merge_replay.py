"""Byte-level BPE encoding and decoding by replaying the merges over a whole block of texts at once.

Each block of texts is split into pre-tokens by the vocabulary's pattern. The distinct pre-tokens that the task hasn't met yet
form one corpus of linked byte sequences. An inverted index maps the rank of a mergeable neighbour pair to the positions where
the pair stands; ranks are replayed in ascending order over all words together, and a merge touches only its two neighbours:
their new pairs enter the index, stale entries are skipped. A pre-token that is itself in the vocabulary is one token, as in the
tiktoken library. Ids are then read per occurrence, in text order.

The work on a text depends on nothing but the text and the vocabulary, so the job is one pass without a shuffle; a lost task
is simply run again. What a task keeps is bounded: one block of texts, its new words, and a table of about ``MOST_WORDS`` words.

Null texts count as empty: no tokens, digests of the empty string. Repeated rows give repeated result rows; ids may be null.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lumenframe.llm.common import chunks, texts_of

#: Distinct pre-tokens that a task remembers; it starts anew beyond that.
MOST_WORDS = 250_000
#: Text bytes whose new pre-tokens form one corpus.
CORPUS_BYTES = 12 << 20


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary; a token's id is its rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = [str(k) for k in range(size)]
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], np.int64)
        self.none = size  # stands behind the last token of a word
        rows = [
            (self.ranks[t[:k]] * (size + 1) + self.ranks[t[k:]], rank)
            for t, rank in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        rows.sort()
        self._keys = np.array([k for k, _ in rows], np.int64)
        self._rank_of = np.array([r for _, r in rows], np.int64)

    def pairs(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Rank of the token that neighbours merge into, or -1."""
        key = a * (self.none + 1) + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._rank_of[at], -1)


def merge_alone(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word: again and again the leftmost pair of lowest rank."""
    parts = [bytes([c]) for c in word]
    while len(parts) > 1:
        ranks = [vocabulary.ranks.get(a + b, 1 << 40) for a, b in zip(parts, parts[1:])]
        lowest = min(ranks)
        if lowest == 1 << 40:
            break
        k = ranks.index(lowest)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [vocabulary.ranks[p] for p in parts]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and how many each word has.

    ``places`` is the inverted index. A pair that comes earlier in rank than the merge that forms it is possible in
    vocabularies whose tokens split in several ways; words where that happens are merged one by one instead.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(words) else 0
    if not n:
        return np.empty(0, np.int32), sizes
    starts = ends - sizes
    token = np.append(vocabulary.byte[np.frombuffer(b"".join(words), np.uint8)], vocabulary.none)
    right = np.append(np.arange(1, n + 1), n)
    right[ends[sizes > 0] - 1] = n
    left = np.append(np.arange(-1, n - 1), n)
    left[starts[sizes > 0]] = n
    pair = np.append(vocabulary.pairs(token[:n], token[right[:n]]), -1)  # rank of each position with its right neighbour
    live = np.ones(n, bool)
    places: dict[int, list[np.ndarray]] = {}
    todo: list[int] = []
    again: list[np.ndarray] = []

    def note(at: np.ndarray) -> None:
        ranks = pair[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cuts.tolist(), len(at)]
        for rank, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
            if rank in places:
                places[rank].append(at[a:b])
            else:
                places[rank] = [at[a:b]]
                heappush(todo, rank)

    first = np.flatnonzero(pair >= 0)
    if len(first):
        note(first)
    while todo:
        rank = heappop(todo)
        found = places.pop(rank)
        at = np.concatenate(found)
        at = np.unique(at[pair[at] == rank])  # others have lost a neighbour to an earlier merge
        if not len(at):
            continue
        b = right[at]
        if len(at) > 1 and (b[:-1] == at[1:]).any():  # runs of one token: every second place, from the left
            place = np.arange(len(at))
            head = np.concatenate(([True], b[:-1] != at[1:]))
            at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            b = right[at]
        after = right[b]
        token[at] = rank
        live[b] = False
        pair[b] = -1
        right[at] = after
        left[after] = at
        pair[at] = vocabulary.pairs(rank, token[after])
        before = left[at]
        inner = before < n
        before = before[inner]
        pair[before] = vocabulary.pairs(token[before], rank)
        touched = np.concatenate((at, before))
        new = pair[touched]
        touched, new = touched[new >= 0], new[new >= 0]
        if len(touched):
            if (new < rank).any():
                again.append(touched[new < rank])
            note(touched)
    owner = np.repeat(np.arange(len(words)), sizes)
    ids = token[:n][live].astype(np.int32)
    counts = np.bincount(owner[live], minlength=len(words))
    if again:
        redo = set(owner[np.concatenate(again)].tolist())
        lists = np.split(ids, np.cumsum(counts)[:-1])
        for k in redo:
            lists[k] = np.array(merge_alone(words[k], vocabulary), np.int32)
            counts[k] = len(lists[k])
        ids = np.concatenate(lists)
    return ids, counts


def _ranges(chars: str) -> str:
    """Inside of a character set that holds exactly these characters, given in order."""
    out, start = [], 0
    for k in range(1, len(chars) + 1):
        if k == len(chars) or ord(chars[k]) != ord(chars[k - 1]) + 1:
            out.append(f"{re.escape(chars[start])}-{re.escape(chars[k - 1])}")
            start = k
    return "".join(out)


@cache
def character_classes() -> tuple[dict[str, str], str]:
    r"""The characters of ``\p{L}``, ``\p{N}`` and ``\s`` as the tiktoken library sees them, and those about which libraries differ.

    Libraries carry different versions of Unicode. They agree on what the oldest, Python's own, knows; each character that only a
    newer one knows is put to the tiktoken library, behind a letter and behind a digit: it shares a piece with its like.
    """
    import sys
    import unicodedata

    import regex
    import tiktoken

    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    classes = {name: set(regex.findall(name, every)) for name in (r"\p{L}", r"\p{N}", r"\s")}
    doubtful = [c for c in every if unicodedata.category(c) == "Cn" and (c in classes[r"\p{L}"] or c in classes[r"\p{N}"])]
    tokens = {bytes([k]): k for k in range(256)}
    for c in doubtful:
        for before in "a1":
            tokens.setdefault((before + c).encode(), len(tokens))
    probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=tokens, special_tokens={})
    for name, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        classes[name].difference_update(c for c in doubtful if len(probe.encode_ordinary(before + c)) > 1)
    return {name: "".join(sorted(chars)) for name, chars in classes.items()}, "".join(doubtful)


def explicit_classes(pattern: str, top: int = 0x110000) -> str | None:
    r"""The pattern with ``\p{L}``, ``\p{N}`` and ``\s`` written as ranges of the characters below ``top``, for the standard library.

    None if something else in the pattern needs the larger library.
    """
    rest = re.sub(r"\\p\{[LN]\}|\\[sS]", "x", pattern)
    if re.search(r"\\[pPXRKG]|\[\[|&&|[+*?}]\+|\(\?[^:!=]", rest):
        return None
    sets = {name: _ranges("".join(c for c in chars if ord(c) < top)) for name, chars in character_classes()[0].items()}
    parts = re.split(r"(\[[^\]]*\])", pattern)
    for k, part in enumerate(parts):
        inside = k % 2 == 1
        if not inside:
            part = part.replace(r"\S", f"[^{sets[r'\s']}]")
        for name, chars in sets.items():
            part = part.replace(name, chars if inside else f"[{chars}]")
        parts[k] = part
    return "".join(parts)


class Encoder:
    """Splits texts into pre-tokens and gives their ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        plain = explicit_classes(pattern, 0x10000)
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.split_low = self.split_new = self.split
        if plain is not None:
            # sets of the first 65,536 characters are the fastest; characters that are news to some libraries need all sets spelled out
            self.split_low = re.compile(plain).findall
            self.split_new = re.compile(explicit_classes(pattern)).findall
        self.has_new = re.compile(f"[{_ranges(character_classes()[1])}]").search
        self.forget()

    def forget(self) -> None:
        self.code: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)

    def splitter(self, text: str) -> Callable[[str], list[str]]:
        return self.split_new if self.has_new(text) else self.split

    def learn(self) -> None:
        """Ids of the words that got a code since the last time."""
        old = len(self.sizes)
        new = list(islice(self.code, old, None))
        raw = [w.encode() for w in new]
        whole = [self.vocabulary.ranks.get(w, -1) for w in raw]
        merged, counts = replay([b"" if r >= 0 else w for w, r in zip(raw, whole)], self.vocabulary)
        # a word that is a token counts one id, put where its merges would be
        sizes = np.where(np.array(whole, np.int64) >= 0, 1, counts)
        ids = np.empty(int(sizes.sum()), np.int32)
        alone = np.repeat(np.array(whole, np.int64) >= 0, sizes)
        ids[alone] = [r for r in whole if r >= 0]
        ids[~alone] = merged
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))

    def encode(self, texts: pa.Array) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        if len(self.code) > MOST_WORDS:
            self.forget()
        get, codes, words = self.code.__getitem__, [], []
        for part in chunks(pa.RecordBatch.from_arrays([texts], ["text"])):
            high = pc.match_substring_regex(part.column(0), "[\U00010000-\U0010ffff]").to_pylist()
            split = [(self.splitter(t) if h else self.split_low)(t) if t else [] for t, h in zip(part.column(0).to_pylist(), high)]
            words += map(len, split)
            codes.append(np.fromiter(chain.from_iterable(map(get, ws) for ws in split), np.int32, sum(map(len, split))))
        self.learn()
        starts = np.cumsum(self.sizes) - self.sizes
        at = 0
        flat = np.concatenate(codes) if codes else np.empty(0, np.int32)
        for n in words:
            mine = flat[at : at + n]
            at += n
            sizes = self.sizes[mine]
            total = int(sizes.sum())
            yield self.ids[np.repeat(starts[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)].tolist()


_KEPT: dict[tuple[str, str | None], Vocabulary | Encoder] = {}


def vocabulary_of(lines: Broadcast) -> Vocabulary:
    """The vocabulary, read once by each Python worker."""
    key = (hashlib.sha256(lines.value).hexdigest(), None)
    if key not in _KEPT:
        _KEPT[key] = Vocabulary(lines.value)
    return _KEPT[key]


def encoder_of(lines: Broadcast, pattern: str) -> Encoder:
    """The encoder with the words it knows, kept by a Python worker from task to task."""
    key = (hashlib.sha256(lines.value).hexdigest(), pattern)
    if key not in _KEPT:
        _KEPT[key] = Encoder(vocabulary_of(lines), pattern)
    return _KEPT[key]


def _shared(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary file for the tasks: a file of fixed size, under a megabyte here."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with the token ids of every whole text."""
    lines = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(lines, pattern)
        for batch in batches:
            for part in chunks(batch, limit=CORPUS_BYTES):
                ids = pa.array(encoder.encode(part.column("text")), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": ids})

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes`` of rows ``doc_id, ids``; ids outside the vocabulary are an error."""
    lines = _shared(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary_of(lines).tokens
        for batch in batches:
            raw = [b"".join(map(tokens.__getitem__, ids or [])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(raw, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens, digest of the ids and digest of the bytes decoded from those ids, per row of ``docs``."""
    lines = _shared(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(lines, pattern)
        decimal, tokens = encoder.vocabulary.decimal, encoder.vocabulary.tokens
        for batch in batches:
            for part in chunks(batch, limit=CORPUS_BYTES):
                n, ids_hash, text_hash = [], [], []
                for ids in encoder.encode(part.column("text")):
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_hash.append(hashlib.sha256(b"".join(map(tokens.__getitem__, ids))).hexdigest())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array(ids_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string()),
                })

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
