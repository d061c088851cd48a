"""Benchmark questions inside texts, also where their numbers, names or units were exchanged.

Canonical form: words are lower-cased and stripped of punctuation; numbers (digits or number words) become ``<num>``, a known
unit after a number becomes ``<unit>``, a capitalised word that doesn't open a sentence becomes ``<name>``, and a run of names is one
placeholder. Each run of ``window`` canonical words is a template window. Two readings are hashed, with and without ``<name>``, so
that a change of letter case alone hides nothing. Windows with fewer than ``least_literal`` words besides numbers and units say too little as
templates; with ``written`` they are hashed as written, numbers and units kept, and match exact copies only.

Join: a membership filter of bounded size over the benchmark's window hashes drops nearly all windows of the corpus inside the scan; the
rest is hash-joined with the benchmark's windows, salted by document, so that a passage that a third of all texts share is spread
over many tasks. The filter only spares work: the join decides, and compares the window's words by a second hash.

Slot check: matched windows of one text and item (a group no larger than the text) are cut into alignments by the distance of
their positions. Within an alignment the item's slots, the values that stand where it has placeholders, must map to the text's
values as a function: where the item says the same value twice, so must the text. An alignment where fewer than ``consistency`` of the
slot pairs agree with the mapping is taken apart: an item that repeats itself matches a copy of it at several distances, and a list of its variants
follows the copy. Its windows of equal distance are judged by themselves; the set that covers most is kept, with those that agree with it.
Windows hashed as written have no slots and always count; a text gives each of them once.

A text leaks an item if the windows left cover at least ``coverage`` of the item's words, or ``most_words`` of them. Items of fewer words than a window are covered by one window of their
own length, those of few literal words as written or not at all. Items of fewer than ``least_words`` words, numbers included, say too little to stand inside a text by chance or not
("Yes.", "12"): only a text that is such an item from its first word to its last leaks it.

Null or empty texts match nothing. Texts are judged by id and text together: different texts under one id, or without an id, are judged apart, and repeated rows of one text are
one; null ids of items stay null; repeated items are found under each id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import chunks, maybe_members, membership_bits, mixed, named, texts_of
from lumenframe.session import cut_lineage

NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
    "years dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit meter meters metre metres kilometer "
    "kilometers kilometre kilometres mph kmh watt watts volt volts joule joules newton newtons".split()
)
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUMBER = re.compile(rb"[+-]?\d[\d.,]*(?:st|nd|rd|th)?")
_MEASURE = re.compile(rb"([+-]?\d[\d.,]*)([a-z]+)")

_WORD, _NUM, _UNIT, _NAME, _EMPTY, _BREAK = range(6)
_ENDS, _CAPITAL, _MARKS = 8, 16, 31
#: Codes of the placeholders; word codes end in five zero bits, these don't.
_CODE = np.array([0, 0x6E756D1, 0x756E69741, 0x6E616D651, 0, 0], np.uint64)


@dataclass(frozen=True)
class Search:
    window: int = 8  # canonical words
    least_literal: int = 4
    coverage: float = 0.5
    most_words: int = 24
    consistency: float = 0.9
    salts: int = 16
    least_words: int = 5  # items of fewer words must be the whole text
    written: bool = False  # windows of few literal words too, as written


#: What callers get who name no search: templates, and as written what templates leave out.
WHOLE = Search(written=True)


class _Kinds(dict):
    """Written word to the hash of its bare form, with its kind and flags in the low bits; starts anew when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = self.classify(word)
        return value

    @staticmethod
    def classify(word: bytes) -> int:
        import xxhash

        if word == b"\x00":
            return _BREAK | _ENDS
        ends = _ENDS if word.rstrip(b"\"')]}").endswith((b".", b"!", b"?")) else 0
        bare = word.strip(_PUNCTUATION)
        if not bare:
            return _EMPTY | ends
        text = bare.decode()
        low = text.lower()
        key = xxhash.xxh3_64_intdigest(low.encode()) & ~_MARKS
        if bare[0] < 58 or low in NUMBER_WORDS:  # no letter sorts before the digits' end
            raw = low.encode()
            measure = _MEASURE.fullmatch(raw)
            if low in NUMBER_WORDS or _NUMBER.fullmatch(raw) or measure and measure[2].decode() in UNITS:
                return key | _NUM | ends
        if low in UNITS:
            return key | _UNIT | ends
        return key | _WORD | ends | (_CAPITAL if text[0].isupper() and text[1:] != text[1:].upper() else 0)


_KINDS = _Kinds()


@dataclass
class _Reading:
    """Canonical words of some texts, one after the other: code, text, first and last + 1 written word, literal or not."""

    code: np.ndarray
    text: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    literal: np.ndarray


def _previous(x: np.ndarray, first) -> np.ndarray:
    return np.concatenate(([first], x[:-1])) if len(x) else x


def _solid_words(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Written words that hold more than punctuation, the text of each, its hash with marks, and whether it opens a sentence."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        mine = t.replace(b"\x00", b" ").replace(b"\n", b" \x00 ").split() if t else []
        words += mine
        sizes.append(len(mine))
    text = np.repeat(np.arange(len(texts)), sizes)
    value = np.fromiter(map(_KINDS.__getitem__, words), np.uint64, len(words))
    marks = (value & np.uint64(_MARKS)).astype(np.int8)
    solid = np.flatnonzero((marks & 7) < _EMPTY)
    ended = np.concatenate(([0], np.cumsum((marks & _ENDS) > 0)))[solid]  # sentence ends before each word
    text, value = text[solid], value[solid]
    opens = (ended != _previous(ended, -1)) | (text != _previous(text, -1))
    return [words[k] for k in solid.tolist()] if len(solid) < len(words) else words, text, value, opens


def _readings(text: np.ndarray, value: np.ndarray, opens: np.ndarray) -> tuple[_Reading, _Reading, _Reading]:
    """With names as placeholders, with names as ordinary words, and as written (literal: neither number nor unit, whatever precedes)."""
    kind = (value & np.uint64(7)).astype(np.int8)
    code = value & np.uint64(~_MARKS & (2**64 - 1))
    place = np.arange(len(kind))
    written = _Reading(code, text, place, place + 1, kind == _WORD)
    same_text = text == _previous(text, -1)
    kind = np.where((kind == _UNIT) & ~(same_text & (_previous(kind, _WORD) == _NUM)), _WORD, kind)

    def reading(kinds: np.ndarray) -> _Reading:
        run = same_text & (kinds == _NAME) & (_previous(kinds, _WORD) == _NAME)
        at = np.flatnonzero(~run)
        kept = kinds[at]
        return _Reading(np.where(kept == _WORD, code[at], _CODE[kept]), text[at], at, np.concatenate((at[1:], [len(kinds)])), kept == _WORD)

    capital = (value & np.uint64(_CAPITAL)) > 0
    return reading(np.where((kind == _WORD) & capital & ~opens, _NAME, kind)), reading(kind), written


def _windows_at(r: _Reading, n: int, search: Search, only_named: bool) -> np.ndarray:
    """Places of the windows inside one text that say enough."""
    last = len(r.code) - n + 1
    if last <= 0:
        return np.empty(0, np.int64)
    ok = r.text[n - 1 :] == r.text[:last]
    literal = np.concatenate(([0], np.cumsum(r.literal)))
    ok &= literal[n:] - literal[:last] >= search.least_literal
    if only_named:
        names = np.concatenate(([0], np.cumsum(r.code == _CODE[_NAME])))
        ok &= names[n:] > names[:last]
    return np.flatnonzero(ok)


def _written_at(r: _Reading, n: int, search: Search) -> np.ndarray:
    """Places of the windows inside one text that say too little as templates."""
    last = len(r.code) - n + 1
    if last <= 0:
        return np.empty(0, np.int64)
    literal = np.concatenate(([0], np.cumsum(r.literal)))
    return np.flatnonzero((r.text[n - 1 :] == r.text[:last]) & (literal[n:] - literal[:last] < search.least_literal))


def _alone(r: _Reading, at: np.ndarray, n: int, search: Search) -> np.ndarray:
    """Of windows with fewer than ``least_words`` words, those that are their whole text."""
    if n >= search.least_words or not len(at):
        return at
    return at[np.searchsorted(r.text, r.text[at], side="right") - np.searchsorted(r.text, r.text[at]) == n]


def _hashes(r: _Reading, at: np.ndarray, n: int, by: int) -> np.ndarray:
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out *= np.uint64(by)
        out += r.code[at + k]
    return mixed(out)


def _proof(r: _Reading, at: np.ndarray, n: int) -> np.ndarray:
    return _hashes(r, at, n, 0xD6E8FEB86659FD93)


def _key(r: _Reading, at: np.ndarray, n: int) -> np.ndarray:
    return _hashes(r, at, n, 0x9E3779B97F4A7C15)


_FIELDS = "id long, key long, hash long, proof long, at long, stop long, slot_at array<long>, slots array<string>, total long, n long"


def _rows(part: pa.RecordBatch, words: list[bytes], r: _Reading, at: np.ndarray, n: int, written: bool = False) -> pa.RecordBatch:
    """Windows of the texts of ``part``, which also gives their ids and keys. Windows as written have null slots."""
    slot_at, slots = ([None] * len(at), [None] * len(at)) if written else ([], [])
    for a in () if written else at.tolist():
        held = [k for k in range(a, a + n) if not r.literal[k]]
        slot_at.append([int(r.start[k]) for k in held])
        slots.append([b" ".join(w.strip(_PUNCTUATION) for w in words[r.start[k] : r.stop[k]]).decode().lower() for k in held])
    text = r.text[at]
    first = np.searchsorted(r.text, text)  # the first canonical word of the text
    after = np.searchsorted(r.text, text, side="right")
    begin = r.start[first]
    whose = part.select(["doc_id", "key"]).take(pa.array(text))
    return pa.RecordBatch.from_pydict({
        "id": whose.column(0), "key": whose.column(1), "hash": pa.array(_key(r, at, n).view(np.int64)),
        "proof": pa.array(_proof(r, at, n).view(np.int64)), "at": pa.array(r.start[at] - begin), "stop": pa.array(r.stop[at + n - 1] - begin),
        "slot_at": pa.array([ks and [k - b for k in ks] for ks, b in zip(slot_at, begin.tolist())], pa.list_(pa.int64())),
        "slots": pa.array(slots, pa.list_(pa.string())), "total": pa.array(r.stop[after - 1] - begin), "n": pa.array(np.full(len(at), n)),
    })


def _short_pieces(r: _Reading, n: int) -> Iterator[tuple[_Reading, int]]:
    """The texts that are shorter than a window, one by one."""
    edges = np.flatnonzero(np.concatenate(([True], r.text[1:] != r.text[:-1], [True]))) if len(r.text) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < n:
            yield _Reading(*(x[a:b] for x in (r.code, r.text, r.start, r.stop, r.literal))), b - a


def template_windows(texts: DataFrame, search: Search = Search()) -> DataFrame:
    """Every template window of rows ``doc_id, key, text``; a shorter text is one window of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words, text, value, opens = _solid_words(part.column("text").cast(pa.binary()).to_pylist())
                *templates, written = _readings(text, value, opens)
                for r, with_names in zip(templates, (True, False)):
                    yield _rows(part, words, r, _windows_at(r, search.window, search, with_names), search.window)
                    for piece, n in _short_pieces(r, search.window):
                        yield _rows(part, words, piece, _windows_at(piece, n, search, with_names), n)
                if not search.written:
                    continue
                yield _rows(part, words, written, _written_at(written, search.window, search), search.window, True)
                for piece, n in _short_pieces(written, search.window):
                    yield _rows(part, words, piece, _written_at(piece, n, search), n, True)

    return texts.mapInArrow(run, _FIELDS)


def _once(r: _Reading, at: np.ndarray, n: int) -> np.ndarray:
    """The first place of each window in its text."""
    seen = np.stack((r.text[at].astype(np.uint64), _key(r, at, n)), axis=1)
    return at[np.sort(np.unique(seen, axis=0, return_index=True)[1])]


def candidate_windows(
    texts: DataFrame, lengths: list[int], written_lengths: list[int], bits: np.ndarray, n_bits: int, search: Search = Search(),
) -> DataFrame:
    """The windows of rows ``doc_id, key, text``, as templates and as written, that the membership filter lets pass."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words, text, value, opens = _solid_words(part.column("text").cast(pa.binary()).to_pylist())
                *templates, written = _readings(text, value, opens)
                for r, with_names in zip(templates, (True, False)):
                    for n in lengths:
                        at = _alone(r, _windows_at(r, n, search, with_names), n, search)
                        at = at[maybe_members(_key(r, at, n), shared.value, n_bits)]
                        if len(at):
                            yield _rows(part, words, r, at, n)
                for n in written_lengths:
                    at = _alone(written, _written_at(written, n, search), n, search)
                    at = at[maybe_members(_key(written, at, n), shared.value, n_bits)]
                    if len(at):
                        yield _rows(part, words, written, _once(written, at, n), n, True)

    return texts.mapInArrow(run, _FIELDS)


def _alignments(windows: list[dict], gap: int) -> Iterator[list[dict]]:
    """Windows whose distance of positions in text and item is about the same."""
    ordered = sorted(windows, key=lambda w: w["at"] - w["item_at"])
    group: list[dict] = []
    for w in ordered:
        if group and w["at"] - w["item_at"] - (group[-1]["at"] - group[-1]["item_at"]) > gap:
            yield group
            group = []
        group.append(w)
    yield group


def _slot_pairs(windows: list[dict]) -> set[tuple]:
    return {
        (a, b, s, t)
        for w in windows
        for a, s, b, t in zip(w["item_slot_at"], w["item_slots"], w["slot_at"], w["slots"])
    }


def _by_value(pairs: set[tuple]) -> dict[str, Counter]:
    by_value: dict[str, Counter] = {}
    for _, _, s, t in pairs:
        by_value.setdefault(s, Counter())[t] += 1
    return by_value


def _agreement(windows: list[dict]) -> float:
    """Share of the slot pairs that follow the most frequent mapping of each item value; 1 without slots."""
    pairs = _slot_pairs(windows)
    return sum(max(c.values()) for c in _by_value(pairs).values()) / len(pairs) if pairs else 1.0


def _covered(windows: list[dict]) -> set[int]:
    return {k for w in windows for k in range(w["item_at"], w["item_stop"])}


def _consistent(group: list[dict], consistency: float) -> tuple[list[dict], float]:
    """The windows of an alignment that one mapping explains, and the share of their slot pairs that follow it."""
    share = _agreement(group)
    if share >= consistency:
        return group, share
    diagonals: dict[int, list[dict]] = {}
    for w in group:
        diagonals.setdefault(w["at"] - w["item_at"], []).append(w)
    sound = [d for _, d in sorted(diagonals.items()) if _agreement(d) >= consistency]
    out: list[dict] = []
    mapping: dict[str, Counter] = {}
    agree = n = 0
    for d in sorted(sound, key=lambda d: -len(_covered(d))):  # each pair of slots stands on one diagonal: counts add up
        pairs = _slot_pairs(d)
        more = _by_value(pairs)
        grown = {s: mapping.get(s, Counter()) + c for s, c in more.items()}
        now = agree + sum(max(c.values()) - max(mapping[s].values() if s in mapping else (0,)) for s, c in grown.items())
        if now >= consistency * (n + len(pairs)):
            out += d
            mapping |= grown
            agree, n = now, n + len(pairs)
    return out, agree / n if n else 1.0


_LEAKS = "doc_id long, key long, item_id long, item_words long, covered_words long, n_windows long, slot_consistency double"


def _judge(search: Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                written = [w for w in row["windows"] if w["slots"] is None]
                covered = _covered(written)
                n, least = len(written), 1.0
                for group in _alignments([w for w in row["windows"] if w["slots"] is not None], search.window):
                    kept, share = _consistent(group, search.consistency)
                    n += len(kept)
                    least = min(least, share)
                    covered |= _covered(kept)
                total = row["windows"][0]["item_words"]
                if covered and len(covered) >= min(search.coverage * total, search.most_words):
                    out.append((row["doc_id"], row["key"], row["item_id"], total, len(covered), n, least))
            names = [x.split()[0] for x in _LEAKS.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    return run


def _keyed(texts: DataFrame) -> DataFrame:
    """Adds a hash of id and text, by which texts are told apart."""
    return texts.withColumn("key", F.xxhash64("doc_id", "text"))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, search: Search) -> DataFrame:
    items = benchmark.select(named(item_col).cast("long").alias("doc_id"), named(item_text_col).cast("string").alias("text"))
    wanted = cut_lineage(template_windows(_keyed(items), search))
    counts = wanted.groupBy("n", F.col("slots").isNull().alias("written")).count().collect()  # at most two rows per length
    bits, n_bits = membership_bits(wanted, "hash", sum(r["count"] for r in counts))
    lengths, written_lengths = (sorted(r["n"] for r in counts if r["written"] == w) for w in (False, True))
    seen = candidate_windows(_keyed(texts_of(docs, id_col, text_col)), lengths, written_lengths, bits, n_bits, search)
    seen = seen.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(search.salts)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(search.salts - 1).cast("long")))
    theirs = wanted.select(
        "hash", "proof", "n", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("stop").alias("item_stop"),
        F.col("slot_at").alias("item_slot_at"), F.col("slots").alias("item_slots"), F.col("total").alias("item_words"), salts.alias("salt"),
    )
    pairs = seen.drop("total", "stop").join(theirs, ["hash", "proof", "n", "salt"])
    window = F.struct("at", "slot_at", "slots", "item_at", "item_stop", "item_slot_at", "item_slots", "item_words")
    grouped = pairs.groupBy(F.col("id").alias("doc_id"), "key", "item_id").agg(F.collect_set(window).alias("windows"))
    return grouped.mapInArrow(_judge(search), _LEAKS)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", search: Search = WHOLE,
) -> DataFrame:
    """One row per text and benchmark item that the text leaks, with how much of the item it covers."""
    return _found(docs, benchmark, id_col, text_col, item_col, item_text_col, search).drop("key")


def drop_leaking(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", search: Search = WHOLE,
) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns. A row goes for its own text, never for another row's with its id."""
    bad = _found(docs, benchmark, id_col, text_col, item_col, item_text_col, search).select(F.col("key").alias("leaking key")).distinct()
    key = F.xxhash64(named(id_col).cast("long"), named(text_col).cast("string"))
    return docs.join(bad, key == F.col("leaking key"), "left_anti")
