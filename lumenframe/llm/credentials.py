"""Secrets in texts: strong patterns, and weak candidates that count only when their complements stand near.

Three strong kinds are always reported: ``assign`` (a key word, an equals sign or colon, a value of 12+ characters),
``access`` (an access key id) and ``hex`` (16+ hexadecimal digits). Three weak kinds are too common to report alone:

* ``identifier``: the value assigned to a user, account or client id;
* ``secret``: a short value with a digit, assigned to a password-like key, or a long token that looks drawn at random: it holds small and
  capital letters and digits, few of them in runs as words have them, and spread evenly;
* ``endpoint``: a URL with a scheme, or the value assigned to a host-like key.

A token inside an endpoint, a path or a file name, or assigned to an identifier's key, is no secret. Each part opens a scope around itself: ``reach`` code points to
both sides, cut at blank lines. An interval join inside the text links parts whose scopes hold each other; a part that overlaps another is never its complement. A weak
secret is reported if an identifier or an endpoint is linked to it, a weak identifier if a secret is, an endpoint if both are. Strong spans take part as identifiers
(``access``) and secrets (the other two). The join sorts the parts by position and looks up the nearest one of each role on either side by bisection, so a text with
many parts costs n log n and no pair is listed.

Positions are code points of the text as stored, ends exclusive. A text is read whole, inside one task, without a shuffle.
Null and empty texts have no spans; repeated rows give repeated result rows; ids may be null.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import chunks, texts_of

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
_LEAST_VALUE, _LEAST_ACCESS, _LEAST_SHORT = 12, 18, 6

_IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account(?:_id)?|client_?id|access_?key(?:_?id)?|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
_ENDPOINT = re.compile(r"""\b(?:([a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,})|(?:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9.:/_-]{3,}))""", re.ASCII | re.IGNORECASE)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.~-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-]|\.[A-Za-z0-9])")
_DIGIT, _SMALL, _CAPITAL = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
_LETTERS = re.compile("[a-z]{4,}|[A-Z]{4,}")
_BLANK_LINE = re.compile(r"\n[\t\r ]*\n")

_ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}


@dataclass(frozen=True)
class Linking:
    reach: int = 300  # code points between the ends of two linked parts, at most
    least_entropy: float = 3.8  # bits a character, for a token without a key
    most_letters: float = 0.4  # share of its characters that stand in runs of four or more small or four or more capital letters, as those of words do


Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The strong kinds: leftmost matches that don't overlap within a kind, too short ones dropped."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _looks_random(token: str, linking: Linking) -> bool:
    if not (_SMALL.search(token) and _CAPITAL.search(token) and _DIGIT.search(token)):
        return False
    n = len(token)
    if sum(m.end() - m.start() for m in _LETTERS.finditer(token)) > linking.most_letters * n:
        return False
    return -sum(c / n * log2(c / n) for c in Counter(token).values()) >= linking.least_entropy


def _apart(spans: list[Span], others: list[Span]) -> list[Span]:
    """The spans that overlap none of the others."""
    taken = sorted((a, b) for a, b, _ in others)
    starts, reached = [a for a, _ in taken], []
    for _, b in taken:
        reached.append(max(b, reached[-1] if reached else 0))
    out = []
    for span in spans:
        k = bisect_left(starts, span[1])
        if not k or reached[k - 1] <= span[0]:
            out.append(span)
    return out


def weak_spans(text: str, strong: list[Span], linking: Linking) -> list[Span]:
    """Candidates of the weak kinds that don't overlap a strong span."""
    named = [(*m.span(1), "identifier") for m in _IDENTIFIER.finditer(text)]
    places = [(*m.span(m.lastindex), "endpoint") for m in _ENDPOINT.finditer(text)]
    keyed = [
        (m.start(), m.end(), "secret") for m in _ASSIGN.finditer(text) if _LEAST_SHORT <= m.end(2) - m.start(2) < _LEAST_VALUE and _DIGIT.search(m[2])
    ]
    tokens = [(m.start(), m.end(), "secret") for m in _TOKEN.finditer(text) if _looks_random(m.group(), linking)]
    return _apart(keyed + _apart(tokens, named + places + keyed) + named + places, strong)


class _Near:
    """Whether a part of one role stands within reach of an interval, in the same block of the text."""

    def __init__(self, spans: list[Span], blocks: list[int], reach: int):
        self.reach, self.blocks = reach, blocks
        self.starts: dict[tuple[str, int], list[int]] = {}
        self.ends: dict[tuple[str, int], list[int]] = {}
        for a, b, kind in spans:
            key = (_ROLE[kind], self.block(a))
            self.starts.setdefault(key, []).append(a)
            self.ends.setdefault(key, []).append(b)
        for lists in (self.starts, self.ends):
            for v in lists.values():
                v.sort()

    def block(self, position: int) -> int:
        return bisect_left(self.blocks, position + 1)

    def has(self, role: str, span: Span) -> bool:
        """A part of a role ends at most ``reach`` in front of the span or starts at most as far behind it, and doesn't overlap it."""
        key = (role, self.block(span[0]))
        ends, starts = self.ends.get(key, []), self.starts.get(key, [])
        return bisect_left(ends, span[0] - self.reach) < bisect_left(ends, span[0] + 1) or bisect_left(starts, span[1]) < bisect_left(starts, span[1] + self.reach)


def linked_spans(text: str, linking: Linking = Linking()) -> list[Span]:
    """All spans of a text: the strong ones, and the weak ones that have their complements."""
    strong = base_spans(text)
    weak = weak_spans(text, strong, linking)
    if weak:
        near = _Near(strong + weak, [m.start() for m in _BLANK_LINE.finditer(text)], linking.reach)
        for span in weak:
            identifier, secret, endpoint = (near.has(r, span) for r in ("identifier", "secret", "endpoint"))
            role = _ROLE[span[2]]
            if {"secret": identifier or endpoint, "identifier": secret, "endpoint": identifier and secret}[role]:
                strong.append(span)
    return sorted(set(strong), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", linking: Linking = Linking()) -> DataFrame:
    """One row per row of ``docs`` with its spans ``[(start, stop, kind)]``, sorted by start and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part in chunks(batch):
                spans = [[{"start": a, "stop": b, "kind": k} for a, b, k in linked_spans(t, linking)] if t else [] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "spans": pa.array(spans, kind)})

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start: long, stop: long, kind: string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and listings of the spans that ``find`` gives."""
    def listing(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"),
    )


def redacted(text: str, linking: Linking = Linking()) -> str:
    """The text with every span, or union of overlapping spans, replaced by ``[SECRET]``."""
    pieces, at = [], 0
    for a, b, _ in linked_spans(text, linking):
        if a >= at:
            pieces += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*pieces, text[at:]]) if pieces else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", linking: Linking = Linking()) -> DataFrame:
    """All rows and columns of ``docs``; texts without their secrets, and ``length_col`` as the new length where a text changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                at = part.schema.get_field_index(text_col)
                old = part.column(at).to_pylist()
                new = [redacted(t, linking) if t else t for t in old]
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                size = part.schema.get_field_index(length_col) if length_col else -1
                if size >= 0:
                    kept = part.column(size).to_pylist()
                    sizes = [len(b) if a is not b else n for a, b, n in zip(old, new, kept)]
                    part = part.set_column(size, part.schema.field(size), pa.array(sizes, part.schema.field(size).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
