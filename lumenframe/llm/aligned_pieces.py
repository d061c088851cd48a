"""Sentencepiece encoding and decoding that keeps, for every piece, the bytes of the text it comes from.

A text is normalised first. The model's compiled character map is a double-array trie with a pool of replacements: at each place its longest key
that the text goes on with is replaced, any other character is copied, and spaces are then squeezed and written as U+2581 as the model's settings say.
With each normalised character goes the byte at which its source begins, so a replacement of any length, a dropped space and the space put in front of the
text all keep their place. Merges run over the normalised characters in the order of the pieces' scores, leftmost first; a character without a piece
becomes its bytes. A piece's span runs from the source of its first character to the source of the character behind it; of a character's bytes
the last holds the span and the others are empty, as the library has it.

No merge crosses two characters that stand side by side in no piece, so texts fall into words (if some piece has U+2581 behind another character, a text is merged in one go), and a
task encodes each word once while it remembers it: ids, their decoded text and the pieces' lengths. It remembers at most ``MOST_WORDS`` words and encodes long ones anew.

The work is one pass without a shuffle; a lost task is run again. Models are BPE with byte fallback; others are refused. Null texts count as empty: no
ids, an empty text. Repeated rows give repeated result rows; ids of rows may be null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lumenframe.llm.common import chunks, texts_of

SPACE = "▁"
MOST_WORDS = 400_000
LONG_WORD = 128
_NONE = float("-inf")


class CharacterMap:
    """Rules of a compiled character map: 4 bytes of trie size, the trie's units of 4 bytes, then replacements that end with a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").astype(np.int64)
        self.pool = compiled[4 + size :]
        self.rules = {key.decode(): value.decode() for key, value in self._walk()}
        alone = {k for k in self.rules if len(k) == 1}
        longer = [k for k in self.rules if len(k) > 1]
        self.longest = max(map(len, self.rules), default=0)
        # A key can only begin at a character that is a key by itself, or that some longer key goes on from.
        ways = [f"[{_class(alone)}]"] * bool(alone) + [f"[{_class({k[0] for k in longer})}](?=[{_class({k[1] for k in longer})}])"] * bool(longer)
        self.candidate: Callable[[str, int], re.Match | None] | None = re.compile("|".join(ways)).search if ways else None

    def _walk(self) -> Iterator[tuple[bytes, bytes]]:
        """All keys with their replacements."""
        if not len(self.units):
            return
        byte = np.arange(256)
        todo = [(b"", self._below(0))]
        while todo:
            key, base = todo.pop()
            at = base ^ byte
            at, step = at[at < len(self.units)], byte[at < len(self.units)]
            unit = self.units[at]
            for k in np.flatnonzero((unit & 0x800000FF) == step):
                if not step[k]:
                    continue
                below = self._below(int(at[k]))
                longer = key + bytes([int(step[k])])
                if unit[k] >> 8 & 1:
                    start = int(self.units[below]) & 0x7FFFFFFF
                    yield longer, self.pool[start : self.pool.index(b"\0", start)]
                todo.append((longer, below))

    def _below(self, at: int) -> int:
        """Where the children of a unit are found, each at this place xor its byte."""
        unit = int(self.units[at])
        return at ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def apply(self, text: str) -> Iterator[tuple[str, int, int]]:
        """``(written, start, length)`` of the parts of the text in order; a part of length -1 is copied character by character."""
        at = copied = 0
        while self.candidate and (found := self.candidate(text, at)):
            at = found.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                new = self.rules.get(text[at : at + n])
                if new is not None:
                    if copied < at:
                        yield text[copied:at], copied, -1
                    yield new, at, n
                    at = copied = at + n
                    break
            else:
                at += 1
        if copied < len(text):
            yield text[copied:], copied, -1


def _class(characters: set[str]) -> str:
    return "".join(map(re.escape, sorted(characters)))


def byte_offsets(text: str) -> np.ndarray:
    """The byte at which each character begins, and the number of bytes."""
    if text.isascii():
        return np.arange(len(text) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])


def splitter(pieces: Iterable[str]) -> Callable[[str], list[str]]:
    """Cuts a normalised text where no merge can cross: between two characters that stand side by side in no piece.

    Four kinds of characters: U+2581; letters, widened by all that pieces have behind them; others that have a neighbour in some piece; and
    the rest, each a word by itself. A word is U+2581s, others and letters in this order, where others end a word unless the last of them has a letter behind it in some piece.
    """
    after: dict[str, set[str]] = defaultdict(set)
    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            after[a].add(b)
    inside = {*after, *(b for x in after.values() for b in x)} - {SPACE}
    if any(SPACE in x for a, x in after.items() if a != SPACE):
        return lambda text: [text] * bool(text)
    letters = {c for c in inside if c.isalpha()}
    while more := {b for a in letters for b in after[a]} - letters:
        letters |= more
    others = inside - letters
    leading = {c for c in others if after[c] & letters}
    run = f"[{_class(others)}]" if others else "(?!)"
    front = f"(?:{run}*[{_class(leading)}])?" if leading else ""
    ways = [f"{SPACE}*{front}[{_class(letters)}]+"] * bool(letters) + [f"{SPACE}*{run}+", f"{SPACE}+", f"[^{SPACE}{_class(inside)}]"]
    return re.compile("|".join(ways)).findall


#: An encoded word: its ids in decimal, each with a comma behind it; what they decode to inside a text; the normalised characters that each id takes, a byte to an id.
Word = tuple[str, str, bytes]


class Model(dict):
    """A sentencepiece model; as a dictionary, the words that it remembers."""

    def __init__(self, model: bytes, most_words: int = MOST_WORDS):
        from sentencepiece import sentencepiece_model_pb2 as wire

        super().__init__()
        self.most_words = most_words
        self.before: dict[str, Word] = {}
        spec = wire.ModelProto()
        spec.ParseFromString(model)
        kinds = wire.ModelProto.SentencePiece
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap)
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.pieces = [p.piece for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.ids = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[3:-1], 16): k for k, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte_of = {k: b for b, k in self.byte_ids.items()}
        self.silent = {k for k, kind in enumerate(self.kinds) if kind == kinds.CONTROL}
        self.unknown = {k for k, kind in enumerate(self.kinds) if kind == kinds.UNKNOWN}
        self.unknown_text = spec.trainer_spec.unk_surface
        self.written = [f"{k}," for k in range(len(self.pieces))]
        self.inside = [p.replace(SPACE, " ") for p in self.pieces]
        if (
            spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or len(self.byte_ids) < 256
            or spec.trainer_spec.treat_whitespace_as_suffix or not rules.escape_whitespaces or SPACE not in self.ids
            or any(k in (kinds.USER_DEFINED, kinds.UNUSED) for k in self.kinds) or max(map(len, self.ids)) > 255
        ):
            raise ValueError("a BPE model with byte fallback, escaped spaces and no user-defined or unused pieces is needed")
        self.split = splitter(self.ids)

    # Normalising ------------------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its characters and of its end."""
        if not text:
            return "", np.zeros(1, np.int64)
        place = byte_offsets(text)
        parts, source, inner = [], [], []
        first: int | None = None  # where the spaces in front end
        for written, start, n in self.map.apply(text):
            if first is None and (n >= 0 and written != " " or n < 0 and written.strip(" ")):
                first = start if n >= 0 else start + len(written) - len(written.lstrip(" "))
            parts.append(written)
            source.append(np.arange(start, start + len(written)) if n < 0 else np.full(len(written), start))
            if self.squeeze and n >= 0:
                inner += [(len(parts) - 1, k) for k in range(len(written)) if written[k] == " " and written[:k].strip(" ")]
        new = "".join(parts)
        source = np.concatenate(source) if source else np.zeros(0, np.int64)
        begin, end = place[source], int(place[-1])
        if self.squeeze:
            new, begin, end = self._squeezed(new, begin, end, parts, inner)
            if not new:
                return "", np.array([end])
        new = new.replace(" ", SPACE)
        if self.prefix:
            new, begin = SPACE + new, np.concatenate([[place[first] if self.squeeze and first is not None else 0], begin])
        if self.squeeze:
            kept = len(new.rstrip(SPACE))
            end = int(begin[kept]) if kept < len(new) else end
            new, begin = new[:kept], begin[:kept]
        return new, np.concatenate([begin, [end]])

    @staticmethod
    def _squeezed(text: str, begin: np.ndarray, end: int, parts: list[str], inner: list[tuple[int, int]]) -> tuple[str, np.ndarray, int]:
        """Without spaces in front and behind other spaces; those inside a replacement stay."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = code == 32
        drop = blank & np.concatenate([[True], blank[:-1]])
        if inner:
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            drop[[int(ends[part]) + k for part, k in inner]] = False
        kept = code[~drop]
        return kept.tobytes().decode("utf-32-le", "surrogatepass"), begin[~drop], end

    # Encoding ---------------------------------------------------------------------------------

    def words(self, normalised: str) -> list[Word]:
        return list(map(self.__getitem__, self.split(normalised)))

    def __missing__(self, word: str) -> Word:
        """Looks among the words of the generation before this one, so that frequent words are never encoded again."""
        new = self.before.get(word) or self.encoded(word)
        if len(word) <= LONG_WORD:
            if 2 * len(self) >= self.most_words:
                self.before = dict(self)
                self.clear()
            self[word] = new
        return new

    def encoded(self, word: str) -> Word:
        parts = self.merged(word)
        try:
            ids = [self.ids[p] for p in parts]
            return "".join([self.written[i] for i in ids]), "".join([self.inside[i] for i in ids]), bytes(map(len, parts))
        except KeyError:  # a character without a piece
            ids, lengths = [], []
        for part in parts:
            known = self.ids.get(part)
            own = [self.byte_ids[b] for b in part.encode()] if known is None else [known]
            ids += own
            lengths += [0] * (len(own) - 1) + [len(part)]
        return "".join([self.written[i] for i in ids]), self.decode(ids, inside=True), bytes(lengths)

    def merged(self, word: str) -> list[str]:
        """The word's characters, joined by the highest score first and from the left among equal ones."""
        if len(word) > LONG_WORD:
            return self._merged_by_queue(word)
        part, score = list(word), self.score.get
        value = list(map(score, map(add, part, part[1:]), repeat(_NONE)))
        while value and (top := max(value)) is not _NONE:
            at = value.index(top)
            new = part[at] = part[at] + part.pop(at + 1)
            del value[at]
            if at:
                value[at - 1] = score(part[at - 1] + new, _NONE)
            if at < len(value):
                value[at] = score(new + part[at + 1], _NONE)
        return part

    def _merged_by_queue(self, word: str) -> list[str]:
        """Neighbours are linked and pairs queued, for words without spaces of any length."""
        part: list[str] = list(word)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        queue = [(-self.score[a + b], k, a + b) for k, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.score]
        heapify(queue)
        while queue:
            _, k, joined = heappop(queue)
            other = after[k]
            if not part[k] or other < 0 or part[k] + part[other] != joined:
                continue
            part[k], part[other] = joined, ""
            after[k] = after[other]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and part[a] + part[b] in self.score:
                    heappush(queue, (-self.score[part[a] + part[b]], a, part[a] + part[b]))
        return [p for p in part if p]

    def encode(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids with the first byte of each and the byte behind it."""
        normalised, place = self.normalise(text or "")
        words = self.words(normalised)
        begins, ends = spans(words, place)
        return ids_of(words), begins, ends

    # Decoding ---------------------------------------------------------------------------------

    def decode(self, ids: list[int], inside: bool = False) -> str:
        """The text of the ids; ``inside`` keeps a leading space. Runs of byte pieces are read as UTF-8."""
        out: list[str] = []
        run = bytearray()
        leading = not inside and (self.prefix or self.squeeze)
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(readable(bytes(run)))
                run.clear()
                leading = False
            if i in self.silent:
                continue
            if i in self.unknown:
                piece, leading = self.unknown_text, False
            else:
                piece = self.pieces[i]
                if leading:
                    rest = piece.removeprefix(SPACE)
                    leading = self.squeeze and not rest
                    piece = rest
            out.append(piece.replace(SPACE, " "))
        if run:
            out.append(readable(bytes(run)))
        return "".join(out)


def readable(run: bytes) -> str:
    """UTF-8, where each byte that can't be read becomes a replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError as e:
        return run[: e.start].decode() + "�" + readable(run[e.start + 1 :])


def ids_of(words: list[Word]) -> list[int]:
    return [int(i) for w in words for i in w[0].split(",") if i]


def spans(words: list[Word], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source bytes of the pieces, from ``place``: the source byte of each normalised character and of the end."""
    length = np.frombuffer(b"".join([w[2] for w in words]), np.uint8)
    behind = np.cumsum(length, dtype=np.int64)
    # Bytes of a character stand in front of it until the last one takes it.
    return place[behind - length], place[behind]


def covering(begins: np.ndarray, ends: np.ndarray, at: int) -> int:
    """The piece whose span holds byte ``at``, -1 if none does."""
    k = bisect_right(begins.tolist(), at) - 1
    return k if k >= 0 and ends[k] > at else -1


_MODELS: dict[str, Model] = {}


def model_of(model: bytes) -> Model:
    """The model with the words it knows, kept by a Python worker from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Model(model)
    return _MODELS[key]


def _sent(docs: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, begins, ends`` of every row of ``docs``: the text's ids with their spans in bytes. ``path`` names the model file, about half a megabyte."""
    model = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model.value)
        for batch in batches:
            for part in chunks(batch):
                ids, begins, ends = zip(*map(own.encode, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                    names=["doc_id", "ids", "begins", "ends"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``; null ids give an empty text."""
    model = _sent(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([own.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_spanned, spans_sha256`` of every row of ``docs``.

    ``n_spanned`` is the number of source bytes that the pieces' spans cover; ``spans_sha256`` digests the spans as pairs of little-endian 32-bit integers.
    """
    model = _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_of(model.value)
        for batch in batches:
            for part in chunks(batch):
                rows = [digest(own, text or "") for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in zip(*rows))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_spanned", "spans_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_spanned long, spans_sha256 string")


def digest(model: Model, text: str) -> tuple[int, str, str, int, str]:
    normalised, place = model.normalise(text)
    words = model.words(normalised)
    begins, ends = spans(words, place)
    if model.squeeze:  # pieces of nothing but a space in front depend on each other
        decoded = model.decode(ids_of(words))
    else:
        decoded = "".join([w[1] for w in words])
        decoded = decoded.removeprefix(" ") if model.prefix else decoded
    written = "".join([w[0] for w in words])[:-1]
    both = np.stack([begins, ends], 1).astype("<i4")
    hexed = [hashlib.sha256(x).hexdigest() for x in (written.encode(), decoded.encode(), both.tobytes())]
    return len(begins), hexed[0], hexed[1], int((ends - begins).sum()), hexed[2]
