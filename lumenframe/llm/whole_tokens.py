"""Token counts with a shortcut for pre-tokens that are one token by themselves.

The vocabulary is a sentencepiece BPE model with byte fallback. Its normaliser is the identity, writes a space as U+2581 and
puts one in front of each text, and no piece holds U+2581 behind another character (``Counter`` checks all of this and refuses other models). So no merge
crosses from a character to a U+2581 that follows it, and a text's tokens are those of its pre-tokens: runs of U+2581 with the characters up to the next one.
Characters that occur in no piece of two or more characters never merge; a text is cut at them as well, and each counts as many tokens as the model gives it alone.

Offline, every vocabulary string is encoded by the model; the strings that come back as one token form the shortcut table. A pre-token in the table counts
1. The others are merged, each distinct one once per task: pairs are joined in the order of their pieces' scores, leftmost first, and a character without a piece
counts its bytes.

One pass over the texts, no shuffle. A task keeps at most ``MOST_WORDS`` distinct pre-tokens. Null texts count as empty: no bytes, no tokens. Repeated rows give repeated result rows; ids may be null; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lumenframe.llm.common import chunks, texts_of

SPACE = "▁"
MOST_WORDS = 400_000


class Counter(dict):
    """Pre-token to its number of tokens."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as wire

        super().__init__()
        spec = wire.ModelProto()
        spec.ParseFromString(model)
        kinds = wire.ModelProto.SentencePiece
        normal = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        rules = spec.normalizer_spec
        plain = rules.name == "identity" and not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces
        if (
            not plain or rules.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix
            or spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces)
            or any(SPACE in p.lstrip(SPACE) for p in normal)
        ):
            raise ValueError("the shortcut is proved for identity-normalised BPE models with byte fallback only")
        self.score = normal
        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The model puts a SPACE in front of what it encodes: strings that begin with one are asked without it,
        # others behind a line break, which stays apart from them, and its own tokens are taken off.
        lead = len(processor.encode("\n"))
        pieces = list(normal)
        asked = [p[1:].replace(SPACE, " ") if p[0] == SPACE else "\n" + p.replace(SPACE, " ") for p in pieces]
        counts = [len(ids) - (0 if p[0] == SPACE else lead) for p, ids in zip(pieces, processor.encode(asked, num_threads=1))]
        self.shortcut = frozenset(p for p, n in zip(pieces, counts) if n == 1)
        merging = {c for p in normal if len(p) > 1 for c in p}
        inside = "".join(sorted(map(re.escape, merging - {SPACE})))
        self.split = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]").findall

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        n = self[word] = 1 if word in self.shortcut else self.merged(word)
        return n

    def merged(self, word: str) -> int:
        """Tokens of a pre-token after its merges."""
        part = self.merged_long(word) if len(word) > 64 else self.merged_short(word)
        score = self.score
        return sum(1 if p in score else len(p.encode()) for p in part)

    def merged_short(self, word: str) -> list[str]:
        """Joins the best pair by looking at all of them each time: fastest for ordinary words."""
        get, none = self.score.get, float("-inf")
        part = list(word)
        best = [get(a + b, none) for a, b in zip(part, part[1:])]
        while best:
            high = max(best)
            if high == none:
                break
            k = best.index(high)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del best[k]
            if k < len(best):
                best[k] = get(part[k] + part[k + 1], none)
            if k:
                best[k - 1] = get(part[k - 1] + part[k], none)
        return part

    def merged_long(self, word: str) -> list[str]:
        """The same with a queue of pairs, so that a text without spaces costs n log n."""
        score = self.score
        part: list[str] = list(word)
        n = len(part)
        right = [*range(1, n), -1]
        left = [*range(-1, n - 1)]
        todo = [(-score[a + b], k, a + b) for k, (a, b) in enumerate(zip(part, part[1:])) if a + b in score]
        heapify(todo)
        while todo:
            _, a, text = heappop(todo)
            b = right[a]
            if b < 0 or part[a] + part[b] != text or not part[a]:
                continue
            part[a], part[b] = text, ""
            after = right[a] = right[b]
            if after >= 0:
                left[after] = a
                if text + part[after] in score:
                    heappush(todo, (-score[text + part[after]], a, text + part[after]))
            before = left[a]
            if before >= 0 and part[before] + text in score:
                heappush(todo, (-score[part[before] + text], before, part[before] + text))
        return [p for p in part if p]

    def count(self, text: str | None) -> int:
        return sum(map(self.__getitem__, self.split(SPACE + text.replace(" ", SPACE)))) if text else 0


_COUNTERS: dict[str, Counter] = {}


def counter_of(model: bytes) -> Counter:
    """The counter of a model file with the words it knows, kept by a Python worker from task to task."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(model)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``; ``path`` names the model file, about half a megabyte."""
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            for part in chunks(batch):
                text = part.column("text")
                tokens = np.fromiter(map(counter.count, text.to_pylist()), np.int64, len(text))
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
