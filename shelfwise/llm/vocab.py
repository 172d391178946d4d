"""Byte-pair vocabularies: the file's contents travel to the workers as a broadcast, which its size bounds."""

from __future__ import annotations

import heapq
import json
from pathlib import Path

from pyspark.sql import SparkSession

#: A vocabulary file larger than this is refused rather than broadcast.
MAX_FILE_BYTES = 64 << 20


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> dict:
    """Model, added tokens and the other parts of a tokenizer file, read on the driver."""
    file = Path(path)
    if file.stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{path} is too large to be sent to every worker")
    return json.loads(file.read_text(encoding="utf-8"))


def shared(spark: SparkSession, value):
    return spark.sparkContext.broadcast(value)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others in
    order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Byte-pair merging by rank: the lowest rank first, the leftmost of equal ranks."""

    #: Above this number of symbols a heap finds the next pair.
    SHORT = 48

    def __init__(self, spec: dict):
        model = spec["model"]
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        self.rank = {tuple(pair): i for i, pair in reversed(list(enumerate(pairs)))}
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.letters = {b: c for b, c in enumerate(byte_alphabet())}

    def symbols(self, text: str) -> list[str]:
        """The start symbols of a pre-token: one for each byte, the last with the end-of-word suffix."""
        out = list(text.encode().decode("latin-1").translate(self.letters))
        if out:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        return self._short(symbols) if len(symbols) <= self.SHORT else self._long(symbols)

    def _short(self, symbols: list[str]) -> list[str]:
        rank, symbols = self.rank, list(symbols)
        none = len(rank)
        ranks = [rank.get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((symbols[at - 1], symbols[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((symbols[at], symbols[at + 1]), none)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs over a linked list; a pair that has changed meanwhile is passed over."""
        parts: list[str | None] = list(symbols)
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        rank = self.rank
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, left, right = heapq.heappop(heap)
            follow = after[at]
            if parts[at] != left or follow < 0 or parts[follow] != right:
                continue
            parts[at], parts[follow] = left + right, None
            after[at] = after[follow]
            if after[at] >= 0:
                before[after[at]] = at
            for i in (before[at], at):
                if i >= 0 and after[i] >= 0 and (r := rank.get((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))
        return [p for p in parts if p is not None]
