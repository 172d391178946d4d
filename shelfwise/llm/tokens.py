"""Token counts with the whole-token shortcut.

Offline, every vocabulary string that ends a word is put through the merges: those that come out as one token are proven
whole. A pre-token that is one of these counts 1 without any merging; only the rest is merged. A worker remembers the
counts of the pieces it has met.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import by_batch, texts
from shelfwise.llm.vocab import Merges, read_vocabulary, shared, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048

# Fixed value: the public pattern of the word vocabulary's pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

REMEMBERED, REMEMBERED_CHARS = 500_000, 64
#: Separators that Python's split takes for white space and the pattern does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def whole_tokens(merges: Merges) -> set[str]:
    """The texts that encode alone as one token: proven by merging each vocabulary string that ends a word."""
    back = {c: b for b, c in merges.letters.items()}
    proven = set()
    for name in merges.ids:
        stem = name.removesuffix(merges.suffix)
        if stem and stem != name and all(c in back for c in stem):
            try:
                text = bytes(back[c] for c in stem).decode()
            except UnicodeDecodeError:  # part of a sign: never a pre-token
                continue
            if merges.merge(merges.symbols(text)) == [name]:
                proven.add(text)
    return proven


class Counter:
    def __init__(self, spec: dict, proven: set[str]):
        self.merges, self.proven = Merges(spec), proven
        self.pattern = regex.compile(PRE_TOKEN)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        """Tokens of a run of visible signs."""
        merges, proven = self.merges, self.proven
        n = sum(1 if p in proven else len(merges.merge(merges.symbols(p))) for p in self.pattern.findall(piece))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = n
        return n

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: signs are lowered alone
        text = text.lower()
        pieces = regex.split(r"\s+", text) if _NOT_SPACE.search(text) else text.split()
        known = self.known.get
        return sum([known(p) or self._piece(p) for p in pieces])

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        return len(self.added.findall(text)) + sum(map(self._plain, self.added.split(text)))


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text of docs (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Special strings inside a text count as one token each, none is added.
    Repeated rows and null doc_ids come back as they went in; other columns are not read; an empty table gives an empty
    result. path: the vocabulary file on the driver; limit: n_tokens above it is over_limit.
    """
    path = path or vocabulary_path(VOCABULARY)
    spec = read_vocabulary(path)
    held = shared(docs.sparkSession, (spec, whole_tokens(Merges(spec))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _counters:
            _counters[path] = Counter(*held.value)
        counter, sizes, counts = _counters[path], [], []
        for text in texts(batch.column(1)):
            sizes.append(len(text or b""))
            counts.append(counter.count((text or b"").decode()))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    counted = by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
