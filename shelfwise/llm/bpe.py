"""BPE encoding and decoding by dynamic programming over prefixes.

The encoding of every prefix of a pre-token ends in one token only, and that token is the one match ending there that is
compatible with the last token of the prefix before it. So one pass with an automaton that reports all vocabulary strings
ending at each place, and a test of pairs, finds the last token of every prefix; following the lengths back from the end
gives the ids. Time is linear in the length of a pre-token, however long it is.

A pair of tokens is compatible if their bytes together encode to just this pair. Both tokens grow by merges of rising rank,
so it is enough to look at the symbols that stand left and right of the seam at the same time: the pair breaks if two of
these merge before either is used up.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import by_batch, texts
from shelfwise.llm.vocab import Merges, read_vocabulary, shared, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"

# Fixed value: the public pattern of byte-level pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Encoded pieces that a worker remembers, and the longest piece remembered.
REMEMBERED, REMEMBERED_CHARS = 500_000, 64
_NEVER = 1 << 40


class Encoder:
    """Encodes and decodes whole texts with one byte-level vocabulary."""

    def __init__(self, spec: dict):
        merges = Merges(spec)
        self.letters, self.rank, self.ids = merges.letters, merges.rank, merges.ids
        self.names = {i: name for name, i in self.ids.items()}
        self.pattern = regex.compile(PRE_TOKEN)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        back = {c: b for b, c in merges.letters.items()}
        self.bytes = {i: bytes(back[c] for c in name) for name, i in self.ids.items() if all(c in back for c in name)}
        self.bytes |= {i: content.encode() for content, i in added.items()}
        # Offline: the last merge of each vocabulary string that encodes to itself; the others can never be emitted.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        rising = True
        for name, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(name) == 1:
                self.made[i] = (-1, -1, -1)
            else:
                last = self._last_merge(merges, name)
                if last is None:
                    continue
                left, right = self.ids[last[0]], self.ids[last[1]]
                self.made[i] = (self.rank[last], left, right)
                rising &= max(self.made[left][0], self.made[right][0]) < self.rank[last]
            self.automaton.add_word(name, (i, len(name)))
        if not rising:
            raise ValueError("the ranks of this vocabulary do not rise along its merges")
        self.automaton.make_automaton()
        self.length = {i: len(self.names[i]) for i in self.made}
        self.right_edges: dict[int, list] = {}
        self.left_edges: dict[int, list] = {}
        self.pairs: dict[int, bool] = {}
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    @staticmethod
    def _last_merge(merges: Merges, name: str) -> tuple[str, str] | None:
        """The two symbols of which a string is made in the end, None if it does not become one token."""
        if merges.merge(list(name)) != [name]:
            return None
        found = [(merges.rank[pair], pair) for k in range(1, len(name)) if (pair := (name[:k], name[k:])) in merges.rank]
        for _, pair in sorted(found):
            if merges.merge(list(pair[0])) == [pair[0]] and merges.merge(list(pair[1])) == [pair[1]]:
                if Encoder._stands(merges, name, pair):
                    return pair
        return None

    @staticmethod
    def _stands(merges: Merges, name: str, pair: tuple[str, str]) -> bool:
        """Without the last merge the string would end as this pair."""
        rank = merges.rank.pop(pair)
        try:
            return merges.merge(list(name)) == list(pair)
        finally:
            merges.rank[pair] = rank

    def _edge(self, token: int, side: int) -> list[tuple[str, int, int]]:
        """The symbols that stand at the right (side 2) or left (side 1) edge while a token grows: name, rank that makes
        it, rank that uses it up."""
        known = self.right_edges if side == 2 else self.left_edges
        if token not in known:
            edge, used, part = [], _NEVER, token
            while part >= 0:
                rank, *parts = self.made[part]
                edge.append((self.names[part], rank, used))
                used, part = rank, parts[side - 1]
            known[token] = edge
        return known[token]

    def compatible(self, left: int, right: int) -> bool:
        """The bytes of both tokens together encode to just these two."""
        rank = self.rank
        for a, a_made, a_used in self._edge(left, 2):
            for b, b_made, b_used in self._edge(right, 1):
                if b_made < a_used and a_made <= b_used:
                    r = rank.get((a, b))
                    if r is not None and r < a_used and r <= b_used:
                        return False
        return True

    def _ids(self, pre_token: str) -> array:
        """Ids of one pre-token: the last token of every prefix, then back from the end."""
        word = pre_token.encode().decode("latin-1").translate(self.letters)
        last = [-1] * (len(word) + 1)
        pairs = self.pairs
        for end, (token, length) in self.automaton.iter(word):
            if last[end + 1] < 0:
                before = last[end + 1 - length]
                if before >= 0:
                    key = before << 32 | token
                    good = pairs.get(key)
                    if good is None:
                        good = pairs[key] = self.compatible(before, token)
                    if not good:
                        continue
                elif end + 1 != length:
                    continue
                last[end + 1] = token
        out, at, length = array("i"), len(word), self.length
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        return b"".join(self._ids(p).tobytes() for p in self.pattern.findall(piece))

    def _known(self, memory: dict[str, bytes], key: str, piece: str) -> bytes:
        found = memory.get(key)
        if found is None:
            found = self._piece(piece)
            if len(piece) <= REMEMBERED_CHARS:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[key] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens. A blank before a visible sign starts a pre-token, so the pieces between
        blanks can be encoded one by one; where blanks follow one another, the whole text is split by the pattern."""
        if re.search(r" \s|\s \Z", text):
            return b"".join(self._known(self.first, p, p) for p in self.pattern.findall(text))
        head, *rest = text.split(" ")
        known = self.spaced.get
        return self._known(self.first, head, head) + b"".join(
            [known(p) or self._known(self.spaced, p, " " + p) for p in rest]
        )

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.split is None or not self.split.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        parts = [array("i", [self.added[p]]).tobytes() if p in self.added else self._plain(p) for p in self.split.split(text) if p]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, held) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(held.value)
    return _encoders[path]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string): every whole text of docs (doc_id, text) encoded, and its ids decoded again.

    No special tokens are added; those written in a text become their own ids, and decoding keeps them. Null and empty texts
    have no ids and decode to the empty text. Repeated rows and null doc_ids come back as they went in; other columns are not
    read; an empty table gives an empty result. path: the vocabulary file on the driver.
    """
    path = path or vocabulary_path(VOCABULARY)
    held = shared(docs.sparkSession, read_vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(path, held)
        ids = [encoder.encode((text or b"").decode()) for text in texts(batch.column(1))]
        decoded = [encoder.decode(x.tolist()) for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())],
            names=["doc_id", "ids", "decoded"],
        )

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
