"""Benchmark decontamination: SimHash of item-sized windows under a multi-index, then exact similarity.

For every benchmark item, each window of a document with as many words is compared with it. A window's SimHash is looked up
in blocks of bits: two fingerprints at most r bits apart agree in one of r + 1 blocks at least, so the lookup misses none
within the radius. Candidates are verified by the weighted Jaccard similarity of their word shingles, counted with repeats.
An item with fewer words than a shingle is one shingle as a whole: windows match it that are equal.

A window that reaches the similarity shares a known share of its shingles with one item. So only windows that hold that many
shingles of the benchmark at all are hashed, found by running counts; no match is lost by that, and clean text costs one
hash for each word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import texts
from shelfwise.llm.hashing import mixed, powers
from shelfwise.llm.vocab import shared

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 20
#: Benchmark text that is sent to the workers at once; a larger benchmark is matched in several passes.
MAX_BENCHMARK_BYTES = 32 << 20
#: Bytes of text handled at once.
PIECE = 4 << 20

# Bytes of words: ASCII letters and digits, and everything beyond ASCII.
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased bytes."""
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return start, end, mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(data: bytes) -> bytes:
    """Lower case; texts beyond ASCII by the rules of Unicode."""
    return data.lower() if data.isascii() else data.decode().lower().encode()


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a lower-cased text, worked through in pieces that end between words."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and _IN_WORD[data[end]]:
            end += 1
        start, stop, code = _words_of(np.frombuffer(data, np.uint8, end - at, at))
        parts.append((start + at, stop + at, code))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_hashes(codes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of each run of k words."""
    n = max(len(codes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + codes[i : i + n]
    return mixed(out)


def simhash(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes; a tie is 0."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes), bitorder="little").tobytes(), "little")


def similarity(a: list[bytes], b: list[bytes], k: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the shingles of two word lists: each shingle weighs as often as it occurs."""
    x, y = (Counter(zip(*(w[i:] for i in range(k)))) for w in (a, b))
    both = sum((x & y).values())
    return both / (len(a) + len(b) - 2 * (k - 1) - both)


class Items:
    """Benchmark items by size, with a multi-index of their fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], k: int, similar: float, radius: int):
        self.k, self.similar, self.radius = k, similar, radius
        self.words: list[list[bytes]] = []
        self.ids: list[int] = []
        self.short: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        codes, short = [], defaultdict(list)
        for item, text in sorted(rows):
            data = lowered(text.encode())
            start, end, code = words(data)
            own = [data[s:e] for s, e in zip(start, end)]
            if len(start) >= k:
                self.ids.append(item)
                self.words.append(own)
                codes.append(shingle_hashes(code, k))
            elif own:
                self.short[len(own)][b" ".join(own)].append(item)
                short[len(own)].append(shingle_hashes(code, len(own)))
        self.short = {size: dict(known) for size, known in self.short.items()}
        self.short_codes = {size: np.unique(np.concatenate(found)) for size, found in short.items()}
        self.known = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True
        self.prints = [simhash(c) for c in codes]
        self.sizes = sorted({len(w) for w in self.words})
        edges = [round(b * 64 / (radius + 1)) for b in range(radius + 2)]
        self.blocks = [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]
        self.index: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for i, (fingerprint, own) in enumerate(zip(self.prints, self.words)):
            for b, (low, mask) in enumerate(self.blocks):
                self.index[len(own), b, fingerprint >> low & mask].append(i)

    def candidates(self, size: int, fingerprint: int) -> list[int]:
        """Items of the size whose fingerprint is within the radius."""
        near = {i for b, (low, mask) in enumerate(self.blocks) for i in self.index.get((size, b, fingerprint >> low & mask), ())}
        return sorted(i for i in near if (self.prints[i] ^ fingerprint).bit_count() <= self.radius)

    def equal_to_short(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each size of items of fewer than k words, where windows begin whose hash is that of an item."""
        return {size: np.flatnonzero(np.isin(shingle_hashes(codes, size), known)) for size, known in self.short_codes.items()}

    def short_matches(self, data: bytes, start: np.ndarray, end: np.ndarray, spots: dict[int, np.ndarray]) -> list[tuple]:
        """Like matches, for the windows of one text that equal an item of fewer than k words."""
        out = []
        for size, places in spots.items():
            free: dict[int, int] = {}
            for at in places.tolist():
                window = b" ".join(data[s:e] for s, e in zip(start[at : at + size], end[at : at + size]))
                for item in self.short[size].get(window, ()):
                    if at >= free.get(item, 0):
                        free[item] = at + size
                        out.append((item, at, size, int(start[at]), int(end[at + size - 1]), 1.0))
        return out

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles occur in the benchmark."""
        found = self.maybe[hashes & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(found)
        if len(at):
            place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
            found[at] = self.known[place] == hashes[at]
        return found

    def matches(self, data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, found: np.ndarray) -> list[tuple]:
        """(item, first word, words, first byte, end byte, similarity) of the matching windows of one lower-cased text, for
        each item the best of those that overlap."""
        count = np.concatenate([[0], np.cumsum(found)])
        out = []
        for size in self.sizes:
            n = size - self.k + 1
            # Two windows of n shingles each with i in common have the similarity i / (2 n - i).
            least = math.ceil(2 * n * self.similar / (1 + self.similar) - 1e-9)
            by_item: dict[int, list[tuple[float, int]]] = defaultdict(list)
            if len(hashes) >= n:
                for at in np.flatnonzero(count[n:] - count[:-n] >= least).tolist():
                    window = None
                    for i in self.candidates(size, simhash(hashes[at : at + n])):
                        window = window or [data[s:e] for s, e in zip(start[at : at + size], end[at : at + size])]
                        if (s := similarity(window, self.words[i], self.k)) >= self.similar:
                            by_item[i].append((-s, at))
            for i, windows in by_item.items():
                taken: list[int] = []
                for s, at in sorted(windows):
                    if all(abs(at - t) >= size for t in taken):
                        taken.append(at)
                        out.append((self.ids[i], at, size, int(start[at]), int(end[at + size - 1]), -s))
        return sorted(out)


_MATCH = "item_id long, first_word long, n_words int, first_byte long, end_byte long, similarity double"


def _pass(docs: DataFrame, items: Items) -> DataFrame:
    held = shared(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = ["doc_id", *(part.split()[0] for part in _MATCH.split(", "))]
        for batch in batches:
            rows = []
            for doc, matches in zip(*_in_groups(own, batch)):
                rows += [(doc, *m) for m in matches]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {_MATCH}")


def _in_groups(items: Items, batch: pa.RecordBatch) -> tuple[list, list]:
    """The matches of each text of a batch; short texts are hashed together."""
    ids, found, group, size = batch.column(0).to_pylist(), [], [], 0

    def flush() -> None:
        nonlocal group, size
        data = b"\n".join(group)
        start, end, codes = words(data)
        hashes = shingle_hashes(codes, items.k)
        hits = items.hits(hashes)
        short = items.equal_to_short(codes)
        limits = np.concatenate([[0], np.cumsum([len(t) + 1 for t in group])])
        first = np.searchsorted(start, limits)
        for i, text in enumerate(group):
            low, high = first[i], first[i + 1]
            top = max(high - items.k + 1, low)
            shift, matched = limits[i], []
            if hits[low:top].any():
                matched = items.matches(text, start[low:high] - shift, end[low:high] - shift, hashes[low:top], hits[low:top])
            own = {m: at[(at >= low) & (at + m <= high)] - low for m, at in short.items()}
            if any(map(len, own.values())):
                matched = sorted(matched + items.short_matches(text, start[low:high] - shift, end[low:high] - shift, own))
            found.append(matched)
        group, size = [], 0

    for text in texts(batch.column(1)):
        group.append(lowered(text or b""))
        size += len(group[-1])
        if size >= PIECE:
            flush()
    if group:
        flush()
    return ids, found


def matches(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, first_byte, end_byte, similarity): passages of docs (doc_id, text) that match an
    item of benchmark (item_id, text).

    A window of as many words as the item matches if the fingerprints differ in radius bits at most and the similarity of
    the k-word shingles is similar or more; of windows of a document that overlap, the best one for each item is given, the
    first of equals. Words are runs of letters, digits and signs beyond ASCII, in lower case; bytes count in the lower-cased
    text. An item of fewer than k words matches each equal window, whatever the radius; one without a word, or null, takes no part.
    Null and empty texts match nothing; repeated rows of docs match as often, repeated items once; other columns are not read;
    empty tables give an empty result. A benchmark of more than 32 MB is matched part by part.
    """
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / MAX_BENCHMARK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    out = None
    for p in range(parts):
        items = Items([tuple(r) for r in rows.where(part == p).collect()], k, similar, radius)
        found = _pass(docs, items)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that match no item, with the columns of docs.

    A row is judged by its text alone, so rows without a doc_id and repeated rows are judged like others. Null, empty and very long
    texts: as in matches. Empty tables: an empty docs gives an empty result, an empty benchmark leaves all rows.
    """
    rows = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    named = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = matches(named, rows).select(F.col("doc_id").alias("__hash")).distinct()
    return docs.join(found, F.xxhash64(docs["text"]) == found["__hash"], "left_anti")
