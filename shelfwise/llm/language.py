"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) the vectors of its letters, the letter
at place p permuted (rotated) p times; a text's vector bundles (adds) those of its n-grams; a language's prototype bundles
the unit vectors of its texts. A text gets the language whose prototype has the largest cosine with it.

Letter vectors follow from the letter alone, so there is no alphabet to limit. Bundling is linear: a batch counts n-grams
per text and multiplies the counts with the n-gram vectors, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import by_batch, texts

DIMENSIONS, GRAM = 1024, 3
#: Texts and different n-grams whose counts are held at once, and characters of a batch of texts.
ROWS, COLUMNS, CHARS = 256, 4096, 4_000_000
UNKNOWN = "und"
#: How strongly a lead in cosine raises the score.
SHARPNESS = 10.0


def letter_vectors(letters: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same in every process: bits of a mixed counter."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (words + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.float32)


def _is_letter(text: str) -> np.ndarray:
    return np.fromiter(map(str.isalpha, text), bool, len(text))


class Letters:
    """Code points to letters: lower-cased runs of letters, with one boundary (0) on either side of a run."""

    def __init__(self):
        self.known = np.zeros(0x110000, np.uint8)  # 0 not met, 1 letter, 2 other

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = self.known[points]
        if not kind.all():
            fresh = np.unique(points[kind == 0])
            self.known[fresh] = np.where(_is_letter("".join(map(chr, fresh))), 1, 2)
            kind = self.known[points]
        return np.where(kind == 1, points, 0)


_letters = Letters()


def _grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the n-grams of a batch of texts: the text of each, its number among the different n-grams, the letters of these,
    and whether each text has a letter. A gram needs a letter in its middle: runs are taken with one boundary each side."""
    parts = [_letters.codes(t.lower()) for t in batch]
    codes = np.concatenate([x for p in parts for x in (np.zeros(1, np.uint32), p.astype(np.uint32))] + [np.zeros(1, np.uint32)])
    owner = np.repeat(np.arange(len(batch)), [len(p) + 1 for p in parts])
    letters, small = np.unique(codes, return_inverse=True) if len(codes) < 1000 else _small(codes)
    a = np.int64(len(letters))
    middle = np.flatnonzero(codes[1:-1] != 0) + 1
    key = (small[middle - 1] * a + small[middle]) * a + small[middle + 1]
    if a**3 <= 1 << 24:
        there = np.zeros(a**3, bool)
        there[key] = True
        grams = np.flatnonzero(there)
        number = np.zeros(a**3, np.int32)
        number[grams] = np.arange(len(grams))
        which = number[key]
    else:
        grams, which = np.unique(key, return_inverse=True)
    spelled = np.stack([letters[grams // (a * a)], letters[grams // a % a], letters[grams % a]], axis=1)
    own = owner[middle]
    has = np.zeros(len(batch), bool)
    has[own] = True
    return own, which, spelled, has


def _small(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by a table over code points."""
    there = np.zeros(0x110000, bool)
    there[codes] = True
    letters = np.flatnonzero(there)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    return letters, number[codes]


def gram_vectors(spelled: np.ndarray, dimensions: int) -> np.ndarray:
    """Bound vectors of n-grams: the product of their letters' vectors, the letter at place p rotated p times."""
    letters, inverse = np.unique(spelled, return_inverse=True)
    vectors, inverse = letter_vectors(letters, dimensions), inverse.reshape(spelled.shape)
    out = vectors[inverse[:, 0]]
    for place in range(1, spelled.shape[1]):
        out = out * np.roll(vectors, place, axis=1)[inverse[:, place]]
    return out


def _bundles(batch: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    own, which, spelled, has = _grams(batch)
    out = np.zeros((len(batch), dimensions), np.float32)
    order = np.argsort(own, kind="stable") if len(own) and (np.diff(own) < 0).any() else slice(None)
    own, which = own[order], which[order]
    for column in range(0, len(spelled), COLUMNS):
        block = spelled[column : column + COLUMNS]
        vectors = gram_vectors(block, dimensions)
        inside = slice(None) if len(spelled) <= COLUMNS else (which >= column) & (which < column + COLUMNS)
        rows, grams = own[inside], which[inside] - column
        for start in range(0, len(batch), ROWS):
            low, high = np.searchsorted(rows, [start, start + ROWS])
            n = min(ROWS, len(batch) - start)
            if high > low:
                counts = np.bincount((rows[low:high] - start) * len(block) + grams[low:high], minlength=n * len(block))
                out[start : start + n] += counts.reshape(n, len(block)).astype(np.float32) @ vectors
    return out, has


def bundle(batch: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The unit vectors of texts (zero without letters), and whether each has a letter. Texts are joined into batches of
    bounded length; a longer one is bundled in pieces, cut where no letter stands, so that no n-gram is lost."""
    out, has = np.zeros((len(batch), dimensions), np.float32), np.zeros(len(batch), bool)
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            vectors, letters = _bundles([t for _, t in held], dimensions)
            for (i, _), vector, letter in zip(held, vectors, letters):
                out[i] += vector
                has[i] |= letter
        held, size = [], 0

    for i, text in enumerate(batch):
        for piece in _cut(text):
            held.append((i, piece))
            size += len(piece)
            if size >= CHARS:
                flush()
    flush()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0), has


def _cut(text: str) -> list[str]:
    """Pieces of a long text, cut where a sign that is no letter stands (or, without one, anywhere)."""
    pieces, start = [], 0
    while len(text) - start > CHARS:
        end = start + CHARS
        near = next((e for e in range(end, max(start, end - 10_000), -1) if not text[e].isalpha()), end)
        pieces.append(text[start:near])
        start = near
    return [*pieces, text[start:]]


def _column_texts(column: pa.Array) -> list[str]:
    return [(x or b"").decode() for x in texts(column)]


def prototypes(docs: DataFrame, learn: Column, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their unit prototypes, from text and lang of all rows of docs where learn holds.

    A task adds up the vectors of its texts by language and emits these sums only; Spark adds those of all tasks."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = bundle(_column_texts(batch.column(0)), dimensions)
            names = np.array(batch.column(1).to_pylist(), object)
            for name in set(names):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0, dtype=np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "place": np.arange(dimensions, dtype=np.int32), "value": vector})

    # Rounded before adding up, so that the sum does not depend on the order in which tasks end.
    parts = rows.mapInArrow(run, "lang string, place int, value double").withColumn("value", F.round(F.col("value") * 1e6).cast("long"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).orderBy("lang").collect()
    names = [row["lang"] for row in found]
    vectors = np.array([[x["value"] for x in row["v"]] for row in found], np.float64).reshape(len(names), dimensions)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    keep = norm[:, 0] > 0
    return [n for n, k in zip(names, keep) if k], (vectors[keep] / norm[keep]).astype(np.float32)


def identify(docs: DataFrame, languages: list[str], vectors: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, second, cosine): the language of every whole text of docs (doc_id, text).

    cosine is that with the best prototype, second the next best language; score, from 0 to 1, is the best language's share
    when cosines compete (a softmax). A text that is null or has no letter gets und and score 0, as does any text when no
    language could be learned. Ties go to the first language by name. Repeated rows and null doc_ids come back as they went
    in; other columns are not read; an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, has = bundle(_column_texts(batch.column(1)), vectors.shape[1])
        if languages:
            cosines = (own @ vectors.T).astype(np.float64)
            best = cosines.argmax(axis=1)
            top = cosines.max(axis=1)
            share = np.exp((cosines - top[:, None]) * SHARPNESS)
            share = np.where(has, 1 / share.sum(axis=1), 0.0)
            after = np.where(np.arange(len(languages)) == best[:, None], -2, cosines).argmax(axis=1)
            pred = [languages[b] if h else UNKNOWN for b, h in zip(best, has)]
            second = [languages[b] if h and len(languages) > 1 else None for b, h in zip(after, has)]
            top = np.where(has, np.clip(top, -1, 1), 0.0)
        else:
            pred, second = [UNKNOWN] * len(has), [None] * len(has)
            share = top = np.zeros(len(has))
        columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(share), pa.array(second, pa.string()), pa.array(top)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "second", "cosine"])

    schema = "doc_id long, lang_pred string, score double, second string, cosine double"
    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)

