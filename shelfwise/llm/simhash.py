"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart have a midpoint at most r / 2 bits from both. So every distinct fingerprint emits all
its variants within r / 2 flipped bits, the variants are shuffled, and fingerprints that meet in a variant are linked. All
that meet lie in one ball of radius r / 2, hence within r of one another: linking each with the least of its ball keeps every
connection without emitting pairs, and a ball holds at most as many fingerprints as there are variants (65 for r = 2), so no
group can grow. Equal texts and equal fingerprints are collapsed first, so a hot group costs one fingerprint.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from shelfwise.llm.common import by_batch, stored, texts
from shelfwise.llm.graph import components

BITS = 64
SEED = 42
#: Bytes of a text handled at once: a long text is worked through in pieces, cut at white space.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _pieces(data: bytes):
    """The words of a text, some at a time."""
    start = 0
    while len(data) - start > PIECE:
        end = max(data.rfind(bytes([c]), start, start + PIECE) for c in _SPACE)
        if end <= start:  # one word longer than a piece
            ends = [e for c in _SPACE if (e := data.find(bytes([c]), start + PIECE)) >= 0]
            if not ends:
                break
            end = min(ends)
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included, as an unsigned 64-bit number.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text of fewer words is one shingle, one of no
    word (or null) has fingerprint 0. A bit is 1 if over half of the shingles' XXH64 hashes have it.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces((text or b"").lower()):
        run = tail + piece
        if len(run) >= words:
            shingles = map(b" ".join, zip(*(run[i:] for i in range(words))))
            n = len(run) - words + 1
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), n)
            for at in range(0, n, 1 << 15):
                part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        tail = run[-(words - 1) :] if words > 1 else []
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(text, words) for text in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Masks of all variants within half the radius, as signed longs."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: a midpoint lies half of it from both ends")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) that connect all distinct values of fp at most radius bits apart, through the least of each ball."""
    variants = fps.select(
        "fp", F.explode(F.transform(F.array(*map(F.lit, ball(radius))), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant")
    )
    low = F.min("fp").over(Window.partitionBy("variant"))
    met = variants.select(F.col("fp").alias("a"), low.alias("b")).where("a <> b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text).

    component_id is the least doc_id of all documents that links reach, itself included; fingerprints link at radius or
    fewer differing bits. Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows come back as
    often as they go in. A row without a doc_id takes part and gets its component's least doc_id (null if there is none).
    Other columns are not read. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct_fingerprints")
    roots = components(links(firsts, radius))
    linked = firsts.join(roots, firsts.fp == roots.node).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "root").select("fp", "component_id")
    ids = firsts.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # Written, so that the last join has a shuffle of its own below each side: a hot fingerprint can then be split.
    ids = stored(ids, "component_ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """docs without the near duplicates: of every component one row stays. A row is named by doc_id and the hash of its text;
    the least name stays, rows without a doc_id after all others, and of rows with the same name one. Columns are those of
    docs."""
    return least_of_each(docs, _named_components(docs, words, radius))


def _named_components(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, text_hash, root): component_id cannot name a component where doc_ids repeat, so each text is numbered by its hash."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    roots = near_duplicates(by_text, words, radius).select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("root")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).join(roots, "text_hash")


def least_of_each(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of docs whose name is the least of their component, each name once. placed: doc_id, text_hash, root."""
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    kept = placed.groupBy("root").agg(F.min(name).alias("name")).select(F.col("name.doc_id").alias("__doc"), F.col("name.text_hash").alias("__hash"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__hash"))
    plain = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "array", "struct", "variant"))]
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.col("text").asc_nulls_last(), *plain)
    left = docs.join(kept, same, "left_semi")
    return left.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
