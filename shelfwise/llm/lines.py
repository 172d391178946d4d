"""Line dedup by a deletion-neighbourhood join.

Two lines are near if one word must be put in, taken out or replaced at most. Then some variant, the line itself or the line
without one word, is common to both. So lines emit all their variants as hashed keys, equal variants are joined, the edit
distance of the lines that meet is verified, and of lines that are equal or near the earliest is kept.

Two things keep this linear. A near pair has its first or its last half in common, so only lines that share a half with
another line emit variants at all; no pair is lost by that. And within a variant no pairs are made: lines that lost the same
place are all near one another, and all are near the line that equals the variant, so least places say which line comes
first. Equal lines are collapsed before anything else; a hot line costs one partial aggregate for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from shelfwise.llm.common import stored, texts

#: Lines of fewer words are deduplicated only if they are equal.
NEAR_WORDS = 8
#: Variants that a worker holds before it hands them on.
EMITTED = 100_000
#: Three primes below 2^31 and a base for each: the hash of a sequence of words is a polynomial in the base.
_FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 741_103_597), (2_147_483_587, 1_220_703_125))
_powers = [np.ones(1, np.uint64) for _ in _FIELDS]


def _power(field: int, n: int) -> np.ndarray:
    """The first n powers of a field's base, doubled as far as they are needed."""
    prime, base = _FIELDS[field]
    while len(_powers[field]) < n:
        known = _powers[field]
        step = np.uint64(pow(base, len(known), prime))
        _powers[field] = np.concatenate([known, known * step % np.uint64(prime)])
    return _powers[field][:n]


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two key parts and the place of each variant: place -1 is the whole line, i the line without word i.

    The hash of a variant follows from sums over the words before and after the place, so a line of any length costs time
    in proportion to it. The second part also holds the variant's length."""
    n = len(words)
    codes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, n)
    hashes = []
    for k, (prime, base) in enumerate(_FIELDS):
        p = np.uint64(prime)
        terms = (codes >> np.uint64(7 * k)) % p * _power(k, n) % p
        before = np.concatenate([[0], np.cumsum(terms)]).astype(np.uint64)
        after = (before[-1] - before[1:]) % p * np.uint64(pow(base, -1, prime)) % p
        hashes.append(np.concatenate([before[-1:] % p, (before[:-1] + after) % p]).astype(np.int64))
    length = np.concatenate([[n], np.full(n, n - 1)])
    return hashes[0] << 31 | hashes[1], hashes[2] << 32 | length, np.arange(-1, n, dtype=np.int32)


def near(a: list[str], b: list[str]) -> bool:
    """At most one word is put in, taken out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    most = max(len(a), len(b))
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    return head + tail >= most - 1


def _text_hash() -> Column:
    return F.xxhash64("text")


#: What does not count at the ends of a line.
_EDGE = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGE))


def _halves(line: bytes) -> list[int]:
    """Hashed first and last halves of a line, for a partner that is no longer than the line and for one a word longer; none
    of a short line."""
    words = line.split(b" ")
    n, out = len(words), []
    if n < NEAR_WORDS:
        return out
    for longest in (n, n + 1):
        half = (longest - 1) // 2
        out.append(xxhash.xxh64_intdigest(b" ".join(words[:half]), 2 * longest))
        out.append(xxhash.xxh64_intdigest(b" ".join(words[n - half :]), 2 * longest + 1))
    return out


def _lines(docs: DataFrame, with_halves: bool = False) -> DataFrame:
    """(doc_id, text_hash, place, k1, k2) of every line that is not blank, blanks at its ends taken off; k1 and k2 are two
    independent hashes, the name of a line. On demand also halves, an array that is empty for short lines."""
    edge = _EDGE.encode()

    def signed(values: list[int]) -> pa.Array:
        return pa.array(np.array(values, np.uint64).view(np.int64))

    def result(batch: pa.RecordBatch, rows: list, places: list, k1: list, k2: list, halves: list) -> pa.RecordBatch:
        at = pa.array(np.array(rows, np.int32))
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(places, np.int32)), signed(k1), signed(k2)]
        names = ["doc_id", "text_hash", "place", "k1", "k2"]
        if with_halves:
            ends = np.cumsum([0, *map(len, halves)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), signed([h for part in halves for h in part])))
            names.append("halves")
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = ([], [], [], [], [])
            for row, text in enumerate(texts(batch.column(2))):
                for place, line in enumerate(text.split(b"\n")):
                    line = line.strip(edge)
                    if line:
                        found = (row, place, xxhash.xxh64_intdigest(line, 0), xxhash.xxh64_intdigest(line, 1))
                        for values, value in zip(held, (*found, _halves(line) if with_halves else [])):
                            values.append(value)
                if len(held[0]) >= EMITTED:
                    yield result(batch, *held)
                    held = ([], [], [], [], [])
            if held[0]:
                yield result(batch, *held)

    whole = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, place int, k1 long, k2 long" + (", halves array<bigint>" if with_halves else "")
    return whole.mapInArrow(run, schema)


def _variant_rows(lines: DataFrame) -> DataFrame:
    """(v1, v2, place, at) of every variant of lines (at, line); at says where the line first stands and its name."""

    def emitted(batch: pa.RecordBatch, held: list) -> pa.RecordBatch:
        v1, v2, place = (np.concatenate([h[i] for _, h in held]) for i in range(3))
        own = batch.column(0).take(pa.array(np.repeat([row for row, _ in held], [len(h[0]) for _, h in held])))
        return pa.RecordBatch.from_arrays([pa.array(v1), pa.array(v2), pa.array(place), own], names=["v1", "v2", "place", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for row, line in enumerate(batch.column(1).to_pylist()):
                held.append((row, variants(line.split(" "))))
                size += len(held[-1][1][0])
                if size >= EMITTED:
                    yield emitted(batch, held)
                    held, size = [], 0
            if held:
                yield emitted(batch, held)

    at = lines.schema["at"].dataType.simpleString()
    return lines.select("at", "line").mapInArrow(run, f"v1 long, v2 long, place int, at {at}")


def _earlier_near(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(k1, k2, near): for each line that has an earlier near line, where the earliest of these stands.

    firsts: k1, k2, at (where the line first stands, and its name), halves."""
    halves = firsts.where("size(halves) > 0").select("k1", "k2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("half")
    named = halves.join(shared, "half").select("k1", "k2").distinct()
    wanted = firsts.join(named, ["k1", "k2"]).select("at", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"))
    # The texts of these lines: one row for each document that holds some of them first.
    places = wanted.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("ats")).withColumnRenamed("doc_id", "__doc")
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_hash().alias("__hash"))
    held = rows.join(places, (F.col("__hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    cut = held.select(F.split("text", "\n").alias("cut"), F.explode("ats").alias("at"))
    line = _trimmed(F.get("cut", F.col("at.place")))
    lines = stored(cut.select("at", line.alias("line")).dropDuplicates(["at"]), "lines")

    rows = stored(_variant_rows(lines), "variants")
    shared = rows.groupBy("v1", "v2").agg(F.min("at.k1").alias("low"), F.max("at.k1").alias("high")).where("low <> high").select("v1", "v2")
    met = stored(rows.join(shared, ["v1", "v2"]), "met")
    same = met.groupBy("v1", "v2", "place").agg(F.min("at").alias("near"))
    whole = same.where("place = -1").select("v1", "v2", F.col("near").alias("other"))
    lost = same.where("place >= 0").join(whole, ["v1", "v2"], "left")
    lost = lost.select("v1", "v2", "place", F.least("near", F.coalesce("other", "near")).alias("near"))
    least = same.groupBy("v1", "v2").agg(F.min("near").alias("near")).select("v1", "v2", F.lit(-1).alias("place"), "near")
    found = met.join(lost.unionByName(least), ["v1", "v2", "place"]).where("near < at")
    pairs = found.groupBy("at").agg(F.min("near").alias("near"))

    own = lines.select("at", F.col("line").alias("own"))
    other = lines.select(F.col("at").alias("near"), F.col("line").alias("other"))
    verified = pairs.join(own, "at").join(other, "near").where(_near("own", "other"))
    return verified.select("at.k1", "at.k2", "near")


@F.pandas_udf(BooleanType())
def _near(own: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([near(a.split(" "), b.split(" ")) for a, b in zip(own, other)])


def _dropped(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, dropped): places of the lines that have an earlier equal or near line, by document."""
    at = F.struct("doc_id", "text_hash", "place", "k1", "k2")
    firsts = (
        _lines(docs, with_halves=True).groupBy("k1", "k2")
        .agg(F.min(F.struct(at.alias("at"), "halves")).alias("first"), F.count("*").alias("n"))
        .select("k1", "k2", "first.at", "first.halves", "n")
    )
    firsts = stored(firsts, "first_lines")
    near_lines = _earlier_near(firsts, docs)
    earliest = firsts.join(near_lines, ["k1", "k2"], "left").where("n > 1 OR near IS NOT NULL")
    earliest = stored(earliest.select("k1", "k2", F.least("at", F.coalesce("near", "at")).alias("earliest")), "earliest_lines")
    late = _lines(docs).join(earliest, ["k1", "k2"])
    late = late.where(F.struct("doc_id", "text_hash", "place") > F.struct("earliest.doc_id", "earliest.text_hash", "earliest.place"))
    return late.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("dropped"))


def dedup(docs: DataFrame, into: str = "dropped") -> DataFrame:
    """docs with text left without repeated lines, and a column named by into: the places (from 0) of the lines taken out,
    sorted.

    A line goes if an equal line (blanks at the ends do not count) stands earlier, or if it has at least 8 words and one
    stands earlier that differs by one word. Earlier: in the order of doc_id (null first), then a hash of the text, then the
    place. Blank lines stay. A repeated row is the same document, so all its copies keep the same lines. Null and empty
    texts stay as they are; an empty table gives an empty result; other columns pass through.
    """
    gone = _dropped(docs).withColumnsRenamed({"doc_id": "__doc", "text_hash": "__of", "dropped": "__gone"})
    rows = docs.withColumn("__hash", _text_hash())
    joined = rows.join(gone, (F.col("__hash") == F.col("__of")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__doc")), "left")
    cut = F.split("text", "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(cut, i)), "\n")
    )
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c != into]
    return joined.select(*columns, F.sort_array(F.coalesce("__gone", F.array().cast("array<int>"))).alias(into))


#: The same in DuckDB: equal lines by their least place, near lines among those that share their first or last half.
ORACLE = """
WITH cut AS (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, i - 1 AS place, trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM cut)
), firsts AS (
    SELECT line, min((doc_id, place)) AS spot, string_split(line, ' ') AS words, len(string_split(line, ' ')) AS n
    FROM line WHERE line <> '' GROUP BY line
), halved AS (
    SELECT *, unnest([n, n + 1]) AS longest FROM firsts WHERE n >= 8
), half AS (
    SELECT line, words, n, spot, longest, 'first' AS side, words[1:((longest - 1) // 2)] AS part FROM halved
    UNION ALL
    SELECT line, words, n, spot, longest, 'last', words[(n - (longest - 1) // 2 + 1):n] FROM halved
), pair AS (
    SELECT DISTINCT a.line, a.words AS a, a.n AS na, b.words AS b, b.n AS nb, b.spot
    FROM half a JOIN half b USING (longest, side, part)
    WHERE a.line <> b.line AND greatest(a.n, b.n) = longest AND b.spot < a.spot
), near AS (
    SELECT line, min(spot) AS spot FROM pair
    WHERE CASE
        WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: a[i] <> b[i])) = 1
        WHEN na = nb + 1 THEN len(list_filter(range(1, na + 1), lambda i: list_concat(a[1:(i - 1)], a[(i + 1):na]) = b)) > 0
        WHEN nb = na + 1 THEN len(list_filter(range(1, nb + 1), lambda i: list_concat(b[1:(i - 1)], b[(i + 1):nb]) = a)) > 0
        ELSE false END
    GROUP BY line
), gone AS (
    SELECT l.doc_id, l.place FROM line l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
    WHERE (l.doc_id, l.place) > f.spot OR (l.doc_id, l.place) > n.spot
), dropped AS (
    SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
    CASE WHEN places IS NULL THEN d.text ELSE
        array_to_string(list_transform(
            list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(places, i - 1)), lambda i: lines[i]), chr(10))
    END AS text,
    CAST(len(lines) AS INTEGER) AS n_lines,
    CAST(coalesce(len(places), 0) AS INTEGER) AS n_dropped
FROM documents d JOIN cut USING (doc_id) LEFT JOIN dropped USING (doc_id)
"""
