"""Periodic runs of words, found with multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q, at least `least` words and two periods long, that no
neighbouring word extends. The words of a text become numbers, then

- periods below SHORT are found by comparing the text with itself q words on (direct lag scans);
- periods in [2w, 4w), for w = 16, 32, 64 ..., start from the minimizers of windows of w grams of w words: inside a run
  equal windows lie q apart, so their minimizers do too. Minimizers with equal grams are paired at those distances and every
  pair is grown in both directions by comparing words, so that a hash collision costs time and never a result.
- a gram with a period of at most half its length lies in a run already known and is no minimizer: without it equal grams lie
  more than w / 2 apart, which bounds the pairs of a gram at each scale. What only such grams could show are runs whose two
  halves lie in two known runs of one shorter period that touch; those are listed from these pairs.

The work is about n log n words for n words, whatever they repeat. A text is one row and one task works on it; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfwise.llm.common import texts

#: Periods below this are found by lag scans; the first scale starts at windows of half as many words.
SHORT = 32
LEAST = 12
#: Bytes of text whose results are held before they are handed on.
FLUSH = 8 << 20
_NEVER = np.uint64(1 << 63)


def _stretches(hit: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the maximal stretches of True of at least `least`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    spans = edges.reshape(-1, 2)
    return spans[spans[:, 1] - spans[:, 0] >= least]


def _sliding(values: np.ndarray, width: int, best: np.ufunc, worst) -> np.ndarray:
    """best over every window of `width` values, by prefix and suffix bests of blocks."""
    n = len(values)
    blocks = np.concatenate((values, np.full(-n % width, worst, values.dtype))).reshape(-1, width)
    before = best.accumulate(blocks, axis=1).ravel()
    after = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(after[: n - width + 1], before[width - 1 : n])


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _grown(words: np.ndarray, left: int, lag: int) -> tuple[int, int]:
    """The maximal stretch (start, end) around `left` of words that equal those `lag` on; empty if `left` itself does not."""
    n, end, step = len(words) - lag, left, 16
    while end < n:
        stop = min(n, end + step)
        differ = words[end:stop] != words[end + lag : stop + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, step * 2
    start, step = left, 16
    while end > left and start > 0:
        stop = max(0, start - step)
        differ = (words[stop:start] != words[stop + lag : start + lag])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = stop, step * 2
    return start, end


class _Found:
    """Runs by their span: an interval has one smallest period, and its multiples are found with the same span."""

    def __init__(self, least: int) -> None:
        self.least, self.period = least, {}

    def add(self, start: int, end: int, lag: int) -> None:
        """A maximal stretch [start, end) of words equal to those lag on."""
        length = end - start + lag
        if end - start >= lag and length >= self.least:
            span = (int(start), int(end) + lag)
            self.period[span] = min(lag, self.period.get(span, lag))

    def table(self) -> np.ndarray:
        """start, end, period by start, then period."""
        rows = sorted((s, q, e) for (s, e), q in self.period.items())
        return np.array([(s, e, q) for s, q, e in rows], np.int64).reshape(-1, 3)


def _scale(words: np.ndarray, grams: np.ndarray, width: int, found: _Found) -> None:
    """Runs of periods in [2 width, 4 width) that hold a gram of no small period."""
    n, usable = len(words), grams >> np.uint64(1)
    spans = found.table()
    spans = spans[(spans[:, 2] * 2 <= width) & (spans[:, 1] - spans[:, 0] >= width)]
    if len(spans):
        depth = np.zeros(len(usable) + 1, np.int64)
        np.add.at(depth, spans[:, 0], 1)
        np.add.at(depth, spans[:, 1] - width + 1, -1)
        usable[np.cumsum(depth[:-1]) > 0] = _NEVER
    if len(usable) < width:
        return
    low = _sliding(usable, width, np.minimum, _NEVER)
    around = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    chosen = np.flatnonzero((_sliding(around, width, np.maximum, np.uint64(0)) == usable) & (usable != _NEVER))
    if len(chosen) < 2:
        return
    order = np.argsort(usable[chosen], kind="stable")
    at, key = chosen[order], usable[chosen][order]
    done: dict[int, int] = {}
    pairs = []
    for step in range(1, len(at)):  # the step-th next minimizer with an equal gram, while any is near enough
        near = (key[step:] == key[:-step]) & (at[step:] - at[:-step] < 4 * width)
        if not near.any():
            break
        first, second = at[:-step][near], at[step:][near]
        far = second - first >= 2 * width
        pairs.append(np.stack((first[far], second[far] - first[far]), axis=1))
    if not pairs:
        return
    pairs = np.concatenate(pairs)
    for left, lag in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if 2 * lag <= n and done.get(lag, 0) <= left:
            start, end = _grown(words, left, lag)
            done[lag] = max(end, left + 1)
            found.add(start, end, lag)


def _touching(words: np.ndarray, found: _Found) -> None:
    """Runs of longer periods across two runs of one shorter period that touch or overlap."""
    rows = found.table()
    last: dict[int, tuple[int, int]] = {}
    for s2, e2, p in rows.tolist():
        before, last[p] = last.get(p), (s2, e2)
        if before is None or before[1] < s2:
            continue
        s1, e1 = before
        root, doubled = words[s2 : s2 + p], np.concatenate((words[s1 : s1 + p],) * 2)
        shift = next((d for d in np.flatnonzero(doubled[:p] == root[0]).tolist() if np.array_equal(doubled[d : d + p], root)), None)
        if shift is None:
            continue
        least, most = max(4 * p, SHORT), min(e1 - s1, e2 - s2)
        for lag in range(least + (s2 - s1 - shift - least) % p, most + 1, p):
            start, end = max(s1, s2 - lag), min(e1, e2 - lag)
            if end - start < lag:
                continue
            if s1 == s2 - lag or e1 == e2 - lag:  # the runs end together: the words beyond may go on being equal
                start, end = _grown(words, start, lag)
            found.add(start, end, lag)


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of numbers: rows (start, end, period), by start, then period."""
    n, found = len(words), _Found(least)
    for lag in range(1, min(SHORT, n // 2 + 1)):
        hit = words[:-lag] == words[lag:]
        if np.count_nonzero(hit) >= max(lag, least - lag):
            for start, end in _stretches(hit, max(lag, least - lag)).tolist():
                found.add(start, end, lag)
    width, grams = SHORT // 2, None
    while 4 * width <= n:
        if grams is None:
            grams, size = _mixed(words.astype(np.uint64) + np.uint64(1)), 1
        while size < width:
            grams = _mixed(grams[:-size] * np.uint64(0xD6E8FEB86659FD93) + grams[size:])
            size *= 2
        _scale(words, grams, width, found)
        width *= 2
    if n >= 2 * SHORT and found.period:
        _touching(words, found)
    return found.table()


def _row(text: bytes | None, least: int) -> tuple[np.ndarray, bytes]:
    words = (text or b"").split()
    known: dict[bytes, int] = {}
    found = runs_of(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)), least)
    if len(found):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, found[:, 0] + found[:, 2], 1)
        np.add.at(depth, found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
    return found, b" ".join(words)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with `runs`, an array of (start, length, period) by start, then period, and `collapsed`: the words
    that no run repeats (those after the first period of any run go), joined by one blank.

    Words are runs of anything but ASCII white space, numbered from 0. A text that is null, empty or blank has no runs and
    collapses to the empty text. Repeated rows are worked on one by one; all columns of docs are carried along, so none may be
    named runs or collapsed. An empty table gives an empty result.
    """
    taken = {"runs", "collapsed"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)} first")
    return _with_runs(docs, docs.columns, least)


def _with_runs(docs: DataFrame, carried: list[str], least: int) -> DataFrame:
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, found, collapsed = 0, 0, [], []
            for i, text in enumerate(texts(batch.column(1))):
                spans, rest = _row(text, least)
                found.append(spans), collapsed.append(rest)
                held += len(rest) + spans.nbytes
                if held > FLUSH or i + 1 == batch.num_rows:
                    yield _result(batch.column(0).slice(at, i + 1 - at), found, collapsed, kind)
                    at, held, found, collapsed = i + 1, 0, [], []

    schema = f"row {packed.schema['row'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return packed.mapInArrow(run, schema).select("row.*", "runs", "collapsed")


def _result(rows: pa.Array, found: list, collapsed: list, kind: pa.DataType) -> pa.RecordBatch:
    spans = np.concatenate(found)
    ends = np.cumsum([0] + [len(f) for f in found], dtype=np.int32)
    fields = [pa.array(spans[:, 0]), pa.array(spans[:, 1] - spans[:, 0]), pa.array(spans[:, 2])]
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([rows, lists.cast(kind), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["row", "runs", "collapsed"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the longest run (ties: smallest start, then period; nulls
    without one); runs_sha256 of the lines `start,length,period`; collapsed_sha256."""
    found = _with_runs(docs, ["doc_id"], LEAST)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    ranked = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return ranked.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): docs in which one document in ten repeats itself, so that there is something to find.

    With h the crc32 of the decimal doc_id (null: the empty text), g = h div 10 and n words: if h is divisible by 10, word
    i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    hit = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("w"))
    n, g = F.size("w"), F.expr("h div 10")
    sized = hit.select("doc_id", "text", "w", n.alias("n"), g.alias("g")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    sized = sized.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    repeated = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[a + (i - a) % p])), ' ')")
    return sized.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
