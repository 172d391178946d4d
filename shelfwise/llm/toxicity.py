"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Every word of the examples is a term, and so is every stem that LEAST_DOCS examples have. A term's weight is its TF-IDF times
its relevance: how clearly more frequent it is in toxic examples, and FLOOR for all others. Terms are counted on Spark and known
by 64-bit hash; terms that share a hash are one term. The examples lie in blocks of similar ones. A query adds up its rare terms
from their lists; of the frequent terms each block keeps the largest weight, which bounds the cosines in it, and blocks whose
bound is below the k-th best cosine are skipped. The result is that of a full search. The neighbours' labels, weighted by
squared cosine, make a vote that a logistic curve, fitted on the examples' own votes without themselves, turns into a score.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfwise.llm.common import by_batch, crc_of, stored, texts
from shelfwise.llm.hashing import mixed, powers
from shelfwise.llm.linear import Logistic, logit, sigmoid
from shelfwise.llm.vocab import shared

#: Most labelled documents that fitting uses, and most bytes of text they have together.
MAX_EXAMPLES, MAX_BYTES = 10_000, 64 << 20
#: Least relevance of a term, least documents that have a stem, lengths of stems.
FLOOR, LEAST_DOCS, STEMS = 0.02, 5, (5, 6, 7, 8)
#: Terms that so large a share of the examples has are bounded by block; examples of a block; so many texts are searched at once.
DENSE, BLOCK, TOGETHER, TOGETHER_BYTES = 0.05, 32, 128, 4 << 20
#: What rounding may take from a cosine of single precision.
SLACK = 1e-5
NEIGHBOURS, EVIDENCE = 15, 3
#: Code points handled at once.
PIECE = 1 << 18
#: Blocks that are added up together where more than this share of queries and blocks is wanted.
STRETCH, MOST = 16, 0.4
THRESHOLD = 0.5
SEED = 23

_NEAR = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))


@cache
def _in_word() -> np.ndarray:
    """Which code points are letters, digits or the low line."""
    return np.array([chr(c).isalnum() or c == ord("_") for c in range(sys.maxunicode + 1)])


def _points(batch: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, code points in lower case, where each text begins): texts joined by a blank up to PIECE code
    points, a longer one in pieces that end between words."""
    start, held, size = 0, [], 0
    for i, text in enumerate(batch):
        held.append((text or b"").decode().lower())
        size += len(held[-1]) + 1
        if size < PIECE and i + 1 < len(batch):
            continue
        begins = np.cumsum([0, *(len(own) + 1 for own in held[:-1])])
        points = np.frombuffer(" ".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = 0
        while at < len(points):
            end = min(at + 2 * PIECE, len(points))
            while end < len(points) and _in_word()[points[end]]:
                end += 1
            first = max(np.searchsorted(begins, at, "right") - 1, 0)
            yield start + first, points[at:end], np.maximum(begins[first:] - at, 0)
            at = end
        start, held, size = i + 1, [], 0


def _forms(batch: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, forms, has) by pieces: the text of each occurrence of a word and the word's place among the different words,
    hashes of these words and their stems, and which of them there are."""
    for text, points, begins in _points(batch):
        inside = np.concatenate([[False], _in_word()[points], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        up, down = powers(len(points) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[: len(points)], dtype=np.uint64)])
        code = (total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)
        _, at, word = np.unique(code, return_index=True, return_inverse=True)
        first, length = start[at], (end - start)[at]
        forms = np.zeros((len(at), 1 + len(STEMS)), np.uint64)
        forms[:, 0] = mixed(code[at])
        has = np.column_stack([np.ones(len(at), bool), *(length > n for n in STEMS)])
        for column, n in enumerate(STEMS, 1):
            long = has[:, column]
            forms[long, column] = mixed((total[first[long] + n] - total[first[long]]) * down[first[long]] + np.uint64((n << 32) + 1))
        yield text + np.searchsorted(begins, start, "right") - 1, word, forms.view(np.int64), has


def examples(labels: DataFrame, learn: Column, limit: int) -> DataFrame:
    """(doc_id, toxic): at most limit labelled documents where learn holds, picked by a hash of doc_id; of conflicting labels
    1 counts."""
    known = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    count = known.count()
    place = F.xxhash64("doc_id", F.lit(SEED))
    share = F.pmod(place, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * limit / max(count, 1)))
    return known.where(share).orderBy(place, "doc_id").limit(limit)


def within(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Of at most MAX_EXAMPLES rows (doc_id, toxic, text) the first by a hash of doc_id that have max_bytes of text together;
    a text that is longer than that alone does not count."""
    size = F.octet_length("text").cast("long")
    running = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))
    sizes = rows.select("doc_id", F.coalesce(size, F.lit(0)).alias("size")).where(F.col("size") <= max_bytes)
    return rows.join(sizes.withColumn("up_to", running).where(F.col("up_to") <= max_bytes).select("doc_id"), "doc_id")


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, plain, toxic): in how many rows (text, toxic) of either label a term, known by its hash, stands; every word counts,
    and every stem that LEAST_DOCS rows have."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column(1).to_numpy()
        found = {True: [], False: []}
        for text, word, forms, has in _forms(list(texts(batch.column(0)))):
            for column in range(forms.shape[1]):
                there = has[word, column]
                found[column == 0].append((text[there], forms[word[there], column]))
        parts = []
        for is_word, pairs in found.items():
            text, form = (np.concatenate(x) for x in zip(*pairs))
            names, number = np.unique(form, return_inverse=True)
            text, number = np.divmod(np.unique(text * max(len(names), 1) + number), max(len(names), 1))
            plain, toxic = (np.bincount(number[label[text] == v], minlength=len(names)) for v in (0, 1))
            parts.append((names, plain, toxic, np.full(len(names), is_word)))
        return pa.RecordBatch.from_pydict(dict(zip(("term", "plain", "toxic", "word"), map(np.concatenate, zip(*parts)))))

    sums = by_batch(rows.select("text", "toxic"), run, "term long, plain long, toxic long, word boolean").groupBy("term")
    sums = sums.agg(F.sum("plain").cast("int").alias("plain"), F.sum("toxic").cast("int").alias("toxic"), F.bool_or("word").alias("word"))
    return sums.where(F.col("word") | (F.col("plain") + F.col("toxic") >= LEAST_DOCS)).select("term", "plain", "toxic")


def term_weights(plain: np.ndarray, toxic: np.ndarray, n_plain: int, n_toxic: int) -> np.ndarray:
    """The inverse document frequency of each term times its relevance: how significantly larger its share of toxic documents
    is, in parts of the largest, and FLOOR at least."""
    docs, n = plain + toxic, n_plain + n_toxic
    share = docs / n
    # A term that all documents have says nothing; its z is 0.
    z = (toxic / n_toxic - plain / n_plain) / (np.sqrt(share * (1 - share) * (1 / n_plain + 1 / n_toxic)) + 1e-9)
    relevance = FLOOR + np.clip(z / max(z.max(initial=0.0), 1e-9), 0, 1)
    return (np.log((1 + n) / (1 + docs)) + 1) * relevance


class Vectors:
    """Texts as unit vectors over the terms, which are numbered in the order of their hashes.

    A vector set is (bounds, terms, weights): text i has the terms and weights from bounds[i] to bounds[i + 1]."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        by = np.argsort(terms)
        self.terms, self.idf = terms[by], weights[by]

    def of(self, batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of texts, terms in order; a text without any term has none."""
        keys = [np.empty(0, np.int64)]
        for text, word, forms, has in _forms(batch if len(self.terms) else []):
            at = np.minimum(np.searchsorted(self.terms, forms[has]), len(self.terms) - 1)
            number = np.full(forms.shape, -1)
            number[has] = np.where(self.terms[at] == forms[has], at, -1)
            for column in range(forms.shape[1]):
                term = number[word, column]
                keys.append((text * len(self.terms) + term)[term >= 0])
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        row, terms = np.divmod(key, max(len(self.terms), 1))
        weights = (1 + np.log(times)) * self.idf[terms]
        norm = np.sqrt(np.bincount(row, weights * weights, len(batch)))
        return np.searchsorted(row, np.arange(len(batch) + 1)), terms, weights / norm[row]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, count long, one range after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Index:
    """The examples in blocks of similar ones: lists of the rare terms, and of the frequent ones rows and largest weights.

    The examples are given by doc_id, label, number of terms, and their terms and weights one after another. Lists and blocks
    are made where they are used first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.ids, self.labels, self.terms, self.weights, self.n_terms = ids, labels, terms, weights, n_terms
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        self.lists: np.ndarray | None = None
        self.looked = self.blocks_met = 0

    def __getstate__(self):
        kept = ("ids", "labels", "terms", "weights", "n_terms", "bounds")
        return {name: self.__dict__[name] for name in kept} | {"lists": None, "looked": 0, "blocks_met": 0}

    def vector(self, example: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.bounds[example], self.bounds[example + 1])
        return self.terms[own], self.weights[own]

    def _build(self) -> None:
        lengths, n = np.diff(self.bounds), len(self.ids)
        # Examples of a block share the label and the heaviest term, and are about as long.
        heaviest = [t[w.argmax()] for t, w in map(self.vector, range(n))]
        self.order = np.lexsort((self.ids, lengths, heaviest, -self.labels))
        self.slot = np.empty(n, np.int32)
        self.slot[self.order] = np.arange(n)
        self.n_blocks = -(-n // BLOCK)
        place = np.repeat(self.slot, lengths)
        count = np.bincount(self.terms, minlength=self.n_terms)
        often = np.flatnonzero(count > DENSE * n)
        self.row = np.full(self.n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        row = self.row[self.terms]
        self.rows = np.zeros((self.n_blocks * BLOCK, len(often)), np.float32)
        self.rows[place[row >= 0], row[row >= 0]] = self.weights[row >= 0]
        self.rows = self.rows.reshape(self.n_blocks, BLOCK, len(often))
        self.largest = self.rows.max(axis=1)
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(self.terms[rare], kind="stable")]
        self.lists, self.list_weights = place[rare].astype(np.int64), self.weights[rare].astype(np.float64)
        self.query = np.zeros(self.n_terms, np.float32)
        count[often] = 0
        self.start = np.concatenate([[0], np.cumsum(count)])

    def nearest(self, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query of a vector set (cosine, example) of the k examples of the largest positive cosine, ties to the
        smaller doc_id; not the example without."""
        if self.lists is None:
            self._build()
        bounds, terms, weights = queries
        n = len(bounds) - 1
        query, row = np.repeat(np.arange(n), np.diff(bounds)), self.row[terms]
        often = row >= 0
        dense = np.zeros((n, len(self.largest.T)), np.float32)
        dense[query[often], row[often]] = weights[often]
        rare, heavy, query = terms[~often], weights[~often], query[~often]
        count = self.start[rare + 1] - self.start[rare]
        own = np.searchsorted(query, np.arange(n + 1))
        sums = np.empty((n, self.n_blocks * BLOCK), np.float32)
        for i in range(n):
            part = slice(own[i], own[i + 1])
            at = _spread(self.start[rare[part]], count[part])
            sums[i] = np.bincount(self.lists[at], self.list_weights[at] * np.repeat(heavy[part], count[part]), sums.shape[1])
        if without is not None:
            sums[np.arange(n), self.slot[without]] = -np.inf
        sums = sums.reshape(n, self.n_blocks, BLOCK)
        most = sums.max(axis=2) + dense @ self.largest.T + SLACK
        # The blocks of the best bounds first: they say what the k-th best cosine is at least.
        few = min(-(-k // BLOCK) + 1, self.n_blocks)
        first = np.zeros(most.shape, bool)
        np.put_along_axis(first, np.argpartition(-most, few - 1, axis=1)[:, :few], True, axis=1)
        self._complete(sums, dense, first)
        least = np.zeros(n)
        for i in range(n):
            seen = sums[i, first[i]].ravel()
            if len(seen) >= k:
                least[i] = max(np.partition(seen, -k)[-k] - SLACK, 0)
        rest = (most >= least[:, None]) & ~first
        self._complete(sums, dense, rest)
        self.looked += int(first.sum() + rest.sum())
        self.blocks_met += first.size
        sums[~(first | rest)] = -np.inf
        return [self._best(terms[low:high], weights[low:high], s.ravel(), k) for low, high, s in zip(bounds, bounds[1:], sums)]

    def _complete(self, sums: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Add the frequent terms' part where a query wants a block; blocks that most queries want are multiplied with all at once."""
        share = wanted.mean(axis=0)
        for low in range(0, self.n_blocks, STRETCH):
            stretch = slice(low, min(low + STRETCH, self.n_blocks))
            if share[stretch].mean() > MOST:
                rows = self.rows[stretch].reshape(-1, dense.shape[1])
                more, part = (dense @ rows.T).reshape(len(dense), -1, BLOCK), sums[:, stretch]
                np.add(part, more, out=part, where=wanted[:, stretch, None])
                continue
            for block in low + np.flatnonzero(share[stretch]):
                which = np.flatnonzero(wanted[:, block])
                sums[which, block] += dense[which] @ self.rows[block].T

    def _best(self, terms: np.ndarray, weights: np.ndarray, cosines: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best by cosines summed term after term: they do not depend on what else is searched along."""
        least = np.partition(cosines, -k)[-k] - SLACK if len(cosines) > k else 0
        found = []
        self.query[terms] = weights
        for example in self.order[np.flatnonzero(cosines >= max(least, 1e-30))].tolist():
            own, heavy = self.vector(example)
            found.append((float(self.query[own] @ heavy), example))
        self.query[terms] = 0
        return sorted(found, key=lambda f: (-f[0], self.ids[f[1]]))[:k]


class Voter:
    """The fitted model: terms, index and the curve from votes to scores."""

    def __init__(self, vectors: Vectors | None, index: Index | None, prior: float, silent: float):
        self.vectors, self.index, self.prior, self.silent = vectors, index, prior, silent
        self.curve: Logistic | None = None
        self.held = None

    def __getstate__(self):
        return self.__dict__ | {"held": None}

    def vote(self, found: list[tuple[float, int]]) -> float:
        """The neighbours' labels weighted by squared cosine, with the prior as one more neighbour of cosine 1: a few
        distant neighbours say little."""
        weight = np.array([c * c for c, _ in found])
        return float((weight @ self.index.labels[[i for _, i in found]] + self.prior) / (weight.sum() + 1))

    def found(self, batch: list[bytes | None], without: list[int] | None = None) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """The nearest examples of each text that has a term."""
        for at, part in _together(batch):
            bounds, terms, weights = self.vectors.of(part)
            some = np.flatnonzero(np.diff(bounds))
            near = self.index.nearest((np.append(bounds[some], bounds[-1]), terms, weights), NEIGHBOURS, without and [without[at + i] for i in some])
            yield from zip((at + some).tolist(), near)

    def votes(self, batch: list[bytes | None], ids: list[int]) -> list[float]:
        """The vote on each example, by doc_id, of all the others."""
        place = {doc: i for i, doc in enumerate(self.index.ids.tolist())}
        out = [self.prior] * len(batch)
        own = [i for i, doc in enumerate(ids) if doc in place]
        for i, near in self.found([batch[i] for i in own], [place[ids[i]] for i in own]):
            out[own[i]] = self.vote(near)
        return out

    def fit_curve(self, votes: np.ndarray, labels: np.ndarray) -> None:
        if len(set(labels.tolist())) == 2:
            curve = Logistic(penalty=0.1).fit(logit(votes)[:, None], labels)
            if curve.weights[0] > 0:
                self.curve = curve

    def scores(self, batch: list[bytes | None], curve: Logistic | None) -> list[tuple[float, list[tuple[float, int]]]]:
        """The score from 0 to 1 and the nearest examples of each text."""
        out = [(self.silent, [])] * len(batch)
        if self.index is not None:
            for i, near in self.found(batch):
                if near:
                    vote = self.vote(near)
                    out[i] = float(sigmoid(curve.margin(logit(np.array([[vote]]))))[0]) if curve else vote, near[:EVIDENCE]
        return out


def _together(batch: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """(place, texts): at most TOGETHER texts, of TOGETHER_BYTES or one text."""
    start = size = 0
    for i, text in enumerate(batch):
        own = len(text or b"")
        if i > start and (i - start == TOGETHER or size + own > TOGETHER_BYTES):
            yield start, batch[start:i]
            start, size = i, 0
        size += own
    if start < len(batch):
        yield start, batch[start:]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> Voter:
    """The model learned from at most max_examples labelled documents of max_bytes where learn, a condition on doc_id, holds.

    Terms and index come from these examples alone, so what comes to the driver and is sent to the workers is bounded by the
    parameters: hashes and weights, no texts. The examples' votes on each other are taken in tasks. Without both classes the score
    is the class there is, or 0.
    """
    chosen = F.broadcast(examples(labels, learn, max_examples))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    rows = stored(rows, "labelled")
    # Copies of a text would make its every word look significant; of each text the least doc_id stays.
    alike = rows.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = stored(within(rows.join(alike, "doc_id"), max_bytes), "examples")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Voter(None, None, 0.0, float(next(iter(n), 0)))
    counted = count_terms(rows).toArrow()
    plain, toxic = (counted.column(c).to_numpy().astype(np.float64) for c in ("plain", "toxic"))
    vectors = Vectors(counted.column("term").to_numpy(), term_weights(plain, toxic, n[0], n[1]))
    del counted, plain, toxic
    weighed = shared(docs.sparkSession, vectors)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, found = [], []
        for _, part in _together(list(texts(batch.column(1)))):
            bounds, terms, weights = weighed.value.of(part)
            lengths.append(np.diff(bounds))
            found += [(terms[low:high], weights[low:high]) for low, high in zip(bounds, bounds[1:])]
        columns = [batch.column(0), batch.column(2), pa.array(np.concatenate(lengths), pa.int64()), pa.array([t.astype(np.int32).tobytes() for t, _ in found]), pa.array([w.astype(np.float32).tobytes() for _, w in found])]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "length", "terms", "weights"])

    table = by_batch(rows.select("doc_id", "text", "toxic"), run, "doc_id long, toxic int, length long, terms binary, weights binary").toArrow()
    ids, labelled, lengths = (table.column(c).to_numpy() for c in ("doc_id", "toxic", "length"))
    loud = lengths > 0
    # Of examples without any term, the toxic share; one toxic document of ten is supposed where there are none.
    quiet = float((labelled[~loud].sum() + 0.1) / ((~loud).sum() + 1))
    if not loud.any():
        return Voter(vectors, None, 0.0, quiet)
    terms, weights = (_joined(table.column(c), kind) for c, kind in (("terms", np.int32), ("weights", np.float32)))
    del table
    index = Index(ids[loud], labelled[loud].astype(np.int64), lengths[loud], terms, weights, len(vectors.terms))
    voter = Voter(vectors, index, n[1] / (n[0] + n[1]), quiet)
    voter.held = held = shared(docs.sparkSession, voter)

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        votes = held.value.votes(list(texts(batch.column(1))), batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(2), pa.array(votes, pa.float64())], names=["toxic", "vote"])

    seen = by_batch(rows.select("doc_id", "text", "toxic"), own, "toxic int, vote double").toArrow()
    votes, of = seen.column("vote").to_numpy(), seen.column("toxic").to_numpy()
    by = np.lexsort((votes, of))  # the curve must not depend on the order of the rows
    voter.fit_curve(votes[by], of[by])
    return voter


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of a binary column, one after another."""
    return np.concatenate([np.frombuffer(value.as_buffer(), kind) for value in column if len(value.as_buffer())])


def score(docs: DataFrame, voter: Voter) -> DataFrame:
    """(doc_id, score, predicted, evidence) of every whole text of docs (doc_id, text): evidence are the nearest examples.

    A null or empty text, or one without any known term, gets the toxic share of such examples and no evidence. Repeated rows
    and null doc_ids come back as they went in; other columns are not read; an empty table gives an empty result.
    """
    held = voter.held or shared(docs.sparkSession, voter)
    curve = voter.curve

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = held.value
        found = model.scores(list(texts(batch.column(1))), curve)
        near = [[{"doc_id": model.index.ids[i], "toxic": model.index.labels[i], "cosine": c} for c, i in e] for _, e in found]
        scores = np.array([s for s, _ in found])
        columns = [batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(near, _NEAR)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "evidence"])

    schema = "doc_id long, score double, predicted int, evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>"
    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def held_out(column: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """crc32 of the id's text, modulo parts, is part."""
    return crc_of(column) % parts == part
