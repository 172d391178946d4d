"""Language-model scores by class-based bigrams: P(word | before) = P(class of word | class of before) * P(word | class).

Words are put into classes by exchange clustering: in each round every second word moves to the class under which its
neighbours on both sides, counted over the whole training text, are likeliest. Counts of words, of classes in sequence and of
neighbours all come from all training documents, and all words take part, in two ways:

- the `head` most frequent words (a parameter; it bounds what is broadcast and what a task sums up) have one class for what
  precedes them and what follows them, found in the rounds;
- every other word gets its class from the classes before it, in one step on Spark (words grouped by hash), and as a context
  all of them count as one. Their counts, classes and scores are looked up in joins on the word's hash, never sent whole.

Probabilities are smoothed and add up to one over all words and the event "never seen": class transitions are drawn to the class
frequencies, and within a class every word gives a discount to the words never seen.

A document is encoded once, as the ranks of its head words and the hashes of the others; the rounds and the scoring read only
that. Words are told apart by XXH64 (64 bits).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.llm.common import stored, texts

HEAD = 1 << 18
CLASSES = 64
ROUNDS = 4
#: Words counted at once by a task; tokens of the encoded text that one task of a round reads at least.
FLUSH = 1 << 22
TOKENS_A_TASK = 1 << 28
#: Head words whose neighbour counts travel as one row.
WORDS_A_BLOCK = 1 << 10
#: Weight of the class frequencies in class transitions.
PULL = 1.0
_TINY = 1e-300
_NO_WORDS = np.zeros(0, np.uint64)


def _hashes(text: bytes | None) -> np.ndarray:
    """The words of a text as hashes: A-Z lower-cased, runs of anything but ASCII white space."""
    words = (text or b"").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) if words else _NO_WORDS


def _words(spark: SparkSession, docs: DataFrame, learn: Column) -> DataFrame:
    """(hash, n) of every distinct word of the documents to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in texts(batch.column(0)):
                held.append(_hashes(text))
                size += len(held[-1])
                if size >= FLUSH:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    parts = docs.where(learn).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "hash long, n long")
    return parts.groupBy("hash").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Word counts of the training text. table: (hash, n) of all words; head words stand by falling count, then hash."""

    table: DataFrame
    hashes: np.ndarray
    counts: np.ndarray
    documents: int
    tokens: int
    types: int
    discount: float

    @property
    def size(self) -> int:
        return len(self.hashes)


def vocabulary(docs: DataFrame, learn: Column, head: int = HEAD) -> Vocabulary:
    """Counts over the documents where learn is true; every text ends in one end token, a word of its own."""
    table = stored(_words(docs.sparkSession, docs, learn), "words")
    n_docs = docs.where(learn).count()
    total, types, once, twice = table.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = table.orderBy(F.desc("n"), "hash").limit(head).toArrow()
    return Vocabulary(
        table, top["hash"].to_numpy().astype(np.int64).view(np.uint64), top["n"].to_numpy().astype(np.int64), n_docs,
        (total or 0) + n_docs, types + (n_docs > 0), (once + 1) / (once + 2 * twice + 2),
    )


def encode(docs: DataFrame, words: Vocabulary, learn: Column) -> DataFrame:
    """(row, doc_id, learn, ids, rest) of every row of docs: the ranks of its words (-1: no head word) and the hashes of the
    others, both in order. row numbers the rows."""
    order = np.argsort(words.hashes)
    keys = docs.sparkSession.sparkContext.broadcast((words.hashes[order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_keys, rank = keys.value
        for batch in batches:
            at, held, size = 0, [], 0
            for i, text in enumerate(texts(batch.column(2))):
                held.append(_hashes(text))
                size += len(held[-1])
                if size >= FLUSH or i + 1 == batch.num_rows:
                    yield ranked(batch.slice(at, i + 1 - at), held, sorted_keys, rank)
                    at, held, size = i + 1, [], 0

    def ranked(batch: pa.RecordBatch, held: list[np.ndarray], sorted_keys: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        flat = np.concatenate(held)
        ids = np.full(len(flat), -1, np.int32)
        if len(sorted_keys):
            near = np.minimum(np.searchsorted(sorted_keys, flat), len(sorted_keys) - 1)
            ids = np.where(sorted_keys[near] == flat, rank[near], ids)
        ends = np.cumsum([0] + [len(h) for h in held])
        other = ids < 0
        other_ends = np.concatenate(([0], np.cumsum(other)))[ends]
        lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in ((ends, ids), (other_ends, flat[other].view(np.int64)))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "learn", "ids", "rest"])

    rows = docs.select(F.col("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = rows.mapInArrow(run, f"doc_id {kind}, learn boolean, ids array<int>, rest array<bigint>")
    return stored(encoded.select(F.monotonically_increasing_id().alias("row"), "*"), "encoded")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _sequence(ids: np.ndarray, ends: np.ndarray, of_id: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): for each token, an end after each text included, the context class and its own class.

    Classes are 0 .. classes - 1 of head words, then that of all other words, then the edge of a text.
    """
    n, rest, edge = len(ends) - 1, classes, classes + 1
    own = np.full(len(ids) + n, edge, np.int16)
    inside = np.ones(len(own), bool)
    inside[ends[1:] + np.arange(n)] = False
    own[inside] = np.where(ids >= 0, of_id[ids], rest) if len(of_id) else rest
    return np.concatenate(([edge], own[:-1])).astype(np.int16), own


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _blocks(words: Vocabulary, parity: int) -> int:
    """Blocks of the words that move. The i-th of them lies in block i mod blocks, so that all have their share of frequent ones."""
    return max(1, -(-((words.size + 1 - parity) // 2) // WORDS_A_BLOCK))


def _neighbours(encoded: DataFrame, words: Vocabulary, of_id: np.ndarray, classes: int, parity: int) -> DataFrame:
    """(block, payload): sums over the training text. Block b: class counts before and after the head words of the block
    that move this round; block -1: counts of classes in sequence."""
    spark, wide, step = encoded.sparkSession, classes + 2, 2
    sent = spark.sparkContext.broadcast(of_id)
    blocks = _blocks(words, parity)
    per_block = -(-words.size // (step * blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, pairs = sent.value, np.zeros(wide * wide, np.int64)
        around = np.zeros(blocks * per_block * 2 * wide, np.int32)
        for batch in batches:
            ids, ends = _flat(batch.column(0))
            before, own = _sequence(ids, ends, of, classes)
            pairs += np.bincount(before.astype(np.int32) * wide + own, minlength=wide * wide)
            places = np.arange(len(ids)) + np.searchsorted(ends[1:], np.arange(len(ids)), side="right")
            taken = (ids >= 0) & (ids % step == parity)
            word, place = (ids[taken] // step).astype(np.int64), places[taken]
            word = (word % blocks * per_block + word // blocks) * (2 * wide)
            keys, n = np.unique(np.concatenate((word + before[place], word + wide + own[place + 1])), return_counts=True)
            around[keys] += n.astype(np.int32)
        yield block(-1, pairs)
        for b, part in enumerate(around.reshape(blocks, -1)):
            if part.any():
                yield block(b, part)

    def block(b: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(values)], pa.binary())], names=["block", "payload"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-words.tokens // TOKENS_A_TASK))
    parts = encoded.where("learn").select("ids").coalesce(tasks).mapInArrow(run, "block int, payload binary")
    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, payload binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (block, payload) to one row a block; the sums are 64-bit."""
    key, total = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([_packed(total)], pa.binary())], names=["block", "payload"])

    for batch in batches:
        for b, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key is not None and b != key:
                yield done()
            values = np.frombuffer(zlib.decompress(payload.as_py()), np.int64 if b < 0 else np.int32).astype(np.int64)
            key, total = b, values if b != key else total + values
    if key is not None:
        yield done()


def _likelihood(pairs: np.ndarray) -> float:
    """What of the log likelihood depends on the classes."""
    xlogx = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return xlogx(pairs) - xlogx(pairs.sum(axis=0)) - xlogx(pairs.sum(axis=1))


def _moves(sums: DataFrame, words: Vocabulary, pairs: np.ndarray, classes: int, parity: int) -> np.ndarray:
    """(word, class) of every head word that moves this round. Bounded by the head."""
    wide = classes + 2
    counts = pairs.astype(float) + PULL / wide
    forward = np.log(counts / counts.sum(axis=1, keepdims=True))
    size = np.log(np.maximum(pairs.sum(axis=0)[:classes], 1.0))
    blocks = _blocks(words, parity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                around = np.frombuffer(zlib.decompress(payload.as_py()), np.int64).reshape(-1, 2, wide).astype(float)
                gain = around[:, 0] @ forward[:, :classes] + around[:, 1] @ forward[:classes].T - around[:, 0].sum(axis=1, keepdims=True) * size
                seen = np.flatnonzero(around[:, 0].sum(axis=1))
                word = (seen * blocks + b) * 2 + parity
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(gain[seen].argmax(axis=1), pa.int32())], names=["word", "class"])

    found = sums.where("block >= 0").mapInArrow(run, "word int, class int").toArrow()
    return np.stack((found["word"].to_numpy(), found["class"].to_numpy()))


def _pairs(sums: DataFrame, classes: int) -> np.ndarray:
    row = sums.where("block = -1").first()
    values = np.frombuffer(zlib.decompress(row.payload), np.int64) if row else np.zeros((classes + 2) ** 2, np.int64)
    return values.reshape(classes + 2, classes + 2).copy()


def cluster(encoded: DataFrame, words: Vocabulary, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of each head word, counts of classes in sequence, log likelihood before each round and at the end).

    At first the most frequent words have a class each and the others follow by rank. All words that move in a round are judged
    against the counts before it; every other word stays, so neighbours do not swap places. The likeliest state is kept.
    """
    of_id = (np.arange(words.size) % classes).astype(np.int16)
    best, trace = None, []
    for turn in range(rounds + 1):
        sums = stored(_neighbours(encoded, words, of_id, classes, turn % 2), "neighbours")
        pairs = _pairs(sums, classes)
        trace.append(_likelihood(pairs))
        if best is None or trace[-1] > best[0]:
            best = trace[-1], of_id, pairs
        if turn < rounds:
            moved = _moves(sums, words, pairs, classes, turn % 2)
            of_id = of_id.copy()
            of_id[moved[0]] = moved[1]
    return best[1], best[2], trace


@dataclass
class Model:
    """rest: (hash, n, class) of all words but the head. transition: log10 P(class | context); emission: log10 P(word | class) of
    head words; unseen: log10 P(never seen | context); size: log10 of the class sizes."""

    words: Vocabulary
    classes: int
    of_id: np.ndarray
    rest: DataFrame
    transition: np.ndarray
    emission: np.ndarray
    unseen: np.ndarray
    size: np.ndarray

    def perplexity(self, scores: DataFrame) -> float:
        """Of all tokens of scores."""
        total, n = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
        return 10 ** (-total / n)


def _contexts(encoded: DataFrame, words: Vocabulary, of_id: np.ndarray, classes: int) -> DataFrame:
    """(hash, context) of every occurrence of a word outside the head in the training text."""
    sent = encoded.sparkSession.sparkContext.broadcast(of_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = _flat(batch.column(0))
            rest, _ = _flat(batch.column(1))
            before, own = _sequence(ids, ends, sent.value, classes)
            yield pa.RecordBatch.from_arrays([pa.array(rest), pa.array(before[own == classes].astype(np.int32))], names=["hash", "context"])

    return encoded.where("learn AND size(rest) > 0").select("ids", "rest").mapInArrow(run, "hash long, context int")


def fit(encoded: DataFrame, words: Vocabulary, classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """The model of the rows of encoded that are learnt from."""
    of_id, pairs, _ = cluster(encoded, words, classes, rounds)
    wide = classes + 2
    counts = pairs.astype(float) + PULL / wide
    forward = np.log(counts / counts.sum(axis=1, keepdims=True))[:, :classes]
    # A word is likeliest in the class that its contexts predict, for the share it would have there.
    pull = forward - np.log(np.maximum(pairs.sum(axis=0)[:classes], 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, ends = _flat(batch.column(1))
            n, _ = _flat(batch.column(2))
            gain = np.add.reduceat(pull[context] * n[:, None], ends[:-1], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain.argmax(axis=1), pa.int32())], names=["hash", "contexts", "ns", "class"])

    # Both groupings need only the one shuffle by hash.
    seen = _contexts(encoded, words, of_id, classes).repartition("hash").groupBy("hash", "context").agg(F.count("*").alias("n"))
    grouped = seen.groupBy("hash").agg(F.collect_list(F.struct("context", "n")).alias("l")).select("hash", "l.context", "l.n")
    placed = stored(grouped.mapInArrow(run, "hash long, contexts array<int>, ns array<bigint>, class int"), "other_words")
    flat = placed.select("class", F.explode(F.arrays_zip("contexts", "ns")).alias("e"))
    added = flat.groupBy("class", F.col("e.contexts").alias("context")).agg(F.sum("e.ns").alias("n")).collect()  # classes x contexts
    rest = placed.select("hash", F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"), "class")

    final = pairs.astype(float)
    final[:, classes] = 0
    for row in added:
        final[row.context, row["class"]] += row.n
    types = np.bincount(of_id, minlength=classes).astype(float)
    for row in rest.groupBy("class").count().collect():
        types[row["class"]] += row["count"]
    return _model(words, classes, of_id, rest, final[:, [*range(classes), classes + 1]], types)


def _model(words: Vocabulary, classes: int, of_id: np.ndarray, rest: DataFrame, counts: np.ndarray, types: np.ndarray) -> Model:
    """counts: contexts x (classes and the end)."""
    size = counts.sum(axis=0)
    share = size / max(size.sum(), 1.0)
    transition = (counts + PULL * share) / (counts.sum(axis=1, keepdims=True) + PULL)
    inside = np.maximum(size[:classes], 1.0)
    unseen = transition[:, :classes] @ (words.discount * types / inside)
    # A class without words is never met; without any word in training an unseen one scores as in base_score.
    unseen = np.where(unseen > 0, unseen, 0.1 / (words.tokens + 0.1 * (words.types + 1)))
    emission = (words.counts - words.discount) / inside[of_id]
    return Model(words, classes, of_id, rest, np.log10(np.maximum(transition, _TINY)), np.log10(emission), np.log10(unseen), np.log10(inside))


_PARTS = "row long, doc_id {}, learn boolean, n_tokens long, known long, base double, part double, rest array<bigint>, contexts array<int>"


def score(encoded: DataFrame, model: Model) -> DataFrame:
    """One row for each row of encoded: doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score: log10 probability of the text and its end; base_score: the sum of log10((c + 0.1) / (N + 0.1 (V + 1))), c the
    count of a token, N of all and V of distinct tokens in training. A text that is null, empty or blank is its end alone. Where nothing was learnt, every score is 0.
    """
    words, classes = model.words, model.classes
    if not words.tokens:
        zero, n = F.lit(0.0), F.size("ids") + 1
        return encoded.select("doc_id", "learn", n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"), F.lit(1.0).alias("perplexity"))
    lost = np.log10(words.tokens + 0.1 * (words.types + 1))
    by_rank = np.concatenate((np.log10(words.counts + 0.1), [0.0]))
    emission = np.concatenate((model.emission, [0.0]))
    table = np.insert(model.transition, classes, 0.0, axis=1)  # what other words add comes from the join
    sent = encoded.sparkSession.sparkContext.broadcast((model.of_id, by_rank, emission, table, float(np.log10(words.documents + 0.1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_id, base_of, emission_of, table, end = sent.value
        for batch in batches:
            ids, ends = _flat(batch.column(3))
            before, own = _sequence(ids, ends, of_id, classes)
            starts, lengths = ends[:-1] + np.arange(len(ends) - 1), np.diff(ends)
            spread = np.zeros((2, len(own)))
            inside = own <= classes
            spread[0, inside], spread[0, ~inside] = base_of[ids], end
            spread[1] = table[before, own]
            spread[1, inside] += emission_of[ids]
            base, part = np.add.reduceat(spread, starts, axis=1)
            known = np.add.reduceat((own != classes).astype(np.int64), starts)
            rest = batch.column(4)
            _, rest_ends = _flat(rest)
            contexts = pa.ListArray.from_arrays(pa.array(rest_ends.astype(np.int32)), pa.array(before[own == classes].astype(np.int32)))
            columns = [pa.array(lengths.astype(np.int64) + 1), pa.array(known), pa.array(base), pa.array(part), rest, contexts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["row", "doc_id", "learn", "n_tokens", "known", "base", "part", "rest", "contexts"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    parts = stored(encoded.select("row", "doc_id", "learn", "ids", "rest").mapInArrow(_whole(run), _PARTS.format(kind)), "scores")
    others = parts.where("size(rest) > 0").select("row", F.explode(F.arrays_zip("rest", "contexts")).alias("e"))
    others = others.select("row", F.col("e.rest").alias("hash"), F.col("e.contexts").alias("context"))
    met = others.join(model.rest, "hash", "left")
    emitted = F.log10(F.col("n") - words.discount) - _at(model.size, "class")
    seen = F.col("n").isNotNull()
    summed = met.select(
        "row",
        F.log10(F.coalesce("n", F.lit(0)) + 0.1).alias("b"),
        F.when(seen, _at(model.transition[:, :classes].ravel(), F.col("context") * classes + F.col("class")) + emitted).otherwise(_at(model.unseen, "context")).alias("s"),
        seen.cast("long").alias("k"),
    ).groupBy("row").agg(F.sum("b").alias("b"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    joined = parts.drop("rest", "contexts").join(summed, "row", "left")
    total = F.col("part") + F.coalesce("s", F.lit(0.0))
    return joined.select(
        "doc_id", "learn", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * float(lost)).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def _whole(run: Callable) -> Callable:
    return lambda batches: run(b for b in batches if b.num_rows)


def _at(values: np.ndarray, index: Column | str) -> Column:
    """The value at an index of a list that the model's parameters bound."""
    place = F.col(index) if isinstance(index, str) else index
    return F.element_at(F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})"), place.cast("int") + 1)


def score_corpus(docs: DataFrame, learn: Column, head: int = HEAD, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """score() of every row of docs (doc_id, text) by a model of the rows where learn is true (null: false).

    Repeated rows count and are scored one by one. Other columns are not read. An empty table gives an empty result.
    """
    words = vocabulary(docs, learn, head)
    encoded = encode(docs, words, learn)
    return score(encoded, fit(encoded, words, classes, rounds))
