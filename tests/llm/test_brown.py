"""Class-based bigrams against plain counting."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import brown, queries
from shelfwise.llm.common import crc_of, table
from tests.conftest import SMALL

END = None


def tokens(text):
    return (text or "").encode().lower().split() + [END]


def learnt(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 != 0


def number(word):
    return np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)


class Plain:
    """The model from its classes and counts over the raw texts."""

    def __init__(self, docs, model):
        words, self.classes = model.words, model.classes
        self.rank = {int(h): i for i, h in enumerate(words.hashes.view(np.int64))}
        self.of = {h: int(model.of_id[i]) for h, i in self.rank.items()} | {r.hash: r["class"] for r in model.rest.collect()}
        self.count, self.pair, self.size, self.types = Counter(), Counter(), Counter(), defaultdict(set)
        for doc_id, text in docs:
            if learnt(doc_id):
                before = "edge"
                for t in tokens(text):
                    c = "end" if t is END else self.of[number(t)]
                    self.count[t] += 1
                    self.pair[before, c] += 1
                    self.size[c] += 1
                    self.types[c].add(t)
                    before = self.context(t)
        self.total = sum(self.count.values())
        self.before = Counter()
        for (g, _), n in self.pair.items():
            self.before[g] += n
        once, twice = (sum(n == k for t, n in self.count.items() if t is not END) for k in (1, 2))
        self.discount = (once + 1) / (once + 2 * twice + 2)

    def context(self, t):
        h = number(t) if t is not END else None
        return int(self.of[h]) if h in self.rank else "other"

    def turn(self, g, c):
        return (self.pair[g, c] + self.size[c] / self.total) / (self.before[g] + 1)

    def chance(self, g, t):
        if t is END:
            return self.turn(g, "end")
        if t in self.count:
            c = self.of[number(t)]
            return self.turn(g, c) * (self.count[t] - self.discount) / self.size[c]
        return sum(self.turn(g, c) * self.discount * len(self.types[c]) / self.size[c] for c in range(self.classes) if self.size[c])

    def row(self, doc_id, text):
        found, before, score = tokens(text), "edge", 0.0
        for t in found:
            score += math.log10(self.chance(before, t))
            before = self.context(t)
        base = sum(math.log10((self.count[t] + 0.1) / (self.total + 0.1 * (len(self.count) + 1))) for t in found)
        return (doc_id, learnt(doc_id), len(found), sum(t in self.count for t in found), self.total, base, score)


@pytest.fixture(scope="module", params=[50, brown.HEAD])
def fitted(spark, request):
    docs = table(spark, SMALL, "documents")
    learn = crc_of("doc_id") % 10 != 0
    words = brown.vocabulary(docs, learn, request.param)
    encoded = brown.encode(docs, words, learn)
    model = brown.fit(encoded, words, classes=8, rounds=3)
    plain = Plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], model)
    return docs, encoded, model, plain


def test_scores_equal_plain_counting(fitted):
    docs, encoded, model, plain = fitted
    got = {r[0]: tuple(r) for r in brown.score(encoded, model).collect()}
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = plain.row(doc_id, text)
        assert got[doc_id][:5] == want[:5]
        assert got[doc_id][5:7] == pytest.approx(want[5:], rel=1e-9)
        assert got[doc_id][7] == pytest.approx(10 ** (-want[6] / want[2]))


def test_probabilities_add_up_to_one(fitted):
    plain = fitted[3]
    for g in ("edge", "other", 0, 3):
        assert sum(plain.chance(g, t) for t in [*plain.count, b"\xff never seen"]) == pytest.approx(1)


def test_exchange_raises_the_likelihood_and_finds_alternating_words(spark):
    import random

    draw = random.Random(11)
    kinds = [[f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)], [f"c{i}" for i in range(20)]]
    texts = [" ".join(draw.choice(kinds[i % 3]) for i in range(60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = brown.vocabulary(docs, F.lit(True))
    encoded = brown.encode(docs, words, F.lit(True))
    of_id, _, trace = brown.cluster(encoded, words, classes=3, rounds=6)
    assert max(trace) > trace[0]
    found = {h: int(c) for h, c in zip(words.hashes.tolist(), of_id)}
    for kind in kinds:
        most = Counter(found[xxhash.xxh64_intdigest(w.encode())] for w in kind).most_common(1)[0][1]
        assert most >= 18


def test_held_out_text_is_likelier_than_by_word_counts(spark):
    got = queries.op11_class_ngram_scores(spark, SMALL).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_odd_rows(spark, odd_docs, no_docs):
    learn = crc_of("doc_id") % 10 != 0
    got = brown.score_corpus(odd_docs, learn, classes=4, rounds=1).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert len({tuple(r) for r in got if r.doc_id == 7}) == 1
    assert brown.score_corpus(no_docs, learn, classes=4, rounds=1).count() == 0
    nothing = brown.score_corpus(odd_docs, F.lit(False), classes=4, rounds=1).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}
    blank = brown.score_corpus(odd_docs, F.coalesce(F.trim("text"), F.lit("")) == "", classes=4, rounds=1).collect()
    assert all(math.isfinite(r.score) for r in blank) and {r.train_tokens for r in blank} == {2}
