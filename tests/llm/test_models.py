"""Language, toxicity and quality: held-out accuracy, exact search, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import language, quality, toxicity
from shelfwise.llm.common import crc_of, table

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = table(spark, DATA, "documents")
    held = crc_of("doc_id") % 4 == 2
    languages, vectors = language.prototypes(docs, ~held)
    assert languages == ["de", "en", "es", "fr"]
    found = language.identify(docs, languages, vectors).join(docs.where(held).select("doc_id", "lang"), "doc_id")
    right, lowest, highest = found.select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.min("score"), F.max("score")).first()
    assert right > 0.97 and 0 <= lowest <= highest <= 1


def test_text_vector_is_the_bundle_of_bound_vectors():
    text, size = "abc ab", 256
    vectors = {c: language.letter_vectors(np.array([ord(c) if c != " " else 0]), size)[0] for c in "abc "}
    bound = lambda g: np.prod([np.roll(vectors[c], p) for p, c in enumerate(g)], axis=0)
    want = sum(bound(g) for g in (" ab", "abc", "bc ", " ab", "ab "))
    got, has = language.bundle([text], size)
    assert has[0] and np.allclose(got[0], want / np.linalg.norm(want), atol=1e-6)


def test_language_batches_and_blocks_do_not_matter(monkeypatch):
    texts = ["Hallo Welt", "", "123", "ein zwei drei " * 50, "漢字 " * 9]
    whole, has = language.bundle(texts)
    assert has.tolist() == [True, False, False, True, True]
    for name, value in (("CHARS", 20), ("COLUMNS", 3), ("ROWS", 2)):
        monkeypatch.setattr(language, name, value)
    parts, _ = language.bundle(texts)
    assert np.allclose(whole, parts, atol=1e-5)


def test_language_of_odd_rows(odd_docs, no_docs):
    languages, vectors = language.prototypes(odd_docs, F.lit(True))
    assert languages == ["de", "en"]
    rows = {r.doc_id: r for r in language.identify(odd_docs, languages, vectors).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[4].lang_pred == "de"
    assert language.identify(no_docs, languages, vectors).count() == 0
    languages, vectors = language.prototypes(no_docs, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd_docs, languages, vectors).collect()} == {"und"}


@pytest.fixture(scope="module")
def voter(spark):
    return toxicity.fit(table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels"), ~toxicity.held_out())


def test_toxicity_of_held_out_documents(spark, voter):
    found = toxicity.score(table(spark, "/root/testdata/sf0.1", "documents"), voter).where(toxicity.held_out())
    rows = found.join(table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "toxic"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.98
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.9
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.01
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_example_with_a_word_is_indexed_and_every_text_with_one_searched(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", name) for name in ("documents", "labels"))
    voter = toxicity.fit(docs, labels, ~toxicity.held_out())
    chosen = docs.join(toxicity.examples(labels, ~toxicity.held_out(), toxicity.MAX_EXAMPLES), "doc_id").where(F.col("text").rlike(r"\w"))
    assert len(voter.index.ids) == chosen.select("text", "toxic").distinct().count()
    known = docs.join(chosen.select("doc_id"), "doc_id").select("doc_id", "text")
    rows = toxicity.score(known, voter).collect()
    assert all(r.evidence for r in rows) and len({r.score for r in rows}) > 1


def plain_nearest(index, terms, weights, k):
    """Every example's cosine, summed up one after another."""
    query = dict(zip(terms.tolist(), weights.tolist()))
    found = []
    for example in range(len(index.ids)):
        own = zip(*(x.tolist() for x in index.vector(example)))
        if (cosine := sum(w * query[t] for t, w in own if t in query)) > 0:
            found.append((cosine, int(index.ids[example])))
    return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def together(queries):
    """Single vectors as a vector set."""
    bounds = np.cumsum([0, *(len(terms) for terms, _ in queries)])
    return bounds, np.concatenate([t for t, _ in queries]).astype(np.int64), np.concatenate([w for _, w in queries])


def vectors_of(voter, batch):
    bounds, terms, weights = voter.vectors.of(batch)
    return [(terms[low:high], weights[low:high]) for low, high in zip(bounds, bounds[1:])]


def plain_words(text):
    return re.findall(r"\w+", text.lower())


def plain_forms(word):
    return word, *(word[:n] + "*" for n in toxicity.STEMS if len(word) > n)


def plain_hash(form):
    """The hash of a word, or of a stem, which ends in a star."""
    letters, m = form.rstrip("*"), 1 << 64
    code = sum((ord(c) + 1) * pow(0x9E3779B97F4A7C15, i, m) for i, c in enumerate(letters))
    code += len(letters) if form[-1] != "*" else (len(letters) << 32) + 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        code = (code % m ^ code % m >> shift) * factor % m
    code ^= code >> 31
    return code - m if code >> 63 else code


def test_words_and_stems_of_texts_in_pieces(monkeypatch):
    batch = ["One, two_2 twoandtwenty", None, "", "ÄPFEL größere twoandtwenty İstanbul 中文 e\u0301", "abcdefghij " * 9 + "x" * 100, "!"]
    for piece in (1 << 18, 8):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        found = Counter()
        for text, word, forms, has in toxicity._forms([b and b.encode() for b in batch]):
            found.update((t, f) for t, w in zip(text.tolist(), word) for f, h in zip(forms[w].tolist(), has[w]) if h)
        assert found == Counter((i, plain_hash(f)) for i, b in enumerate(batch) for w in plain_words(b or "") for f in plain_forms(w))


def test_nearest_examples_equal_a_full_search(spark, voter):
    index, n = voter.index, len(voter.vectors.terms)
    random = np.random.default_rng(1)
    queries = []
    for _ in range(30):
        terms = np.sort(random.choice(n, size=random.integers(1, min(n, 8) + 1), replace=False))
        weights = random.random(len(terms)) + 0.01
        queries.append((terms, weights / np.linalg.norm(weights)))
    texts = table(spark, "/root/testdata/sf0.1", "documents").where(toxicity.held_out()).orderBy("doc_id").limit(60).collect()
    queries += [v for v in vectors_of(voter, [(r.text or "").encode() for r in texts]) if len(v[0])]
    index.looked = index.blocks_met = 0
    for (terms, weights), found in zip(queries, index.nearest(together(queries), 15)):
        want = plain_nearest(index, terms, weights, 15)
        assert np.allclose([c for c, _ in found], [c for c, _ in want], atol=1e-6) and len(found) == len(want)
        least = want[-1][0] + 1e-6 if want else 0
        assert {index.ids[i] for c, i in found if c > least} == {i for c, i in want if c > least}
    assert 0 < index.looked < 0.9 * index.blocks_met
    # What is searched along makes no difference.
    assert [index.nearest(together([q]), 15)[0] for q in queries[:20]] == index.nearest(together(queries[:20]), 15)


def test_terms_weights_vote_and_score_equal_plain_versions(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.001", name) for name in ("documents", "labels"))
    voter = toxicity.fit(docs, labels, ~toxicity.held_out())
    chosen = docs.join(toxicity.examples(labels, ~toxicity.held_out(), toxicity.MAX_EXAMPLES), "doc_id").groupBy("text", "toxic").count().collect()
    forms = [({f for w in set(plain_words(r.text)) for f in plain_forms(w)}, r.toxic) for r in chosen]
    n = [sum(t == label for _, t in forms) for label in (0, 1)]
    seen = [Counter(f for own, t in forms if t == label for f in own) for label in (0, 1)]
    names = sorted(f for f in seen[0] | seen[1] if f[-1] != "*" or seen[0][f] + seen[1][f] >= toxicity.LEAST_DOCS)
    assert len(names) == len(voter.vectors.terms)
    z, idf = {}, {}
    for f in names:
        share = (seen[0][f] + seen[1][f]) / sum(n)
        z[f] = (seen[1][f] / n[1] - seen[0][f] / n[0]) / (math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-9)
        idf[f] = math.log((1 + sum(n)) / (1 + seen[0][f] + seen[1][f])) + 1
    weight = {f: idf[f] * (toxicity.FLOOR + min(max(z[f] / max(z.values()), 0), 1)) for f in names}
    number = {f: voter.vectors.terms.tolist().index(plain_hash(f)) for f in names}
    for row in docs.where(toxicity.held_out() & F.col("text").isNotNull()).limit(10).collect():
        counts = Counter(f for w in plain_words(row.text) for f in plain_forms(w) if f in weight)
        want = {number[f]: (1 + math.log(c)) * weight[f] for f, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in want.values()))
        (terms, weights), = vectors_of(voter, [row.text.encode()])
        assert terms.tolist() == sorted(want) and np.allclose(weights, [want[t] / norm for t in sorted(want)])
        near = plain_nearest(voter.index, terms, weights, toxicity.NEIGHBOURS)
        toxic = dict(zip(voter.index.ids.tolist(), voter.index.labels.tolist()))
        total = sum(c * c for c, _ in near)
        vote = (sum(c * c * toxic[i] for c, i in near) + voter.prior) / (total + 1)
        score = 1 / (1 + math.exp(-voter.curve.margin(np.array([[math.log(vote / (1 - vote))]]))[0])) if voter.curve else vote
        assert math.isclose(voter.scores([row.text.encode()], voter.curve)[0][0], score, abs_tol=1e-4)


def test_examples_stay_within_their_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * size) for i, size in enumerate((5, 5, 900, 5, 0, 5))] + [(9, 1, None)], "doc_id long, toxic int, text string")
    kept = toxicity.within(rows, 20).collect()
    assert {r.doc_id for r in kept} == {0, 1, 3, 4, 5, 9}
    assert sum(len(r.text or "") for r in toxicity.within(rows, 12).collect()) <= 12


def test_equal_examples_tie_by_doc_id():
    terms, weights = np.tile(np.arange(3, dtype=np.int32), 50), np.full(150, 3**-0.5, np.float32)
    index = toxicity.Index(np.arange(50)[::-1].copy(), np.arange(50) % 2, np.full(50, 3), terms, weights, 3)
    found = index.nearest(together([(np.arange(3), np.full(3, 3**-0.5))]), 15)[0]
    assert [index.ids[i] for _, i in found] == list(range(15))
    left_out = index.nearest(together([(np.arange(3), np.full(3, 3**-0.5))]), 15, [49])[0]
    assert [index.ids[i] for _, i in left_out] == list(range(1, 16))


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs, voter):
    rows = toxicity.score(odd_docs, voter).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.predicted for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert toxicity.score(no_docs, voter).count() == 0
    none = spark.createDataFrame([(None, 1), (4, None), (6, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, none, F.lit(True))).collect()} == {0.0}
    nothing = toxicity.fit(odd_docs, none.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd_docs, nothing).collect()} == {0.0}


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    apart = crc_of("doc_id") % 3 == 1
    found = quality.classify(docs, labels.where(~apart)).join(labels.where(apart).select("doc_id", "quality"), "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.97
    assert np.mean([r.predicted for r in found if r.quality]) > 0.98


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    both = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (7, 1), (None, 0), (8, None)], "doc_id long, quality int")
    rows = quality.classify(odd_docs, both).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    one = both.where("quality = 1")
    assert {r.score for r in quality.classify(odd_docs, one).collect()} == {1.0}
    assert {r.score for r in quality.classify(odd_docs, both.limit(0)).collect()} == {0.5}
    assert quality.classify(no_docs, both).count() == 0
    assert quality.keep_good(odd_docs, one).columns == odd_docs.columns
    assert quality.keep_good(odd_docs, both.limit(0)).count() == 10
