import random

from pyspark.sql import functions as F

from shelfwise.llm import lines
from tests.llm import brute


def test_near_is_a_word_distance_of_one():
    random.seed(1)
    for _ in range(3000):
        a = random.choices("abc", k=random.randint(0, 5))
        b = list(a)
        for _ in range(random.randint(0, 2)):
            at = random.randint(0, len(b))
            b[at : at + random.randint(0, 1)] = random.choices("abc", k=random.randint(0, 1))
        assert lines.near(a, b) == (brute.word_distance(a, b) <= 1)


def test_variants_are_the_hashes_of_what_is_left():
    words = [f"w{i % 5}" for i in range(9)]
    v1, v2, place = lines.variants(words)
    for a, b, p in list(zip(v1, v2, place))[1:]:
        w1, w2, _ = lines.variants(words[:p] + words[p + 1 :])
        assert (a, b) == (w1[0], w2[0])


def test_equals_brute_force(spark, documents):
    docs = [(r.doc_id, r.text) for r in documents.where("n_chars < 1500").collect()]
    got = lines.dedup(documents.where("n_chars < 1500")).collect()
    assert {r.doc_id: r.text for r in got} == brute.dedup_lines(docs)


def test_near_lines_of_every_kind(spark):
    base = [f"word{i}" for i in range(10)]
    texts = [base, base[1:], base[:-1], ["new", *base], [*base, "new"], base[:5] + ["x"] + base[6:], base[:4] + ["x", "y"] + base[6:], base[:7]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup_lines(rows)
    assert [i for i, t in got.items() if not t] == [1, 2, 3, 4, 5, 6] or set(i for i, t in got.items() if not t) >= {1, 2, 3, 4, 5}


def test_hot_line_and_hot_template(spark):
    rows = [(i, f"the one line that all have in common\nitem {i} of the list that a template made") for i in range(300)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", F.size("dropped").alias("n"))
    assert {(r.doc_id, r.n) for r in got.collect()} == {(i, 2 if i else 0) for i in range(300)}


def test_odd_rows(odd_docs, no_docs):
    got = lines.dedup(odd_docs)
    assert set(got.columns) == set(odd_docs.columns)
    rows = got.collect()
    assert len(rows) == 10
    text = {r.doc_id: r.text for r in rows}
    assert text[1] is None and text[2] == "" and text[3] == " \n\t " and text[7] == ""
    assert text[6] and text[4] == "hello"
    assert lines.dedup(no_docs).count() == 0
