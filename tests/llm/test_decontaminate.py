import random
import re

from shelfwise.llm import decontaminate
from tests.llm import brute


def test_equals_brute_force(spark, documents):
    random.seed(8)
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = []
    for n in range(30):  # passages of documents, some with words changed
        words = random.choice(docs)[1].split()[:40]
        for _ in range(n % 4):
            words[random.randrange(len(words))] = "other"
        items.append((n, " ".join(words)))
    items += [(100, None), (101, ""), (102, "too short"), (103, "none of these words stands anywhere in the corpus")]
    found = decontaminate.matches(documents, spark.createDataFrame(items, "item_id long, text string")).collect()
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    spaced = {doc: f" {' '.join(words(text))} " for doc, text in docs}
    short = {(doc, i) for i, t in items if 0 < len(words(t)) < 5 for doc, text in spaced.items() if f" {' '.join(words(t))} " in text}
    assert {(r.doc_id, r.item_id) for r in found} == brute.passages(docs, [(i, t) for i, t in items if t and len(words(t)) >= 5]) | short
    assert all(r.similarity >= 0.8 for r in found)


def test_spans_point_at_the_passage(spark):
    item = "Seven words are in this one item"
    docs = spark.createDataFrame([(1, "Before it. SEVEN words,\nare in this one item! After. Seven words are in this one item")], "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).orderBy("first_word").collect()
    text = docs.first().text.lower()
    assert [text[r.first_byte : r.end_byte] for r in found] == ["seven words,\nare in this one item", "seven words are in this one item"]


def test_lookup_finds_all_within_the_radius():
    random.seed(9)
    items = decontaminate.Items([(i, " ".join(random.choices("abcdefgh", k=12))) for i in range(50)], 5, 0.8, 20)
    for _ in range(300):
        probe = random.choice(items.prints) ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 24)))
        want = [i for i, p in enumerate(items.prints) if (p ^ probe).bit_count() <= 20]
        assert items.candidates(12, probe) == want


def test_long_text_in_pieces_is_the_same(monkeypatch):
    text = decontaminate.lowered(" ".join(f"Wort{i}" for i in range(3000)).encode())
    whole = decontaminate.words(text)
    monkeypatch.setattr(decontaminate, "PIECE", 64)
    for a, b in zip(whole, decontaminate.words(text)):
        assert (a == b).all()


def test_parts_of_a_large_benchmark_give_the_same(spark, documents, monkeypatch):
    items = [(r.doc_id, " ".join(r.text.split()[:20])) for r in documents.limit(20).collect()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.matches(documents, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 500)
    assert sorted(map(tuple, decontaminate.matches(documents, bench).collect())) == whole


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "these two documents as they are copies")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.matches(odd_docs, bench).collect()) == [6, 7, 7]
    kept = decontaminate.without_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8]
    assert decontaminate.matches(no_docs, bench).count() == 0
    assert decontaminate.matches(odd_docs, bench.limit(0)).count() == 0


def test_items_shorter_than_a_shingle_match_equal_windows(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four"), (2, "So: One, TWO three\nfour! one two three four"), (3, "one two three"), (4, "four one two"), (5, "ha ha ha ha ha"), (6, "one two three four five"), (7, None)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(10, "one two three four"), (11, "ha ha"), (12, "!"), (12, "three four"), (10, "one two three four")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontaminate.matches(docs, bench).collect())
    assert found == [
        (1, 10, 0, 4), (1, 12, 2, 2), (2, 10, 1, 4), (2, 10, 5, 4), (2, 12, 3, 2), (2, 12, 7, 2),
        (5, 11, 0, 2), (5, 11, 2, 2), (6, 10, 0, 4), (6, 12, 2, 2),
    ]
    kept = decontaminate.without_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 7]
