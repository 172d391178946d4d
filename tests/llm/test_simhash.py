import random

import pytest

from shelfwise.llm import simhash
from shelfwise.llm.graph import components
from tests.llm import brute


def test_components_of_chain_star_and_noise(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200), (None, 3)]
    edges += [(random.randrange(300, 420), random.randrange(300, 420)) for _ in range(70)]
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = brute.groups({n for e in real for n in e}, real)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == set(want.items())


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_equals_plain_version():
    texts = [None, "", " \t", "One", "one TWO", "a b c", "ß Ä É x y z", "a\x1cb c\nd\x0be f", "x " * 1000, "Ab cD " * 7]
    for text in texts:
        assert simhash.fingerprint(text and text.encode()) == brute.fingerprint(text)


def test_long_text_in_pieces_is_the_same(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + " " + "y" * 300 + " end of it"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 100)
    assert simhash.fingerprint(text.encode()) == whole == brute.fingerprint(text)


def test_links_connect_exactly_what_is_within_the_radius(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << random.randrange(64) for _ in range(random.choice((0, 1, 2, 3)))) for b in base for _ in range(15)}
    signed = [p - (1 << 64) if p >> 63 else p for p in {p % (1 << 64) for p in prints}]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    apart = lambda a, b: ((a ^ b) % (1 << 64)).bit_count()
    assert all(apart(a, b) <= 2 for a, b in got)
    assert brute.groups(signed, got) == brute.groups(signed, [(a, b) for a in signed for b in signed if a < b and apart(a, b) <= 2])


def test_odd_radius_is_refused():
    with pytest.raises(ValueError):
        simhash.ball(3)


def test_near_duplicates_equal_brute_force(documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert got == brute.near_groups(docs)


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    found = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert found[1] == found[2] == found[3] == (0, 1)
    assert found[7][1] == 6
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(odd_docs, no_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8]
    assert simhash.one_of_each(no_docs).count() == 0
