"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from shelfwise.llm import queries, runs
from shelfwise.llm.common import table
from tests.conftest import SMALL


def plain_runs(x, least=12):
    spans = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                spans.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in spans.items())


def plain_row(doc_id, text, damaged=True):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    g, n = h // 10, len(words)
    if damaged and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, q, e in found for i in range(s + q, e)}
    best = max(found, key=lambda r: (r[2] - r[0], -r[0], -r[1]), default=None)
    longest = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def sequences():
    draw = random.Random(13)
    yield from ([], [1], [0] * 11, [0] * 12, [0] * 500, [0, 1] * 40, fibonacci(600), [0, 0, 1] * 60 + [0] + [0, 0, 1] * 70)
    for _ in range(300):
        k, n = draw.choice([1, 2, 3, 50]), draw.choice([30, 100, 400])
        blocks = [[draw.randrange(k) for _ in range(draw.randrange(1, 120))] for _ in range(3)]
        text = []
        while len(text) < n:
            text += draw.choice(blocks) * draw.choice([1, 1, 2, 5])
        yield text[: n + 200]


def test_all_runs_of_any_sequence():
    for x in sequences():
        assert [(s, q, e) for s, e, q in runs.runs_of(np.array(x, np.int64)).tolist()] == plain_runs(x), x


def test_work_grows_with_the_words_not_their_square(monkeypatch):
    grown = []
    plain = runs._grown
    monkeypatch.setattr(runs, "_grown", lambda words, left, lag: grown.append(lag) or plain(words, left, lag))
    for n in (10_000, 20_000):
        block = np.random.default_rng(n).integers(0, 9, 97)
        text = np.concatenate((np.tile(block, n // 97), np.zeros(n, np.int64), np.arange(n)))
        grown.clear()
        assert len(runs.runs_of(text)) >= 2
        assert len(grown) < 2_000


def test_query_equals_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    got = queries.op13_periodic_runs(spark, SMALL).collect()
    want = [plain_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    loop = "a b c " * 30
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r ", None), (4, loop, "x"), (4, loop, "x"), (None, "é b " * 20, "x"), (6, "w " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    found = runs.find_runs(docs)
    assert found.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed, r.start))
    assert by_id[1] == by_id[2] == [([], "", "x")] and by_id[3] == [([], "", None)]
    assert by_id[4] == [([(0, 90, 3)], "a b c", "x")] * 2
    assert by_id[None] == [([(0, 20, 1)], "é b", "x")]
    assert by_id[6] == [([(0, 200_000, 1)], "w", "x")]
    empty = runs.digests(docs.limit(0))
    assert empty.count() == 0 and len(empty.columns) == 8
    got = {r.doc_id: tuple(r) for r in runs.digests(docs).collect()}
    assert all(got[i] == plain_row(i, dict((r[0], r[1]) for r in rows)[i], damaged=False) for i in (1, 2, 3, 4, None))


def test_taken_names(spark):
    with pytest.raises(ValueError, match="runs"):
        runs.find_runs(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, runs long"))
