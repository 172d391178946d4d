import numpy as np
import pytest

from shelfwise.llm import ann


def exact(rows, k, every):
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = [(-(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in rows if j != i]
            out[i] = sorted(scored)[:k]
    return out


def test_recall_over_several_shards(spark):
    random = np.random.default_rng(2)
    centres = random.normal(size=(30, 24))
    vectors = [(i, (centres[i % 30] + random.normal(size=24)).tolist()) for i in range(3000)]
    found = ann.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 20, shard_rows=700).collect()
    want = exact([(i, np.array(v)) for i, v in vectors], 5, 20)
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for _, j in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        assert all(abs(s - (-dict((j, c) for c, j in exact([x for x in [(i, np.array(v)) for i, v in vectors] if x[0] in (q, i2)], 5, 1)[q])[i2])) < 1e-12 for i2, s in near[:1])


def test_ties_equal_vectors_and_few_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(1000, [-1.0, 0.0, 0.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[50] == [0, 1, 2, 3, 4] and got[1000] == [0, 1, 2, 3, 4]
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), 5, 50).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_unusable_vectors_take_no_part(spark, kind):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (50, None, 1), (100, [], 1), (150, [0.0, 0.0], 1), (200, [nan, 1.0], 1), (250, [inf, 1.0], 1), (300, [None, 1.0], 1),
            (None, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0, 0.0], 1)]
    found = ann.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int")).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(empty).count() == 0
