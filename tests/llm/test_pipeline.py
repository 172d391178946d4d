"""The pipeline against plain versions of its stages, its stages on odd rows, and its registration."""

import hashlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from shelfwise.llm.common import stored, table
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    from shelfwise.llm.vocab import vocabulary_path

    docs = table(spark, SMALL, "documents")
    good = stored(corpus_pipeline.quality_classifier(spark, docs, SMALL), "good")
    quality = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert sum(d in kept for d, q in quality.items() if q) / max(sum(quality.values()), 1) > 0.97
    texts = brute.dedup_lines(list(kept.items()))
    groups = brute.near_groups(list(texts.items()))
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    leaked = {d for d, _ in brute.passages(list(texts.items()), items)}
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = {}
    for d, t in texts.items():
        if d not in leaked:
            ids = library.encode(t, add_special_tokens=False).ids
            want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == want


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, no_docs, SMALL)
        assert found.count() == 0
        found = stored(stage(spark, docs, SMALL), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == odd_docs.columns
            assert found.dtypes == odd_docs.dtypes
        docs = found
    assert docs.count() > 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
