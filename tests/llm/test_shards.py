import zlib

from pyspark.sql import functions as F

from shelfwise.llm import shards


def check(docs, found, n=40):
    rows = found.collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted(((t.doc_id or -1), len((t.text or "").encode()) + 16, zlib.crc32((t.text or "").encode())) for t in texts)
    assert sorted(((r.doc_id or -1), r["size"], r.text_crc32) for r in rows) == want
    sums = [0] * n
    slots = [[] for _ in range(n)]
    for r in rows:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    largest = max(w[1] for w in want)
    assert max(sums) - sum(sums) / n <= largest and sum(sums) / n - min(sums) <= largest


def test_shards_of_documents(documents):
    check(documents, shards.shard_by_bytes(documents))


def test_result_does_not_depend_on_the_sample(documents, monkeypatch):
    first = sorted(map(tuple, shards.shard_by_bytes(documents, 7).collect()))
    monkeypatch.setattr(shards, "SEED", 5)
    assert sorted(map(tuple, shards.shard_by_bytes(documents, 7, ranges=3).collect())) == first


def test_hot_key_and_unlike_sizes(spark):
    """A third of the rows has one doc_id, another third is empty, one record is large."""
    docs = spark.range(3000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END").alias("doc_id"),
        F.expr("CASE WHEN id % 3 = 1 THEN '' WHEN id = 2 THEN repeat('x', 900) ELSE concat('text ', id % 50) END").alias("text"),
    )
    check(docs, shards.shard_by_bytes(docs, 10, ranges=64), 10)


def test_odd_rows(odd_docs, no_docs):
    found = shards.shard_by_bytes(odd_docs.where("doc_id IS NULL OR doc_id <> 5"), 3)
    check(odd_docs.where("doc_id IS NULL OR doc_id <> 5"), found, 3)
    assert shards.shard_by_bytes(no_docs).count() == 0


def test_written_shards(spark, documents, tmp_path):
    shards.write_shards(documents, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and back.select("shard").distinct().count() == 4


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, None, "z"), (None, None, "z"), (3, "c" * 5000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    shards.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    count = lambda found: sorted(map(str, found))
    assert count((r.doc_id, r.text) for r in back.collect()) == count((i, t) for i, t, _ in rows)
    places = sorted((r.shard, r.slot) for r in back.collect())
    assert places == sorted((r.shard, r.slot) for r in shards.shard_by_bytes(docs, 3).collect())
