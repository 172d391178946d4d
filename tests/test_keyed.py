import pytest
from pyspark.sql import functions as F

from shelfwise.operators import snapshots
from shelfwise.operators.keyed import assert_keyed, first_per_key, key_report, keyed_upsert, last_n_per_key
from shelfwise.operators.sampling import hash_sample, random_batch, with_resent
from shelfwise.plans import gold
from shelfwise.session import shared_dir


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 5), ("c", 7)], "k string, v int")


def test_first_and_last_per_key(pairs):
    assert sorted(map(tuple, first_per_key(pairs, ["k"], ["v"]).collect())) == [("a", 1), ("b", 5), ("c", 7)]
    last = last_n_per_key(pairs, ["k"], "v", 2).select("k", "v", "_rn").collect()
    assert sorted(map(tuple, last)) == [("a", 2, 2), ("a", 3, 1), ("b", 5, 1), ("c", 7, 1)]


def test_key_checks(pairs, spark):
    assert key_report(pairs, "t", ["k"]).head().asDict() == {
        "table_name": "t", "primary_key": "k", "row_count": 5, "key_count": 3, "null_keys": 0, "is_valid": False,
    }
    assert_keyed(pairs, ["k", "v"])
    with pytest.raises(ValueError):
        assert_keyed(pairs, ["k"])
    with pytest.raises(ValueError):
        assert_keyed(spark.createDataFrame([(None, 1)], "k string, v int"), ["k"])
    assert key_report(pairs.limit(0), "t", ["k"]).head().is_valid


def test_snapshot_and_upsert(pairs, spark):
    old = snapshots.keyed_snapshot(pairs, ["k", "v"], shared_dir(spark, "snapshot"))
    assert old.count() == 5
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, keyed_upsert(base, new, ["k"]).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    with pytest.raises(ValueError):
        snapshots.keyed_snapshot(pairs, ["k"], shared_dir(spark, "snapshot"))


def test_hash_sample_ignores_partitioning(spark):
    rows = spark.range(20000).withColumn("k", F.col("id").cast("string"))
    one = {r.id for r in hash_sample(rows.coalesce(1), ["k"], 0.05).collect()}
    many = {r.id for r in hash_sample(rows.repartition(7), ["k"], 0.05).collect()}
    assert one == many and 800 < len(one) < 1200
    assert hash_sample(rows, ["k"], 1.0).count() == 20000 and hash_sample(rows, ["k"], 0.0).count() == 0
    resent = with_resent(rows, ["k"], 0.05)
    assert resent.count() == 20000 + len(one) and resent.columns == rows.columns


def test_random_batch_is_cut(spark):
    assert random_batch(spark.range(5000), 100, seed=1).count() == 100
    assert random_batch(spark.range(50), 100, seed=1).count() == 50


def test_a_build_that_dies_leaves_the_last_good_version(spark, pairs, monkeypatch):
    path = shared_dir(spark, "published")
    assert snapshots.current(spark, path) is None
    snapshots.keyed_snapshot(pairs, ["k", "v"], path)
    reading = snapshots.current(spark, path)
    # A bad key: nothing is published and nothing is left.
    with pytest.raises(ValueError):
        snapshots.keyed_snapshot(pairs, ["k"], path)
    assert snapshots.sweep(spark, path) == []
    # Killed between the check and the swap.
    monkeypatch.setattr(snapshots.store, "replace_text", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        snapshots.keyed_snapshot(pairs.limit(1), ["k"], path)
    monkeypatch.undo()
    assert snapshots.current(spark, path).count() == 5
    assert len(snapshots.sweep(spark, path)) == 1
    # Published versions replace each other; one that is being read stays for one more.
    snapshots.keyed_snapshot(pairs.limit(2), ["k", "v"], path)
    assert reading.count() == 5 and snapshots.current(spark, path).count() == 2
    snapshots.keyed_snapshot(pairs.limit(3), ["k", "v"], path)
    assert len(snapshots.published(spark, path)) == snapshots.KEPT == len(snapshots.store.folders(spark, path))


def test_present_snapshots_are_not_built_again(spark, pairs):
    path = shared_dir(spark, "present")
    snapshots.keyed_snapshot(pairs, ["k", "v"], path, skip_if_present=True)
    broken = pairs.withColumn("v", F.raise_error(F.lit("built again")).cast("int"))
    assert snapshots.keyed_snapshot(broken, ["k", "v"], path, skip_if_present=True).count() == 5


def test_gold_layer_is_published_whole(spark, tables, monkeypatch):
    folder = shared_dir(spark, "gold")
    gold.build(tables, folder)
    want = gold.region_daily_of(type(tables)(spark, tables.sf_dir, folder)).count()
    monkeypatch.setattr(gold, "national_daily", lambda sales: sales.select("sales_date"))  # its key does not hold
    with pytest.raises(ValueError):
        gold.build(tables, folder)
    stored = type(tables)(spark, tables.sf_dir, folder)
    assert gold.region_daily_of(stored).count() == want == gold.region_daily(gold.curated(tables)).count()
    with pytest.raises(FileNotFoundError):
        gold.sales_of(type(tables)(spark, tables.sf_dir, folder + "-none"))
