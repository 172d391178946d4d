"""What the findings of round 3 asked of the streams: no row is read, kept or written more often than needed."""

from pyspark.sql.classic.dataframe import DataFrame

from shelfwise.operators.quality import SALES
from shelfwise.plans import streams
from shelfwise.session import shared_dir
from shelfwise.sources.files import append_raw
from shelfwise.sources.star import raw_sales
from shelfwise.streaming import dq
from tests.defects import with_defects


def test_a_batch_is_not_held_and_splits_in_one_pass(spark, tables, monkeypatch):
    def refuse(*_):
        raise AssertionError("a batch was held")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    store = shared_dir(spark, "test-pass")
    feed = with_defects(raw_sales(tables)).limit(500)
    path = shared_dir(spark, "test-feed")
    feed.write.parquet(path)
    feed = spark.read.parquet(path)
    dq._write_batch(feed, 0, store)
    rejected = SALES.quarantine(feed)
    kept = dq.read_quarantine(spark, store).drop("quarantined_at")
    assert kept.count() > 0 and kept.exceptAll(rejected).isEmpty() and rejected.exceptAll(kept).isEmpty()
    assert dq.read_silver(spark, store).count() + kept.count() == 500


def test_a_cycle_writes_its_sales_once(spark, tables, monkeypatch):
    base, replaced = shared_dir(spark, "test-once"), []
    replace = dq._replace
    monkeypatch.setattr(dq, "_replace", lambda df, path, *rest: (replaced.append(path.split("/")[-1]), replace(df, path, *rest)))
    append_raw(raw_sales(tables).limit(300), f"{base}/landing")
    result = dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
    assert sorted(replaced) == ["gold_national_daily", "gold_region_daily"] and result["gold_sales_serving"].count() > 0


def test_a_part_of_the_feed_lands_in_one_pass(spark, tables, monkeypatch):
    scans, land = [], streams.append_raw

    def counted(df, landing):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        land(df, landing)

    monkeypatch.setattr(streams, "append_raw", counted)
    got = streams.unique_sales(tables)
    assert scans == [1, 1, 1]
    assert got.count() == got.distinct().count()
