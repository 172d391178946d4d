import pytest
from pyspark.sql import functions as F

from shelfwise.operators.quality import SALES, quarantined_sales, silver_sales
from shelfwise.plans.gold import SERVING_INPUTS, curated_from, national_daily, region_daily
from shelfwise.session import shared_dir
from shelfwise.sources.files import append_raw
from shelfwise.sources.star import raw_sales
from shelfwise.streaming import dq
from tests.defects import with_defects


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tables, files):
    base = shared_dir(spark, "test-stream")
    feed = with_defects(raw_sales(tables))
    append_raw(feed.repartition(files), f"{base}/landing")
    counts = dq.run_quality(spark, f"{base}/landing", f"{base}/store", files_per_batch=2)
    assert same(dq.read_silver(spark, f"{base}/store"), silver_sales(feed))
    assert same(dq.read_quarantine(spark, f"{base}/store").drop("quarantined_at"), quarantined_sales(feed))
    want = {r.rule: r.failed for r in SALES.metrics(feed).collect()}
    assert counts == {"checked": feed.count(), **want}


def test_cycles_are_incremental_and_end_like_one_batch(spark, tables):
    base = shared_dir(spark, "test-cycle")
    feed = with_defects(raw_sales(tables))
    half = F.pmod(F.xxhash64("sale_id", "dc_id"), F.lit(2))
    for cycle in (0, 1):
        append_raw(feed.filter(half == cycle), f"{base}/landing")
        result = dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
    sales = curated_from(silver_sales(feed))
    assert same(result["gold_region_daily"], region_daily(sales)) and same(result["gold_national_daily"], national_daily(sales))
    assert same(result["gold_sales_serving"], sales.select(*SERVING_INPUTS))
    # Nothing new has landed: a further run adds no rows.
    before = dq.read_silver(spark, f"{base}/store").count()
    assert dq.run_quality(spark, f"{base}/landing", f"{base}/store").get("checked", 0) == 0
    assert dq.read_silver(spark, f"{base}/store").count() == before
    # A fresh store is a full refresh.
    dq.run_quality(spark, f"{base}/landing", f"{base}/fresh")
    assert dq.read_silver(spark, f"{base}/fresh").count() == before


def test_counts_of_more_than_a_hundred_batches(spark, tables):
    base = shared_dir(spark, "test-many")
    feed = with_defects(raw_sales(tables)).limit(400)
    append_raw(feed.repartition(105), f"{base}/landing")
    counts = dq.run_quality(spark, f"{base}/landing", f"{base}/store", files_per_batch=1)
    stored = dq.read_silver(spark, f"{base}/store").count() + dq.read_quarantine(spark, f"{base}/store").count()
    assert counts["checked"] == stored == 400
    assert dq.rule_counts(spark, f"{base}/store").select("batch_id").distinct().count() > 100


def test_a_batch_that_is_run_again_changes_nothing(spark, tables):
    base = shared_dir(spark, "test-again")
    feed = with_defects(raw_sales(tables))
    append_raw(feed, f"{base}/landing")
    dq.run_quality(spark, f"{base}/landing", f"{base}/store")
    before = dq.read_silver(spark, f"{base}/store").count()
    dq._write_batch(spark.read.schema(feed.schema).parquet(f"{base}/landing"), 0, f"{base}/store")
    assert dq.read_silver(spark, f"{base}/store").count() == before


def test_a_cycle_reads_and_writes_only_the_touched_periods(spark, tables):
    base = shared_dir(spark, "test-days")
    feed = raw_sales(tables).filter("order_ts >= '2001-05-10' AND order_ts < '2001-08-01'")
    newest = "2001-07-30"
    append_raw(feed.filter(F.col("order_ts") < newest), f"{base}/landing")
    dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
    before = dq.read_gold(spark, f"{base}/store", "gold_region_daily").inputFiles()
    append_raw(feed.filter(F.col("order_ts") >= newest), f"{base}/landing")
    dq.run_quality(spark, f"{base}/landing", f"{base}/store")
    periods = dq.refresh(spark, f"{base}/store")
    assert [str(p) for p in periods] == [f"{newest[:7]}-01"]
    read = dq.silver_of(spark, f"{base}/store", periods)
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and f"period#" in scan.split("PartitionFilters")[1].split("]")[0]
    assert read.select("period").distinct().count() == 1 < dq.read_silver(spark, f"{base}/store").select(F.trunc("order_ts", "month")).distinct().count()
    after = dq.read_gold(spark, f"{base}/store", "gold_region_daily").inputFiles()
    kept = {f for f in before if f"period={newest[:7]}" not in f}
    assert kept < set(before) and kept < set(after)
    sales = curated_from(silver_sales(feed))
    assert same(dq.read_gold(spark, f"{base}/store", "gold_region_daily"), region_daily(sales))
    assert dq.refresh(spark, f"{base}/store") == []


def test_a_sale_sent_again_for_another_day_counts_on_its_first(spark, tables):
    base = shared_dir(spark, "test-moved")
    rows = raw_sales(tables).dropDuplicates(["sale_id"]).limit(50)
    rows = written_rows(spark, rows)
    shift = lambda n: rows.withColumn("order_ts", (F.col("order_ts").cast("timestamp_ntz") + F.expr(f"INTERVAL {n} DAYS")).cast("string"))
    parts = [rows, shift(40).limit(20), shift(-35).filter(F.pmod(F.xxhash64("sale_id"), F.lit(3)) == 0)]
    for at, part in enumerate(parts):
        append_raw(part, f"{base}/landing")
        result = dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
        feed = parts[0]
        for other in parts[1 : at + 1]:
            feed = feed.unionByName(other)
        sales = curated_from(silver_sales(feed))
        assert same(result["gold_sales_serving"], sales.select(*SERVING_INPUTS))
        assert same(result["gold_national_daily"], national_daily(sales))


def written_rows(spark, df):
    path = shared_dir(spark, "rows")
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_a_cycle_that_died_before_gold_is_made_up_for(spark, tables):
    base = shared_dir(spark, "test-died")
    feed = with_defects(raw_sales(tables))
    half = F.pmod(F.xxhash64("sale_id", "dc_id"), F.lit(2))
    append_raw(feed.filter(half == 0), f"{base}/landing")
    dq.run_quality(spark, f"{base}/landing", f"{base}/store")  # and no refresh
    append_raw(feed.filter(half == 1), f"{base}/landing")
    result = dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
    assert same(result["gold_national_daily"], national_daily(curated_from(silver_sales(feed))))
