"""Findings F1 to F4 of round 4: what the streams write, shuffle and keep."""

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.columns import packed, unpacked
from shelfwise.operators.quality import silver_sales
from shelfwise.plans import gold, streams
from shelfwise.session import LEAN, settings, shared_dir, written
from shelfwise.sources.files import RAW_SCHEMA, append_raw, append_written
from shelfwise.sources.star import SALES_COLUMNS, raw_sales, raw_sales_by_order
from shelfwise.streaming import dq, events


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def sale(number, day, **other):
    made = {c: "x" for c in SALES_COLUMNS} | {"sale_id": number, "order_ts": f"{day} 08:00:00", "units_ordered": "3", "units_fulfilled": "3"}
    made |= {"unit_price_idr": "5", "gross_idr": "15", "discount_idr": "0", "net_idr": "15", "promo_flag": "0", "status": "fulfilled", "ship_ts": None}
    return tuple((made | other)[c] for c in SALES_COLUMNS)


def test_the_feed_of_the_cycles_is_worked_out_once_and_landed_by_moving(spark, tables, monkeypatch):
    worked_out, landed = [], []
    monkeypatch.setattr(streams, "raw_sales_by_order", lambda t: (worked_out.append(1), raw_sales_by_order(t))[1])
    monkeypatch.setattr(streams, "append_written", lambda s, folder, landing: (landed.append(landing), append_written(s, folder, landing)))
    assert streams.incremental_cycle(tables).count() > 0 and worked_out == [1]
    there = spark.read.schema(RAW_SCHEMA).parquet(landed[0])
    assert len(landed) == 2 and rows(there) == rows(raw_sales(tables))


def test_a_folder_that_is_not_there_lands_nothing(spark):
    base = shared_dir(spark, "test-land")
    append_written(spark, f"{base}/none", f"{base}/landing")
    assert spark.read.schema(RAW_SCHEMA).parquet(f"{base}/landing").count() == 0


def test_only_what_sales_are_compared_by_is_shuffled(spark, tables, monkeypatch):
    base, plans = shared_dir(spark, "test-slim"), []
    append_raw(raw_sales(tables).limit(400), f"{base}/landing")
    dq.run_quality(spark, f"{base}/landing", f"{base}/store")
    periods = dq._touched(spark, f"{base}/store", [0])
    sifted = dq._sifted(spark, f"{base}/store", periods, "month")
    monkeypatch.setattr(dq, "written", lambda df, purpose: (plans.append(df), written(df, purpose))[1])
    dq._sifted(spark, f"{base}/store", periods, "month")
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sale_id" in text and "outlet_id" not in text and "net_idr" not in text
    assert sifted.filter("bitmap_count(tied) > 0").isEmpty()
    won = dq._marked(dq._placed(spark, f"{base}/store", periods), sifted, "won")
    assert "Exchange hashpartitioning" not in won._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")


def odd_feed(spark):
    """Sales sent again with other values, equal in what is compared first, whole copies, and rows without a key."""
    made = [sale(f"S{n}", f"2024-0{n % 3 + 1}-1{n % 7}", product_id=f"P{n % 4}") for n in range(40)]
    made += [sale(f"S{n}", f"2024-0{n % 3 + 1}-1{n % 7}", product_id=f"P{n % 4}", outlet_id="a", net_idr="7") for n in range(0, 40, 3)]
    made += [sale(f"S{n}", f"2024-0{n % 3 + 1}-1{n % 7}", product_id="A", ship_ts="2024-05-01 00:00:00") for n in range(0, 40, 5)]
    made += [sale(f"S{n}", "2024-04-02", product_id="P") for n in range(0, 40, 6)] + [sale(f"S{n}", "2023-12-30") for n in range(0, 40, 11)]
    made += [sale(None, "2024-01-05", product_id="Q"), sale(None, "2024-02-05"), sale(None, "2024-01-05", product_id="Q")] + made[:9]
    return spark.createDataFrame(made, RAW_SCHEMA)


@pytest.mark.parametrize("order", [1, 2])
@pytest.mark.parametrize("bitmaps", [1, 4096])
def test_sales_sent_again_in_any_batch_and_period_count_once_and_whole(spark, monkeypatch, order, bitmaps):
    monkeypatch.setattr(dq, "BITMAPS", bitmaps)  # with 1, periods go one by one
    monkeypatch.setattr(dq, "MARKED", 8)  # several blocks a file
    monkeypatch.setattr(dq, "FIRST", ("order_ts", "product_id")[:order])
    base, feed = shared_dir(spark, "test-odd"), odd_feed(spark).filter("sale_id IS NOT NULL")
    feed = written(feed.withColumn("batch", F.pmod(F.xxhash64(*SALES_COLUMNS), F.lit(3))), "odd")
    for at in range(3):
        append_raw(feed.filter(F.col("batch") == at).drop("batch"), f"{base}/landing")
        result = dq.run_cycle(spark, f"{base}/landing", f"{base}/store")
        sales = gold.curated_from(silver_sales(feed.filter(F.col("batch") <= at).drop("batch")))
        assert rows(result["gold_sales_serving"]) == rows(sales.select(*gold.SERVING_INPUTS))
        assert rows(result["gold_region_daily"]) == rows(gold.region_daily(sales))


def test_rows_without_sale_id_are_one_sale_that_is_no_key(spark):
    base = shared_dir(spark, "test-null")
    append_raw(odd_feed(spark), f"{base}/landing")
    with pytest.raises(ValueError, match="1 rows with a null key"):
        dq.run_cycle(spark, f"{base}/landing", f"{base}/store")


def test_lean_settings_hold_for_a_while(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    with pytest.raises(KeyError), settings(spark, LEAN):
        assert spark.conf.get(key) == LEAN[key] != before
        raise KeyError
    assert spark.conf.get(key) == before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_a_packed_row_comes_back_as_it_was(spark):
    odd = ["", " ", "x", "\x1f", "\x1b", "\x1bn", "\x1bs\x1be", "a\x1f\x1bb", 'a,"b"\n\\', None, "é中", "\x1f\x1f"]
    texts = spark.createDataFrame([(a, b, n) for n, a in enumerate(odd) for b in odd], "a string, b string, n bigint")
    texts = texts.withColumn("n", F.expr("CASE WHEN n % 5 = 0 THEN NULL ELSE n * -1234567890123 END"))
    texts = texts.withColumn("at", F.expr("timestamp_ntz'2024-02-29 23:59:59.123456' + make_interval(n % 9)"))
    names = ["a", "n", "b", "at"]
    both = texts.select(*names, packed(names).alias("row"))
    again = both.select(*unpacked("row", names, {"n": "bigint", "at": "timestamp_ntz"}))
    assert again.dtypes == texts.select(names).dtypes and rows(again) == rows(texts)
    assert both.select("row").distinct().count() == texts.distinct().count()


def test_the_state_of_unique_sales_keeps_digests_on_disk(spark):
    base, made = shared_dir(spark, "test-state"), []
    for part in range(2):
        made += [sale(f"S{n}", f"2024-01-{n % 9 + 1:02d}", dc_id=None if n % 2 else "\x1f") for n in range(part * 3, 12 + part * 3)]
        append_raw(spark.createDataFrame(made, RAW_SCHEMA), f"{base}/landing")
        assert events.unique_sales(spark, f"{base}/landing", f"{base}/out")["too_late"] == 0
    assert rows(spark.read.parquet(f"{base}/out")) == rows(silver_sales(spark.createDataFrame(made, RAW_SCHEMA)).distinct())
    kept = spark.read.format("statestore").load(f"{base}/out-checkpoint")
    assert kept.select("key.*").dtypes == [("known", "binary")] and kept.count() == 15
    assert not any("\x1f" in str(r) or "S1" in str(r) for r in kept.collect())
    spark_files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.changelog").load(f"{base}/out-checkpoint/state")
    assert spark_files.count() > 0 and spark.conf.get("spark.sql.streaming.stateStore.compression.codec", None) is None
