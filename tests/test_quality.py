import os
import tempfile

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfwise.operators.quality import SALES, quarantined_sales, silver_sales, typed_sales
from shelfwise.plans.gold import curated_from, region_daily
from shelfwise.sources.files import RAW_SCHEMA
from shelfwise.sources.star import SALES_COLUMNS, Tables, raw_sales
from tests.defects import with_defects

GOOD = {
    "sale_id": "S1", "product_id": "P1", "outlet_id": "O1", "dc_id": "D1", "account_id": "A1", "region": "ASIA",
    "province": "x", "city": "x", "division": "d", "brand": "b", "category": "c", "order_ts": "2024-01-02 03:04:05",
    "ship_ts": None, "units_ordered": "10", "units_fulfilled": "4", "unit_price_idr": "100", "gross_idr": "1000",
    "discount_idr": "0", "net_idr": "400", "channel": "direct", "promo_flag": "0", "status": "partial",
}


def raw(spark, *changes):
    rows = [tuple({**GOOD, **change}[c] for c in SALES_COLUMNS) for change in changes]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def reasons(spark, *changes):
    rows = quarantined_sales(raw(spark, *changes)).select("sale_id", "reject_reason").collect()
    return {r.sale_id: r.reject_reason for r in rows}


def test_reasons_and_their_precedence(spark):
    got = reasons(
        spark,
        {"sale_id": "ok"},
        {"sale_id": "a", "product_id": None, "region": None, "order_ts": "N/A"},
        {"sale_id": "b", "region": None, "units_ordered": "-1"},
        {"sale_id": "c", "order_ts": "N/A", "status": "UNKNOWN"},
        {"sale_id": "d", "units_ordered": "-5", "unit_price_idr": "0"},
        {"sale_id": "e", "status": "UNKNOWN", "unit_price_idr": "-1"},
        {"sale_id": "f", "unit_price_idr": "0"},
    )
    assert got == {
        "a": "null_product", "b": "null_region", "c": "malformed_timestamp", "d": "negative_units",
        "e": "invalid_status", "f": "out_of_range_price",
    }


def test_rules_that_come_out_null_reject_and_are_labelled_other(spark):
    holes = [
        {"sale_id": "u", "units_ordered": "many"}, {"sale_id": "n", "units_ordered": None},
        {"sale_id": "s", "status": None}, {"sale_id": "p", "unit_price_idr": "1e"}, {"sale_id": "q", "unit_price_idr": None},
    ]
    assert set(reasons(spark, *holes).values()) == {"other"}
    assert silver_sales(raw(spark, *holes)).count() == 0


def test_boundaries_pass(spark):
    assert silver_sales(raw(spark, {"units_ordered": "0"}, {"unit_price_idr": "1"})).count() == 2


def test_typing_never_fails(spark):
    row = typed_sales(raw(spark, {"order_ts": "2024-13-45", "net_idr": "x", "promo_flag": ""})).head()
    assert row.order_ts is None and row.net_idr is None and row.promo_flag is None


def test_silver_and_quarantine_partition_the_feed(tables):
    feed = with_defects(raw_sales(tables))
    kept, rejected = silver_sales(feed), quarantined_sales(feed)
    assert kept.count() + rejected.count() == feed.count()
    assert 0.1 < rejected.count() / feed.count() < 0.2
    assert silver_sales(raw_sales(tables)).count() == feed.count()


def test_a_line_without_its_order_is_kept_and_rejected(spark, tables):
    lost = tables.lineitem.limit(1).withColumn("l_orderkey", F.lit(-1).cast("bigint"))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in os.listdir(tables.sf_dir):
        if name != "lineitem.parquet":
            os.symlink(f"{tables.sf_dir}/{name}", f"{folder}/{name}")
    tables.lineitem.unionByName(lost).write.parquet(f"{folder}/lineitem.parquet")
    feed = raw_sales(Tables(spark, folder))
    rejected = quarantined_sales(feed).collect()
    assert feed.count() == tables.lineitem.count() + 1
    assert [(r.sale_id.startswith("SAL--1-"), r.reject_reason) for r in rejected] == [(True, "null_region")]


def test_metrics_of_an_empty_feed(spark):
    rows = SALES.metrics(raw(spark, {}).limit(0)).collect()
    assert len(rows) == 6 and all(r.checked == 0 and r.failed == 0 and r.failed_pct is None for r in rows)


def test_observed_counts_equal_the_metrics(spark):
    feed = raw(spark, {"product_id": None}, {"region": None}, {"region": None, "status": "x"}, {})
    seen = Observation("rules")
    SALES.observe(feed, seen).count()
    want = {r.rule: r.failed for r in SALES.metrics(feed).collect()}
    assert seen.get == {"checked": 4, **want}


def test_dedup_keeps_the_first_and_breaks_ties_the_same_way(spark):
    late, early = {"order_ts": "2024-01-05 00:00:00"}, {"order_ts": "2024-01-01 00:00:00"}
    tied = [{"product_id": p, **early} for p in ("P3", "P2", "P9")]
    for order in (tied + [late], [late] + tied[::-1]):
        rows = curated_from(silver_sales(raw(spark, *order))).collect()
        assert [(r.product_id, str(r.sales_date)) for r in rows] == [("P2", "2024-01-01")]


def test_roll_up_of_zero_units_has_no_fill_rate(spark):
    feed = raw(spark, {"units_ordered": "0", "units_fulfilled": "0", "status": "backorder"})
    row = region_daily(curated_from(silver_sales(feed))).head()
    assert row.fill_rate is None and row.stockout_rate == 1.0 and row.backorder_count == 1


def test_revenue_at_risk_is_the_unfilled_part(spark):
    rows = curated_from(
        silver_sales(raw(spark, {"sale_id": "1"}, {"sale_id": "2", "status": "cancelled"}, {"sale_id": "3", "units_fulfilled": "99"}))
    ).collect()
    assert {r.sale_id: r.revenue_at_risk_idr for r in rows} == {"1": 600, "2": 0, "3": 0}
