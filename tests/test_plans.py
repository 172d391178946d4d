"""Physical plans: what must, and must not, be in them."""

import pytest

import __spark_entry__ as entry
from shelfwise.plans.registry import QUERIES as PLANS
from tests.conftest import SMALL

EAGER = {
    "expiry_model_scores", "demand_forecast", "stream_dq_silver", "stream_quarantine", "incremental_cycle",
    "incremental_national", "stored_gold_kpis", "stored_gold_feed", "expiry_model_frame", "demand_forecast_frame", "expiry_model_report",
    "decision_log_saved", "region_daily_upserted", "stream_rule_totals",
}
QUERIES = {name: query for name, query in entry.queries().items() if name in PLANS}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_pairing_of_all_rows_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_dedup_limits_groups_before_the_shuffle(spark):
    text = plan(QUERIES["region_daily"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_top_k_is_distributed(spark):
    for name in ("risk_worklist", "backorder_feed", "dash_risk_worklist", "national_kpis", "tracked_skus"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SMALL))


def test_scans_are_pruned_and_filtered(spark):
    text = plan(QUERIES["nl_revenue_fill_region"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "l_partkey" not in text and "part.parquet" not in text and "supplier.parquet" not in text
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,17)]" in plan(QUERIES["doc_page"](spark, SMALL))


def test_metric_views_join_only_what_they_use(spark):
    for name, used in (("dash_status_mix", ()), ("dash_counters", ()), ("dash_units_division", ("part",)), ("tracked_skus", ("part",))):
        text = plan(QUERIES[name](spark, SMALL))
        for table in ("orders", "customer", "nation", "supplier", "part"):
            assert (f"{table}.parquet" in text) == (table in used)


def test_reads_of_stored_gold_neither_join_nor_read_all_days(spark, tables):
    from shelfwise.plans import serving

    stored = serving.with_stored_gold(tables)
    for read in (serving.national_kpis, serving.region_latest, serving.national_trend):
        text = plan(read(stored))
        assert "lineitem.parquet" not in text and "Join" not in text
    for read in (serving.backorder_feed, serving.search_rows, serving.division_mix):
        text = plan(read(stored))
        assert "lineitem.parquet" not in text and "/curated" not in text
    from shelfwise.plans import gold

    assert "PartitionFilters: [isnotnull(sales_date" in plan(gold.sales_serving(stored, gold.sales_of(stored)))


def test_labels_need_no_shuffle_beyond_the_daily_sums(spark):
    text = plan(QUERIES["expiry_label"](spark, SMALL))
    assert "hashpartitioning(dc_id" not in text and "hashpartitioning(product_id" not in text
    assert text.count("part.parquet") == 1


def test_dimensions_are_not_broadcast_past_the_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("region_daily", "fact_inventory", "product_risk", "dash_dc_map", "persona_sales"):
            text = plan(QUERIES[name](spark, SMALL))
            assert "BroadcastHashJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
