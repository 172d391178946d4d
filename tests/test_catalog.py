import pytest
from pyspark.sql import functions as F

from shelfwise.operators import governance as gov, variants
from shelfwise.operators import sql_governance as sql_gov
from shelfwise.plans import catalog, dashboard, sketches
from shelfwise.plans.metric_defs import sales_metrics
from shelfwise.session import shared_dir
from shelfwise.sources.star import access_allowlist, dim_account, fact_sales


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_meet_without_an_exchange(spark, tables):
    joined = catalog.priority_status(tables)
    below = plan_of(joined).split("SortMergeJoin", 1)[1]
    assert "Exchange" not in below and "Bucketed: true" in below


def test_partitions_comments_and_tags_are_set_at_the_write(spark, tables):
    path = shared_dir(spark, "saved")
    sales = fact_sales(tables, ["sale_id", "region", "status"])
    saved = catalog.save_table(sales, "saved_sales", path, "Sales 'by' region", {"status": "State"}, "commercial-confidential", ("region",))
    assert "PartitionFilters: [isnotnull(region" in plan_of(saved.filter("region = 'ASIA'"))
    tags = catalog.table_tags(spark, "saved_sales").first()
    assert tuple(tags) == ("Sales 'by' region", "commercial-confidential", "ap-southeast-3", 1)
    assert saved.count() == sales.count()
    # Written again, the table has the new schema.
    again = catalog.save_table(sales.drop("status"), "saved_sales", path)
    assert again.columns == ["sale_id", "region"]
    spark.sql("DROP TABLE saved_sales")


def test_sql_users_see_what_the_policy_lets_them(spark, tables):
    sql_gov.register(spark, access_allowlist(spark))
    for who in ("admin@example.com", "analyst@example.com", "asia.rm@example.com", "nobody@example.com", "o'hara\\"):
        for df, policy in ((dim_account(tables), gov.ACCOUNT_POLICY), (fact_sales(tables, ["sale_id", "region", "net_idr"]), gov.SALES_POLICY)):
            sql_gov.governed_view(df, "seen", policy, who)
            got, want = spark.table("seen"), policy.apply(df, access_allowlist(spark), who)
            assert got.columns == want.columns
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert spark.sql("SELECT mask_partial('secret', false), mask_partial(NULL, false), mask_full(NULL, false), mask_full('x', true)").first()[:] == (
        "•••et", None, "REDACTED-PII", "x",
    )


def test_sketches_merge_within_their_error_and_never_see_the_sales_again(spark, tables):
    folder = shared_dir(spark, "sketches")
    stored = sketches.build(tables, folder)
    merged = sketches.unique_by(stored, ["region"])
    assert "lineitem" not in plan_of(merged)
    exact = fact_sales(tables, ["region", "outlet_key", "product_key"]).groupBy("region").agg(
        F.count_distinct("outlet_key").alias("outlets"), F.count_distinct("product_key").alias("skus")
    )
    for row in merged.join(exact, "region").collect():
        assert row.unique_outlets == pytest.approx(row.outlets, rel=3 * sketches.RELATIVE_ERROR)
        assert row.unique_skus == pytest.approx(row.skus, rel=3 * sketches.RELATIVE_ERROR)
    many = spark.range(300_000).selectExpr("id % 50 AS day", "id * 7 AS k").groupBy("day").agg(F.hll_sketch_agg("k", sketches.LG_K).alias("s"))
    (estimate,) = many.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()
    assert estimate == pytest.approx(300_000, rel=3 * sketches.RELATIVE_ERROR)


def test_rollup_tells_levels_from_null_values(spark, tables):
    rolled = dashboard.sales_rollup(tables)
    assert plan_of(rolled).count("Expand") == 1
    levels = {r.level: r.n for r in rolled.groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert levels[2] == 1 and levels[1] == rolled.filter("level = 1").select("region").distinct().count()
    whole = rolled.filter("level = 2").first()
    direct = sales_metrics(tables).query((), dashboard.ROLLUP_MEASURES).first()
    assert [whole[m] for m in dashboard.ROLLUP_MEASURES] == list(direct)


def test_variant_results_tell_json_null_from_missing(spark):
    rows = [
        (1, '{"document":{"elements":[{"id":"0","type":"text","content":"a"}]},"error_status":null}'),
        (2, '{"document":null,"error_status":"NO_ELEMENTS"}'), (3, '{"document":{"elements":[]}}'), (4, "no json"), (5, None),
    ]
    read = variants.read_payloads(spark.createDataFrame(rows, "page_id long, result string"), "result")
    kept = {r.page_id: r.e for r in variants.parsed_only(read).select("page_id", variants.elements_of().alias("e")).collect()}
    assert {k: [tuple(e) for e in v] for k, v in kept.items()} == {1: [("0", "text", "a")], 3: []}
    assert {r.error_status: r.pages for r in variants.failures(read).collect()} == {"NO_ELEMENTS": 1, "UNREADABLE": 2}
    made = spark.range(1).select(
        variants.payload(F.expr("array(named_struct('id', '0', 'type', 'text', 'content', cast(null AS string)))")).alias("full"),
        variants.payload(F.expr("cast(array() AS array<string>)")).alias("none"),
    ).first()
    assert made.full == '{"document":{"elements":[{"id":"0","type":"text","content":null}]},"error_status":null}'
    assert made.none == '{"document":null,"error_status":"NO_ELEMENTS"}'
