"""Findings F12 and F16 of round 3: the sales of an order are de-duplicated where the join leaves them."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfwise.plans import gold, serving
from shelfwise.sources.star import Tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def odd(spark):
    """Lines without a number, lines sent again with other values, and orders, customers and parts that come twice."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = Tables(spark, SMALL)
    lines = t.lineitem.filter("l_orderkey < 120")
    without = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_linenumber")).alias("l_linenumber")
    lines = lines.select(*[without if c == "l_linenumber" else c for c in lines.columns])
    again = lines.filter("l_partkey % 3 = 0").withColumns({"l_quantity": F.expr("l_quantity % 7 + 1"), "l_discount": F.expr("l_discount + 0.01")})
    orders = t.orders.filter("o_orderkey < 118").withColumn("o_custkey", F.expr("IF(o_orderkey % 9 = 0, null, o_custkey)"))
    later = orders.filter("o_orderkey % 4 = 0").withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 3 DAYS"))
    changed = {
        "lineitem": lines.unionByName(again).unionByName(lines.filter("l_partkey % 5 = 0")),
        "orders": orders.unionByName(later),
        "part": t.part.unionByName(t.part.withColumns({"p_brand": F.lit("Brand#0"), "p_type": F.lit("LARGE")})),
        "customer": t.customer.unionByName(t.customer.withColumn("c_nationkey", F.expr("(c_nationkey + 6) % 25"))),
    }
    for name in os.listdir(SMALL):
        if name.removesuffix(".parquet") not in changed:
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
    for name, df in changed.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, folder)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "columns", [gold.SERVING_INPUTS, ("region", "sales_date", "units_ordered"), ("sale_id",), ("sale_id", "is_stockout"), ("net_idr", "revenue_at_risk_idr")]
)
def test_sales_by_order_are_the_curated_sales(odd, columns):
    want = rows(gold.curated(odd).select(*columns))
    assert want and rows(gold.curated_by_order(odd, columns)) == want


def test_rows_without_sale_id_are_one_sale(odd):
    sales = gold.curated_by_order(odd)
    assert odd.lineitem.filter("l_linenumber IS NULL").count() > 1 and sales.filter("sale_id IS NULL").count() == 1


def test_columns_that_break_no_tie_follow_from_earlier_ones(odd):
    kept = gold.silver(odd)
    for name, earlier in (("units_fulfilled", ("units_ordered", "status")), ("account_id", ("outlet_id",)), ("city", ("province",))):
        assert max(gold._DEDUP_ORDER.index(c) for c in earlier) < gold._DEDUP_ORDER.index(name)
        assert kept.groupBy(*earlier).agg(F.count_distinct(F.struct(name)).alias("n")).filter("n > 1").isEmpty()


def test_demand_needs_no_exchange_by_sale_and_no_parts(odd):
    text = serving.region_series(odd)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sale_id" not in text and "part.parquet" not in text
