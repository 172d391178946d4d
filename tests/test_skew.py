"""One order, customer, supplier and SKU hold a third of all rows, and no dimension may be broadcast."""

import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwise.sources.star import Tables
from tests.conftest import SMALL
from tests.support import tables_equal

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
CHANGED = ("lineitem", "orders")


@pytest.fixture(scope="module")
def skewed(spark):
    """The small tables with a hot newest order: a third of the lines, all of one SKU and supplier."""
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    t = Tables(spark, SMALL)
    newest = t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").head()
    hot = F.pmod(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey"), F.lit(3)) == 0
    lines = t.lineitem.withColumns(
        {
            "l_orderkey": F.when(hot, F.lit(newest.o_orderkey)).otherwise(F.col("l_orderkey")),
            "l_partkey": F.when(hot, F.lit(3)).otherwise(F.col("l_partkey")),
            "l_suppkey": F.when(hot, F.lit(1)).otherwise(F.col("l_suppkey")),
            "l_linenumber": F.when(hot, F.lit(1)).otherwise(F.col("l_linenumber")),
        }
    ).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in t.lineitem.schema.fields])
    customer = F.when(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == 0, F.lit(1)).otherwise(F.col("o_custkey"))
    orders = t.orders.withColumn("o_custkey", customer.cast("bigint"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    orders.write.parquet(f"{folder}/orders.parquet")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        table = name.removesuffix(".parquet")
        if table not in CHANGED:
            os.symlink(f"{SMALL}/{name}", f"{folder}/{name}")
        source = f"{folder}/{name}/*.parquet" if table in CHANGED else f"{SMALL}/{name}"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{source}'")
    return folder, con


@pytest.mark.parametrize(
    "name",
    ["region_daily", "sales_curated", "fact_inventory", "product_risk", "persona_sales", "metric_sales_by_region",
     "dash_dc_map", "demand_features", "serving_pk_check"],
)
def test_hot_keys_change_nothing(spark, skewed, name):
    folder, con = skewed
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert tables_equal(con, QUERIES[name](spark, folder).toArrow(), ORACLE[name]) is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
