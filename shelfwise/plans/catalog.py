"""Saved catalog tables: partitioned or bucketed by join key, with comments and tags set as they are written."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.governance import CLASSIFICATION, comment_table, tag_table
from shelfwise.plans.personas import RESIDENCY
from shelfwise.session import shared_dir
from shelfwise.sources.star import STATUS, Tables, dim_distribution_center, dim_outlet, dim_product

#: Buckets of the tables that meet on the order key; at scale, as many as the larger table has 200 MB parts.
BUCKETS = 8

# What the catalog says of the saved dimensions and their columns.
COMMENTS: dict[str, tuple[str, dict[str, str]]] = {
    "dim_product": ("Products with brand, division and shelf life", {"product_id": "Key", "shelf_life_days": "Days from receipt to expiry"}),
    "dim_outlet": ("Outlets that order", {"outlet_id": "Key", "dc_id": "Centre that serves the outlet"}),
    "dim_distribution_center": ("Distribution centres", {"dc_id": "Key"}),
}


def save_table(
    df: DataFrame, name: str, path: str, comment: str = "", columns: Mapping[str, str] | None = None,
    classification: str | None = None, partition_by: tuple[str, ...] = (), buckets: int = 0, bucket_by: str = "",
) -> DataFrame:
    """Write df as a catalog table at path and return it as read from the catalog. A bucketed table is written by one task a
    bucket and sorted within, so a join on its key neither shuffles nor sorts it again."""
    spark = df.sparkSession
    if buckets:
        df = df.repartition(buckets, bucket_by)
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    if comment or columns:
        comment_table(spark, name, comment, columns or {})
    if classification:
        tag_table(spark, name, RESIDENCY, classification)
    return spark.table(name)


def table_tags(spark: SparkSession, name: str) -> DataFrame:
    """One row of what the catalog holds about a table: comment, tags and the number of commented columns."""
    properties = {row.key: row.value for row in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    commented = sum(bool(c.description) for c in spark.catalog.listColumns(name))
    row = (spark.catalog.getTable(name).description, properties.get("data_classification"), properties.get("data_residency"), commented)
    return spark.createDataFrame([row], "comment string, data_classification string, data_residency string, commented_columns int")


def saved_dimensions(t: Tables) -> DataFrame:
    """The dimensions saved with comments and tags, and both read back from the catalog, with their rows counted."""
    frames = {"dim_product": dim_product(t), "dim_outlet": dim_outlet(t), "dim_distribution_center": dim_distribution_center(t)}
    reports = []
    for name, df in frames.items():
        table = f"{name}_{uuid.uuid4().hex}"
        comment, columns = COMMENTS[name]
        saved = save_table(df, table, shared_dir(t.spark, table), comment, columns, CLASSIFICATION[name])
        rows = saved.agg(F.count(F.lit(1))).scalar()
        reports.append(table_tags(t.spark, table).select(F.lit(name).alias("table_name"), "*", rows.alias("row_count")))
    first, *others = reports
    for report in others:
        first = first.unionByName(report)
    return first


def bucketed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(lines, orders) as catalog tables in buckets of the order key."""
    lines = t.lineitem.select("l_orderkey", F.expr(STATUS).alias("status"), F.expr("cast(l_quantity AS bigint)").alias("units"))
    orders = t.orders.select("o_orderkey", "o_orderpriority")
    suffix = uuid.uuid4().hex
    saved = []
    for name, df, key in (("lines", lines, "l_orderkey"), ("orders", orders, "o_orderkey")):
        table = f"{name}_{suffix}"
        saved.append(save_table(df, table, shared_dir(t.spark, table), f"{name} by order", buckets=BUCKETS, bucket_by=key))
    return saved[0], saved[1]


def priority_status(t: Tables) -> DataFrame:
    """Lines and units by order priority and status, joined bucket by bucket: no exchange below the join."""
    lines, orders = bucketed(t)
    joined = lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)
    return joined.groupBy("o_orderpriority", "status").agg(F.count(F.lit(1)).alias("lines"), F.sum("units").alias("units"))
