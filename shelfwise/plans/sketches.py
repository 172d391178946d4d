"""Distinct counts at any grain out of stored gold: mergeable sketches per day, and no second look at the sales.

A sketch of a day and region holds the outlets and products seen (HyperLogLog, 2**LG_K registers at most). Sketches of any days and
regions merge into one that is as good as if it had seen all their sales: a relative standard error of 1.04 / sqrt(2**LG_K),
1.6 % at 12, and exact but for hash collisions while a group has a few hundred distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import snapshots
from shelfwise.session import shared_dir
from shelfwise.sources.star import Tables, fact_sales

LG_K = 12
RELATIVE_ERROR = 1.04 / 2 ** (LG_K / 2)
KEYS = ("sales_date", "region")
#: Measure: the numeric key that is counted.
COUNTED = {"unique_outlets": "outlet_key", "unique_skus": "product_key"}


def daily_sketches(t: Tables) -> DataFrame:
    """Orders and sketches per day and region; small beside the sales, whatever their volume."""
    sales = fact_sales(t, ["order_ts", "region", *COUNTED.values()]).withColumn("sales_date", F.to_date("order_ts"))
    sketches = [F.hll_sketch_agg(column, LG_K).alias(name) for name, column in COUNTED.items()]
    return sales.filter("sales_date IS NOT NULL AND region IS NOT NULL").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("order_count"), *sketches)


def build(t: Tables, folder: str) -> DataFrame:
    """Publish the sketches as a gold table; read back."""
    return snapshots.keyed_snapshot(daily_sketches(t), KEYS, f"{folder}/gold_sales_sketches")


def unique_by(sketches: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Orders and estimated distinct counts by expressions over day and region (`expression AS name`, or a name)."""
    named = sketches.selectExpr("order_count", *COUNTED, *grain)
    keys = [c for c in named.columns if c not in ("order_count", *COUNTED)]
    merged = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in COUNTED]
    return named.groupBy(*keys).agg(F.sum("order_count").alias("order_count"), *merged)


def unique_by_month_region(t: Tables) -> DataFrame:
    stored = build(t, shared_dir(t.spark, "sketches"))
    return unique_by(stored, ["cast(trunc(sales_date, 'MONTH') AS date) AS sale_month", "region"])
