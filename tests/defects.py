"""Defects for the raw feed, as a test's own damage to otherwise clean rows."""

from pyspark.sql import functions as F

# Column, what it is replaced by, and the hundredths of the rows it hits.
DEFECTS = (
    ("product_id", None, (0, 3)), ("region", None, (2, 5)), ("units_ordered", "-2", (5, 7)), ("status", "LOST", (7, 9)),
    ("unit_price_idr", "0", (9, 11)), ("order_ts", "not a time", (10, 13)), ("units_ordered", "many", (13, 14)),
)


def with_defects(feed):
    """The feed with about 14 % of its rows damaged, some of them twice."""
    share = F.pmod(F.xxhash64("sale_id", "dc_id"), F.lit(100))
    for column, value, (low, high) in DEFECTS:
        feed = feed.withColumn(column, F.when((share >= low) & (share < high), F.lit(value)).otherwise(F.col(column)))
    return feed
