"""Expiry and stockout risk: forward labels, scores per SKU and centre, worklists and the what-if rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import EXPIRY_LABEL_AT, ratio, recommended_action, risk_severity
from shelfwise.operators.keyed import last_n_per_key

SERIES = ("dc_id", "product_id")
LABEL_DAYS = 7
RECENT_READINGS = 14
# The features of the expiry model.
FEATURES = (
    "days_of_supply", "days_to_expiry", "avg_daily_demand", "on_hand_units", "reorder_gap", "shelf_life_days",
    "in_transit_units", "reserved_units",
)


def expiry_features(inventory: DataFrame, products: DataFrame) -> DataFrame:
    shelf = products.select("product_id", "shelf_life_days")
    return inventory.join(shelf, "product_id").withColumn(
        "reorder_gap", F.col("on_hand_units") - F.col("reorder_point")
    )


def with_label_or_null(features: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Label: does the expiry score reach the action level within the next 7 days? Null for rows whose 7 days are not all
    there yet. `keys` identify a series; those the rows already lie together by save a shuffle."""
    reached = F.when(F.col("expiry_risk_score") >= EXPIRY_LABEL_AT, F.col("day_idx"))
    backwards = Window.partitionBy(*keys).orderBy(F.col("day_idx").desc())
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    label = F.coalesce((F.col("_next") <= F.col("day_idx") + LABEL_DAYS).cast("int"), F.lit(0))
    return (
        features.withColumns({"_next": F.min(reached).over(later), "_last": F.max("day_idx").over(backwards)})
        .withColumn("label", F.when(F.col("day_idx") + LABEL_DAYS <= F.col("_last"), label))
        .drop("_next", "_last")
    )


def with_forward_label(features: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The rows that have a label, with it: those whose 7 days are all there."""
    return with_label_or_null(features, keys).filter("label IS NOT NULL")


_STOCKOUT_SHARE = ratio("sum(stockout_flag)", "count(1)")


def recent_stockouts(inventory: DataFrame) -> DataFrame:
    """Share of the last 14 readings of each series that were stockouts."""
    return stockout_share(last_n_per_key(inventory, SERIES, "reading_date", RECENT_READINGS))


def stockout_share(readings: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Share of stockouts among all readings given of each series. With the keys they already lie by, nothing is shuffled."""
    shares = readings.groupBy(*keys).agg(*[F.first(k).alias(k) for k in SERIES if k not in keys], F.expr(_STOCKOUT_SHARE).alias("stockout_risk_score"))
    return shares.select(*SERIES, "stockout_risk_score")


_LATEST = (
    "brand", "division", "region", "expiry_risk_score", "days_to_expiry", "on_hand_units", "days_of_supply",
    "at_risk_expiry_units", "avg_daily_demand",
)


def risk_scores(
    readings: DataFrame, latest_columns: Sequence[str] = _LATEST, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Latest reading and recent stockout share per series, out of its last RECENT_READINGS readings.

    `keys` identify a series; with those the readings already lie by, nothing is shuffled, and a series has no more rows than
    that, so nothing is ranked either.
    """
    grouped = readings.groupBy(*keys)
    return grouped.agg(
        F.max_by(F.struct(*SERIES, *latest_columns), "reading_date").alias("latest"),
        F.expr(_STOCKOUT_SHARE).alias("stockout_risk_score"),
    ).select("latest.*", "stockout_risk_score")


def with_action(scores: DataFrame) -> DataFrame:
    return scores.withColumn(
        "recommended_action",
        F.expr(recommended_action("stockout_risk_score", "expiry_risk_score", "days_to_expiry")),
    )


def with_names(scores: DataFrame, products: DataFrame, centres: DataFrame) -> DataFrame:
    return scores.join(products.select("product_id", "product_name"), "product_id", "left").join(
        centres.select("dc_id", "dc_name"), "dc_id", "left"
    )


def at_risk(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.filter((F.col("expiry_risk_score") >= threshold) | (F.col("stockout_risk_score") >= threshold))


def worst_first() -> list[Column]:
    """Order of the worklist; the keys make it total."""
    return [F.greatest("expiry_risk_score", "stockout_risk_score").desc(), F.col("dc_id"), F.col("product_id")]


# Scores carry three (expiry) and four (stockout) decimals, so percentages round half up in integers.
EXPIRY_PCT = "cast((cast(round(expiry_risk_score * 1000) AS bigint) + 5) div 10 AS int)"
STOCKOUT_PCT = "cast((cast(round(stockout_risk_score * 10000) AS bigint) + 50) div 100 AS int)"


def worklist_view(scores: DataFrame) -> DataFrame:
    return scores.select(
        "product_id",
        "dc_id",
        "product_name",
        "brand",
        "division",
        "region",
        "dc_name",
        F.expr(EXPIRY_PCT).alias("expiry_risk_pct"),
        F.expr(STOCKOUT_PCT).alias("stockout_risk_pct"),
        "days_to_expiry",
        "on_hand_units",
        F.expr("((cast(round(days_of_supply * 100) AS bigint) + 5) div 10) / 10D").alias("days_of_supply"),
        "at_risk_expiry_units",
        "recommended_action",
    )


def _level(value: str, two: str, one: str) -> str:
    return f"CASE WHEN {value} {two} THEN 2 WHEN {value} {one} THEN 1 ELSE 0 END"


# The what-if cut-offs of each input (level 2, level 1); the reorder point never adds risk.
WHAT_IF_LEVELS = {
    "days_of_supply": (">= 45", ">= 30"),
    "days_to_expiry": ("<= 20", "<= 45"),
    "avg_daily_demand": ("<= 20", "<= 40"),
    "on_hand_units": (">= 3000", ">= 2000"),
    "shelf_life_days": ("<= 120", "<= 270"),
}
WHAT_IF_MAX = 12


def what_if(features: DataFrame) -> DataFrame:
    """Rule-of-thumb expiry risk of each row: level points out of 12, bent by a power of 0.85, with a severity."""
    points = " + ".join(_level(c, *cuts) for c, cuts in WHAT_IF_LEVELS.items())
    scored = features.withColumn("points", F.expr(points)).withColumn(
        "risk", F.expr(f"round(greatest(0D, least(1D, pow(points / cast({WHAT_IF_MAX} AS double), 0.85D))), 4)")
    )
    return scored.withColumn("severity", F.expr(risk_severity("risk")))


def tracked_skus(products: DataFrame, sales: DataFrame, must: Column, n: int) -> DataFrame:
    """The SKUs to track: all must-haves first, then the best sellers, up to n."""
    volume = sales.groupBy("product_id").agg(F.sum("units_ordered").alias("volume"))
    ranked = products.join(volume, "product_id", "left").fillna({"volume": 0}).withColumn("is_must", must)
    return ranked.orderBy(F.col("is_must").desc(), F.col("volume").desc(), "product_id").limit(n)
