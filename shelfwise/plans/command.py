"""Command-centre roll-ups over the region snapshot and the risk worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import fill_tone, map_band, marker_radius, mercator_x, mercator_y, stockout_tone
from shelfwise.operators import risk
from shelfwise.plans.serving import region_snapshot, scored
from shelfwise.session import written
from shelfwise.sources.star import Tables, dim_distribution_center, dim_product


def _weighted(rate: str) -> str:
    """Demand-weighted mean of a four-decimal rate over the regions; 0 without demand."""
    total = f"sum(cast(round({rate} * 10000) AS bigint) * demand_units)"
    return f"coalesce(cast({total} AS double) / nullif(cast(sum(demand_units) AS double) * 10000D, 0D), 0D)"


def national_snapshot(t: Tables) -> DataFrame:
    return (
        region_snapshot(t)
        .agg(
            F.coalesce(F.sum("demand_units"), F.lit(0)).alias("demand"),
            F.coalesce(F.sum("backorder_count"), F.lit(0)).alias("backorders"),
            F.round(F.sum("revenue_at_risk_m_idr"), 1).alias("revenue_at_risk_m_idr"),
            F.expr(_weighted("fill_rate")).alias("fill"),
            F.expr(_weighted("stockout_rate")).alias("stockout"),
        )
        .withColumns({"fill_tone": F.expr(fill_tone("fill")), "stockout_tone": F.expr(stockout_tone("stockout"))})
    )


def worst_region(t: Tables) -> DataFrame:
    return (
        region_snapshot(t)
        .select("region", "stockout_rate", "fill_rate", "revenue_at_risk_m_idr")
        .orderBy(F.col("stockout_rate").desc(), "region")
        .limit(1)
    )


def region_ranking(t: Tables) -> DataFrame:
    return (
        region_snapshot(t)
        .select(
            "region",
            "stockout_rate",
            F.expr(stockout_tone("stockout_rate")).alias("tone"),
            F.expr("least(stockout_rate * 400D, 100D)").alias("bar_pct"),
        )
        .orderBy(F.col("stockout_rate").desc(), "region")
    )


def top_risk(t: Tables) -> DataFrame:
    """The worst 8 of all pairs at risk."""
    worst = risk.at_risk(scored(t)).orderBy(*risk.worst_first()).limit(8)
    named = risk.with_names(worst, dim_product(t), dim_distribution_center(t))
    return risk.worklist_view(named.orderBy(*risk.worst_first()))


def risk_by_region(t: Tables) -> DataFrame:
    """How many pairs are at risk in each region."""
    counts = risk.at_risk(scored(t)).groupBy("region").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "region")


def map_points(t: Tables) -> DataFrame:
    """Regions that have a centroid, with marker size by demand, colour by stockout rate and world coordinates."""
    centroids = (
        dim_distribution_center(t).groupBy("region").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    )
    regions = region_snapshot(t).withColumn("peak", F.max("demand_units").over(Window.partitionBy()))  # one row per region
    points = regions.join(centroids, "region")
    return points.select(
        "region",
        "lat",
        "lng",
        "demand_units",
        "stockout_rate",
        F.expr(map_band("stockout_rate")).alias("colour"),
        F.expr("stockout_rate >= 0.15D").alias("critical"),
        F.expr(marker_radius("demand_units", "peak")).alias("radius"),
        F.expr(f"round({mercator_x('lng')}, 4)").alias("world_x"),
        F.expr(f"round({mercator_y('lat')}, 4)").alias("world_y"),
    )


# The alerts over SKUs: severity, the score behind each and where it is raised.
SKU_ALERTS = (("sku-stockout", "crit", "stockout_risk_score", 0.5), ("expiry", "warn", "expiry_risk_score", 0.7))
_NAMED = 3


def _region_alerts(t: Tables) -> DataFrame:
    """One row from the regions' snapshot, taken apart into its alerts."""
    regions = region_snapshot(t).agg(
        F.min_by(F.struct("region", "stockout_rate"), F.expr("struct(-stockout_rate, region)")).alias("worst"),
        F.sum("backorder_count").alias("backorders"),
    )
    return regions.select(
        F.inline(
            F.expr(
                """filter(array(
                     named_struct('alert_id', 'stockout', 'severity', 'crit', 'subject', worst.region,
                                  'value', cast(worst.stockout_rate AS double), 'raised', worst.stockout_rate >= 0.15D),
                     named_struct('alert_id', 'backorder', 'severity', 'warn', 'subject', worst.region,
                                  'value', cast(backorders AS double), 'raised', backorders > 0)
                   ), a -> a.raised)"""
            )
        )
    ).drop("raised")


def _sku_alerts(t: Tables) -> DataFrame:
    """For each alert over SKUs how many pairs raise it, and the products of the worst three."""
    kinds = F.filter(
        F.array(
            *[
                F.when(F.col(score) >= at, F.struct(F.lit(name).alias("alert_id"), F.lit(severity).alias("severity")))
                for name, severity, score, at in SKU_ALERTS
            ]
        ),
        lambda kind: kind.isNotNull(),
    )
    # Ranking and counts both stand on the scores: written once, else the whole inventory would be worked out twice.
    scores = written(risk.at_risk(scored(t)), "at-risk")
    raised = scores.withColumn("kind", F.explode(kinds)).select("kind.*", "*").drop("kind")
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy(*risk.worst_first()))
    # Ranked rows are cut in each task before the shuffle; names come after the cut.
    worst = risk.with_names(
        raised.withColumn("place", place).filter(F.col("place") <= _NAMED), dim_product(t), dim_distribution_center(t)
    )
    names = worst.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("place", "product_name"))).alias("worst"))
    counts = raised.groupBy("alert_id", "severity").agg(F.count(F.lit(1)).cast("double").alias("value"))
    subject = F.concat_ws(", ", F.transform("worst", lambda w: w["product_name"]))
    return counts.join(names, "alert_id").select("alert_id", "severity", subject.alias("subject"), "value")


def alerts(t: Tables) -> DataFrame:
    """The alerts raised over all regions and all pairs at risk, with the severity of the whole; one row that says ok if
    there are none."""
    every = _region_alerts(t).unionByName(_sku_alerts(t))
    # Four alerts at most.
    found = every.agg(F.collect_list(F.struct("alert_id", "severity", "subject", "value")).alias("found"))
    calm = F.expr("array(struct('none' AS alert_id, 'ok' AS severity, cast(null AS string) AS subject, 0D AS value))")
    overall = F.expr("CASE WHEN size(found) = 0 THEN 'ok' WHEN exists(found, a -> a.severity = 'crit') THEN 'crit' ELSE 'warn' END")
    return found.select(F.inline(F.when(F.size("found") == 0, calm).otherwise(F.col("found"))), overall.alias("overall"))
