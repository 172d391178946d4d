"""Dashboard widgets, metric-view grains and the worked example questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import AT_RISK_NET, EXPIRY_FLAG_ABOVE, plain_ratio, ratio
from shelfwise.operators import forecast
from shelfwise.plans.metric_defs import ds_inventory, ds_sales, inventory_risk_metrics, last_days, sales_metrics
from shelfwise.sources.inventory import fact_inventory
from shelfwise.sources.star import (
    SURGE_BRANDS, SURGE_REGIONS, Tables, dim_distribution_center, dim_product, fact_sales,
)

_COUNTERS = ("net_revenue_bn_idr", "fill_rate", "revenue_at_risk_bn_idr", "stockout_order_rate")

# Every metric-view question: view, dimensions, measures.
GRAINS = {
    "metric_sales_by_region": (sales_metrics, ("region",), None),
    "metric_sales_by_month_division": (sales_metrics, ("sale_month", "division"), None),
    "metric_sales_by_status": (sales_metrics, ("order_status", "is_promo"), None),
    "metric_sales_by_date": (sales_metrics, ("sale_date",), ("order_count", "net_revenue_idr", "fill_rate")),
    "metric_sales_by_place": (sales_metrics, ("province", "city", "channel"), ("order_count", "units_ordered", "gross_revenue_idr")),
    "metric_sales_by_brand": (sales_metrics, ("brand", "category"), ("order_count", "discount_idr", "unique_skus")),
    "metric_inventory_by_brand": (inventory_risk_metrics, ("brand", "division"), ("readings", "on_hand_units", "stockout_rate")),
    "metric_inventory_by_dc": (inventory_risk_metrics, ("distribution_center",), None),
    "metric_inventory_by_region_day": (inventory_risk_metrics, ("region", "reading_date"), None),
    "dash_counters": (ds_sales, (), _COUNTERS),
    "dash_daily_revenue": (ds_sales, ("sales_date",), ("net_revenue_bn_idr", "revenue_at_risk_bn_idr")),
    "dash_daily_fill_region": (ds_sales, ("sales_date", "region"), ("fill_rate",)),
    "dash_units_division": (ds_sales, ("division",), ("units_ordered",)),
    "dash_revenue_region": (ds_sales, ("region",), ("net_revenue_bn_idr",)),
    "dash_status_mix": (ds_sales, ("status",), ("total_orders", "cancellation_rate")),
    "dash_daily_units_division": (ds_sales, ("sales_date", "division"), ("units_ordered",)),
    "dash_units_region": (ds_sales, ("region",), ("units_ordered",)),
    "dash_hourly_orders": (ds_sales, ("sales_hour", "promo_flag"), ("total_orders", "units_ordered")),
    "dash_inventory_counters": (
        ds_inventory, (), ("readings", "skus_at_expiry_risk", "at_risk_expiry_units", "avg_days_of_supply"),
    ),
    "dash_daily_stockout_region": (ds_inventory, ("reading_date", "region"), ("stockout_rate",)),
    "dash_expiry_division": (ds_inventory, ("division",), ("avg_expiry_risk",)),
    "dash_stockout_region": (ds_inventory, ("region",), ("stockout_rate",)),
}


def grain(name: str):
    view, dimensions, measures = GRAINS[name]

    def plan(t: Tables) -> DataFrame:
        v = view(t)
        return v.query(dimensions, measures or list(v.measures))

    return plan


def filtered(t: Tables) -> DataFrame:
    """The counters under the dashboard's date, region and division filters."""
    return ds_sales(t).query(
        measures=_COUNTERS,
        where=[
            last_days(t, "order_ts", 365),
            "region IN ('ASIA', 'EUROPE')",
            "division IN ('Pharma-OTC', 'Consumer-Health')",
        ],
    )


def filter_values(t: Tables) -> DataFrame:
    """What the filter widgets offer: every region and division that occurs."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("filter"), F.col(c).alias("value")) for c in ("region", "division")]
    )
    return (
        fact_sales(t, ["region", "division"])
        .select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("filter", "value")
    )


ROLLUP_MEASURES = ("order_count", "net_revenue_idr", "units_ordered", "fill_rate", "stockout_rate", "unique_outlets")


def latest_inventory(t: Tables) -> DataFrame:
    """Readings of the newest day, on which the readings of every series end."""
    return fact_inventory(t, last_days=1)


def _names(t: Tables) -> DataFrame:
    return dim_product(t).select("product_id", "product_name")


def risk_worklist(t: Tables) -> DataFrame:
    """Newest readings above the expiry flag, worst 50; names are looked up after the cut."""
    flagged = latest_inventory(t).filter(F.col("expiry_risk_score") > EXPIRY_FLAG_ABOVE)
    order = [F.col("expiry_risk_score").desc(), F.col("dc_id"), F.col("product_id")]
    named = flagged.orderBy(*order).limit(50).join(_names(t), "product_id", "left").orderBy(*order)
    return named.select(
        "product_name", "product_id", "brand", "division", "dc_id", "region", "expiry_risk_score", "days_to_expiry",
        "at_risk_expiry_units", "on_hand_units", "days_of_supply",
    )


def dc_map(t: Tables) -> DataFrame:
    """Demand and stockout rate per distribution centre, centres without either included."""
    sales = (
        fact_sales(t, ["dc_id", "net_idr", "units_ordered"])
        .groupBy("dc_id")
        .agg(F.sum("net_idr").alias("net_idr"), F.sum("units_ordered").alias("units_ordered"))
    )
    stock = (
        fact_inventory(t).groupBy("dc_id").agg(F.expr(plain_ratio("sum(stockout_flag)", "count(1)")).alias("rate"))
    )
    return (
        dim_distribution_center(t)
        .join(sales, "dc_id", "left")
        .join(stock, "dc_id", "left")
        .select(
            "dc_id", "dc_name", "city", "region", "lat", "lng",
            F.coalesce("net_idr", F.lit(0)).alias("net_idr"),
            F.coalesce("units_ordered", F.lit(0)).alias("units_ordered"),
            F.coalesce("rate", F.lit(0.0)).alias("stockout_rate"),
        )
    )


def forecast_chart(t: Tables) -> DataFrame:
    """National daily units: actuals, the joint and a 14-day forecast. The day that is not over yet is left out."""
    daily = (
        fact_sales(t, ["order_ts", "units_ordered"])
        .filter(F.col("order_ts") < t.midnight(0))
        .groupBy(F.to_date("order_ts").alias("ds"))
        .agg(F.sum("units_ordered").alias("demand"))
    )
    dense = forecast.dense_series(daily.withColumn("series", F.lit("national")), "series")
    return forecast.actual_and_forecast(daily, forecast.seasonal_naive(dense, "series"))


def _recent_sales(t: Tables, columns, days: int = 30) -> DataFrame:
    return fact_sales(t, ["order_ts", *columns]).filter(F.col("order_ts") >= t.midnight(days))


_FILL3 = ratio("sum(units_fulfilled)", "sum(units_ordered)", 3)


def revenue_fill_region(t: Tables) -> DataFrame:
    recent = _recent_sales(t, ["region", "net_idr", "units_fulfilled", "units_ordered"])
    return (
        recent.groupBy("region")
        .agg(F.sum("net_idr").alias("net_revenue_idr"), F.expr(_FILL3).alias("fill_rate"))
        .orderBy(F.col("net_revenue_idr").desc(), "region")
    )


def stockout_region(t: Tables) -> DataFrame:
    recent = fact_inventory(t, last_days=31)
    return (
        recent.groupBy("region")
        .agg(
            F.expr(ratio("sum(stockout_flag)", "count(1)", 3)).alias("stockout_rate"),
            F.sum("stockout_flag").alias("stockout_days"),
        )
        .orderBy(F.col("stockout_rate").desc(), "region")
    )


def at_risk_division(t: Tables) -> DataFrame:
    recent = _recent_sales(t, ["division", "status", "net_idr"])
    return (
        recent.groupBy("division")
        .agg(F.sum(F.expr(AT_RISK_NET)).alias("revenue_at_risk_idr"), F.sum("net_idr").alias("net_revenue_idr"))
        .orderBy(F.col("revenue_at_risk_idr").desc(), "division")
    )


def expiry_skus(t: Tables) -> DataFrame:
    flagged = latest_inventory(t).filter(F.col("expiry_risk_score") > EXPIRY_FLAG_ABOVE)
    return (
        flagged.join(_names(t), "product_id")
        .groupBy("dc_id", "product_id", "product_name", "brand", "division")
        .agg(
            F.max("expiry_risk_score").alias("expiry_risk_score"),
            F.min("days_to_expiry").alias("days_to_expiry"),
            F.sum("at_risk_expiry_units").alias("at_risk_units"),
        )
        .orderBy(F.col("expiry_risk_score").desc(), "dc_id", "product_id")
        .limit(20)
    )


def fill_otc_region(t: Tables, region: str = "ASIA") -> DataFrame:
    recent = _recent_sales(t, ["region", "division", "brand", "units_fulfilled", "units_ordered"])
    return (
        recent.filter((F.col("region") == region) & (F.col("division") == "Pharma-OTC"))
        .groupBy("brand")
        .agg(F.expr(_FILL3).alias("fill_rate"), F.sum("units_ordered").alias("units_ordered"))
        .orderBy(F.col("units_ordered").desc(), "brand")
    )


def demand_brand(t: Tables) -> DataFrame:
    recent = _recent_sales(t, ["region", "division", "brand", "units_ordered", "net_idr"])
    return (
        recent.filter(
            (F.col("division") == "Pharma-OTC")
            & F.col("region").isin(*SURGE_REGIONS)
            & F.col("brand").isin(*SURGE_BRANDS)
        )
        .groupBy("region", "brand")
        .agg(F.sum("units_ordered").alias("units_ordered"), F.sum("net_idr").alias("net_revenue_idr"))
        .orderBy(F.col("units_ordered").desc(), "region", "brand")
    )


def sales_rollup(t: Tables) -> DataFrame:
    """Sales measures by region and division, by region, and of the whole."""
    return sales_metrics(t).rollup(("region", "division"), ROLLUP_MEASURES)
