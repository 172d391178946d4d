"""The metric views over sales and inventory, and the two dashboard datasets."""

from __future__ import annotations

from shelfwise.functions.columns import AT_RISK_NET, EXPIRY_FLAG_ABOVE, IS_STOCKOUT, exact_mean, plain_ratio
from shelfwise.operators.metrics import MetricView
from shelfwise.sources.inventory import INVENTORY_COLUMNS, SERIES_KEYS, fact_inventory, readings
from shelfwise.sources.star import SALES_COLUMNS, SALES_KEYS, Tables, dim_product, fact_sales

_FILL_RATE = plain_ratio("sum(units_fulfilled)", "sum(units_ordered)")
_STOCKOUT_ORDERS = plain_ratio(f"count_if({IS_STOCKOUT})", "count(1)")
_STOCKOUT_READINGS = plain_ratio("sum(stockout_flag)", "count(1)")


def _flagged(key: str) -> str:
    return f"count(DISTINCT CASE WHEN expiry_risk_score > {EXPIRY_FLAG_ABOVE}D THEN {key} END)"


def sales_metrics(t: Tables) -> MetricView:
    return MetricView(
        source=lambda columns: fact_sales(t, columns or ["sale_id"]),
        columns=(*SALES_COLUMNS, *SALES_KEYS),
        dimensions={
            "sale_date": "to_date(order_ts)",
            "sale_month": "cast(date_trunc('MONTH', order_ts) AS date)",
            "region": "region",
            "province": "province",
            "city": "city",
            "division": "division",
            "brand": "brand",
            "category": "category",
            "channel": "channel",
            "order_status": "status",
            "is_promo": "promo_flag = 1",
        },
        measures={
            "order_count": "count(1)",
            "net_revenue_idr": "sum(net_idr)",
            "gross_revenue_idr": "sum(gross_idr)",
            "discount_idr": "sum(discount_idr)",
            "units_ordered": "sum(units_ordered)",
            "units_fulfilled": "sum(units_fulfilled)",
            "fill_rate": _FILL_RATE,
            "backorder_orders": "count_if(status = 'backorder')",
            "partial_orders": "count_if(status = 'partial')",
            "stockout_rate": _STOCKOUT_ORDERS,
            "revenue_at_risk_idr": f"sum({AT_RISK_NET})",
            "unique_outlets": "count(DISTINCT outlet_key)",
            "unique_skus": "count(DISTINCT product_key)",
        },
    )


# Decimals of the averaged inventory columns.
_MEANS = {"expiry_risk_score": 3, "days_of_supply": 2, "days_to_expiry": 0, "avg_daily_demand": 1}


def _mean_of_parts(column: str) -> str:
    """exact_mean out of the parts of its column."""
    scale = 10 ** _MEANS[column]
    return f"cast(sum({column}_sum) AS double) / nullif(cast(sum({column}_n) * {scale} AS double), 0D)"


def inventory_risk_metrics(t: Tables) -> MetricView:
    """Readings lie by SKU, so distinct SKUs and pairs are counted there; only sums leave it."""
    parts = {
        "n": "count(1)",
        "on_hand": "sum(on_hand_units)",
        "in_transit": "sum(in_transit_units)",
        "at_risk": "sum(at_risk_expiry_units)",
        "stockouts": "sum(stockout_flag)",
        "flagged": f"max(CASE WHEN expiry_risk_score > {EXPIRY_FLAG_ABOVE}D THEN 1 ELSE 0 END)",
        "pairs": "count(DISTINCT s_nationkey)",
    }
    for column, digits in _MEANS.items():
        parts[f"{column}_sum"] = f"sum(cast(round({column} * {10**digits}) AS bigint))"
        parts[f"{column}_n"] = f"count({column})"
    return MetricView(
        source=lambda columns: readings(t),
        columns=(*INVENTORY_COLUMNS, *SERIES_KEYS),
        dimensions={
            "reading_date": "reading_date",
            "region": "region",
            "division": "division",
            "brand": "brand",
            "distribution_center": "dc_id",
        },
        measures={
            "readings": "coalesce(sum(n), 0L)",
            "on_hand_units": "sum(on_hand)",
            "in_transit_units": "sum(in_transit)",
            "at_risk_expiry_units": "sum(at_risk)",
            "avg_expiry_risk_score": _mean_of_parts("expiry_risk_score"),
            "stockout_rate": plain_ratio("sum(stockouts)", "sum(n)"),
            "avg_days_of_supply": _mean_of_parts("days_of_supply"),
            "avg_days_to_expiry": _mean_of_parts("days_to_expiry"),
            "avg_daily_demand": _mean_of_parts("avg_daily_demand"),
            "skus_at_expiry_risk": "coalesce(sum(flagged), 0L)",
            "sku_dcs": "coalesce(sum(pairs), 0L)",
        },
        lies_by=("l_partkey",),
        parts=parts,
    )


def ds_sales(t: Tables) -> MetricView:
    return MetricView(
        source=lambda columns: fact_sales(t, columns or ["sale_id"]),
        columns=SALES_COLUMNS,
        dimensions={
            "sales_date": "to_date(order_ts)",
            "sales_hour": "hour(order_ts)",
            "region": "region",
            "province": "province",
            "city": "city",
            "division": "division",
            "brand": "brand",
            "category": "category",
            "channel": "channel",
            "status": "status",
            "promo_flag": "promo_flag",
        },
        measures={
            "total_orders": "count(1)",
            "units_ordered": "sum(units_ordered)",
            "net_revenue_bn_idr": "cast(sum(net_idr) AS double) / 1e9D",
            "revenue_at_risk_bn_idr": f"cast(sum({AT_RISK_NET}) AS double) / 1e9D",
            "fill_rate": _FILL_RATE,
            "stockout_order_rate": _STOCKOUT_ORDERS,
            "cancellation_rate": plain_ratio("count_if(status = 'cancelled')", "count(1)"),
        },
    )


def ds_inventory(t: Tables) -> MetricView:
    """Inventory with product names; the name is joined only when a query uses it."""

    def source(columns):
        df = fact_inventory(t)
        if "product_name" in columns:
            df = df.join(dim_product(t).select("product_id", "product_name"), "product_id", "left")
        return df

    return MetricView(
        source=source,
        columns=(*INVENTORY_COLUMNS, "product_name"),
        dimensions={
            "reading_date": "reading_date",
            "dc_id": "dc_id",
            "product_id": "product_id",
            "product_name": "product_name",
            "brand": "brand",
            "division": "division",
            "region": "region",
        },
        measures={
            "readings": "count(1)",
            "stockout_rate": _STOCKOUT_READINGS,
            "avg_days_of_supply": exact_mean("days_of_supply", 2),
            "avg_expiry_risk": exact_mean("expiry_risk_score", 3),
            "at_risk_expiry_units": "sum(at_risk_expiry_units)",
            "skus_at_expiry_risk": _flagged("concat(dc_id, '|', product_id)"),
        },
    )


def last_days(t: Tables, column: str, days: int):
    """A `where` entry: the timestamp lies on one of the `days` days before the newest order's day, or on that day."""
    return (column, lambda ts: ts >= t.midnight(days))
