"""Gold tables: curated sales, daily roll-ups and the serving rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import AT_RISK_UNFILLED, IS_STOCKOUT, ratio
from shelfwise.operators import snapshots
from shelfwise.operators.governance import assert_no_pii
from shelfwise.operators.keyed import first_per_key
from shelfwise.operators.quality import SALES, silver_sales
from shelfwise.sources.star import SALE_KEYS, Tables, dim_product, raw_sales, raw_sales_by_order, sales_referenced

# Duplicates of a sale often share its order time; all other columns make the choice repeatable.
_DEDUP_ORDER = (
    "order_ts", "product_id", "dc_id", "outlet_id", "units_ordered", "unit_price_idr", "discount_idr", "net_idr",
    "status", "ship_ts", "units_fulfilled", "gross_idr", "account_id", "region", "province", "city", "division", "brand",
    "category", "channel", "promo_flag",
)

# What the fact view works out from columns that come before them in that order: there is no tie left for them to break.
_SETTLED = ("units_fulfilled", "account_id", "city")

# The serving tables and their primary keys.
SERVING_KEYS = {
    "gold_product_risk": ("dc_id", "product_id"),
    "gold_region_daily": ("region", "sales_date"),
    "gold_national_daily": ("sales_date",),
    "gold_sales_serving": ("sale_id",),
    "gold_demand_forecast": ("region", "forecast_date"),
}


# The curated columns that the serving tables are built from.
SERVING_INPUTS = (
    "sale_id", "order_ts", "sales_date", "region", "province", "city", "dc_id", "division", "brand", "category",
    "product_id", "outlet_id", "units_ordered", "units_fulfilled", "unit_price_idr", "gross_idr", "discount_idr",
    "net_idr", "revenue_at_risk_idr", "channel", "promo_flag", "status", "is_stockout",
)


# The columns that curated sales add, with what they are worked out from.
_DERIVED = {
    "sales_date": ("to_date(order_ts)", ("order_ts",)),
    "is_stockout": (IS_STOCKOUT, ("status",)),
    "revenue_at_risk_idr": (AT_RISK_UNFILLED, ("status", "units_ordered", "units_fulfilled", "unit_price_idr")),
}


def derived(sales: DataFrame, recent_since: Column | None = None) -> DataFrame:
    """Sales with their date, stockout flag and revenue at risk; `recent_since` adds the 30-day flag."""
    columns = {name: F.expr(text) for name, (text, _) in _DERIVED.items()}
    if recent_since is not None:
        columns["is_recent_30d"] = F.col("order_ts") >= recent_since
    return sales.withColumns(columns)


def curated_from(silver: DataFrame, recent_since: Column | None = None) -> DataFrame:
    """One row per sale, with the columns derived from it."""
    return derived(first_per_key(silver, ("sale_id",), _DEDUP_ORDER), recent_since)


def silver(t: Tables) -> DataFrame:
    return silver_sales(raw_sales(t))


def curated(t: Tables, with_recent: bool = False) -> DataFrame:
    return curated_from(silver(t), t.clock(days_back=30) if with_recent else None)


def curated_by_order(t: Tables, columns: Sequence[str] = SERVING_INPUTS) -> DataFrame:
    """Some columns of the curated sales. A sale is a line of an order, and after their join the lines lie by order: its rows
    are limited to one where they are, without an exchange of their own. The order in which the first is chosen goes up to the
    last column asked for, as rows that agree so far are the same here."""
    inputs = {c for name in columns for c in (_DERIVED[name][1] if name in _DERIVED else (name,))}
    last = max((_DEDUP_ORDER.index(c) for c in inputs - {"sale_id"}), default=0)
    order = [c for c in _DEDUP_ORDER[: last + 1] if c not in _SETTLED]
    read = inputs.union(order, sales_referenced(*SALES.rules.values()))
    rows = silver_sales(raw_sales_by_order(t, sorted(read)))
    no_key = " OR ".join(f"{c} IS NULL" for c in SALE_KEYS)
    known = first_per_key(rows.filter(f"NOT ({no_key})"), SALE_KEYS, order)
    unknown = rows.filter(no_key).orderBy(*order).limit(1)  # rows without sale_id are one sale, wherever they lie
    derived = {name: F.expr(text) for name, (text, _) in _DERIVED.items() if name in columns}
    return known.unionByName(unknown).withColumns(derived).select(*columns)


def _kpis() -> dict[str, Column]:
    return {
        "orders": F.count(F.lit(1)),
        "units_ordered": F.sum("units_ordered"),
        "units_fulfilled": F.sum("units_fulfilled"),
        "stockout_orders": F.count_if("is_stockout"),
        "backorder_count": F.count_if(F.col("status") == "backorder"),
        "net_idr": F.sum("net_idr"),
        "revenue_at_risk_idr": F.sum("revenue_at_risk_idr"),
    }


def _rolled(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = sales.groupBy(*keys).agg(*[c.alias(name) for name, c in _kpis().items()])
    return sums.withColumns(
        {
            "order_count": F.col("orders"),
            "demand_units": F.col("units_ordered"),
            "fill_rate": F.expr(ratio("units_fulfilled", "units_ordered")),
            "stockout_rate": F.expr(ratio("stockout_orders", "orders")),
        }
    )


def sales_daily(sales: DataFrame) -> DataFrame:
    """Date x region x division."""
    return _rolled(sales, ["sales_date", "region", "division"]).select(
        "sales_date", "region", "division", "orders", "units_ordered", "units_fulfilled", "fill_rate",
        "stockout_rate", "net_idr", "revenue_at_risk_idr",
    )


_DAILY = (
    "orders", "order_count", "units_ordered", "demand_units", "units_fulfilled", "backorder_count", "fill_rate",
    "stockout_rate", "net_idr", "revenue_at_risk_idr",
)


def region_daily(sales: DataFrame) -> DataFrame:
    return _rolled(sales, ["region", "sales_date"]).select("region", "sales_date", *_DAILY)


def national_daily(sales: DataFrame) -> DataFrame:
    return _rolled(sales, ["sales_date"]).select("sales_date", *_DAILY)


def sales_serving(t: Tables, sales: DataFrame) -> DataFrame:
    """Sales of the last 45 days with the product name and no personal data."""
    recent = sales.filter((F.col("order_ts") >= t.midnight(45)) & (F.col("sales_date") >= t.midnight(45).cast("date")))
    names = dim_product(t).select("product_id", "product_name")
    return recent.join(names, "product_id", "left").select(
        "sale_id", "order_ts", "sales_date", "region", "province", "city", "dc_id", "division", "brand", "category",
        "product_id", "product_name", "outlet_id", "units_ordered", "units_fulfilled", "unit_price_idr", "gross_idr",
        "discount_idr", "net_idr", "revenue_at_risk_idr", "channel", "promo_flag", "status",
    )


def build(t: Tables, folder: str) -> None:
    """Write the gold layer: curated sales by day, the two daily tables and the serving rows. All versions are written and
    their keys checked before the first is published, and no table may hold personal data: a build that fails or dies
    leaves the last good layer as it was."""
    sales = snapshots.stage(
        assert_no_pii(curated_by_order(t)), f"{folder}/curated", ("sale_id",), ("sales_date",)
    )
    rows = sales.read().select(*SERVING_INPUTS)
    tables = {
        "gold_region_daily": region_daily(rows),
        "gold_national_daily": national_daily(rows),
        "gold_sales_serving": sales_serving(t, rows),
    }
    staged = [snapshots.stage(assert_no_pii(df), f"{folder}/{name}", SERVING_KEYS[name]) for name, df in tables.items()]
    for version in (sales, *staged):
        version.publish()


def _stored(t: Tables, name: str) -> DataFrame | None:
    if not t.gold:
        return None
    stored = snapshots.current(t.spark, f"{t.gold}/{name}")
    if stored is None:
        raise FileNotFoundError(f"{t.gold}/{name} has no published version: run plans.gold.build first")
    return stored


def sales_of(t: Tables, columns: Sequence[str] = SERVING_INPUTS) -> DataFrame:
    """Curated sales: the stored ones if there is a gold layer, else worked out from the feed."""
    stored = _stored(t, "curated")
    return curated_by_order(t, columns) if stored is None else stored.select(*columns)


def region_daily_of(t: Tables) -> DataFrame:
    stored = _stored(t, "gold_region_daily")
    return region_daily(curated(t)) if stored is None else stored


def national_daily_of(t: Tables) -> DataFrame:
    stored = _stored(t, "gold_national_daily")
    return national_daily(curated(t)) if stored is None else stored


def serving_of(t: Tables) -> DataFrame:
    stored = _stored(t, "gold_sales_serving")
    return sales_serving(t, curated(t)) if stored is None else stored
