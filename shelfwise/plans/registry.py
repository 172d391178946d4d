"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators import risk
from shelfwise.operators.quality import SALES, quarantined_sales
from shelfwise.operators.sampling import with_resent
from shelfwise.plans import catalog, command, dashboard, docs, gold, learned, personas, serving, sketches, streams
from shelfwise.sources.inventory import SERIES_KEYS, fact_inventory, readings
from shelfwise.sources.star import (
    SALES_COLUMNS, SURGE_BRANDS, Tables, dim_account, dim_distribution_center, dim_outlet, dim_product, fact_sales,
    raw_sales,
)

Plan = Callable[[Tables], DataFrame]


def _expiry_label(t: Tables) -> DataFrame:
    features = readings(t).withColumn("reorder_gap", F.col("on_hand_units") - F.col("reorder_point"))
    labelled = risk.with_forward_label(features, SERIES_KEYS)
    return labelled.select("dc_id", "product_id", "day_idx", *risk.FEATURES, "label")


def _what_if(t: Tables) -> DataFrame:
    latest = risk.expiry_features(dashboard.latest_inventory(t), dim_product(t))
    return risk.what_if(latest).select("dc_id", "product_id", *risk.WHAT_IF_LEVELS, "points", "risk", "severity")


def _tracked_skus(t: Tables) -> DataFrame:
    must = F.col("brand").isin(*SURGE_BRANDS) | (F.col("shelf_life_days") <= 270)
    tracked = risk.tracked_skus(dim_product(t), fact_sales(t, ["product_id", "units_ordered"]), must, 40)
    return tracked.select("product_id", "brand", "division", "shelf_life_days", "volume", "is_must")


QUERIES: dict[str, Plan] = {
    # sources
    "fact_sales": fact_sales,
    "fact_inventory": fact_inventory,
    "dim_product": dim_product,
    "dim_outlet": dim_outlet,
    "dim_account": dim_account,
    "dim_distribution_center": dim_distribution_center,
    "raw_sales_resent": lambda t: with_resent(raw_sales(t), SALES_COLUMNS),
    # quality and gold
    "dq_silver": gold.silver,
    "dq_quarantine": lambda t: quarantined_sales(raw_sales(t)),
    "dq_rule_metrics": lambda t: SALES.metrics(raw_sales(t)),
    "sales_curated": lambda t: gold.curated(t, with_recent=True),
    "sales_daily": lambda t: gold.sales_daily(gold.curated(t)),
    "region_daily": lambda t: gold.region_daily(gold.curated(t)),
    "national_daily": lambda t: gold.national_daily(gold.curated(t)),
    "sales_serving": serving.serving_rows,
    "serving_pk_check": serving.serving_pk_check,
    "stored_gold_kpis": serving.stored_gold_kpis,
    "stored_gold_feed": serving.stored_gold_feed,
    # operational reads
    "national_kpis": serving.national_kpis,
    "national_trend": serving.national_trend,
    "region_latest": serving.region_latest,
    "region_trend": serving.region_trend,
    "product_risk": serving.product_risk,
    "risk_worklist": serving.risk_worklist,
    "open_worklist": serving.open_worklist,
    "division_mix": serving.division_mix,
    "backorder_feed": serving.backorder_feed,
    "search_rows": serving.search_rows,
    "decision_validate": serving.decision_validate,
    "decision_log_recent": serving.decision_log_recent,
    "decision_log_saved": serving.decision_log_saved,
    "region_daily_upserted": serving.region_daily_upserted,
    # governance
    "persona_summary": personas.summary,
    "persona_summary_admin": partial(personas.summary, persona=personas.ADMIN),
    "persona_summary_unknown": partial(personas.summary, persona=personas.UNKNOWN),
    "persona_accounts": personas.accounts,
    "persona_accounts_admin": partial(personas.accounts, persona=personas.ADMIN),
    "persona_sales": personas.sales_by_region,
    "persona_sales_analyst": partial(personas.sales_by_region, persona=personas.ANALYST),
    "governed_accounts": personas.governed_accounts,
    "governed_sales": personas.governed_sales,
    "governed_accounts_sql": personas.governed_accounts_sql,
    "governed_sales_sql": personas.governed_sales_sql,
    "catalog_dimensions": catalog.saved_dimensions,
    "priority_status": catalog.priority_status,
    "expiry_search": learned.expiry_search,
    "demand_naive_spread": learned.naive_spread,
    "metric_sales_rollup": dashboard.sales_rollup,
    "metric_unique_by_month_region": sketches.unique_by_month_region,
    "whoami": personas.whoami,
    "tag_report": personas.tag_report,
    "lineage_edges": personas.lineage_edges,
    # metric views and dashboard
    **{name: dashboard.grain(name) for name in dashboard.GRAINS},
    "dash_filtered": dashboard.filtered,
    "dash_filter_values": dashboard.filter_values,
    "dash_risk_worklist": dashboard.risk_worklist,
    "dash_dc_map": dashboard.dc_map,
    "dash_forecast": dashboard.forecast_chart,
    # worked questions
    "nl_revenue_fill_region": dashboard.revenue_fill_region,
    "nl_stockout_region": dashboard.stockout_region,
    "nl_at_risk_division": dashboard.at_risk_division,
    "nl_expiry_skus": dashboard.expiry_skus,
    "nl_fill_otc_region": dashboard.fill_otc_region,
    "nl_demand_brand": dashboard.demand_brand,
    # command centre
    "cc_national_snapshot": command.national_snapshot,
    "cc_worst_region": command.worst_region,
    "cc_region_ranking": command.region_ranking,
    "cc_top_risk": command.top_risk,
    "cc_risk_by_region": command.risk_by_region,
    "cc_alerts": command.alerts,
    "cc_map_points": command.map_points,
    # risk and forecast
    "stockout_last14": lambda t: risk.stockout_share(readings(t, last_days=risk.RECENT_READINGS), SERIES_KEYS),
    "expiry_label": _expiry_label,
    "whatif_risk": _what_if,
    "tracked_skus": _tracked_skus,
    "demand_features": serving.demand_features,
    "forecast_rounded": serving.forecast_rounded,
    "forecast_by_region": serving.forecast_by_region,
    "forecast_naive_eval": serving.forecast_naive_eval,
    "expiry_model_scores": learned.expiry_model_scores,
    "demand_forecast": learned.demand_forecast,
    "expiry_model_frame": learned.expiry_model_frame,
    "demand_forecast_frame": learned.demand_forecast_frame,
    "expiry_model_report": learned.expiry_model_report,
    # documents
    "doc_elements": docs.doc_elements,
    "doc_elements_by_path": docs.doc_elements_by_path,
    "event_properties": docs.event_properties,
    "doc_text": docs.doc_text,
    "doc_page": docs.doc_page,
    "doc_fields": docs.doc_fields,
    "doc_type_counts": docs.doc_type_counts,
    "doc_field_match": docs.doc_field_match,
    # streaming
    "stream_dq_silver": streams.silver,
    "stream_quarantine": streams.quarantine,
    "stream_rule_totals": streams.rule_totals,
    "incremental_cycle": streams.incremental_cycle,
    "incremental_national": streams.incremental_national,
    "incremental_days": streams.incremental_days,
    "stream_unique_sales": streams.unique_sales,
    "event_windows": streams.event_windows,
}
