"""DuckDB SQL for the registered queries; same column names as the Spark results."""

from __future__ import annotations

from shelfwise.oracle.ctes import SALES, plain_ratio, ratio, scaled, with_ctes

RULES = ("valid_product", "valid_region", "valid_units", "valid_status", "valid_price", "valid_order_ts")
EXTRA: dict[str, str] = {}
FINAL: dict[str, str] = {}


def _mean(column: str, digits: int) -> str:
    scale = 10**digits
    return (
        f"CAST(CAST(sum(CAST(round({column} * {scale}) AS BIGINT)) AS BIGINT) AS DOUBLE) "
        f"/ nullif(CAST(count({column}) * {scale} AS DOUBLE), 0)"
    )


def _i(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def _mean4(column: str) -> str:
    total = f"sum(CAST(round({column} * 10000) AS BIGINT))"
    return f"CAST(CAST({total} * 2 + count({column}) AS BIGINT) // (2 * count({column})) AS DOUBLE) / CAST(10000 AS DOUBLE)"


# ---- sources, quality, gold ------------------------------------------------------------------------------------
FINAL["fact_sales"] = "SELECT * FROM fact_sales"
FINAL["dim_product"] = "SELECT * FROM dim_product"
FINAL["dim_account"] = "SELECT * FROM dim_account"
FINAL["dim_distribution_center"] = "SELECT *, city AS province FROM dim_dc"
FINAL["dim_outlet"] = """
SELECT 'OUT-' || c_custkey AS outlet_id, 'Outlet ' || c_custkey AS outlet_name,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'distributor'
            WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'modern_trade' ELSE 'direct' END AS outlet_type,
       n_name AS city, n_name AS province, r_name AS region, 'DC-' || c_nationkey AS dc_id
FROM customer LEFT JOIN geo ON c_nationkey = n_nationkey"""
FINAL["raw_sales_resent"] = f"""
SELECT * FROM raw_sales
UNION ALL
SELECT * FROM raw_sales WHERE substring(md5(concat_ws('|', {SALES})), 1, 8) < '028f5c29'"""
FINAL["dash_filter_values"] = """
SELECT DISTINCT 'region' AS "filter", region AS "value" FROM fact_sales WHERE region IS NOT NULL
UNION ALL SELECT DISTINCT 'division', division FROM fact_sales WHERE division IS NOT NULL"""
FINAL["fact_inventory"] = "SELECT * FROM inventory"
FINAL["dq_silver"] = FINAL["stream_dq_silver"] = "SELECT * FROM silver"
FINAL["dq_quarantine"] = FINAL["stream_quarantine"] = "SELECT * FROM quarantine"
FINAL["dq_rule_metrics"] = FINAL["stream_rule_totals"] = "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule, count(*) AS checked, count(*) FILTER (NOT {r}) AS failed, "
    f"{ratio(f'100 * count(*) FILTER (NOT {r})', 'count(*)', 2)} AS failed_pct FROM checked"
    for r in RULES
)
FINAL["sales_curated"] = (
    "SELECT *, order_ts >= (SELECT now_ts FROM clock) - INTERVAL 30 DAY AS is_recent_30d FROM curated"
)
FINAL["sales_daily"] = "SELECT * FROM sales_daily"
FINAL["region_daily"] = FINAL["incremental_cycle"] = FINAL["region_daily_upserted"] = "SELECT * FROM region_daily"
FINAL["national_daily"] = FINAL["incremental_national"] = "SELECT * FROM national_daily"
FINAL["sales_serving"] = "SELECT * FROM sales_serving"
FINAL["incremental_days"] = """
SELECT sale_id, order_ts, sales_date, region, province, city, dc_id, division, brand, category, product_id, outlet_id,
       units_ordered, units_fulfilled, unit_price_idr, gross_idr, discount_idr, net_idr, revenue_at_risk_idr, channel,
       promo_flag, status, is_stockout
FROM curated"""

# ---- risk ------------------------------------------------------------------------------------------------------
EXTRA["ranked_stock"] = """
SELECT *, row_number() OVER (PARTITION BY dc_id, product_id ORDER BY reading_date DESC) AS rn FROM inventory"""
EXTRA["stockout14"] = f"""
SELECT dc_id, product_id, {ratio('sum(stockout_flag)', 'count(*)')} AS stockout_risk_score
FROM ranked_stock WHERE rn <= 14 GROUP BY dc_id, product_id"""
EXTRA["scores"] = """
SELECT l.dc_id, l.product_id, l.brand, l.division, l.region, expiry_risk_score, stockout_risk_score, days_to_expiry,
       on_hand_units, days_of_supply, at_risk_expiry_units, avg_daily_demand,
       CASE WHEN stockout_risk_score >= 0.5 THEN 'expedite' WHEN expiry_risk_score >= 0.7 THEN 'redistribute'
            WHEN expiry_risk_score >= 0.5 AND days_to_expiry < 60 THEN 'promote' ELSE 'hold' END AS recommended_action
FROM ranked_stock l JOIN stockout14 s ON s.dc_id = l.dc_id AND s.product_id = l.product_id
WHERE l.rn = 1"""
EXTRA["product_risk"] = """
SELECT s.dc_id, s.product_id, product_name, s.brand, s.division, s.region, dc_name, expiry_risk_score,
       stockout_risk_score, days_to_expiry, on_hand_units, days_of_supply, at_risk_expiry_units, avg_daily_demand,
       recommended_action
FROM scores s LEFT JOIN dim_product p ON p.product_id = s.product_id LEFT JOIN dim_dc d ON d.dc_id = s.dc_id"""
_EXPIRY_PCT = "CAST((CAST(round(expiry_risk_score * 1000) AS BIGINT) + 5) // 10 AS INTEGER)"
_STOCKOUT_PCT = "CAST((CAST(round(stockout_risk_score * 10000) AS BIGINT) + 50) // 100 AS INTEGER)"
EXTRA["at_risk"] = """
SELECT *, greatest(expiry_risk_score, stockout_risk_score) AS worst_score FROM product_risk
WHERE expiry_risk_score >= 0.5 OR stockout_risk_score >= 0.5"""
_VIEW = f"""
SELECT product_id, dc_id, product_name, brand, division, region, dc_name, {_EXPIRY_PCT} AS expiry_risk_pct,
       {_STOCKOUT_PCT} AS stockout_risk_pct, days_to_expiry, on_hand_units,
       CAST((CAST(round(days_of_supply * 100) AS BIGINT) + 5) // 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS days_of_supply,
       at_risk_expiry_units, recommended_action
FROM (SELECT * FROM at_risk ORDER BY worst_score DESC, dc_id, product_id LIMIT %d)"""
EXTRA["worklist"] = _VIEW % 60
EXTRA["decision_batch"] = f"""
SELECT md5(dc_id || '|' || product_id) AS id, product_id, dc_id, product_name, brand, region,
       {_EXPIRY_PCT} AS expiry_risk_pct, {_STOCKOUT_PCT} AS stockout_risk_pct, recommended_action AS action,
       'auto: ' || recommended_action AS note, (SELECT now_ts FROM clock) AS created_at
FROM at_risk WHERE recommended_action <> 'hold'"""
EXTRA["judged"] = """
SELECT *, CASE WHEN length(product_id) NOT BETWEEN 1 AND 64 THEN 'product_id'
               WHEN length(dc_id) NOT BETWEEN 1 AND 64 THEN 'dc_id' WHEN length(product_name) > 160 THEN 'product_name'
               WHEN length(brand) > 64 THEN 'brand' WHEN length(region) > 64 THEN 'region'
               WHEN expiry_risk_pct NOT BETWEEN 0 AND 100 THEN 'expiry_risk_pct'
               WHEN stockout_risk_pct NOT BETWEEN 0 AND 100 THEN 'stockout_risk_pct'
               WHEN action NOT IN ('expedite', 'redistribute', 'promote', 'hold', 'dismiss') THEN 'action'
               WHEN length(note) > 500 THEN 'note' ELSE 'accepted' END AS verdict
FROM decision_batch"""
FINAL["stockout_last14"] = "SELECT * FROM stockout14"
FINAL["product_risk"] = "SELECT * FROM product_risk"
FINAL["risk_worklist"] = "SELECT * FROM worklist"
FINAL["open_worklist"] = """
SELECT w.* FROM worklist w
WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.verdict = 'accepted' AND j.action <> 'dismiss'
                    AND j.dc_id = w.dc_id AND j.product_id = w.product_id)"""
FINAL["decision_validate"] = "SELECT * EXCLUDE (note, created_at) FROM judged"
FINAL["decision_log_saved"] = """
SELECT * EXCLUDE (verdict, id, created_at), 'ops@example.com' AS created_by FROM judged WHERE verdict = 'accepted'"""
FINAL["expiry_model_frame"] = """
SELECT dc_id, product_id, product_name, brand, division, region, dc_name, stockout_risk_score, days_to_expiry, on_hand_units,
       days_of_supply, at_risk_expiry_units, avg_daily_demand, true AS score_in_bounds, true AS action_agrees
FROM product_risk"""
FINAL["decision_log_recent"] = """
SELECT * EXCLUDE (verdict) FROM judged WHERE verdict = 'accepted' ORDER BY created_at DESC, id LIMIT 100"""

EXTRA["expiry_features"] = """
SELECT i.*, on_hand_units - reorder_point AS reorder_gap, p.shelf_life_days
FROM inventory i JOIN dim_product p ON p.product_id = i.product_id"""
_FEATURES = (
    "days_of_supply, days_to_expiry, avg_daily_demand, on_hand_units, reorder_gap, shelf_life_days, in_transit_units, "
    "reserved_units"
)
FINAL["expiry_label"] = f"""
SELECT dc_id, product_id, day_idx, {_FEATURES}, label
FROM (SELECT *, max(CASE WHEN expiry_risk_score >= 0.7 THEN 1 ELSE 0 END) OVER
               (PARTITION BY dc_id, product_id ORDER BY day_idx RANGE BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS label,
             max(day_idx) OVER (PARTITION BY dc_id, product_id) AS last_idx FROM expiry_features)
WHERE day_idx <= last_idx - 7"""
EXTRA["whatif"] = """
SELECT dc_id, product_id, days_of_supply, days_to_expiry, avg_daily_demand, on_hand_units, shelf_life_days,
       CASE WHEN days_of_supply >= 45 THEN 2 WHEN days_of_supply >= 30 THEN 1 ELSE 0 END
       + CASE WHEN days_to_expiry <= 20 THEN 2 WHEN days_to_expiry <= 45 THEN 1 ELSE 0 END
       + CASE WHEN avg_daily_demand <= 20 THEN 2 WHEN avg_daily_demand <= 40 THEN 1 ELSE 0 END
       + CASE WHEN on_hand_units >= 3000 THEN 2 WHEN on_hand_units >= 2000 THEN 1 ELSE 0 END
       + CASE WHEN shelf_life_days <= 120 THEN 2 WHEN shelf_life_days <= 270 THEN 1 ELSE 0 END AS points
FROM expiry_features WHERE reading_date = (SELECT today FROM clock)"""
EXTRA["whatif_risk"] = """
SELECT *, round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
            pow(CAST(points AS DOUBLE) / CAST(12 AS DOUBLE), CAST(0.85 AS DOUBLE)))), 4) AS risk FROM whatif"""
FINAL["whatif_risk"] = """
SELECT *, CASE WHEN risk >= 0.85 THEN 'Critical' WHEN risk >= 0.6 THEN 'High' WHEN risk >= 0.3 THEN 'Moderate'
               ELSE 'Low' END AS severity FROM whatif_risk"""
FINAL["tracked_skus"] = """
SELECT p.product_id, brand, division, shelf_life_days, coalesce(v.volume, 0) AS volume,
       brand IN ('Brand#1', 'Brand#4', 'Brand#8', 'Brand#16') OR shelf_life_days <= 270 AS is_must
FROM dim_product p
LEFT JOIN (SELECT product_id, CAST(sum(units_ordered) AS BIGINT) AS volume FROM fact_sales GROUP BY product_id) v
  ON v.product_id = p.product_id
ORDER BY is_must DESC, volume DESC, p.product_id LIMIT 40"""

# ---- operational reads -----------------------------------------------------------------------------------------
EXTRA["national_window"] = """
SELECT * FROM national_daily WHERE sales_date >= (SELECT max(sales_date) FROM national_daily) - 30"""
FINAL["national_kpis"] = FINAL["stored_gold_kpis"] = f"""
SELECT {scaled('sum(net_idr)', 10**9, 2)} AS revenue_bn_idr,
       {scaled('sum(revenue_at_risk_idr)', 10**9, 2)} AS revenue_at_risk_bn_idr,
       {_i('sum(demand_units)')} AS demand_units, {_i('sum(order_count)')} AS order_count,
       {_i('sum(backorder_count)')} AS backorder_count, {_mean4('fill_rate')} AS fill_rate,
       {_mean4('stockout_rate')} AS stockout_rate
FROM national_window"""
FINAL["national_trend"] = f"""
SELECT strftime(sales_date, '%Y-%m-%d') AS sales_date, {scaled('net_idr', 10**9, 3)} AS revenue_bn_idr,
       {scaled('revenue_at_risk_idr', 10**6, 1)} AS revenue_at_risk_m_idr, demand_units, fill_rate, stockout_rate,
       backorder_count
FROM national_window"""
EXTRA["snapshot"] = f"""
SELECT *, {scaled('revenue_at_risk_idr', 10**6, 1)} AS revenue_at_risk_m_idr FROM region_daily
QUALIFY row_number() OVER (PARTITION BY region ORDER BY sales_date DESC) = 1"""
FINAL["region_latest"] = """
SELECT region, strftime(sales_date, '%Y-%m-%d') AS sales_date, demand_units, fill_rate, stockout_rate,
       revenue_at_risk_m_idr, backorder_count FROM snapshot"""
FINAL["region_trend"] = """
SELECT region, strftime(sales_date, '%Y-%m-%d') AS sales_date, demand_units FROM region_daily
WHERE sales_date >= (SELECT max(sales_date) FROM region_daily) - 30"""
FINAL["division_mix"] = f"""
SELECT division, count(*) AS orders, {scaled('sum(net_idr)', 10**9, 3)} AS net_bn_idr
FROM sales_serving GROUP BY division"""
_FEED = f"""
SELECT sale_id, strftime(order_ts, '%Y-%m-%d %H:%M') AS order_ts, region, city, division, brand, product_name,
       units_ordered, units_fulfilled, {scaled('net_idr', 10**6, 2)} AS net_m_idr, status
FROM (SELECT * FROM sales_serving WHERE status IN ('backorder', 'partial') AND %s ORDER BY order_ts DESC, sale_id LIMIT %d)"""
FINAL["backorder_feed"] = FINAL["stored_gold_feed"] = _FEED.replace("%Y-%m-%d %H:%M", "%%Y-%%m-%%d %%H:%%M") % ("true", 40)
FINAL["search_rows"] = _FEED.replace("%Y-%m-%d %H:%M", "%%Y-%%m-%%d %%H:%%M") % (
    "contains(lower(concat_ws(' ', product_name, brand, region)), 'asia')", 20
)

# ---- forecast --------------------------------------------------------------------------------------------------
EXTRA["region_units"] = """
SELECT region, sales_date AS ds, CAST(sum(units_ordered) AS BIGINT) AS demand FROM curated GROUP BY ALL"""
EXTRA["region_series"] = """
SELECT c.region, c.ds, coalesce(u.demand, 0) AS demand
FROM (SELECT region, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds
      FROM region_units GROUP BY region) c
LEFT JOIN region_units u ON u.region = c.region AND u.ds = c.ds"""
EXTRA["features"] = """
SELECT region, ds, demand, CAST(isodow(ds) - 1 AS INTEGER) AS dow, CAST(day(ds) AS INTEGER) AS day,
       CAST(month(ds) AS INTEGER) AS month, CAST(week(ds) AS INTEGER) AS woy,
       CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend, lag_1, lag_7, roll7_mean, roll7_std
FROM (SELECT *, lag(demand, 1) OVER o AS lag_1, lag(demand, 7) OVER o AS lag_7,
             avg(CAST(demand AS DOUBLE)) OVER w AS roll7_mean, stddev_samp(CAST(demand AS DOUBLE)) OVER w AS roll7_std,
             count(demand) OVER w AS prior
      FROM region_series
      WINDOW o AS (PARTITION BY region ORDER BY ds),
             w AS (PARTITION BY region ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE prior = 7"""
FINAL["demand_features"] = """
SELECT * REPLACE (round(roll7_mean, 6) AS roll7_mean, round(roll7_std, 6) AS roll7_std) FROM features"""
FINAL["forecast_naive_eval"] = """
SELECT count(*) AS val_rows, round(sqrt(avg(CAST(demand - lag_7 AS DOUBLE) * CAST(demand - lag_7 AS DOUBLE))), 6)
         AS naive_lag7_rmse, round(avg(abs(CAST(demand - lag_7 AS DOUBLE))), 6) AS naive_lag7_mae
FROM features WHERE ds > (SELECT max(ds) FROM features) - 14"""

FINAL["demand_naive_spread"] = """
SELECT region, round(stddev_samp(CAST(demand - lag_7 AS DOUBLE)), 6) AS std,
       (SELECT round(coalesce(stddev_samp(CAST(demand - lag_7 AS DOUBLE)), 1), 6) FROM features
        WHERE ds > (SELECT max(ds) FROM features) - 14) AS overall
FROM features WHERE ds > (SELECT max(ds) FROM features) - 14 GROUP BY region"""


def _seasonal(series: str, key: str) -> str:
    return f"""
SELECT {key}, ds + step AS forecast_date, round(level, 1) AS forecast_units,
       round(greatest(0, level - band), 1) AS lower, round(level + band, 1) AS upper
FROM (SELECT {key}, ds, last_ds, unnest([7, 14]) AS step, greatest(CAST(0 AS DOUBLE), CAST(demand AS DOUBLE)) AS level,
             coalesce(std, 1) * CAST(1.28 AS DOUBLE) AS band
      FROM (SELECT *, stddev_samp(residual) OVER (PARTITION BY {key}) AS std,
                   max(ds) OVER (PARTITION BY {key}) AS last_ds
            FROM (SELECT *, CAST(demand - lag(demand, 7) OVER (PARTITION BY {key} ORDER BY ds) AS DOUBLE) AS residual,
                         row_number() OVER (PARTITION BY {key} ORDER BY ds DESC) AS rn FROM {series}))
      WHERE rn <= 7)
WHERE ds + step <= last_ds + 14"""


EXTRA["region_forecast"] = _seasonal("region_series", "region")
FINAL["forecast_rounded"] = """
SELECT region, strftime(forecast_date, '%Y-%m-%d') AS forecast_date, CAST(round(forecast_units) AS BIGINT) AS
       forecast_units, CAST(round(lower) AS BIGINT) AS lower, CAST(round(upper) AS BIGINT) AS upper
FROM region_forecast"""
FINAL["forecast_by_region"] = """
SELECT region, CAST(round(sum(forecast_units)) AS BIGINT) AS forecast_units,
       CAST(round(max(forecast_units)) AS BIGINT) AS peak_units FROM region_forecast GROUP BY region"""
FINAL["demand_forecast_frame"] = """
SELECT region, CAST(last_ds + step AS DATE) AS forecast_date, true AS band_in_order
FROM (SELECT region, max(ds) AS last_ds FROM region_series GROUP BY region), (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS step)"""
EXTRA["national_units"] = """
SELECT CAST(order_ts AS DATE) AS ds, CAST(sum(units_ordered) AS BIGINT) AS demand FROM fact_sales
WHERE CAST(order_ts AS DATE) < (SELECT today FROM clock) GROUP BY ALL"""
EXTRA["national_series"] = """
SELECT 'national' AS series, c.ds, coalesce(u.demand, 0) AS demand
FROM (SELECT CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS DATE) AS ds FROM national_units) c
LEFT JOIN national_units u ON u.ds = c.ds"""
EXTRA["national_forecast"] = _seasonal("national_series", "series")
FINAL["dash_forecast"] = """
SELECT ds AS sales_date, CAST(NULL AS DOUBLE) AS units_forecast, CAST(NULL AS DOUBLE) AS units_upper,
       CAST(NULL AS DOUBLE) AS units_lower, CAST(demand AS DOUBLE) AS units FROM national_units
UNION ALL
SELECT ds, CAST(demand AS DOUBLE), CAST(demand AS DOUBLE), CAST(demand AS DOUBLE), CAST(demand AS DOUBLE)
FROM national_units WHERE ds = (SELECT max(ds) FROM national_units)
UNION ALL
SELECT forecast_date, forecast_units, upper, lower, CAST(NULL AS DOUBLE) FROM national_forecast"""


def _key_report(table: str, relation: str, keys: str) -> str:
    any_null = " OR ".join(f"{k} IS NULL" for k in keys.split(","))
    return f"""
SELECT '{table}' AS table_name, '{keys}' AS primary_key, {_i('sum(n)')} AS row_count, count(*) AS key_count,
       {_i(f'sum(CASE WHEN {any_null} THEN n ELSE 0 END)')} AS null_keys,
       sum(n) = count(*) AND sum(CASE WHEN {any_null} THEN n ELSE 0 END) = 0 AS is_valid
FROM (SELECT {keys}, count(*) AS n FROM {relation} GROUP BY {keys})"""


FINAL["serving_pk_check"] = "\nUNION ALL\n".join(
    [
        _key_report("gold_product_risk", "scores", "dc_id,product_id"),
        _key_report("gold_region_daily", "region_daily", "region,sales_date"),
        _key_report("gold_national_daily", "national_daily", "sales_date"),
        _key_report("gold_sales_serving", "sales_serving", "sale_id"),
        _key_report("gold_demand_forecast", "region_forecast", "region,forecast_date"),
    ]
)

# ---- governance ------------------------------------------------------------------------------------------------


def _me(persona: str) -> str:
    return f"""
(SELECT coalesce(max(is_admin), false) AS is_admin, coalesce(max(allowed_region), 'NONE') AS allowed_region
 FROM allowlist WHERE email = '{persona}') me"""


_SEES = "(me.is_admin OR me.allowed_region = 'ALL' OR t.region = me.allowed_region)"


def _summary(persona: str) -> str:
    return f"""
SELECT me.is_admin AS pii_visible, me.allowed_region AS allowed_region, count(t.seen) AS visible_sales,
       count(DISTINCT t.region) AS visible_regions
FROM {_me(persona)} LEFT JOIN (SELECT region, 1 AS seen FROM fact_sales) t ON {_SEES}
GROUP BY me.is_admin, me.allowed_region"""


_MASKED = """
       CASE WHEN me.is_admin THEN contact_name ELSE '•••' || right(contact_name, 2) END AS contact_name,
       CASE WHEN me.is_admin THEN nik ELSE 'REDACTED-PII' END AS nik,
       CASE WHEN me.is_admin THEN email ELSE '•••' || right(email, 2) END AS email,
       CASE WHEN me.is_admin THEN phone ELSE '•••' || right(phone, 2) END AS phone"""


def _accounts(persona: str) -> str:
    return f"""
SELECT account_id, {_MASKED}, region, outlet_id, account_type FROM dim_account t CROSS JOIN {_me(persona)}
WHERE {_SEES} ORDER BY account_id LIMIT 100"""


def _sales(persona: str) -> str:
    return f"""
SELECT region, count(*) AS orders, {scaled('sum(net_idr)', 10**9, 2)} AS net_bn_idr
FROM fact_sales t CROSS JOIN {_me(persona)} WHERE {_SEES} GROUP BY region"""


FINAL["persona_summary"] = _summary("asia.rm@example.com")
FINAL["persona_summary_admin"] = _summary("admin@example.com")
FINAL["persona_summary_unknown"] = _summary("nobody@example.com")
FINAL["persona_accounts"] = _accounts("asia.rm@example.com")
FINAL["persona_accounts_admin"] = _accounts("admin@example.com")
FINAL["persona_sales"] = _sales("asia.rm@example.com")
FINAL["persona_sales_analyst"] = _sales("analyst@example.com")
FINAL["governed_accounts"] = f"""
SELECT account_id, outlet_id, {_MASKED}, region, account_type
FROM dim_account t CROSS JOIN {_me('analyst@example.com')}"""
FINAL["governed_sales"] = """
SELECT sale_id, product_id, region, division, units_ordered, net_idr, status FROM fact_sales t
WHERE EXISTS (SELECT 1 FROM allowlist a WHERE a.email = 'asia.rm@example.com'
              AND (a.is_admin OR a.allowed_region = 'ALL' OR a.allowed_region = t.region))"""
FINAL["whoami"] = f"""
SELECT 'asia.rm@example.com' AS identity, me.is_admin AS is_admin, me.allowed_region AS allowed_region,
       (SELECT count(*) FROM dim_account t WHERE {_SEES}) AS visible_accounts
FROM {_me('asia.rm@example.com')}"""
FINAL["tag_report"] = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{cls}' AS data_classification, 'ap-southeast-3' AS data_residency, "
    f"{pii} AS pii_columns, count(*) AS row_count FROM {relation}"
    for table, cls, pii, relation in (
        ("dim_account", "regulated-health-pii", 4, "dim_account"),
        ("fact_sales", "commercial-confidential", 0, "fact_sales"),
        ("dim_product", "commercial-confidential", 0, "dim_product"),
        ("dim_outlet", "commercial-confidential", 0, "customer"),
        ("dim_distribution_center", "public-reference", 0, "dim_dc"),
        ("fact_inventory", "commercial-confidential", 0, "inventory"),
    )
)
FINAL["lineage_edges"] = """
SELECT 'sales_raw' AS source, 'sales_silver' AS target, count(*) AS row_count FROM silver
UNION ALL SELECT 'sales_raw', 'sales_quarantine', count(*) FROM quarantine
UNION ALL SELECT 'sales_silver', 'sales_curated', count(*) FROM curated
UNION ALL SELECT 'sales_curated', 'gold_region_daily', count(*) FROM region_daily
UNION ALL SELECT 'sales_curated', 'gold_national_daily', count(*) FROM national_daily"""

# ---- metric views ----------------------------------------------------------------------------------------------
_RISK_B = _i("sum(CASE WHEN status IN ('backorder', 'partial', 'cancelled') THEN net_idr ELSE 0 END)")
_FILL = plain_ratio("sum(units_fulfilled)", "sum(units_ordered)")
_SHORT = plain_ratio("count(*) FILTER (status IN ('backorder', 'partial'))", "count(*)")
_SALES_MEASURES = f"""
count(*) AS order_count, {_i('sum(net_idr)')} AS net_revenue_idr, {_i('sum(gross_idr)')} AS gross_revenue_idr,
{_i('sum(discount_idr)')} AS discount_idr, {_i('sum(units_ordered)')} AS units_ordered,
{_i('sum(units_fulfilled)')} AS units_fulfilled, {_FILL} AS fill_rate,
count(*) FILTER (status = 'backorder') AS backorder_orders, count(*) FILTER (status = 'partial') AS partial_orders,
{_SHORT} AS stockout_rate, {_RISK_B} AS revenue_at_risk_idr, count(DISTINCT outlet_id) AS unique_outlets,
count(DISTINCT product_id) AS unique_skus"""
_STOCK_MEASURES = f"""
count(*) AS readings, {_i('sum(on_hand_units)')} AS on_hand_units, {_i('sum(in_transit_units)')} AS in_transit_units,
{_i('sum(at_risk_expiry_units)')} AS at_risk_expiry_units, {_mean('expiry_risk_score', 3)} AS avg_expiry_risk_score,
{plain_ratio('sum(stockout_flag)', 'count(*)')} AS stockout_rate, {_mean('days_of_supply', 2)} AS avg_days_of_supply,
{_mean('days_to_expiry', 0)} AS avg_days_to_expiry, {_mean('avg_daily_demand', 1)} AS avg_daily_demand,
count(DISTINCT CASE WHEN expiry_risk_score > 0.7 THEN product_id END) AS skus_at_expiry_risk,
count(DISTINCT dc_id || '|' || product_id) AS sku_dcs"""
FINAL["metric_sales_by_region"] = f"SELECT region, {_SALES_MEASURES} FROM fact_sales GROUP BY region"
FINAL["metric_sales_by_month_division"] = f"""
SELECT CAST(date_trunc('month', order_ts) AS DATE) AS sale_month, division, {_SALES_MEASURES} FROM fact_sales
GROUP BY ALL"""
FINAL["metric_sales_by_status"] = f"""
SELECT status AS order_status, promo_flag = 1 AS is_promo, {_SALES_MEASURES} FROM fact_sales GROUP BY ALL"""
FINAL["metric_sales_by_date"] = f"""
SELECT CAST(order_ts AS DATE) AS sale_date, count(*) AS order_count, {_i('sum(net_idr)')} AS net_revenue_idr, {_FILL} AS fill_rate
FROM fact_sales GROUP BY ALL"""
FINAL["metric_sales_by_place"] = f"""
SELECT province, city, channel, count(*) AS order_count, {_i('sum(units_ordered)')} AS units_ordered,
       {_i('sum(gross_idr)')} AS gross_revenue_idr FROM fact_sales GROUP BY ALL"""
FINAL["metric_sales_by_brand"] = f"""
SELECT brand, category, count(*) AS order_count, {_i('sum(discount_idr)')} AS discount_idr,
       count(DISTINCT product_id) AS unique_skus FROM fact_sales GROUP BY ALL"""
FINAL["metric_inventory_by_brand"] = f"""
SELECT brand, division, count(*) AS readings, {_i('sum(on_hand_units)')} AS on_hand_units,
       {plain_ratio('sum(stockout_flag)', 'count(*)')} AS stockout_rate FROM inventory GROUP BY ALL"""
FINAL["metric_inventory_by_dc"] = f"SELECT dc_id AS distribution_center, {_STOCK_MEASURES} FROM inventory GROUP BY dc_id"
FINAL["metric_inventory_by_region_day"] = f"""
SELECT region, reading_date, {_STOCK_MEASURES} FROM inventory GROUP BY region, reading_date"""

_NET_BN = "CAST(sum(net_idr) AS DOUBLE) / CAST(1e9 AS DOUBLE)"
_RISK_BN = f"CAST({_RISK_B} AS DOUBLE) / CAST(1e9 AS DOUBLE)"
_COUNTERS = f"""
{_NET_BN} AS net_revenue_bn_idr, {_FILL} AS fill_rate, {_RISK_BN} AS revenue_at_risk_bn_idr,
{_SHORT} AS stockout_order_rate"""
_DAY = "CAST(order_ts AS DATE)"
FINAL["dash_counters"] = f"SELECT {_COUNTERS} FROM fact_sales"
FINAL["dash_filtered"] = f"""
SELECT {_COUNTERS} FROM fact_sales
WHERE {_DAY} >= (SELECT today FROM clock) - 365 AND region IN ('ASIA', 'EUROPE')
  AND division IN ('Pharma-OTC', 'Consumer-Health')"""
FINAL["dash_daily_revenue"] = f"""
SELECT {_DAY} AS sales_date, {_NET_BN} AS net_revenue_bn_idr, {_RISK_BN} AS revenue_at_risk_bn_idr FROM fact_sales
GROUP BY ALL"""
FINAL["dash_daily_fill_region"] = f"SELECT {_DAY} AS sales_date, region, {_FILL} AS fill_rate FROM fact_sales GROUP BY ALL"
FINAL["dash_units_division"] = f"SELECT division, {_i('sum(units_ordered)')} AS units_ordered FROM fact_sales GROUP BY ALL"
FINAL["dash_revenue_region"] = f"SELECT region, {_NET_BN} AS net_revenue_bn_idr FROM fact_sales GROUP BY ALL"
FINAL["dash_status_mix"] = f"""
SELECT status, count(*) AS total_orders,
       {plain_ratio("count(*) FILTER (status = 'cancelled')", 'count(*)')} AS cancellation_rate
FROM fact_sales GROUP BY ALL"""
FINAL["dash_daily_units_division"] = f"""
SELECT {_DAY} AS sales_date, division, {_i('sum(units_ordered)')} AS units_ordered FROM fact_sales GROUP BY ALL"""
FINAL["dash_units_region"] = f"SELECT region, {_i('sum(units_ordered)')} AS units_ordered FROM fact_sales GROUP BY ALL"
FINAL["dash_hourly_orders"] = f"""
SELECT CAST(hour(order_ts) AS INTEGER) AS sales_hour, promo_flag, count(*) AS total_orders,
       {_i('sum(units_ordered)')} AS units_ordered FROM fact_sales GROUP BY ALL"""
FINAL["dash_inventory_counters"] = f"""
SELECT count(*) AS readings,
       count(DISTINCT CASE WHEN expiry_risk_score > 0.7 THEN dc_id || '|' || product_id END) AS skus_at_expiry_risk,
       {_i('sum(at_risk_expiry_units)')} AS at_risk_expiry_units, {_mean('days_of_supply', 2)} AS avg_days_of_supply
FROM inventory"""
_RATE = plain_ratio("sum(stockout_flag)", "count(*)")
FINAL["dash_daily_stockout_region"] = f"SELECT reading_date, region, {_RATE} AS stockout_rate FROM inventory GROUP BY ALL"
FINAL["dash_expiry_division"] = (
    f"SELECT division, {_mean('expiry_risk_score', 3)} AS avg_expiry_risk FROM inventory GROUP BY ALL"
)
FINAL["dash_stockout_region"] = f"SELECT region, {_RATE} AS stockout_rate FROM inventory GROUP BY ALL"
EXTRA["flagged"] = """
SELECT i.*, product_name FROM inventory i LEFT JOIN dim_product p ON p.product_id = i.product_id
WHERE reading_date = (SELECT max(reading_date) FROM inventory) AND expiry_risk_score > 0.7"""
FINAL["dash_risk_worklist"] = """
SELECT product_name, product_id, brand, division, dc_id, region, expiry_risk_score, days_to_expiry,
       at_risk_expiry_units, on_hand_units, days_of_supply
FROM flagged ORDER BY expiry_risk_score DESC, dc_id, product_id LIMIT 50"""
FINAL["dash_dc_map"] = f"""
SELECT d.dc_id, dc_name, city, region, lat, lng, coalesce(s.net_idr, 0) AS net_idr,
       coalesce(s.units_ordered, 0) AS units_ordered, coalesce(i.rate, 0) AS stockout_rate
FROM dim_dc d
LEFT JOIN (SELECT dc_id, {_i('sum(net_idr)')} AS net_idr, {_i('sum(units_ordered)')} AS units_ordered
           FROM fact_sales GROUP BY dc_id) s ON s.dc_id = d.dc_id
LEFT JOIN (SELECT dc_id, {_RATE} AS rate FROM inventory GROUP BY dc_id) i ON i.dc_id = d.dc_id"""

# ---- worked questions ------------------------------------------------------------------------------------------
EXTRA["month_sales"] = f"SELECT * FROM fact_sales WHERE {_DAY} >= (SELECT today FROM clock) - 30"
_FILL3 = ratio("sum(units_fulfilled)", "sum(units_ordered)", 3)
FINAL["nl_revenue_fill_region"] = f"""
SELECT region, {_i('sum(net_idr)')} AS net_revenue_idr, {_FILL3} AS fill_rate FROM month_sales GROUP BY region"""
FINAL["nl_stockout_region"] = f"""
SELECT region, {ratio('sum(stockout_flag)', 'count(*)', 3)} AS stockout_rate,
       {_i('sum(stockout_flag)')} AS stockout_days
FROM inventory WHERE reading_date >= (SELECT today FROM clock) - 30 GROUP BY region"""
FINAL["nl_at_risk_division"] = f"""
SELECT division, {_RISK_B} AS revenue_at_risk_idr, {_i('sum(net_idr)')} AS net_revenue_idr
FROM month_sales GROUP BY division"""
FINAL["nl_expiry_skus"] = f"""
SELECT dc_id, product_id, product_name, brand, division, max(expiry_risk_score) AS expiry_risk_score,
       min(days_to_expiry) AS days_to_expiry, {_i('sum(at_risk_expiry_units)')} AS at_risk_units
FROM flagged WHERE product_name IS NOT NULL GROUP BY dc_id, product_id, product_name, brand, division
ORDER BY expiry_risk_score DESC, dc_id, product_id LIMIT 20"""
FINAL["nl_fill_otc_region"] = f"""
SELECT brand, {_FILL3} AS fill_rate, {_i('sum(units_ordered)')} AS units_ordered FROM month_sales
WHERE region = 'ASIA' AND division = 'Pharma-OTC' GROUP BY brand"""
FINAL["nl_demand_brand"] = f"""
SELECT region, brand, {_i('sum(units_ordered)')} AS units_ordered, {_i('sum(net_idr)')} AS net_revenue_idr
FROM month_sales WHERE division = 'Pharma-OTC' AND region IN ('ASIA', 'EUROPE')
  AND brand IN ('Brand#1', 'Brand#4', 'Brand#8', 'Brand#16') GROUP BY region, brand"""

# ---- command centre --------------------------------------------------------------------------------------------


def _tone(rate: str) -> str:
    return f"CASE WHEN {rate} >= 0.15 THEN 'crit' WHEN {rate} >= 0.08 THEN 'warn' ELSE 'ok' END"


def _weighted(rate: str) -> str:
    return (
        f"coalesce(CAST(sum(CAST(round({rate} * 10000) AS BIGINT) * demand_units) AS DOUBLE) "
        "/ nullif(CAST(sum(demand_units) AS DOUBLE) * CAST(10000 AS DOUBLE), 0), 0)"
    )


FINAL["cc_national_snapshot"] = f"""
SELECT *, CASE WHEN fill <= 0.8 THEN 'crit' WHEN fill <= 0.9 THEN 'warn' ELSE 'ok' END AS fill_tone,
       {_tone('stockout')} AS stockout_tone
FROM (SELECT {_i('coalesce(sum(demand_units), 0)')} AS demand, {_i('coalesce(sum(backorder_count), 0)')} AS backorders,
             round(sum(revenue_at_risk_m_idr), 1) AS revenue_at_risk_m_idr, {_weighted('fill_rate')} AS fill,
             {_weighted('stockout_rate')} AS stockout FROM snapshot)"""
EXTRA["worst"] = """
SELECT region, stockout_rate, fill_rate, revenue_at_risk_m_idr FROM snapshot
ORDER BY stockout_rate DESC, region LIMIT 1"""
FINAL["cc_worst_region"] = "SELECT * FROM worst"
FINAL["cc_region_ranking"] = f"""
SELECT region, stockout_rate, {_tone('stockout_rate')} AS tone,
       least(stockout_rate * CAST(400 AS DOUBLE), CAST(100 AS DOUBLE)) AS bar_pct FROM snapshot"""
FINAL["cc_top_risk"] = _VIEW % 8
FINAL["cc_risk_by_region"] = 'SELECT region, count(*) AS "count" FROM at_risk GROUP BY region'
EXTRA["raised"] = """
SELECT 'stockout' AS alert_id, 'crit' AS severity, region AS subject, CAST(stockout_rate AS DOUBLE) AS value
FROM worst WHERE stockout_rate >= 0.15
UNION ALL
SELECT 'backorder', 'warn', (SELECT region FROM worst), CAST(sum(backorder_count) AS DOUBLE) FROM snapshot
HAVING sum(backorder_count) > 0
UNION ALL
SELECT 'sku-stockout', 'crit',
       array_to_string(list(product_name ORDER BY worst_score DESC, dc_id, product_id)[1:3], ', '), CAST(count(*) AS DOUBLE)
FROM at_risk WHERE stockout_risk_score >= 0.5 HAVING count(*) > 0
UNION ALL
SELECT 'expiry', 'warn',
       array_to_string(list(product_name ORDER BY worst_score DESC, dc_id, product_id)[1:3], ', '), CAST(count(*) AS DOUBLE)
FROM at_risk WHERE expiry_risk_score >= 0.7 HAVING count(*) > 0"""
FINAL["cc_alerts"] = """
SELECT *, CASE WHEN EXISTS (SELECT 1 FROM raised WHERE severity = 'crit') THEN 'crit' ELSE 'warn' END AS overall
FROM raised
UNION ALL SELECT 'none', 'ok', NULL, CAST(0 AS DOUBLE), 'ok' WHERE NOT EXISTS (SELECT 1 FROM raised)"""
_SIN = "sin(lat * pi() / 180)"
FINAL["cc_map_points"] = f"""
SELECT s.region, lat, lng, demand_units, stockout_rate,
       CASE WHEN stockout_rate >= 0.18 THEN 'red' WHEN stockout_rate >= 0.12 THEN 'orange'
            WHEN stockout_rate >= 0.06 THEN 'amber' ELSE 'green' END AS colour,
       stockout_rate >= 0.15 AS critical,
       round(12 + sqrt(CAST(demand_units AS DOUBLE)
                       / CAST(greatest((SELECT max(demand_units) FROM snapshot), 1) AS DOUBLE)) * 22, 4) AS radius,
       round((lng + 180) / 360 * 256, 4) AS world_x,
       round((CAST(0.5 AS DOUBLE) - ln((1 + {_SIN}) / (1 - {_SIN})) / (4 * pi())) * 256, 4) AS world_y
FROM snapshot s JOIN (SELECT region, avg(lat) AS lat, avg(lng) AS lng FROM dim_dc GROUP BY region) c
  ON c.region = s.region"""

# ---- documents -------------------------------------------------------------------------------------------------
# Fixed values, stated here as well so that the twins do not follow a change of the operators.
NO_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BLOCK_TAGS = (
    "title|h[1-6]|p|li|td|th|div|article|section|nav|ul|ol|header|footer|table|tr|head|body|html|blockquote|pre"
)
ELEMENT_TYPES = {"title": "title", "li": "list", "td": "table", "th": "table"} | {f"h{n}": "section_header" for n in range(1, 7)}
ENTITIES = {
    "&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}
FIELD_PATTERNS = {
    "email": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})",
    "phone": r"(\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4})",
    "ip_address": r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:[^0-9.]|$)",
    "licence": r"((?:Licensed|Released) under [^\n]*?)\.(?:[ \n]|$)",
    "token": r"token = \"([0-9a-f]+)\"",
}
NORMALISED_AWAY = r"[^\p{L}\p{N}]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _typed(key: str) -> str:
    return f"CASE {key} WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'other' END"


_TEXT = f"regexp_replace(translate(html, chr(1) || chr(2), ''), {_quoted(NO_TEXT)}, '', 'g')"
_TEXT = f"regexp_replace({_TEXT}, {_quoted(f'(?is)</(?:{BLOCK_TAGS})' + chr(92) + 'b[^>]*>')}, chr(1) || 'text' || chr(2), 'g')"
_TEXT = f"regexp_replace({_TEXT}, {_quoted(f'(?is)<({BLOCK_TAGS})' + chr(92) + 'b[^>]*>')}, chr(1) || '{chr(92)}1' || chr(2), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '(?is)<br{chr(92)}b[^>]*>', ' ', 'g')"
_TEXT = f"regexp_replace({_TEXT}, '(?s)<[^>]*>', '', 'g')"
for _entity, _character in ENTITIES.items():
    _TEXT = f"replace({_TEXT}, {_quoted(_entity)}, {_quoted(_character)})"
_KIND = " ".join(f"WHEN '{tag}' THEN '{kind}'" for tag, kind in ELEMENT_TYPES.items())
EXTRA["page_elements"] = f"""
SELECT page_id, url, {_typed("regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)")} AS doc_type,
       list_filter(list_transform(string_split({_TEXT}, chr(1)), lambda piece: struct_pack(
           "type" := CASE lower(string_split(piece, chr(2))[1]) {_KIND} ELSE 'text' END,
           content := trim(regexp_replace(string_split(piece, chr(2))[-1], '[ \\t\\r\\n\\f]+', ' ', 'g')))),
         lambda e: e.content <> '') AS found
FROM pages"""
EXTRA["numbered"] = """
SELECT page_id, url, doc_type, list_transform(found, lambda e, i: struct_pack(id := CAST(i - 1 AS VARCHAR), "type" := e."type",
                                                        content := e.content)) AS elements
FROM page_elements WHERE len(found) > 0"""
FINAL["doc_elements"] = """
SELECT page_id, doc_type, e.id AS id, e."type" AS "type", e.content AS content
FROM (SELECT page_id, doc_type, unnest(elements) AS e FROM numbered)"""
EXTRA["page_texts"] = """
SELECT page_id, md5(url) AS doc_id, doc_type, regexp_extract(url, '([^/]+)$', 1) AS file_name,
       array_to_string(list_transform(elements, lambda e: e.content), chr(10)) AS parsed_text,
       CAST(to_json(elements) AS VARCHAR) AS elements_json
FROM numbered"""
FINAL["doc_text"] = "SELECT * FROM page_texts"
FINAL["doc_page"] = "SELECT * FROM page_texts WHERE page_id = 17 LIMIT 1"
_FIELDS = ", ".join(
    f"nullif(regexp_extract(text, {_quoted(pattern)}, 1), '') AS {name}"
    for name, pattern in FIELD_PATTERNS.items()
)
EXTRA["doc_fields"] = f"SELECT doc_id, {_typed('lang')} AS doc_type, source, text, {_FIELDS} FROM documents"
FINAL["doc_fields"] = "SELECT * EXCLUDE (text) FROM doc_fields"
FINAL["doc_type_counts"] = f"SELECT {_typed('lang')} AS doc_type, count(*) AS documents FROM documents GROUP BY ALL"


def _norm(text: str) -> str:
    return f"regexp_replace(lower({text}), {_quoted(NORMALISED_AWAY)}, '', 'g')"


EXTRA["doc_pairs"] = " UNION ALL ".join(
    f"SELECT doc_id, text, '{name}' AS field, {name} AS value FROM doc_fields WHERE {name} IS NOT NULL"
    for name in FIELD_PATTERNS
)
EXTRA["doc_targets"] = f"SELECT *, {_norm('value')} AS target FROM doc_pairs"
FINAL["doc_field_match"] = f"""
SELECT doc_id, field, value, (SELECT min(l.line_no) FROM doc_lines l WHERE l.doc_id = d.doc_id
         AND l.content <> '' AND (contains(l.content, d.target) OR contains(d.target, l.content))) AS line_id
FROM doc_targets d WHERE length(target) >= 2"""
EXTRA["doc_lines"] = f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {_norm('lines[i]')} AS content
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents))"""

# ---- event streams, sketches, catalog, SQL users ---------------------------------------------------------------------
FINAL["stream_unique_sales"] = "SELECT DISTINCT * FROM silver"
# The events table lands in three parts by time, one event in 50 of a part with the next part. An event counts if its hour
# had not been closed when its part landed: the newest event landed before lies less than two hours past the hour's end.
EXTRA["event_parts"] = """
SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS hour,
       CAST(least(floor((epoch_us(ts) - lo) * 3 / greatest(hi - lo, 1)), 2) AS INTEGER) + CAST(event_id % 50 = 0 AS INTEGER) AS part
FROM events CROSS JOIN (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"""
EXTRA["event_marks"] = """
SELECT p.part, (SELECT max(ts) FROM event_parts e WHERE e.part < p.part) - INTERVAL 2 HOUR AS mark
FROM (SELECT DISTINCT part FROM event_parts) p"""
FINAL["event_windows"] = """
SELECT hour AS window_start, event_type, count(*) FILTER (mark IS NULL OR hour + INTERVAL 1 HOUR > mark) AS events,
       CAST(sum(CASE WHEN mark IS NULL OR hour + INTERVAL 1 HOUR > mark THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT)
         AS value_cents,
       count(*) FILTER (mark IS NOT NULL AND hour + INTERVAL 1 HOUR <= mark) AS late_events
FROM event_parts JOIN event_marks USING (part)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)
GROUP BY hour, event_type HAVING count(*) FILTER (mark IS NULL OR hour + INTERVAL 1 HOUR > mark) > 0"""
FINAL["event_properties"] = """
SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"""
FINAL["doc_elements_by_path"] = FINAL["doc_elements"]
FINAL["governed_accounts_sql"] = FINAL["governed_accounts"]
FINAL["governed_sales_sql"] = FINAL["governed_sales"]
FINAL["catalog_dimensions"] = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{comment}' AS comment, '{kind}' AS data_classification, "
    f"'ap-southeast-3' AS data_residency, CAST({columns} AS INTEGER) AS commented_columns, (SELECT count(*) FROM {source}) AS row_count"
    for table, comment, kind, columns, source in (
        ("dim_product", "Products with brand, division and shelf life", "commercial-confidential", 2, "part"),
        ("dim_outlet", "Outlets that order", "commercial-confidential", 2, "customer"),
        ("dim_distribution_center", "Distribution centres", "public-reference", 1, "nation"),
    )
)
FINAL["priority_status"] = """
SELECT o_orderpriority, status, count(*) AS lines, CAST(sum(units_ordered) AS BIGINT) AS units
FROM (SELECT o_orderpriority, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'backorder'
             WHEN l_returnflag = 'R' THEN 'cancelled' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'partial'
             ELSE 'fulfilled' END AS status, CAST(l_quantity AS BIGINT) AS units_ordered
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
GROUP BY ALL"""
FINAL["metric_sales_rollup"] = f"""
SELECT region, division, CAST(grouping(region) + grouping(division) AS INTEGER) AS level, count(*) AS order_count,
       {_i('sum(net_idr)')} AS net_revenue_idr, {_i('sum(units_ordered)')} AS units_ordered, {_FILL} AS fill_rate,
       {_SHORT} AS stockout_rate, count(DISTINCT outlet_id) AS unique_outlets
FROM fact_sales GROUP BY ROLLUP (region, division)"""
# Sketches are exact while a group has a few hundred distinct values; region and month have fewer at the tested scale.
FINAL["metric_unique_by_month_region"] = """
SELECT CAST(date_trunc('month', order_ts) AS DATE) AS sale_month, region, count(*) AS order_count,
       count(DISTINCT outlet_id) AS unique_outlets, count(DISTINCT product_id) AS unique_skus
FROM fact_sales WHERE order_ts IS NOT NULL AND region IS NOT NULL GROUP BY ALL"""

ORACLE = {name: with_ctes(sql, EXTRA) for name, sql in FINAL.items()}
