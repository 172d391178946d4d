"""Operational reads over the gold tables: KPIs, trends, worklists, feeds and the write-back log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import STOCKOUT_STATUSES, contains_ci, in_list, scaled
from shelfwise.operators import decisions, forecast, risk
from shelfwise.operators.keyed import key_report, keyed_upsert
from shelfwise.plans import gold
from shelfwise.session import shared_dir, written
from shelfwise.sources.inventory import SERIES_KEYS, readings
from shelfwise.sources.star import Tables, dim_distribution_center, dim_product

TRAILING_DAYS = 30
WORKLIST_ROWS = 60
FEED_ROWS = 40
SEARCH_ROWS = 20


def newest_days(by_day: DataFrame, days: int = TRAILING_DAYS) -> DataFrame:
    """The rows within `days` days before the newest date, of a table with one row per sales_date.

    They are among the newest days + 1 rows; Spark takes those with a distributed top-k, and only they meet in the
    one window that knows the newest date.
    """
    newest = by_day.orderBy(F.col("sales_date").desc()).limit(days + 1)
    latest = F.max("sales_date").over(Window.partitionBy())
    return (
        newest.withColumn("_latest", latest).filter(F.expr(f"sales_date >= date_sub(_latest, {days})")).drop("_latest")
    )


def mean4(column: str) -> str:
    """Mean of a column that has four decimals, rounded half up to four decimals."""
    total = f"sum(cast(round({column} * 10000) AS bigint))"
    return f"(({total} * 2 + count({column})) div (2 * count({column}))) / 10000D"


def national_kpis(t: Tables) -> DataFrame:
    window = newest_days(gold.national_daily_of(t))
    return window.agg(
        F.expr(scaled("sum(net_idr)", 10**9, 2)).alias("revenue_bn_idr"),
        F.expr(scaled("sum(revenue_at_risk_idr)", 10**9, 2)).alias("revenue_at_risk_bn_idr"),
        F.sum("demand_units").alias("demand_units"),
        F.sum("order_count").alias("order_count"),
        F.sum("backorder_count").alias("backorder_count"),
        F.expr(mean4("fill_rate")).alias("fill_rate"),
        F.expr(mean4("stockout_rate")).alias("stockout_rate"),
    )


def national_trend(t: Tables) -> DataFrame:
    window = newest_days(gold.national_daily_of(t))
    return window.select(
        F.date_format("sales_date", "yyyy-MM-dd").alias("sales_date"),
        F.expr(scaled("net_idr", 10**9, 3)).alias("revenue_bn_idr"),
        F.expr(scaled("revenue_at_risk_idr", 10**6, 1)).alias("revenue_at_risk_m_idr"),
        "demand_units",
        "fill_rate",
        "stockout_rate",
        "backorder_count",
    ).orderBy("sales_date")


def region_snapshot(t: Tables) -> DataFrame:
    """Each region's newest day, as typed columns."""
    by_region = gold.region_daily_of(t)
    columns = ("sales_date", "demand_units", "fill_rate", "stockout_rate", "revenue_at_risk_idr", "backorder_count")
    latest = by_region.groupBy("region").agg(F.max_by(F.struct(*columns), "sales_date").alias("latest"))
    return latest.select("region", "latest.*").withColumn(
        "revenue_at_risk_m_idr", F.expr(scaled("revenue_at_risk_idr", 10**6, 1))
    )


def region_latest(t: Tables) -> DataFrame:
    return (
        region_snapshot(t)
        .select(
            "region",
            F.date_format("sales_date", "yyyy-MM-dd").alias("sales_date"),
            "demand_units",
            "fill_rate",
            "stockout_rate",
            "revenue_at_risk_m_idr",
            "backorder_count",
        )
        .orderBy(F.col("demand_units").desc(), "region")
    )


def region_trend(t: Tables) -> DataFrame:
    """Daily demand per region in the trailing window; a day's list holds one entry per region."""
    by_region = gold.region_daily_of(t)
    by_day = by_region.groupBy("sales_date").agg(F.collect_list(F.struct("region", "demand_units")).alias("regions"))
    return (
        newest_days(by_day)
        .select("sales_date", F.inline("regions"))
        .select("region", F.date_format("sales_date", "yyyy-MM-dd").alias("sales_date"), "demand_units")
        .orderBy("region", "sales_date")
    )


def scored(t: Tables) -> DataFrame:
    """Risk scores with their action; only the readings that scores are made of become rows, and the scores are taken where
    the readings lie."""
    recent = readings(t, last_days=risk.RECENT_READINGS)
    return risk.with_action(risk.risk_scores(recent, keys=SERIES_KEYS))


def product_risk(t: Tables) -> DataFrame:
    """Risk table per SKU and centre, scored by the inventory's own expiry score."""
    named = risk.with_names(scored(t), dim_product(t), dim_distribution_center(t))
    return named.select(
        "dc_id", "product_id", "product_name", "brand", "division", "region", "dc_name", "expiry_risk_score",
        "stockout_risk_score", "days_to_expiry", "on_hand_units", "days_of_supply", "at_risk_expiry_units",
        "avg_daily_demand", "recommended_action",
    )


def worklist_top(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """The worst 60 SKU x centre pairs. Names come after the cut: a name lookup cannot change the ranking."""
    scores = scored(t) if scores is None else scores
    worst = risk.at_risk(scores).orderBy(*risk.worst_first()).limit(WORKLIST_ROWS)
    return risk.with_names(worst, dim_product(t), dim_distribution_center(t))


def risk_worklist(t: Tables) -> DataFrame:
    return risk.worklist_view(worklist_top(t).orderBy(*risk.worst_first()))


def decision_batch(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """Decisions derived from the risk table: the recommended action of each pair with something to do."""
    scores = scored(t) if scores is None else scores
    todo = risk.at_risk(scores).filter("recommended_action <> 'hold'")
    named = todo.join(dim_product(t).select("product_id", "product_name"), "product_id", "left")
    return named.select(
        F.expr("md5(concat(dc_id, '|', product_id))").alias("id"),
        "product_id",
        "dc_id",
        "product_name",
        "brand",
        "region",
        F.expr(risk.EXPIRY_PCT).alias("expiry_risk_pct"),
        F.expr(risk.STOCKOUT_PCT).alias("stockout_risk_pct"),
        F.col("recommended_action").alias("action"),
        F.concat(F.lit("auto: "), F.col("recommended_action")).alias("note"),
        t.clock().alias("created_at"),
    )


def decision_validate(t: Tables) -> DataFrame:
    return decisions.judged(decision_batch(t)).drop("note", "created_at")


def decision_log_recent(t: Tables) -> DataFrame:
    return decisions.recent(decisions.accepted(decision_batch(t)))


def decision_log_saved(t: Tables) -> DataFrame:
    """The valid decisions as the log holds them once recorded, without the ids and times they were given."""
    log = shared_dir(t.spark, "decisions")
    decisions.record(decision_batch(t), "ops@example.com", log)
    return t.spark.read.parquet(log).drop("id", "created_at")


def region_daily_upserted(t: Tables) -> DataFrame:
    """The daily table after its newest month, stored with wrong sums, was replaced by the right rows."""
    daily = written(gold.region_daily_of(t), "region-daily")
    recent = F.col("sales_date") >= t.midnight(30).cast("date")
    stale = daily.withColumn("net_idr", F.when(recent, F.lit(-1).cast("bigint")).otherwise(F.col("net_idr")))
    return keyed_upsert(stale, daily.filter(recent), gold.SERVING_KEYS["gold_region_daily"])


def open_worklist(t: Tables) -> DataFrame:
    """The worklist without the pairs that somebody already acted on."""
    scores = written(scored(t), "scores")  # the worklist and the decisions both stand on it
    acted = decisions.acted_keys(decisions.accepted(decision_batch(t, scores)))
    open_pairs = worklist_top(t, scores).join(acted, ["dc_id", "product_id"], "left_anti")
    return risk.worklist_view(open_pairs.orderBy(*risk.worst_first()))


def serving_rows(t: Tables) -> DataFrame:
    return gold.serving_of(t)


def division_mix(t: Tables) -> DataFrame:
    return (
        serving_rows(t)
        .groupBy("division")
        .agg(F.count(F.lit(1)).alias("orders"), F.expr(scaled("sum(net_idr)", 10**9, 3)).alias("net_bn_idr"))
        .orderBy(F.col("net_bn_idr").desc(), "division")
    )


def _feed_rows(t: Tables, rows: int, *where: Column) -> DataFrame:
    """The newest sales that were not served in full, out of all that meet the conditions."""
    hits = serving_rows(t).filter(in_list("status", STOCKOUT_STATUSES))
    for condition in where:
        hits = hits.filter(condition)
    newest = hits.orderBy(F.col("order_ts").desc(), "sale_id").limit(rows)
    return newest.select(
        "sale_id",
        F.date_format("order_ts", "yyyy-MM-dd HH:mm").alias("order_ts"),
        "region",
        "city",
        "division",
        "brand",
        "product_name",
        "units_ordered",
        "units_fulfilled",
        F.expr(scaled("net_idr", 10**6, 2)).alias("net_m_idr"),
        "status",
    )


def backorder_feed(t: Tables) -> DataFrame:
    return _feed_rows(t, FEED_ROWS)


def search_rows(t: Tables, text: str = "asia") -> DataFrame:
    """The newest of all feed rows whose product, brand or region contains the text, in any case."""
    return _feed_rows(t, SEARCH_ROWS, contains_ci(text, "product_name", "brand", "region"))


def region_series(t: Tables, sales: DataFrame | None = None) -> DataFrame:
    """Dense daily demand of each region."""
    sales = gold.sales_of(t, ("region", "sales_date", "units_ordered")) if sales is None else sales
    daily = sales.groupBy("region", F.col("sales_date").alias("ds")).agg(F.sum("units_ordered").alias("demand"))
    return forecast.dense_series(daily, "region")


def region_forecast(t: Tables, sales: DataFrame | None = None) -> DataFrame:
    return forecast.seasonal_naive(region_series(t, sales), "region")


def forecast_rounded(t: Tables) -> DataFrame:
    return (
        region_forecast(t)
        .select(
            "region",
            F.date_format("forecast_date", "yyyy-MM-dd").alias("forecast_date"),
            *[F.round(c).cast("bigint").alias(c) for c in ("forecast_units", "lower", "upper")],
        )
        .orderBy("region", "forecast_date")
    )


def forecast_by_region(t: Tables) -> DataFrame:
    """Total and peak of each region's forecast."""
    return (
        region_forecast(t)
        .groupBy("region")
        .agg(
            F.round(F.sum("forecast_units")).cast("bigint").alias("forecast_units"),
            F.round(F.max("forecast_units")).cast("bigint").alias("peak_units"),
        )
        .orderBy(F.col("forecast_units").desc(), "region")
    )


def demand_features(t: Tables) -> DataFrame:
    features = forecast.demand_features(region_series(t), "region")
    return features.withColumns({c: F.round(c, 6) for c in ("roll7_mean", "roll7_std")})


def forecast_naive_eval(t: Tables) -> DataFrame:
    return forecast.naive_errors(forecast.demand_features(region_series(t), "region"))


def serving_pk_check(t: Tables) -> DataFrame:
    """Does every serving table's primary key identify its rows?"""
    # Four of the five tables stand on the curated sales: de-duplicate once.
    sales = written(gold.curated(t).select(*gold.SERVING_INPUTS), "curated")
    tables = {
        "gold_product_risk": scored(t),
        "gold_region_daily": gold.region_daily(sales),
        "gold_national_daily": gold.national_daily(sales),
        "gold_sales_serving": gold.sales_serving(t, sales),
        "gold_demand_forecast": region_forecast(t, sales),
    }
    reports = [key_report(df, name, gold.SERVING_KEYS[name]) for name, df in tables.items()]
    result = reports[0]
    for report in reports[1:]:
        result = result.unionByName(report)
    return result


def with_stored_gold(t: Tables) -> Tables:
    """The tables with a gold layer written for them in the shared folder."""
    folder = shared_dir(t.spark, "gold")
    gold.build(t, folder)
    return Tables(t.spark, t.sf_dir, folder)


def stored_gold_kpis(t: Tables) -> DataFrame:
    return national_kpis(with_stored_gold(t))


def stored_gold_feed(t: Tables) -> DataFrame:
    return backorder_feed(with_stored_gold(t))
