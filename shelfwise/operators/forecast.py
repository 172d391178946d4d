"""Demand series: gap filling, calendar and lag features, the seasonal-naive forecast and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import calendar

HORIZON = 14
SEASON = 7
BAND_Z = 1.28


def dense_series(daily: DataFrame, series: str, ds: str = "ds", value: str = "demand") -> DataFrame:
    """Fill the missing dates of each series with 0 between its first and last day.

    Each row spreads over the days up to the next one, so no calendar has to be joined. A series is one row per day.
    """
    following = F.lead(ds).over(Window.partitionBy(series).orderBy(ds))
    days = F.sequence(F.col(ds), F.coalesce(F.date_sub(following, 1), F.col(ds)))
    spread = daily.select(series, F.col(value).alias("_value"), days.alias("_days"))
    return spread.select(series, "_value", F.posexplode("_days").alias("_pos", ds)).select(
        series, ds, F.expr("CASE WHEN _pos = 0 THEN _value ELSE 0L END").alias(value)
    )


def demand_features(dense: DataFrame, series: str) -> DataFrame:
    """Calendar, lag and trailing-week features of each day; days without a full week before them are left out."""
    ordered = Window.partitionBy(series).orderBy("ds")
    week = ordered.rowsBetween(-SEASON, -1)
    return (
        dense.withColumns(calendar("ds"))
        .withColumns(
            {
                "lag_1": F.lag("demand", 1).over(ordered),
                "lag_7": F.lag("demand", SEASON).over(ordered),
                "roll7_mean": F.avg(F.col("demand").cast("double")).over(week),
                "roll7_std": F.stddev_samp(F.col("demand").cast("double")).over(week),
                "prior": F.count("demand").over(week),
            }
        )
        .filter(F.col("prior") == SEASON)
        .drop("prior")
    )


def seasonal_naive(dense: DataFrame, series: str, horizon: int = HORIZON, residual_days: int | None = None) -> DataFrame:
    """Forecast each day by the same weekday of the last observed week, floored at 0, with a band from the
    week-over-week residuals: all of them, or those of the last `residual_days` days."""
    ordered = Window.partitionBy(series).orderBy("ds")
    newest = Window.partitionBy(series).orderBy(F.col("ds").desc())
    used = F.col("residual") if residual_days is None else F.when(F.col("rn") <= residual_days, F.col("residual"))
    scored = (
        dense.withColumn("residual", (F.col("demand") - F.lag("demand", SEASON).over(ordered)).cast("double"))
        .withColumn("rn", F.row_number().over(newest))
        .withColumn("std", F.stddev_samp(used).over(Window.partitionBy(series)))
        .withColumn("last_ds", F.max("ds").over(Window.partitionBy(series)))
    )
    steps = F.sequence(F.lit(SEASON), F.lit((horizon + SEASON - 1) // SEASON * SEASON), F.lit(SEASON))
    ahead = (
        scored.filter(F.col("rn") <= SEASON)
        .withColumn("step", F.explode(steps))
        .withColumn("forecast_date", F.expr("date_add(ds, step)"))
        .filter(F.expr(f"forecast_date <= date_add(last_ds, {horizon})"))
        .withColumn("level", F.greatest(F.lit(0.0), F.col("demand").cast("double")))
        .withColumn("band", F.coalesce("std", F.lit(1.0)) * BAND_Z)
    )
    return ahead.select(
        series,
        "forecast_date",
        F.round("level", 1).alias("forecast_units"),
        F.round(F.greatest(F.lit(0.0), F.col("level") - F.col("band")), 1).alias("lower"),
        F.round(F.col("level") + F.col("band"), 1).alias("upper"),
    )


def naive_errors(features: DataFrame, days: int = HORIZON) -> DataFrame:
    """RMSE and MAE of the same-day-last-week forecast over the last `days` days of all series."""
    error = (F.col("demand") - F.col("lag_7")).cast("double")
    by_day = features.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sq"), F.sum(F.abs(error)).alias("ab")
    )
    # At most `days` dates lie in the window, so the newest `days` rows contain it.
    newest = by_day.orderBy(F.col("ds").desc()).limit(days)
    held_out = newest.withColumn("max_ds", F.max("ds").over(Window.partitionBy())).filter(
        F.expr(f"ds > date_sub(max_ds, {days})")
    )
    return held_out.agg(
        F.sum("n").alias("val_rows"),
        F.round(F.sqrt(F.sum("sq") / F.sum("n")), 6).alias("naive_lag7_rmse"),
        F.round(F.sum("ab") / F.sum("n"), 6).alias("naive_lag7_mae"),
    )


def actual_and_forecast(daily: DataFrame, forecast: DataFrame) -> DataFrame:
    """One chart series: the actuals, the last actual again as the joint, then the forecast."""
    last = daily.orderBy(F.col("ds").desc()).limit(1)
    units = F.col("demand").cast("double")
    actuals = daily.select(F.col("ds").alias("sales_date"), units.alias("units"))
    joint = last.select(
        F.col("ds").alias("sales_date"),
        units.alias("units_forecast"),
        units.alias("units_upper"),
        units.alias("units_lower"),
        units.alias("units"),
    )
    ahead = forecast.select(
        F.col("forecast_date").alias("sales_date"),
        F.col("forecast_units").alias("units_forecast"),
        F.col("upper").alias("units_upper"),
        F.col("lower").alias("units_lower"),
    )
    return joint.unionByName(ahead, allowMissingColumns=True).unionByName(actuals, allowMissingColumns=True)
