import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import forecast
from shelfwise.plans import learned

DAY0 = dt.date(2024, 1, 1)


def daily(spark, series):
    rows = [(k, DAY0 + dt.timedelta(days=i), v) for k, values in series.items() for i, v in values.items()]
    return spark.createDataFrame(rows, "region string, ds date, demand bigint")


@pytest.fixture(scope="module")
def random_series():
    draw = random.Random(7)
    return {r: {i: draw.randint(0, 500) for i in range(90) if draw.random() > 0.1} for r in ("A", "B")}


def test_gaps_become_zero(spark):
    rows = forecast.dense_series(daily(spark, {"A": {0: 5, 3: 7}, "B": {10: 1}}), "region").collect()
    got = sorted((r.region, (r.ds - DAY0).days, r.demand) for r in rows)
    assert got == [("A", 0, 5), ("A", 1, 0), ("A", 2, 0), ("A", 3, 7), ("B", 10, 1)]


def test_features_against_pandas(spark, random_series):
    dense = forecast.dense_series(daily(spark, random_series), "region")
    got = forecast.demand_features(dense, "region").toPandas().sort_values(["region", "ds"]).reset_index(drop=True)
    frames = []
    for region, pdf in dense.toPandas().groupby("region"):
        pdf = pdf.sort_values("ds")
        prior = pdf["demand"].shift(1).rolling(7)
        frames.append(pdf.assign(lag_1=pdf["demand"].shift(1), lag_7=pdf["demand"].shift(7), roll7_mean=prior.mean(), roll7_std=prior.std()))
    want = pd.concat(frames).dropna().reset_index(drop=True)
    assert len(got) == len(want)
    for column in ("lag_1", "lag_7", "roll7_mean", "roll7_std"):
        assert got[column].astype(float).tolist() == pytest.approx(want[column].tolist())
    days = pd.to_datetime(got["ds"])
    assert got["dow"].tolist() == days.dt.dayofweek.tolist()
    assert got["woy"].tolist() == days.dt.isocalendar().week.tolist()


def test_seasonal_naive_repeats_the_last_week(spark, random_series):
    dense = forecast.dense_series(daily(spark, random_series), "region")
    last = {(r.region, r.ds): r.demand for r in dense.collect()}
    end = {k: max(d for r, d in last if r == k) for k in random_series}
    rows = forecast.seasonal_naive(dense, "region", horizon=10).collect()
    assert len(rows) == 20
    for r in rows:
        step = (r.forecast_date - end[r.region]).days
        assert 1 <= step <= 10
        assert r.forecast_units == last[(r.region, end[r.region] - dt.timedelta(days=6 - (step - 1) % 7))]
        assert 0 <= r.lower <= r.forecast_units <= r.upper


def test_one_day_series(spark):
    rows = forecast.seasonal_naive(forecast.dense_series(daily(spark, {"A": {0: 4}}), "region"), "region").collect()
    assert [(r.forecast_units, r.lower) for r in sorted(rows, key=lambda r: r.forecast_date)] == [(4.0, 2.7), (4.0, 2.7)]


def test_naive_errors(spark):
    series = {"A": {i: 10 + (i // 7) * (3 if i >= 28 else 0) for i in range(42)}}
    features = forecast.demand_features(forecast.dense_series(daily(spark, series), "region"), "region")
    rows = {r.ds: abs(r.demand - r.lag_7) for r in features.collect()}
    errors = [rows[d] for d in sorted(rows)[-14:]]
    got = forecast.naive_errors(features).head()
    assert got.val_rows == 14
    assert got.naive_lag7_mae == pytest.approx(sum(errors) / 14, abs=1e-6)
    assert got.naive_lag7_rmse == pytest.approx((sum(e * e for e in errors) / 14) ** 0.5, abs=1e-6)


def test_recursive_model_forecast(spark, random_series):
    dense = forecast.dense_series(daily(spark, random_series), "region")
    features = forecast.demand_features(dense, "region").withColumn("demand", F.col("demand").cast("double"))
    model, spread, metrics, report = learned.train_demand_model(features.cache(), iterations=2, n_trials=3)
    assert len(report) == 3 and sum(r[-1] for r in report) == 1 and min(r[-2] for r in report) == next(r[-2] for r in report if r[-1])
    rows = learned.recursive_forecast(model, dense, horizon=3).collect()
    assert len(rows) == 6 and all(r.level >= 0 for r in rows)
    assert metrics["val_rmse"] > 0 and spread.filter("std IS NULL").count() == 0
    # The first step must equal the model applied to hand-made features of the next day.
    pdf = dense.toPandas()
    for region, group in pdf.groupby("region"):
        week = group.sort_values("ds")["demand"].astype(float).tolist()[-7:]
        day = max(group["ds"]) + dt.timedelta(days=1)
        one = spark.createDataFrame(
            [(region, day.weekday(), day.day, day.month, day.isocalendar().week, int(day.weekday() >= 5), week[-1],
              week[0], sum(week) / 7, float(pd.Series(week).std()), 0.0)],
            "region string, dow int, day int, month int, woy int, is_weekend int, lag_1 double, lag_7 double, "
            "roll7_mean double, roll7_std double, demand double",
        )
        first = min((r for r in rows if r.region == region), key=lambda r: r.forecast_date)
        assert first.forecast_date == day
        assert first.level == pytest.approx(max(0.0, model.transform(one).head().prediction))


def test_expiry_model_learns(spark):
    draw = random.Random(5)
    rows = []
    for day in range(40):
        for _ in range(20):
            x = draw.random()
            rows.append((day, int(x > 0.8), *[x * 10] * 2, *[draw.random()] * 6))
    columns = ", ".join(f"{c} double" for c in learned.risk.FEATURES)
    df = spark.createDataFrame(rows, f"day_idx int, label int, {columns}")
    _, metrics, report = learned.train_expiry_model(df.cache(), iterations=2, n_trials=3)
    assert len({r[1:5] for r in report}) == 3 and metrics["choice_auc"] == max(r[-2] for r in report)
    assert metrics["test_auc"] > 0.95 and metrics["test_average_precision"] > 0.8
