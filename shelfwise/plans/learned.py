"""Models on Spark ML: the expiry-risk classifier and the recursive regional demand forecast."""

from __future__ import annotations

import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, OneHotEncoder, QuantileDiscretizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import calendar
from shelfwise.operators import forecast, risk
from shelfwise.plans import serving
from shelfwise.session import written
from shelfwise.sources.inventory import PANEL_DAYS, SERIES_KEYS, readings
from shelfwise.sources.star import Tables, dim_distribution_center, dim_product

TEST_SHARE = 0.25
SEED = 42
#: Trials of the two searches, and how many of them run at a time.
EXPIRY_TRIALS, DEMAND_TRIALS, AT_A_TIME = 15, 20, 4
# Values that a trial draws from.
_DEPTH, _STEP, _BINS, _SUBSAMPLE = (2, 3, 4, 5), (0.05, 0.1, 0.2, 0.3), (16, 32, 64), (0.7, 0.85, 1.0)


def trials(trees, n: int, iterations: int, seed: int = SEED) -> list[dict]:
    """n different settings of boosted trees, drawn without repetition by a seed: the same on every run."""
    every = (
        ParamGridBuilder()
        .baseOn({trees.maxIter: iterations})
        .addGrid(trees.maxDepth, _DEPTH)
        .addGrid(trees.stepSize, _STEP)
        .addGrid(trees.maxBins, _BINS)
        .addGrid(trees.subsamplingRate, _SUBSAMPLE)
        .build()
    )
    return random.Random(seed).sample(every, min(n, len(every)))


class _Chosen:
    """The best model of a search, its setting, and every trial's figure in the order of the trials."""

    def __init__(self, pipeline: Pipeline, settings: list[dict], evaluator, fit: DataFrame, choose: DataFrame):
        """Fit every setting on `fit`, several at a time, and take the one that does best on `choose`."""
        def run(setting: dict) -> tuple[float, PipelineModel]:
            model = pipeline.fit(fit, setting)
            return evaluator.evaluate(model.transform(choose)), model

        with ThreadPool(AT_A_TIME) as pool:
            results = pool.map(inheritable_thread_target(fit.sparkSession)(run), settings)
        self.figures = [figure for figure, _ in results]
        pick = max if evaluator.isLargerBetter() else min
        self.place = pick(range(len(results)), key=self.figures.__getitem__)
        self.setting, self.model, self.figure = settings[self.place], results[self.place][1], self.figures[self.place]

    def report(self, settings: list[dict]) -> list[tuple]:
        """(trial, depth, step, bins, share of rows, figure, chosen) of every trial."""
        rows = []
        for at, (setting, figure) in enumerate(zip(settings, self.figures)):
            named = {param.name: value for param, value in setting.items()}
            values = (named["maxDepth"], named["stepSize"], named["maxBins"], named["subsamplingRate"])
            rows.append((at, *values, float(figure), at == self.place))
        return rows


def split_days(labelled: DataFrame, share: float = TEST_SHARE) -> dict[str, DataFrame]:
    """Early days to fit, later ones to choose by, the last to measure on. A label looks LABEL_DAYS ahead, so as many days
    are left out before each stretch: no label of one sees a day of the next."""
    last = labelled.agg(F.max("day_idx")).head()[0] or 0
    choose, measure = int(last * (1 - share)), int(last * (1 - share / 2))
    day = F.col("day_idx")
    return {
        "fit": labelled.filter(day <= choose - risk.LABEL_DAYS),
        "choose": labelled.filter((day > choose) & (day <= measure - risk.LABEL_DAYS)),
        "measure": labelled.filter(day > measure),
    }


#: Steps of the grid that the classifier sees a feature on: what the finest trial tells apart.
GRID = max(_BINS)
_ON_GRID = tuple(f"{c}_step" for c in risk.FEATURES)


def feature_grid(rows: DataFrame) -> Bucketizer:
    """The grid of every feature: GRID steps at the quantiles of all its values, within a thousandth of their rank."""
    return QuantileDiscretizer(
        inputCols=list(risk.FEATURES), outputCols=list(_ON_GRID), numBuckets=GRID, relativeError=0.001
    ).fit(rows)


def on_grid(rows: DataFrame, grid: Bucketizer) -> DataFrame:
    """Rows by step of each feature and label, equal ones as one row with their number. To trees that split on the grid they
    are the same rows; there are no more of them than cells of the grid, however many rows there are."""
    steps = grid.transform(rows).select("label", *[F.col(c).cast("int").alias(c) for c in _ON_GRID])
    return steps.groupBy("label", *_ON_GRID).agg(F.count(F.lit(1)).alias("n"))


def _weighted(counted: DataFrame) -> DataFrame:
    """Rows weighted by their number, positives by their scarcity as well."""
    counts = counted.agg(
        F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("neg")
    ).head()
    scarcity = F.when(F.col("label") == 1, (counts["neg"] or 0) / max(1, counts["pos"] or 0)).otherwise(1.0)
    return counted.withColumn("weight", F.col("n") * scarcity)


def _expiry_pipeline() -> tuple[Pipeline, GBTClassifier]:
    assembler = VectorAssembler(inputCols=list(_ON_GRID), outputCol="features")
    trees = GBTClassifier(labelCol="label", weightCol="weight", seed=SEED)
    return Pipeline(stages=[assembler, trees]), trees


def train_expiry_model(
    labelled: DataFrame, iterations: int = 8, n_trials: int = EXPIRY_TRIALS
) -> tuple[PipelineModel, dict[str, float], list[tuple]]:
    """(model refit on all days, metrics, a row for each trial): the setting is chosen on days that no fit saw, and measured
    on later days that neither the fits nor the choice saw. Every row of these days counts, on the grid of the fit's features."""
    days = split_days(labelled)
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label", weightCol="n")
    pipeline, trees = _expiry_pipeline()
    settings = trials(trees, n_trials, iterations)
    grid = feature_grid(days["fit"])
    fit, choose, measure = (written(on_grid(days[part], grid), f"expiry-{part}") for part in ("fit", "choose", "measure"))
    found = _Chosen(pipeline, settings, auc, _weighted(fit), choose)
    predicted = found.model.transform(measure)
    precision = auc.copy().setMetricName("areaUnderPR").evaluate(predicted)
    metrics = {
        "depth": float(found.setting[trees.maxDepth]), "choice_auc": found.figure, "test_auc": auc.evaluate(predicted),
        "test_average_precision": precision,
    }
    grid = feature_grid(labelled)
    refit = pipeline.fit(_weighted(written(on_grid(labelled, grid), "expiry-all")), found.setting)
    return PipelineModel([grid, *refit.stages]), metrics, found.report(settings)


#: What the scored table takes from the newest reading of a pair.
_NEWEST = (
    "brand", "division", "region", "on_hand_units", "days_to_expiry", "days_of_supply", "at_risk_expiry_units",
    "avg_daily_demand", "reorder_gap", "shelf_life_days", "in_transit_units", "reserved_units",
)


def _expiry_features(t: Tables) -> DataFrame:
    """The features of every reading with its label (null where its days are not all there yet), worked out where the readings
    lie and written once: the training rows and the newest readings both come from them."""
    features = readings(t).withColumn("reorder_gap", F.col("on_hand_units") - F.col("reorder_point"))
    labelled = risk.with_label_or_null(features, SERIES_KEYS)
    return written(labelled.select(*risk.SERIES, "reading_date", "day_idx", "stockout_flag", *_NEWEST, "label"), "expiry-features")


def _labelled(features: DataFrame) -> DataFrame:
    doubles = {c: F.col(c).cast("double") for c in risk.FEATURES}
    return features.filter("label IS NOT NULL").select("day_idx", "label", *risk.FEATURES).withColumns(doubles)


def expiry_model_scores(t: Tables) -> DataFrame:
    """The risk table with the classifier's probability as the expiry score."""
    features = _expiry_features(t)
    model, *_ = train_expiry_model(_labelled(features))
    recent = features.filter(F.col("day_idx") >= PANEL_DAYS - risk.RECENT_READINGS)
    latest = risk.risk_scores(recent, _NEWEST)
    probability = F.round(vector_to_array("probability")[1], 4)
    scored = risk.with_action(model.transform(latest).withColumn("expiry_risk_score", probability))
    return risk.with_names(scored, dim_product(t), dim_distribution_center(t)).select(
        "dc_id", "product_id", "product_name", "brand", "division", "region", "dc_name", "expiry_risk_score",
        "stockout_risk_score", "days_to_expiry", "on_hand_units", "days_of_supply", "at_risk_expiry_units",
        "avg_daily_demand", "recommended_action",
    )


def expiry_model_frame(t: Tables) -> DataFrame:
    """What of the scored table does not depend on the fit: all columns but the score and the action, whether the score lies
    within 0 and 1, and whether the action follows from the scores."""
    scored = expiry_model_scores(t)
    agrees = risk.with_action(scored.withColumnRenamed("recommended_action", "given"))
    return agrees.withColumns(
        {"score_in_bounds": F.expr("expiry_risk_score BETWEEN 0 AND 1"), "action_agrees": F.col("given") == F.col("recommended_action")}
    ).drop("expiry_risk_score", "recommended_action", "given")


def expiry_model_report(t: Tables) -> DataFrame:
    """The measured quality of the expiry model, one row per figure."""
    _, metrics, _ = train_expiry_model(_labelled(_expiry_features(t)))
    return t.spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")


_INPUTS = (
    "dow", "day", "month", "woy", "is_weekend", "lag_1", "lag_7", "roll7_mean", "roll7_std", "region_vec",
)


def _demand_pipeline() -> tuple[Pipeline, GBTRegressor]:
    trees = GBTRegressor(labelCol="demand", seed=SEED)
    stages = [
        StringIndexer(inputCol="region", outputCol="region_idx", handleInvalid="keep"),
        OneHotEncoder(inputCol="region_idx", outputCol="region_vec"),
        VectorAssembler(inputCols=list(_INPUTS), outputCol="features"),
        trees,
    ]
    return Pipeline(stages=stages), trees


def split_demand(features: DataFrame) -> dict[str, DataFrame]:
    """The last HORIZON days to measure on, as many before them to choose by, all earlier ones to fit."""
    back = lambda n: F.date_sub(features.agg(F.max("ds")).scalar(), n * forecast.HORIZON)
    day = F.col("ds")
    return {
        "fit": features.filter(day <= back(2)),
        "choose": features.filter((day > back(2)) & (day <= back(1))),
        "measure": features.filter(day > back(1)),
    }


def train_demand_model(features: DataFrame, iterations: int = 8, n_trials: int = DEMAND_TRIALS):
    """(model refit on all days, residual std per region, held-out metrics, a row for each trial). Spread and metrics come
    from the last days, which neither the fits nor the choice of the setting saw."""
    days = split_demand(features)
    rmse = RegressionEvaluator(labelCol="demand", metricName="rmse")
    pipeline, trees = _demand_pipeline()
    settings = trials(trees, n_trials, iterations)
    found = _Chosen(pipeline, settings, rmse, written(days["fit"], "demand-fit"), written(days["choose"], "demand-choose"))
    predicted = found.model.transform(days["measure"])
    spread, overall = residual_spread(predicted)
    metrics = {"val_rmse": rmse.evaluate(predicted), "val_mae": rmse.copy().setMetricName("mae").evaluate(predicted)}
    model = pipeline.fit(features, found.setting)
    return model, spread.withColumn("std", F.coalesce("std", overall)), metrics, found.report(settings)


def residual_spread(predicted: DataFrame) -> tuple[DataFrame, Column]:
    """(sample deviation of the residuals by region, that of all as a value: for regions that have too few)."""
    residual = F.col("demand") - F.col("prediction")
    overall = predicted.agg(F.coalesce(F.stddev_samp(residual), F.lit(1.0)).alias("overall")).scalar()
    return predicted.groupBy("region").agg(F.stddev_samp(residual).alias("std")), overall


def recursive_forecast(model: PipelineModel, series: DataFrame, horizon: int = forecast.HORIZON) -> DataFrame:
    """Forecast all regions at once, one model step per day ahead; each step's value joins the week it is fed by."""
    newest = Window.partitionBy("region").orderBy(F.col("ds").desc())
    week = (
        series.withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= forecast.SEASON)
        .groupBy("region")
        .agg(
            F.max("ds").alias("last_ds"),
            F.expr("transform(array_sort(collect_list(struct(ds, demand))), x -> cast(x.demand AS double))").alias(
                "week"
            ),
        )
    )
    state = week.withColumn("path", F.expr("cast(array() AS array<double>)"))
    for step in range(1, horizon + 1):
        row = state.withColumn("ds", F.date_add("last_ds", step)).withColumns(calendar("ds"))
        row = row.withColumns(
            {
                "lag_1": F.element_at("week", -1),
                "lag_7": F.element_at("week", 1),
                "roll7_mean": F.expr("aggregate(week, 0D, (a, x) -> a + x) / size(week)"),
            }
        ).withColumn(
            "roll7_std",
            F.expr("sqrt(aggregate(week, 0D, (a, x) -> a + pow(x - roll7_mean, 2)) / greatest(1, size(week) - 1))"),
        )
        value = F.greatest(F.lit(0.0), F.col("prediction"))
        state = model.transform(row).select(
            "region",
            "last_ds",
            F.expr("concat(IF(size(week) >= 7, slice(week, 2, 6), week), array(greatest(0D, prediction)))").alias("week"),
            F.array_append("path", value).alias("path"),
        )
    return state.select("region", "last_ds", F.posexplode("path").alias("pos", "level")).select(
        "region", F.expr("date_add(last_ds, pos + 1)").alias("forecast_date"), "level"
    )


_TRIAL = "trial int, depth int, step double, bins int, row_share double, figure double, chosen boolean"


def expiry_search(t: Tables) -> DataFrame:
    """The search for the classifier's setting, one row a trial: figure is the area under the ROC curve on the days of the choice."""
    *_, report = train_expiry_model(_labelled(_expiry_features(t)))
    return t.spark.createDataFrame(report, _TRIAL)


def naive_spread(t: Tables) -> DataFrame:
    """The residual spread of the last days by region for the forecast that repeats the week before."""
    series = written(serving.region_series(t), "demand-series")
    features = forecast.demand_features(series, "region").withColumn("demand", F.col("demand").cast("double"))
    predicted = split_demand(features)["measure"].withColumn("prediction", F.col("lag_7").cast("double"))
    spread, overall = residual_spread(predicted)
    return spread.select("region", F.round("std", 6).alias("std"), F.round(overall, 6).alias("overall"))


def demand_forecast(t: Tables) -> DataFrame:
    series = written(serving.region_series(t), "demand-series")
    features = forecast.demand_features(series, "region").withColumn("demand", F.col("demand").cast("double"))
    model, spread, *_ = train_demand_model(written(features, "demand-features"))
    ahead = recursive_forecast(model, series).join(spread, "region", "left")
    band = F.coalesce("std", F.lit(1.0)) * forecast.BAND_Z
    return ahead.select(
        "region",
        "forecast_date",
        F.round("level", 1).alias("forecast_units"),
        F.round(F.greatest(F.lit(0.0), F.col("level") - band), 1).alias("lower"),
        F.round(F.col("level") + band, 1).alias("upper"),
    )


def demand_forecast_frame(t: Tables) -> DataFrame:
    """What of the forecast does not depend on the fit: its regions and days, and that the band holds the forecast."""
    ordered = F.expr("lower >= 0 AND lower <= forecast_units AND forecast_units <= upper")
    return demand_forecast(t).select("region", "forecast_date", ordered.alias("band_in_order"))
