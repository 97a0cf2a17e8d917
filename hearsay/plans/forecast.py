"""Trends: ridge regression on one feature in closed form, and the next steps of it.

The history is one row per day or hour; its fit is a single aggregate row, the
future is generated from that row.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions import clock
from hearsay.functions.rates import total_interaction

REG = 0.01
HORIZON_DAYS = 7
HORIZON_HOURS = 24


def daily_class_counts(predicted: DataFrame, tz: str | None = None) -> DataFrame:
    """``date, negative_count, positive_count`` of ``predicted(created_at, prediction)``."""
    dated = predicted.select(clock.day(F.col("created_at"), tz).alias("date"), "prediction")
    return dated.filter(F.col("date").isNotNull()).groupBy("date").agg(
        F.count_if(F.col("prediction") == 0).alias("negative_count"),
        F.count_if(F.col("prediction") == 1).alias("positive_count"),
    )


def history_range(daily: DataFrame) -> DataFrame:
    """``first_date, last_date, last_index``: the days covered, index 0 is the first day."""
    first, last = F.min("date"), F.max("date")
    return daily.agg(
        first.alias("first_date"), last.alias("last_date"), F.datediff(last, first).alias("last_index")
    )


def _fit(history: DataFrame, reg: float) -> DataFrame:
    """One row: ``slope, mean_x, mean_y, last_x, last_at`` of ``history(x, y, at)``.

    Ridge regression on a standardised feature shrinks the plain slope by
    ``1 + reg / stddev(y)``.  One point, or equal ones, give slope 0.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    spread = F.stddev_pop(y)
    slope = F.when(spread > 0, F.regr_slope(y, x) / (1 + F.lit(reg) / spread))
    return history.agg(
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.max("x").alias("last_x"), F.max("at").alias("last_at"),
    )


def _next(fit: DataFrame, horizon: int) -> DataFrame:
    """``last_at, step, predicted`` of the next ``horizon`` steps; nothing for no history."""
    known = fit.filter(F.col("last_x").isNotNull())
    steps = known.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    ahead = F.col("last_x") + F.col("step")
    predicted = F.col("mean_y") + F.col("slope") * (ahead - F.col("mean_x"))
    return steps.select("last_at", "step", predicted.alias("predicted"))


def _as_count(predicted: Column, kind: str) -> Column:
    """Not below 0, cut to an integer (after removing float noise)."""
    return F.greatest(F.round(predicted, 6), F.lit(0.0)).cast(kind)


def trend_forecast(
    daily: DataFrame,
    horizon: int = HORIZON_DAYS,
    reg: float = REG,
    feature: str = "days",
    start_date: str | None = None,
) -> DataFrame:
    """``date, predicted_positive_count`` for the days after the last one.

    ``feature="days"`` regresses on days since the first day, ``"row"`` on the
    position of a day among the days present.  With ``start_date``, an empty
    history gives zeros from the day after it, otherwise nothing.
    """
    if feature == "days":
        # Shifting x by a constant changes no prediction, so day 0 may be any day.
        x = F.unix_date("date")
    elif feature == "row":
        # One row per day: small enough for a single window.
        x = F.row_number().over(Window.orderBy("date")) - 1
    else:
        raise ValueError(f"unknown feature {feature!r}")
    history = daily.select(x.alias("x"), F.col("positive_count").alias("y"), F.col("date").alias("at"))
    result = _next(_fit(history, reg), horizon).select(
        F.date_add("last_at", F.col("step")).alias("date"),
        _as_count(F.col("predicted"), "int").alias("predicted_positive_count"),
    )
    if start_date is None:
        return result
    empty = daily.agg(F.count("*").alias("days")).filter(F.col("days") == 0)
    zeros = empty.select(
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ).select(
        F.date_add(F.lit(start_date).cast("date"), F.col("step")).alias("date"),
        F.lit(0).alias("predicted_positive_count"),
    )
    return result.unionByName(zeros)


def hourly_interaction(comments: DataFrame, tz: str | None = None) -> DataFrame:
    """``x, y``: hour index and total interaction of the hours that have comments."""
    hours = comments.select(
        clock.hour_index(F.col("created_at"), tz).alias("x"), total_interaction().alias("total")
    )
    return hours.filter(F.col("x").isNotNull()).groupBy("x").agg(F.sum("total").alias("y"))


def hourly_forecast(
    comments: DataFrame, horizon: int = HORIZON_HOURS, reg: float = REG, tz: str | None = None
) -> DataFrame:
    """``hour_start, predicted_interaction`` for the hours after the last one."""
    return hourly_forecast_of(hourly_interaction(comments, tz), horizon, reg)


def hourly_forecast_of(hours: DataFrame, horizon: int = HORIZON_HOURS, reg: float = REG) -> DataFrame:
    history = hours.withColumn("at", F.col("x"))
    ahead = _next(_fit(history, reg), horizon)
    return ahead.select(
        clock.hour_start(F.col("last_at") + F.col("step")).alias("hour_start"),
        _as_count(F.col("predicted"), "bigint").alias("predicted_interaction"),
    )


def fit_trend_model(daily: DataFrame, reg: float = REG) -> LinearRegressionModel:
    """The same fit as a model that can be stored (feature: days since the first day)."""
    first = daily.agg(F.min("date")).scalar()
    dated = daily.select(F.datediff("date", first).alias("days_since_start"), "positive_count")
    features = VectorAssembler(inputCols=["days_since_start"], outputCol="features").transform(dated)
    return LinearRegression(featuresCol="features", labelCol="positive_count", regParam=reg).fit(features)
