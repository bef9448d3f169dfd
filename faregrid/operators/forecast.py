"""Naive forecast and the profit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.functions.economics import cost_columns, per_unit
from faregrid.params import DEFAULTS, Params

def naive_forecast(features: DataFrame) -> DataFrame:
    """Demand as its running average, revenue at the previous row's fare.

    ``features`` comes from ``main_features(..., previous=["avg_fare"])``. Rows
    without an average (the first kept row of a zone) are dropped.
    """
    return (
        features.where(F.col("exp_avg").isNotNull() & F.col("prev_avg_fare").isNotNull())
        .withColumn("demand_pred", F.col("exp_avg"))
        .withColumn("revenue_pred", F.col("exp_avg") * F.col("prev_avg_fare"))
        .drop("prev_avg_fare", "pos")
    )


def add_fare(df: DataFrame) -> DataFrame:
    """Predicted fare from predicted revenue and demand."""
    return df.withColumn("avg_fare_pred", per_unit(F.col("revenue_pred"), F.col("demand_pred")))


def add_costs(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return df.withColumns(cost_columns(F.col("revenue_pred"), p))


def add_profit(df: DataFrame) -> DataFrame:
    return df.withColumn("profit_pred", F.col("revenue_pred") - F.col("total_costs")).withColumn(
        "margin_pred", per_unit(F.col("profit_pred"), F.col("revenue_pred"))
    )


def predictions_table(forecast: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Fare, costs and profit on a table with predicted demand and revenue."""
    return forecast.transform(add_fare).transform(add_costs, p).transform(add_profit)
