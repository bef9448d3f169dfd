"""Forecast quality metrics and prediction intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions.economics import per_unit
from faregrid.plans.thresholds import attach, exact_quantiles


def one_pass_metrics(actual: str, predicted: str) -> dict[str, Column]:
    """Every metric a single aggregation can give, by name.

    ``mape_pct`` has no guard for zero actuals beyond leaving them out of the
    mean; ``mape`` is a fraction and infinite where all actuals are zero.
    """
    error = F.col(actual) - F.col(predicted)
    paired = error.isNotNull()
    a = F.when(paired, F.col(actual).cast("double"))
    b = F.when(paired, F.col(predicted).cast("double"))
    n = F.count(error)
    squares = F.sum(error * error)
    spread = F.var_pop(a)
    r2 = F.when(spread == 0, F.when(squares == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        1.0 - F.try_divide(squares, n * spread)
    )
    nonzero = a != 0
    share = F.abs(per_unit(error, F.col(actual)))
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.try_divide(squares, n)),
        "r2": r2,
        "mape": F.when(F.count_if(nonzero) == 0, F.lit(float("inf"))).otherwise(F.avg(F.when(nonzero, share))),
        "mape_pct": F.avg(share) * 100.0,
        "wmape": per_unit(F.sum(F.abs(error)), F.sum(F.abs(a))) * 100.0,
        "max_error": F.max(F.abs(error)),
        "mean_actual": F.avg(a),
        "mean_predicted": F.avg(b),
        "std_actual": F.stddev_pop(a),
        "std_predicted": F.stddev_pop(b),
    }


def metrics(
    df: DataFrame, actual: str, predicted: str, names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The named one-pass metrics, per group if ``by`` is given."""
    known = one_pass_metrics(actual, predicted)
    return df.groupBy(*by).agg(*[known[name].alias(name) for name in names])


# The metrics of a full evaluation.
FULL = (
    "mae",
    "rmse",
    "mape",
    "r2",
    "max_error",
    "mean_actual",
    "mean_predicted",
    "std_actual",
    "std_predicted",
)


def full_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """All metrics including the median absolute error, per group if asked.

    ``df`` is read four times, three of them for the exact median.
    """
    one_pass = metrics(df, actual, predicted, FULL, by)
    errors = df.select(*by, F.abs(F.col(actual) - F.col(predicted)).alias("_error"))
    medians = exact_quantiles(errors, {"median_ae": ("_error", 0.5)}, by)
    return attach(one_pass, medians, by)


def prediction_intervals(df: DataFrame, value: str, by: Sequence[str], confidence: float = 0.9) -> DataFrame:
    """Lower and upper percentile of the samples of each point."""
    tail = (1.0 - confidence) / 2.0
    return exact_quantiles(df, {"lower": (value, tail), "upper": (value, 1.0 - tail)}, by)


def add_interval_width(df: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    return df.withColumn("interval_width", F.col(upper) - F.col(lower))


def add_uncertainty_flag(
    df: DataFrame, threshold: float = 0.3, lower: str = "lower", upper: str = "upper"
) -> DataFrame:
    """1 where the width relative to the midpoint exceeds ``threshold``."""
    middle = (F.col(lower) + F.col(upper)) / 2.0
    relative = F.when(middle != 0, F.try_divide(F.col(upper) - F.col(lower), middle)).otherwise(F.lit(0.0))
    return df.withColumn("relative_width", relative).withColumn(
        "high_uncertainty", (F.col("relative_width") > threshold).cast("int")
    )
