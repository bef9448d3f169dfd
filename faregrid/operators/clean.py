"""Trip metrics, filters, imputation and the removal funnel.

Everything but the median is a narrow expression, so a whole cleaning chain
runs in the scan stage.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions.calendar import elapsed_minutes
from faregrid.functions.economics import per_unit
from faregrid.params import DEFAULTS, Params, Range
from faregrid.plans.columns import with_computed
from faregrid.plans.thresholds import exact_quantiles, value_count_quantile

# Columns a library-path trip may not lack.
CRITICAL = (
    "pickup_datetime",
    "dropoff_datetime",
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
)


def _all(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _within(name: str, bounds: Range, inclusive: bool) -> Column:
    value = F.col(name)
    if inclusive:
        return value.between(bounds.low, bounds.high)
    return (value > bounds.low) & (value < bounds.high)


def add_trip_metrics(df: DataFrame) -> DataFrame:
    """Duration in minutes and speed; a trip of no duration has no speed.

    The duration is computed once, not anew for each bound on it.
    """
    minutes = elapsed_minutes(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    return with_computed(df, {"trip_duration_minutes": minutes}).withColumn(
        "speed_mph", per_unit(F.col("trip_distance"), F.col("trip_duration_minutes") / 60.0)
    )


def threshold_test(p: Params = DEFAULTS, inclusive: bool = True) -> Column:
    """All numeric bounds; a NULL in any of them fails.

    Bounds on stored columns come first: they reach the scan and spare the
    derived ones.
    """
    return _all(
        [
            _within("trip_distance", p.distance_miles, inclusive),
            _within("total_amount", p.amount, inclusive),
            _within("trip_duration_minutes", p.trip_minutes, inclusive),
            _within("speed_mph", p.speed_mph, inclusive),
        ]
    )


def filter_thresholds(df: DataFrame, p: Params = DEFAULTS, inclusive: bool = True) -> DataFrame:
    """Numeric bounds; the inclusive form also wants a positive zone."""
    test = threshold_test(p, inclusive)
    if inclusive:
        test = test & (F.col("PULocationID") > 0)
    return df.where(test)


def box_test(p: Params = DEFAULTS) -> Column:
    return _all(
        [
            _within(f"{end}_{axis}", bounds, True)
            for end in ("pickup", "dropoff")
            for axis, bounds in (("longitude", p.box_longitude), ("latitude", p.box_latitude))
        ]
    )


def filter_box(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Pickup and dropoff inside the bounding box."""
    return df.where(box_test(p))


def drop_critical_nulls(df: DataFrame) -> DataFrame:
    return df.dropna(subset=list(CRITICAL))


def impute_median(df: DataFrame, column: str = "passenger_count", continuous: bool = False) -> DataFrame:
    """Fill NULLs with the column's median, if the column exists.

    The median comes from value counts: a count column has few distinct
    values, so its state stays small whatever the number of trips. For a
    ``continuous`` column it comes from the bounded passes of exact quantiles.
    """
    if column not in df.columns:
        return df
    found = exact_quantiles(df, {"q": (column, 0.5)}) if continuous else value_count_quantile(df, column, 0.5)
    median = found.scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median))


def drop_missing_metrics(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["trip_duration_minutes", "speed_mph"])


def clean_library(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Nulls, imputation, box, metrics, strict bounds, missing metrics."""
    return (
        df.transform(drop_critical_nulls)
        .transform(impute_median)
        .transform(filter_box, p)
        .transform(add_trip_metrics)
        .transform(filter_thresholds, p, False)
        .transform(drop_missing_metrics)
    )


def clean_main(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Metrics, then the inclusive bounds."""
    return df.transform(add_trip_metrics).transform(filter_thresholds, p, True)


def removal_funnel(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows left after each library step and after the main filter, in one pass."""
    measured = add_trip_metrics(df)
    critical = _all([F.col(name).isNotNull() for name in CRITICAL])
    boxed = critical & box_test(p)
    bounded = boxed & threshold_test(p, inclusive=False)
    final = bounded & F.col("trip_duration_minutes").isNotNull() & F.col("speed_mph").isNotNull()
    main = threshold_test(p, inclusive=True) & (F.col("PULocationID") > 0)
    steps = [
        ("initial", F.lit(True)),
        ("critical columns", critical),
        ("geographic box", boxed),
        ("thresholds", bounded),
        ("metrics present", final),
        ("main filter", main),
    ]
    counted = measured.agg(*[F.count_if(test).alias(f"n{i}") for i, (_, test) in enumerate(steps)])
    rows = [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"n{i}").alias("rows_left"))
        for i, (name, _) in enumerate(steps)
    ]
    return counted.select("n0", F.inline(F.array(*rows))).select(
        "step_no",
        "step",
        "rows_left",
        per_unit(F.col("rows_left"), F.col("n0")).alias("fraction_left"),
        per_unit(F.col("n0") - F.col("rows_left"), F.col("n0")).alias("fraction_removed"),
    )
