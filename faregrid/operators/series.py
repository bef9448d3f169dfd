"""Zone x time-bin series from trips.

Calendar and holiday columns describe the first trip of a cell. They all
follow from its timestamp, so the aggregation keeps only a minimum, its
buffers stay fixed-width (hash aggregation with map-side partials) and the
flags are computed on the far smaller series.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions.calendar import bin_number, calendar_columns, month_start, naive
from faregrid.functions.economics import per_unit
from faregrid.operators.holidays import add_holiday_flags
from faregrid.operators.zones import attach_centres
from faregrid.params import DEFAULTS, Params

MEASURES = ("total_amount", "trip_distance", "passenger_count")


def _earliest(df: DataFrame, ts: str) -> Column:
    return df.agg(F.min(ts).alias("t")).scalar()


def add_time_bin(
    df: DataFrame, bin_seconds: int, ts: str = "pickup_datetime", origin: datetime | None = None
) -> DataFrame:
    """``time_bin`` counted from the earliest timestamp of ``df``.

    Finding it is one more pass over ``ts`` and the filter columns; give
    ``origin`` where it is known.
    """
    start = naive(origin) if origin is not None else _earliest(df, ts)
    return df.withColumn("time_bin", bin_number(F.col(ts), start, bin_seconds))


def add_month_bin(
    df: DataFrame, bin_seconds: int, ts: str = "pickup_datetime", origin: datetime | None = None
) -> DataFrame:
    """``pickup_bins`` counted from the start of the earliest month; see above for ``origin``."""
    start = naive(origin) if origin is not None else _earliest(df, ts)
    return df.withColumn("pickup_bins", bin_number(F.col(ts), month_start(start), bin_seconds))


def zone_bin_series(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Demand, revenue and means per (cluster_id, time_bin), with flags."""
    cells = (
        df.where(F.col("cluster_id").isNotNull() & F.col("time_bin").isNotNull())
        .groupBy("cluster_id", "time_bin")
        .agg(
            F.count("VendorID").alias("demand"),
            F.coalesce(F.sum("total_amount"), F.lit(0.0)).alias("revenue_total"),
            F.avg("total_amount").alias("avg_fare"),
            F.avg("trip_distance").alias("avg_distance"),
            F.avg("trip_duration_minutes").alias("avg_duration"),
            F.min("pickup_datetime").alias("_first"),
        )
    )
    parts = calendar_columns(F.col("_first"), p.rush_hours)
    wanted = ("hour", "day_of_week", "is_weekend", "is_rush_hour")
    return cells.withColumns({name: parts[name] for name in wanted}).drop("_first")


def aggregate_cells(
    df: DataFrame,
    columns: Sequence[str] = MEASURES,
    zone: str = "pickup_cluster",
    bins: str = "pickup_bins",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Trip count per cell and the sums of those ``columns`` that exist."""
    present = [name for name in columns if name in df.columns]
    return (
        df.where(F.col(zone).isNotNull() & F.col(bins).isNotNull())
        .groupBy(zone, bins)
        .agg(
            F.count("pickup_datetime").alias("demand"),
            *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in present],
            *extra,
        )
    )


def add_fare_and_revenue(df: DataFrame) -> DataFrame:
    """Average fare and revenue, where amounts were aggregated."""
    if "total_amount" not in df.columns:
        return df
    return df.withColumn("avg_fare", per_unit(F.col("total_amount"), F.col("demand"))).withColumn(
        "revenue", F.col("total_amount")
    )


def library_cells(df: DataFrame) -> DataFrame:
    """Cells with fare and revenue, and the first pickup of each cell."""
    return add_fare_and_revenue(aggregate_cells(df, extra=[F.min("pickup_datetime").alias("first_pickup")]))


def enrich_cells(
    cells: DataFrame,
    centres: Sequence[tuple[int, float, float]],
    p: Params = DEFAULTS,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Calendar, holiday and centre columns on :func:`library_cells`.

    Without a ``calendar`` the holiday years come from a second read of
    ``cells``, so it should be a written table.
    """
    parts = calendar_columns(F.col("first_pickup"), p.rush_hours)
    renamed = {"hour_of_day" if name == "hour" else name: column for name, column in parts.items()}
    flagged = add_holiday_flags(cells.withColumns(renamed), "first_pickup", calendar)
    return attach_centres(flagged, centres).drop("first_pickup")
