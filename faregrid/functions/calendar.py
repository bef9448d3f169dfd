"""Calendar expressions over a timestamp column."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# First hour of each part of the day, night being the rest.
DAY_PARTS = {"morning": (6, 12), "afternoon": (12, 17), "evening": (17, 22)}
MICROS = 1_000_000


def weekday_is_weekend(weekday: Column) -> Column:
    """1 for Saturday and Sunday, with Monday as 0."""
    return (weekday >= 5).cast("int")


def is_rush_hour(hour: Column, rush_hours: Sequence[int]) -> Column:
    return hour.isin(list(rush_hours)).cast("int")


def time_of_day(hour: Column) -> Column:
    chain = None
    for name, (start, stop) in DAY_PARTS.items():
        test = (hour >= start) & (hour < stop)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain.otherwise(F.lit("night"))


def calendar_columns(ts: Column, rush_hours: Sequence[int]) -> dict[str, Column]:
    """The calendar parts of a timestamp, by column name."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.day(ts),
        "month": F.month(ts),
        "year": F.year(ts),
        "is_weekend": weekday_is_weekend(weekday),
        "is_rush_hour": is_rush_hour(hour, rush_hours),
        "time_of_day": time_of_day(hour),
    }


def elapsed_micros(start: Column, stop: Column) -> Column:
    """Microseconds between two timestamps, whatever the session zone.

    The difference of naive timestamps is that of their clock readings.
    """
    seconds = (stop - start).cast("interval second").cast("decimal(18,6)")
    return (seconds * F.lit(MICROS)).cast("long")


def elapsed_minutes(start: Column, stop: Column) -> Column:
    """Minutes between two timestamps, with microsecond precision."""
    return elapsed_micros(start, stop) / F.lit(60.0 * MICROS)


def bin_number(ts: Column, origin: Column, bin_seconds: int) -> Column:
    """Index of the bin of ``ts``, bins starting at ``origin``."""
    return F.floor(elapsed_micros(origin, ts) / F.lit(float(bin_seconds) * MICROS)).cast("int")


def month_start(ts: Column) -> Column:
    """Midnight of the first day of the month, as a naive timestamp."""
    return F.trunc(ts, "month").cast("timestamp_ntz")


def naive(moment: datetime) -> Column:
    """A clock reading as a naive timestamp, whatever the session zone."""
    return F.lit(moment.isoformat(" ")).cast("timestamp_ntz")
