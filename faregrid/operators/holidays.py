"""US holiday calendar and holiday flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Holidays on one date, as (name, month, day, first year).
FIXED_DATES = (
    ("New Year's Day", 1, 1, 1870),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1870),
    ("Veterans Day", 11, 11, 1978),
    ("Christmas Day", 12, 25, 1870),
)
# Holidays on a weekday of a month, as (name, month, weekday with
# Monday as 0, which one with -1 for the last, first year).
WEEKDAY_DATES = (
    ("Martin Luther King Jr. Day", 1, 0, 3, 1986),
    ("Washington's Birthday", 2, 0, 3, 1971),
    ("Memorial Day", 5, 0, -1, 1971),
    ("Labor Day", 9, 0, 1, 1894),
    ("Columbus Day", 10, 0, 2, 1971),
    ("Thanksgiving Day", 11, 3, 4, 1942),
)


def _nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    if nth < 0:
        last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
        return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def holiday_calendar(years: DataFrame) -> DataFrame:
    """Holidays of the years in column ``year``: date, name, observed.

    A holiday on a Saturday is also observed the Friday before and one on a
    Sunday the Monday after, which may fall in the neighbouring year.
    """
    year = F.col("year")
    candidates = [
        F.when(year >= since, F.struct(F.lit(name).alias("name"), F.make_date(year, F.lit(month), F.lit(day)).alias("date")))
        for name, month, day, since in FIXED_DATES
    ] + [
        F.when(year >= since, F.struct(F.lit(name).alias("name"), _nth_weekday(year, month, weekday, nth).alias("date")))
        for name, month, weekday, nth, since in WEEKDAY_DATES
    ]
    actual = (
        years.select(F.col("year").cast("int").alias("year"))
        .where("year is not null")
        .distinct()
        .select(F.explode(F.array_compact(F.array(*candidates))).alias("h"))
        .select("h.*")
    )
    weekday = F.weekday("date")
    shift = F.when(weekday == 5, F.date_sub("date", 1)).when(weekday == 6, F.date_add("date", 1))
    both = F.array_compact(
        F.array(
            F.struct(F.col("date"), F.lit(0).alias("observed")),
            F.when(shift.isNotNull(), F.struct(shift.alias("date"), F.lit(1).alias("observed"))),
        )
    )
    return actual.select("name", F.explode(both).alias("d")).select("d.date", "name", "d.observed")


def holiday_years(df: DataFrame, column: str) -> DataFrame:
    """Years touched by a date column and their neighbours.

    The neighbours supply days next to a turn of the year. The result has one
    row per calendar year, so the calendar made from it is small.
    """
    year = F.year(F.col(column))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(year.alias("year"))
        .agg(F.count(F.lit(1)))
        .select(F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("year"))
        .distinct()
    )


def holiday_flags(calendar: DataFrame) -> DataFrame:
    """One row per date that is, precedes or follows a holiday."""
    days = calendar.select("date").distinct()
    marks = F.array(
        F.struct(F.col("date"), F.lit(1).alias("h"), F.lit(0).alias("b"), F.lit(0).alias("a")),
        F.struct(F.date_sub("date", 1).alias("date"), F.lit(0).alias("h"), F.lit(1).alias("b"), F.lit(0).alias("a")),
        F.struct(F.date_add("date", 1).alias("date"), F.lit(0).alias("h"), F.lit(0).alias("b"), F.lit(1).alias("a")),
    )
    return (
        days.select(F.inline(marks))
        .groupBy("date")
        .agg(
            F.max("h").alias("is_holiday"),
            F.max("b").alias("day_before_holiday"),
            F.max("a").alias("day_after_holiday"),
        )
    )


def add_holiday_flags(df: DataFrame, column: str, calendar: DataFrame | None = None) -> DataFrame:
    """Flags for the date of ``column``: on, before and after a holiday.

    The flag table holds at most three dates per holiday, about forty a year;
    without ``calendar`` the years come from ``df``.
    """
    if calendar is None:
        calendar = holiday_calendar(holiday_years(df, column))
    names = ["is_holiday", "day_before_holiday", "day_after_holiday"]
    flags = holiday_flags(calendar).withColumnRenamed("date", "_date")
    joined = df.withColumn("_day", F.to_date(F.col(column))).join(flags, F.col("_day") == F.col("_date"), "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in names}).drop("_day", "_date")
