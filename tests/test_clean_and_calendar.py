import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from faregrid.functions.calendar import bin_number, calendar_columns, elapsed_minutes, month_start, naive
from faregrid.operators import clean, holidays, series, zones
from faregrid.params import DEFAULTS
from faregrid.sources import trips

TRIP = (
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, trip_distance double, total_amount double, "
    "PULocationID int"
)


def trip(minutes=10.0, distance=2.0, amount=12.0, zone=5):
    start = datetime(2024, 1, 1, 8, 0)
    return (start, datetime.fromtimestamp(start.timestamp() + minutes * 60), distance, amount, zone)


def kept(spark, rows, inclusive=True):
    df = clean.add_trip_metrics(spark.createDataFrame(rows, TRIP))
    return clean.filter_thresholds(df, DEFAULTS, inclusive).count()


@pytest.mark.parametrize(
    ("row", "inclusive", "strict"),
    [
        (trip(), 1, 1),
        (trip(minutes=0), 0, 0),
        (trip(minutes=1, distance=0.1), 1, 0),
        (trip(minutes=720, distance=23.0), 1, 0),
        (trip(distance=0.0), 1, 0),
        (trip(distance=23.1, minutes=100), 0, 0),
        (trip(amount=1000.0), 1, 0),
        (trip(amount=1000.01), 0, 0),
        (trip(amount=None), 0, 0),
        (trip(distance=None), 0, 0),
        (trip(minutes=10, distance=8.0), 0, 0),
        (trip(zone=0), 0, 1),
        (trip(zone=None), 0, 1),
    ],
)
def test_bounds(spark, row, inclusive, strict):
    assert kept(spark, [row], True) == inclusive
    assert kept(spark, [row], False) == strict


def test_speed_without_duration_is_null(spark):
    row = clean.add_trip_metrics(spark.createDataFrame([trip(minutes=0)], TRIP)).first()
    assert row.trip_duration_minutes == 0.0
    assert row.speed_mph is None


def test_missing_dropoff_stays_a_row(spark):
    start, _, *rest = trip()
    row = clean.add_trip_metrics(spark.createDataFrame([(start, None, *rest)], TRIP)).first()
    assert row.trip_duration_minutes is None and row.speed_mph is None


def test_microseconds_count(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' a, timestamp_ntz'2024-01-01 00:00:30.000006' b")
    got = df.select(elapsed_minutes(F.col("a"), F.col("b")).alias("m")).first().m
    assert got == pytest.approx(0.5000001, abs=1e-12)


def test_normalised_names_types_and_nan(spark):
    rows = [("2024-01-02 03:04:05", "not a time", float("nan")), ("2024-01-02 03:04:05", None, 1.0)]
    raw = spark.createDataFrame(rows, "tpep_pickup_datetime string, tpep_dropoff_datetime string, trip_distance double")
    got = trips.normalise_trips(raw).collect()
    assert got[0].pickup_datetime == datetime(2024, 1, 2, 3, 4, 5)
    assert got[0].dropoff_datetime is None
    assert [r.trip_distance for r in got] == [None, 1.0]


def test_median_imputation_without_the_column(spark):
    df = spark.range(3)
    assert clean.impute_median(df) is df


def test_median_imputation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (6.0,), (None,)], "passenger_count double")
    assert sorted(r[0] for r in clean.impute_median(df).collect()) == [1.0, 3.0, 3.0, 3.0, 6.0]


def test_funnel_of_nothing(spark):
    columns = TRIP + ", pickup_longitude double, pickup_latitude double, dropoff_longitude double, dropoff_latitude double"
    rows = clean.removal_funnel(spark.createDataFrame([], columns)).collect()
    assert [r.rows_left for r in rows] == [0] * 6
    assert all(r.fraction_left is None for r in rows)


def test_time_of_day_borders(spark):
    hours = [0, 5, 6, 11, 12, 16, 17, 21, 22, 23]
    df = spark.createDataFrame([(datetime(2024, 1, 6, h),) for h in hours], "t timestamp_ntz")
    parts = calendar_columns(F.col("t"), DEFAULTS.rush_hours)
    got = df.select(F.hour("t").alias("h"), parts["time_of_day"].alias("p"), parts["is_weekend"].alias("w")).orderBy("h").collect()
    assert [r.p for r in got] == ["night"] * 2 + ["morning"] * 2 + ["afternoon"] * 2 + ["evening"] * 2 + ["night"] * 2
    assert all(r.w == 1 for r in got)


def test_holiday_dates(spark):
    years = spark.createDataFrame([(2015,), (2016,), (2021,), (2022,)], "year int")
    days = {(r.date, r.observed) for r in holidays.holiday_calendar(years).collect()}
    for day in (date(2015, 1, 19), date(2015, 5, 25), date(2015, 9, 7), date(2015, 10, 12), date(2015, 11, 26),
                date(2016, 1, 18), date(2016, 2, 15), date(2016, 5, 30), date(2021, 6, 19)):
        assert (day, 0) in days
    assert (date(2015, 7, 3), 1) in days  # 4 July 2015 was a Saturday
    assert (date(2016, 12, 26), 1) in days  # 25 December 2016 was a Sunday
    assert (date(2021, 12, 31), 1) in days  # 1 January 2022 was a Saturday
    assert not any(d == date(2015, 6, 19) for d, _ in days)


def test_flags_around_a_turn_of_the_year(spark):
    rows = [(datetime(2016, 12, 31, 23),), (datetime(2017, 1, 1, 1),), (datetime(2017, 1, 3),), (datetime(2017, 3, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = holidays.add_holiday_flags(df, "t").orderBy("t").collect()
    flags = [(r.is_holiday, r.day_before_holiday, r.day_after_holiday) for r in got]
    # 1 January 2017 was a Sunday, observed on the 2nd.
    assert flags == [(0, 1, 0), (1, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_null_keys_are_no_cells(spark):
    columns = TRIP + ", cluster_id int, time_bin int, VendorID int, trip_duration_minutes double"
    start, stop, *rest = trip()
    rows = [(start, stop, *rest, 1, 0, 1, 10.0), (start, stop, *rest, None, 0, 1, 10.0), (start, stop, *rest, 1, 0, None, 10.0)]
    got = series.zone_bin_series(spark.createDataFrame(rows, columns)).collect()
    assert len(got) == 1
    assert (got[0].demand, got[0].revenue_total) == (1, 24.0)


def test_sum_of_missing_amounts_is_zero(spark):
    rows = [(1, 1, None, datetime(2024, 1, 1)), (1, 1, None, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "pickup_cluster int, pickup_bins int, total_amount double, pickup_datetime timestamp_ntz")
    got = series.add_fare_and_revenue(series.aggregate_cells(df)).first()
    assert (got.demand, got.total_amount, got.avg_fare, got.revenue) == (2, 0.0, 0.0, 0.0)
    assert "trip_distance" not in got.asDict()


def test_bins_from_a_given_origin(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 25),)], "pickup_datetime timestamp_ntz")
    assert series.add_time_bin(df, 600, origin=datetime(2024, 1, 1)).first().time_bin == 2


def test_nearest_centre_tie_and_missing_point(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (9.0, 9.0)], "pickup_latitude double, pickup_longitude double")
    got = zones.assign_nearest_centre(df, [(4, 0.0, 1.0), (2, 0.0, -1.0), (9, 8.0, 8.0)]).collect()
    assert [r.pickup_cluster for r in got] == [2, None, 9]


@pytest.mark.parametrize("n", [40, 41, 1500])
def test_any_number_of_centres(spark, n):
    rng = random.Random(n)
    centres = [(i, rng.random(), rng.random()) for i in range(n)] + [(n, 0.5, 0.5), (n + 1, 0.5, 0.5)]
    points = [(rng.random(), rng.random()) for _ in range(50)] + [(0.5, 0.5), (None, 0.1)]
    df = spark.createDataFrame(points, "pickup_latitude double, pickup_longitude double")
    got = [r.pickup_cluster for r in zones.assign_nearest_centre(df, centres).collect()]
    want = [min((((a - x) * (a - x) + (b - y) * (b - y)), i) for i, x, y in centres)[1] if a is not None else None for a, b in points]
    assert got == want
    with pytest.raises(ValueError):
        zones.assign_nearest_centre(df, [])



def test_zone_coordinates_from_a_table(spark):
    df = spark.createDataFrame([(1,), (2,)], "cluster_id int")
    table = spark.createDataFrame([(1, 10.0, 20.0)], "zone_id int, lat double, lon double")
    got = {r.cluster_id: (r.lat, r.lon) for r in zones.join_zone_coordinates(df, table).collect()}
    assert got == {1: (10.0, 20.0), 2: (zones.DEFAULT_LATITUDE, zones.DEFAULT_LONGITUDE)}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_durations_and_bins_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 01:30:00' a, timestamp_ntz'2024-03-10 03:10:00' b")
        row = df.select(
            elapsed_minutes(F.col("a"), F.col("b")).alias("m"),
            bin_number(F.col("b"), month_start(F.col("a")), 600).alias("bin"),
            bin_number(F.col("b"), naive(datetime(2024, 3, 10)), 600).alias("day_bin"),
        ).first()
        assert tuple(row) == (100.0, 9 * 144 + 19, 19)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("continuous", [False, True])
def test_median_of_counts_and_of_a_continuous_column(spark, continuous):
    df = spark.createDataFrame([(1, 0.25), (2, None), (3, 7.5), (4, 1.125), (5, 2.0)], "i int, passenger_count double")
    got = {r.i: r.passenger_count for r in clean.impute_median(df, continuous=continuous).collect()}
    assert got == {1: 0.25, 2: 1.5625, 3: 7.5, 4: 1.125, 5: 2.0}
