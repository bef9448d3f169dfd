"""Sources, cleaning, calendar, zones and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import base_sql as b
from bindings import tables as t
from bindings.registry import query
from faregrid.functions.calendar import calendar_columns
from faregrid.operators import clean, holidays, series, zones
from faregrid.plans import revenue
from faregrid.sources import predictions as prediction_files
from faregrid.sources import sinks, trips
from faregrid.storage import fresh_path, staged

P = t.PARAMS


@query("s1_trip_scan", f"WITH {b.TRIPS} -- result\nSELECT * FROM trips",
       "trip_distance total_amount passenger_count pickup_latitude pickup_longitude dropoff_latitude dropoff_longitude")
def s1(spark, sf):
    path = fresh_path(spark, "trip-files")
    t.trips(spark, sf).write.parquet(path)
    return trips.load_trips(spark, path)


@query("s2_scan_by_role", f"""WITH {b.TRIPS} -- result
    SELECT CASE WHEN pickup_datetime < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'test' END AS role, count(*) AS n_rows,
      sum(total_amount) AS amount FROM trips GROUP BY 1""", "amount")
def s2(spark, sf):
    path = fresh_path(spark, "trips-by-half")
    half = F.when(F.col("pickup_datetime") < F.lit("2024-01-16").cast("timestamp_ntz"), "first").otherwise("second")
    t.trips(spark, sf).withColumn("half", half).write.partitionBy("half").parquet(path)
    scanned = trips.load_by_role(spark, {"train": [f"{path}/half=first"], "test": [f"{path}/half=second"]})
    return scanned.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_amount").alias("amount"))


@query("s3_normalised_columns", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, pickup_datetime, dropoff_datetime, CASE WHEN trip_distance > 23 THEN NULL ELSE trip_distance END
      AS trip_distance FROM trips""", "trip_distance")
def s3(spark, sf):
    raw = t.trips(spark, sf).select(
        "trip_id",
        F.col("pickup_datetime").alias("tpep_pickup_datetime"),
        F.col("dropoff_datetime").alias("tpep_dropoff_datetime"),
        F.when(F.col("trip_distance") > 23, F.lit(float("nan"))).otherwise(F.col("trip_distance")).alias("trip_distance"),
    )
    return trips.normalise_trips(raw)


PRED_DOUBLES = ("revenue_total avg_fare avg_distance avg_duration exp_avg demand_pred revenue_pred avg_fare_pred "
                "driver_costs processing_fees ops_costs total_costs profit_pred margin_pred")


@query("s4_csv_predictions_scan", f"WITH {b.PREDICTIONS} -- result\nSELECT * FROM predictions", PRED_DOUBLES)
def s4(spark, sf):
    path = fresh_path(spark, "predictions-csv")
    prediction_files.write_predictions(t.predictions(spark, sf), path, fmt="csv")
    return prediction_files.read_predictions_csv(spark, path)


@query("s5_predictions_sink", f"""WITH {b.PREDICTIONS} -- result
    SELECT day_of_week, count(*) AS n_rows, sum(revenue_pred) AS revenue FROM predictions GROUP BY 1""", "revenue")
def s5(spark, sf):
    path = fresh_path(spark, "predictions-by-day")
    prediction_files.write_predictions(t.predictions(spark, sf), path, partition_by=["day_of_week"])
    written = spark.read.parquet(path)
    return written.groupBy("day_of_week").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("revenue_pred").alias("revenue"))


SUMMARY_PARTS = ("demand_wmape", "demand_mae", "demand_rmse", "demand_r2", "revenue_wmape", "revenue_mae",
                 "revenue_rmse", "revenue_r2", "avg_predicted_demand", "avg_predicted_revenue",
                 "avg_predicted_profit", "avg_margin")


def _sql_metrics(prefix, a, p):
    return f"""sum(abs({a} - {p})) / sum(abs({a})) * 100 AS {prefix}_wmape, avg(abs({a} - {p})) AS {prefix}_mae,
      sqrt(avg(pow({a} - {p}, 2))) AS {prefix}_rmse,
      1 - sum(pow({a} - {p}, 2)) / (count(*) * var_pop({a})) AS {prefix}_r2"""


@query("s6_summary_sink", f"""WITH {b.PREDICTIONS} -- result
    SELECT {_sql_metrics("demand", "demand", "demand_pred")}, {_sql_metrics("revenue", "revenue_total", "revenue_pred")},
      avg(demand_pred) AS avg_predicted_demand, avg(revenue_pred) AS avg_predicted_revenue,
      avg(profit_pred) AS avg_predicted_profit, avg(margin_pred) AS avg_margin FROM predictions""",
       " ".join(SUMMARY_PARTS))
def s6(spark, sf):
    path = fresh_path(spark, "summary")
    summary = sinks.run_summary(t.predictions(spark, sf))
    sinks.write_json(summary, path)
    read = spark.read.schema(summary.schema).json(path)
    model = [F.col(f"{m}_model.{n}").alias(f"{m}_{n}") for m in ("demand", "revenue") for n in ("wmape", "mae", "rmse", "r2")]
    return read.select(*model, "business_metrics.*")


@query("s7_zone_mapping", f"""WITH {b.CLEAN} -- result
    SELECT cluster_id AS zone_id, avg(trip_distance) AS avg_trip_distance FROM cleaned GROUP BY 1""", "avg_trip_distance")
def s7(spark, sf):
    return staged(sinks.zone_mapping(zones.assign_zone(clean.clean_main(t.trips(spark, sf), P))), "zone-mapping")


@query("c1_trip_metrics", f"""WITH {b.MEASURED} -- result
    SELECT trip_id, trip_duration_minutes, speed_mph FROM measured""", "trip_duration_minutes speed_mph")
def c1(spark, sf):
    return clean.add_trip_metrics(t.trips(spark, sf)).select("trip_id", "trip_duration_minutes", "speed_mph")


@query("c2_inclusive_thresholds", f"WITH {b.CLEAN} -- result\nSELECT trip_id, total_amount FROM cleaned", "total_amount")
def c2(spark, sf):
    return clean.clean_main(t.trips(spark, sf), P).select("trip_id", "total_amount")


@query("c3_strict_thresholds", f"""WITH {b.MEASURED} -- result
    SELECT trip_id, total_amount FROM measured
    WHERE trip_distance > 0 AND trip_distance < 23 AND trip_duration_minutes > 1 AND trip_duration_minutes < 720
      AND speed_mph > 0 AND speed_mph < 45.31 AND total_amount > 0 AND total_amount < 1000""", "total_amount")
def c3(spark, sf):
    measured = clean.add_trip_metrics(t.trips(spark, sf))
    return clean.filter_thresholds(measured, P, inclusive=False).select("trip_id", "total_amount")


@query("c4_bounding_box", f"""WITH {b.TRIPS} -- result
    SELECT trip_id FROM trips WHERE pickup_longitude BETWEEN -74.15 AND -73.7004
      AND pickup_latitude BETWEEN 40.5774 AND 40.9176 AND dropoff_longitude BETWEEN -74.15 AND -73.7004
      AND dropoff_latitude BETWEEN 40.5774 AND 40.9176""")
def c4(spark, sf):
    return clean.filter_box(t.trips(spark, sf), P).select("trip_id")


def _with_gaps(spark, sf):
    """Trips of users with error events lack the dropoff longitude."""
    return t.trips(spark, sf).withColumn(
        "dropoff_longitude", F.when(F.col("passenger_count").isNotNull(), F.col("dropoff_longitude"))
    )


@query("c5_drop_critical_nulls", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, pickup_datetime FROM trips WHERE passenger_count IS NOT NULL""")
def c5(spark, sf):
    return clean.drop_critical_nulls(_with_gaps(spark, sf)).select("trip_id", "pickup_datetime")


@query("c6_median_imputation", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, coalesce(passenger_count, (SELECT quantile_cont(passenger_count, 0.5) FROM trips)) AS passenger_count
    FROM trips""", "passenger_count")
def c6(spark, sf):
    return clean.impute_median(t.trips(spark, sf)).select("trip_id", "passenger_count")


@query("c7_drop_missing_metrics", f"""WITH {b.MEASURED} -- result
    SELECT trip_id, speed_mph FROM measured WHERE speed_mph IS NOT NULL""", "speed_mph")
def c7(spark, sf):
    return clean.drop_missing_metrics(clean.add_trip_metrics(t.trips(spark, sf))).select("trip_id", "speed_mph")


@query("c8_library_cleaning", f"""WITH {b.LIBRARY_CLEAN} -- result
    SELECT trip_id, passenger_count, trip_duration_minutes, speed_mph, total_amount FROM library_clean""",
       "passenger_count trip_duration_minutes speed_mph total_amount")
def c8(spark, sf):
    return clean.clean_library(t.trips(spark, sf), P).select(
        "trip_id", "passenger_count", "trip_duration_minutes", "speed_mph", "total_amount"
    )


_IN_BOX = """pickup_longitude BETWEEN -74.15 AND -73.7004 AND pickup_latitude BETWEEN 40.5774 AND 40.9176
  AND dropoff_longitude BETWEEN -74.15 AND -73.7004 AND dropoff_latitude BETWEEN 40.5774 AND 40.9176"""


@query("c9_removal_funnel", f"""WITH {b.LIBRARY_CLEAN},
    steps AS (
      SELECT 0 AS step_no, 'initial' AS step, (SELECT count(*) FROM trips) AS rows_left
      UNION ALL SELECT 1, 'critical columns', (SELECT count(*) FROM trips)
      UNION ALL SELECT 2, 'geographic box', (SELECT count(*) FROM trips WHERE {_IN_BOX})
      UNION ALL SELECT 3, 'thresholds', (SELECT count(*) FROM library_clean)
      UNION ALL SELECT 4, 'metrics present', (SELECT count(*) FROM library_clean)
      UNION ALL SELECT 5, 'main filter', (SELECT count(*) FROM measured
        WHERE trip_distance BETWEEN 0 AND 23 AND trip_duration_minutes BETWEEN 1 AND 720
          AND speed_mph BETWEEN 0 AND 45.31 AND total_amount BETWEEN 0 AND 1000 AND PULocationID > 0)
    ) -- result
    SELECT *, rows_left / (SELECT count(*) FROM trips) AS fraction_left,
      1 - rows_left / (SELECT count(*) FROM trips) AS fraction_removed FROM steps""", "fraction_left fraction_removed")
def c9(spark, sf):
    return clean.removal_funnel(t.trips(spark, sf), P)


_HOUR = "CAST(hour(pickup_datetime) AS INTEGER)"
_WEEKDAY = "CAST(isodow(pickup_datetime) - 1 AS INTEGER)"


def _calendar(spark, sf, *names):
    parts = calendar_columns(F.col("pickup_datetime"), P.rush_hours)
    return t.trips(spark, sf).select("trip_id", *[parts[n].alias(n) for n in names])


@query("d1_calendar_parts", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, {_HOUR} AS hour, {_WEEKDAY} AS day_of_week, CAST(day(pickup_datetime) AS INTEGER) AS day_of_month,
      CAST(month(pickup_datetime) AS INTEGER) AS month, CAST(year(pickup_datetime) AS INTEGER) AS year FROM trips""")
def d1(spark, sf):
    return _calendar(spark, sf, "hour", "day_of_week", "day_of_month", "month", "year")


@query("d2_is_weekend", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, CAST(isodow(pickup_datetime) IN (6, 7) AS INTEGER) AS is_weekend FROM trips""")
def d2(spark, sf):
    return _calendar(spark, sf, "is_weekend")


@query("d3_is_rush_hour", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, CAST(hour(pickup_datetime) BETWEEN 7 AND 9 OR hour(pickup_datetime) BETWEEN 16 AND 19 AS INTEGER)
      AS is_rush_hour FROM trips""")
def d3(spark, sf):
    return _calendar(spark, sf, "is_rush_hour")


@query("d4_time_of_day", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, CASE WHEN hour(pickup_datetime) BETWEEN 6 AND 11 THEN 'morning'
      WHEN hour(pickup_datetime) BETWEEN 12 AND 16 THEN 'afternoon'
      WHEN hour(pickup_datetime) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END AS time_of_day FROM trips""")
def d4(spark, sf):
    return _calendar(spark, sf, "time_of_day")


_TRIP_YEARS = "years AS (SELECT * FROM (VALUES (2023), (2024), (2025)) y(year))"


@query("d5_is_holiday", f"""WITH {b.TRIPS}, {_TRIP_YEARS}, {b.HOLIDAYS} -- result
    SELECT trip_id, CAST(CAST(pickup_datetime AS DATE) IN (SELECT date FROM holidays) AS INTEGER) AS is_holiday FROM trips""")
def d5(spark, sf):
    return holidays.add_holiday_flags(t.trips(spark, sf), "pickup_datetime").select("trip_id", "is_holiday")


_ORDER_YEARS = "years AS (SELECT DISTINCT unnest([year(o_orderdate) - 1, year(o_orderdate), year(o_orderdate) + 1]) AS year FROM orders)"


@query("d6_days_around_holidays", f"""WITH {_ORDER_YEARS}, {b.HOLIDAYS} -- result
    SELECT o_orderkey,
      CAST(CAST(o_orderdate AS DATE) + 1 IN (SELECT date FROM holidays) AS INTEGER) AS day_before_holiday,
      CAST(CAST(o_orderdate AS DATE) - 1 IN (SELECT date FROM holidays) AS INTEGER) AS day_after_holiday
    FROM orders""")
def d6(spark, sf):
    flagged = holidays.add_holiday_flags(t.read(spark, sf, "orders"), "o_orderdate")
    return flagged.select("o_orderkey", "day_before_holiday", "day_after_holiday")


@query("d7_holiday_calendar", f"""WITH {_ORDER_YEARS}, {b.HOLIDAYS} -- result
    SELECT date, name, observed FROM holidays""")
def d7(spark, sf):
    return holidays.holiday_calendar(holidays.holiday_years(t.read(spark, sf, "orders"), "o_orderdate"))


@query("d8_time_bin", f"WITH {b.BINNED} -- result\nSELECT trip_id, time_bin FROM binned")
def d8(spark, sf):
    cleaned = clean.clean_main(t.trips(spark, sf), P)
    return series.add_time_bin(cleaned, P.bin_seconds).select("trip_id", "time_bin")


@query("d9_month_bin", f"""WITH {b.TRIPS} -- result
    SELECT trip_id, CAST(floor(date_diff('microsecond',
      date_trunc('month', (SELECT min(pickup_datetime) FROM trips)), pickup_datetime) / 21600e6) AS INTEGER) AS pickup_bins
    FROM trips""")
def d9(spark, sf):
    return series.add_month_bin(t.trips(spark, sf), P.bin_seconds).select("trip_id", "pickup_bins")


@query("z1_zone_count", f"WITH {b.CLEAN} -- result\nSELECT count(DISTINCT cluster_id) AS n_zones FROM cleaned")
def z1(spark, sf):
    return zones.count_zones(zones.assign_zone(clean.clean_main(t.trips(spark, sf), P)))


@query("z1_busiest_zones", f"""WITH {b.CLEAN} -- result
    SELECT cluster_id, count(*) AS trips FROM cleaned GROUP BY 1 ORDER BY trips DESC, cluster_id LIMIT 5""")
def z1_busiest(spark, sf):
    return zones.busiest_zones(zones.assign_zone(clean.clean_main(t.trips(spark, sf), P)))


# What any fit must give: all centres, every point at its nearest one, and the sums of the points
# back from the sizes and means of the clusters.
@query("z2_fit_centres", f"""WITH {b.LIBRARY_CLEAN} -- result
    SELECT 40 AS centres, 0 AS misplaced, count(*) AS trips, sum(pickup_latitude) AS latitudes,
      sum(pickup_longitude) AS longitudes FROM library_clean""", "latitudes longitudes")
def z2(spark, sf):
    return _fit_summary(*_fitted(spark, sf, zones.fit_centres))


def _fitted(spark, sf, fit):
    cleaned = staged(clean.clean_library(t.trips(spark, sf), P).select("pickup_latitude", "pickup_longitude"), "points")
    return cleaned, fit(cleaned, P)


def _fit_summary(cleaned, centres):
    lat, lon = F.col("pickup_latitude"), F.col("pickup_longitude")
    assigned = zones.attach_centres(zones.assign_nearest_centre(cleaned, centres), centres)
    own = (lat - F.col("cluster_lat")) ** 2 + (lon - F.col("cluster_lon")) ** 2
    least = zones.least_squared(centres)
    means = assigned.withColumn("off", (own > least + 1e-12).cast("int")).groupBy("pickup_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("off").alias("off"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon")
    )
    return means.agg(
        F.lit(len(centres)).alias("centres"),
        F.sum("off").cast("int").alias("misplaced"),
        F.sum("n").alias("trips"),
        F.sum(F.col("n") * F.col("lat")).alias("latitudes"),
        F.sum(F.col("n") * F.col("lon")).alias("longitudes"),
    )


@query("z2_centres_in_batches", f"""WITH {b.LIBRARY_CLEAN} -- result
    SELECT 40 AS centres, 0 AS misplaced, count(*) AS trips, sum(pickup_latitude) AS latitudes,
      sum(pickup_longitude) AS longitudes, true AS near_full_fit FROM library_clean""", "latitudes longitudes")
def z2_batches(spark, sf):
    """As above from mini-batches, whose squared distances exceed the full fit's by 2 % at most."""
    cleaned, centres = _fitted(spark, sf, zones.fit_centres_in_batches)
    full = zones.squared_distances(cleaned, zones.fit_centres(cleaned, P)).first()["inertia"]
    own = zones.squared_distances(cleaned, centres).first()["inertia"]
    return _fit_summary(cleaned, centres).withColumn("near_full_fit", F.lit(own <= 1.02 * full))


@query("z3_nearest_centre", f"WITH {b.NEAREST} -- result\nSELECT trip_id, pickup_cluster FROM nearest")
def z3(spark, sf):
    cleaned = clean.clean_library(t.trips(spark, sf), P)
    return zones.assign_nearest_centre(cleaned, t.CENTRES).select("trip_id", "pickup_cluster")


@query("z4_centre_coordinates", f"""WITH {b.NEAREST} -- result
    SELECT trip_id, pickup_cluster, cluster_lat, cluster_lon FROM nearest LEFT JOIN centres USING (pickup_cluster)""",
       "cluster_lat cluster_lon")
def z4(spark, sf):
    assigned = zones.assign_nearest_centre(clean.clean_library(t.trips(spark, sf), P), t.CENTRES)
    return zones.attach_centres(assigned, t.CENTRES).select("trip_id", "pickup_cluster", "cluster_lat", "cluster_lon")


@query("z5_zone_coordinates", """SELECT s_suppkey, zone,
      CASE WHEN zone BETWEEN 1 AND 103 THEN 40.73 + (zone % 50) * 0.006
        WHEN zone BETWEEN 104 AND 130 THEN 40.82 + (zone % 15) * 0.008
        WHEN zone BETWEEN 131 AND 177 THEN 40.65 + (zone % 25) * 0.007
        WHEN zone BETWEEN 178 AND 236 THEN 40.7 + (zone % 30) * 0.006
        WHEN zone BETWEEN 237 AND 263 THEN 40.58 + (zone % 12) * 0.007 ELSE 40.7 END AS lat,
      CASE WHEN zone BETWEEN 1 AND 103 THEN -73.99 - (zone % 20) * 0.008
        WHEN zone BETWEEN 104 AND 130 THEN -73.9 - (zone % 10) * 0.007
        WHEN zone BETWEEN 131 AND 177 THEN -73.95 - (zone % 18) * 0.006
        WHEN zone BETWEEN 178 AND 236 THEN -73.8 - (zone % 22) * 0.005
        WHEN zone BETWEEN 237 AND 263 THEN -74.14 - (zone % 8) * 0.006 ELSE -73.9 END AS lon
    FROM (SELECT s_suppkey, CAST(s_suppkey * 3 AS INTEGER) AS zone FROM supplier) AS result""", "lat lon")
def z5(spark, sf):
    located = t.read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 3).cast("int").alias("zone"))
    return zones.add_zone_coordinates(located, "zone")


SERIES_DOUBLES = "revenue_total avg_fare avg_distance avg_duration"


@query("a1_zone_bin_series", f"WITH {b.SERIES} -- result\nSELECT * FROM series", SERIES_DOUBLES)
def a1(spark, sf):
    return revenue.main_series(t.trips(spark, sf), P)


@query("a2_cell_aggregation", f"""WITH {b.LIBRARY_CELLS} -- result
    SELECT pickup_cluster, pickup_bins, demand, total_amount, trip_distance, passenger_count FROM cells""",
       "total_amount trip_distance passenger_count")
def a2(spark, sf):
    binned = series.add_month_bin(clean.clean_library(t.trips(spark, sf), P), P.bin_seconds)
    return series.aggregate_cells(zones.assign_nearest_centre(binned, t.CENTRES))


@query("a3_fare_and_revenue", f"""WITH {b.LIBRARY_CELLS} -- result
    SELECT pickup_cluster, pickup_bins, demand, avg_fare, revenue FROM cells""", "avg_fare revenue")
def a3(spark, sf):
    return revenue.library_cells_from_trips(t.trips(spark, sf), t.CENTRES, P).select(
        "pickup_cluster", "pickup_bins", "demand", "avg_fare", "revenue"
    )


@query("a4_enriched_cells", f"""WITH {b.LIBRARY_CELLS}, {_TRIP_YEARS}, {b.HOLIDAYS} -- result
    SELECT pickup_cluster, pickup_bins, demand, revenue, CAST(hour(first_pickup) AS INTEGER) AS hour_of_day,
      CAST(isodow(first_pickup) - 1 AS INTEGER) AS day_of_week, CAST(day(first_pickup) AS INTEGER) AS day_of_month,
      CAST(month(first_pickup) AS INTEGER) AS month, CAST(year(first_pickup) AS INTEGER) AS year,
      CAST(isodow(first_pickup) >= 6 AS INTEGER) AS is_weekend,
      CAST(hour(first_pickup) IN (7, 8, 9, 16, 17, 18, 19) AS INTEGER) AS is_rush_hour,
      CAST(CAST(first_pickup AS DATE) IN (SELECT date FROM holidays) AS INTEGER) AS is_holiday,
      CAST(CAST(first_pickup AS DATE) + 1 IN (SELECT date FROM holidays) AS INTEGER) AS day_before_holiday,
      CAST(CAST(first_pickup AS DATE) - 1 IN (SELECT date FROM holidays) AS INTEGER) AS day_after_holiday,
      cluster_lat, cluster_lon
    FROM cells LEFT JOIN centres USING (pickup_cluster)""", "revenue cluster_lat cluster_lon")
def a4(spark, sf):
    return series.enrich_cells(t.library_cells(spark, sf), t.CENTRES, P).drop(
        "total_amount", "trip_distance", "passenger_count", "avg_fare", "time_of_day"
    )
