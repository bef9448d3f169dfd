"""Common table expressions shared by the oracle queries.

They state the pipeline independently: ranks over whole zones, and the
exponential average as a self-join over all earlier rows.
"""

from bindings.tables import CENTRES, QUESTIONS

TRIPS = """
located AS (
  SELECT *, CAST(1 + floor(sqrt((event_id * 7919) % 400)) AS INTEGER) AS PULocationID FROM events
),
trips AS (
  SELECT event_id AS trip_id, 1 + event_id % 2 AS VendorID, ts AS pickup_datetime,
    ts + to_minutes(CAST(regexp_extract(props, '[0-9]+') AS INTEGER)) AS dropoff_datetime,
    PULocationID, value * 0.25 AS trip_distance,
    (2.5 + value) * (1 + CAST(0.3 AS DOUBLE) * (PULocationID % 3)) AS total_amount,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id % 5 + 1 AS DOUBLE) END AS passenger_count,
    CAST(40.56 AS DOUBLE) + (user_id % 37) * CAST(0.01 AS DOUBLE) AS pickup_latitude,
    CAST(-74.16 AS DOUBLE) + (user_id % 47) * CAST(0.01 AS DOUBLE) AS pickup_longitude,
    CAST(40.56 AS DOUBLE) + (event_id % 37) * CAST(0.01 AS DOUBLE) AS dropoff_latitude,
    CAST(-74.16 AS DOUBLE) + (event_id % 47) * CAST(0.01 AS DOUBLE) AS dropoff_longitude
  FROM located
)"""

MEASURED = TRIPS + """,
timed AS (
  SELECT *, date_diff('microsecond', pickup_datetime, dropoff_datetime) / 6e7 AS trip_duration_minutes FROM trips
),
measured AS (
  SELECT *, trip_distance / nullif(trip_duration_minutes / 60, 0) AS speed_mph FROM timed
)"""

CLEAN = MEASURED + """,
cleaned AS (
  SELECT *, PULocationID AS cluster_id FROM measured
  WHERE trip_distance BETWEEN 0 AND 23 AND trip_duration_minutes BETWEEN 1 AND 720
    AND speed_mph BETWEEN 0 AND 45.31 AND total_amount BETWEEN 0 AND 1000 AND PULocationID > 0
)"""

BINNED = CLEAN + """,
binned AS (
  SELECT *, CAST(floor(date_diff('microsecond', (SELECT min(pickup_datetime) FROM cleaned), pickup_datetime)
                       / 21600e6) AS INTEGER) AS time_bin
  FROM cleaned
)"""

SERIES = BINNED + """,
series AS (
  SELECT cluster_id, time_bin, count(VendorID) AS demand, sum(total_amount) AS revenue_total,
    avg(total_amount) AS avg_fare, avg(trip_distance) AS avg_distance, avg(trip_duration_minutes) AS avg_duration,
    CAST(arg_min(hour(pickup_datetime), pickup_datetime) AS INTEGER) AS hour,
    CAST(arg_min(isodow(pickup_datetime) - 1, pickup_datetime) AS INTEGER) AS day_of_week,
    CAST(arg_min(isodow(pickup_datetime) >= 6, pickup_datetime) AS INTEGER) AS is_weekend,
    CAST(arg_min(hour(pickup_datetime) IN (7, 8, 9, 16, 17, 18, 19), pickup_datetime) AS INTEGER) AS is_rush_hour
  FROM binned GROUP BY cluster_id, time_bin
)"""

LAGGED = SERIES + """,
lagged AS (
  SELECT *, row_number() OVER w AS pos, lag(demand, 1) OVER w AS ft_1, lag(demand, 2) OVER w AS ft_2,
    lag(demand, 3) OVER w AS ft_3, lag(demand, 4) OVER w AS ft_4, lag(demand, 5) OVER w AS ft_5,
    lag(avg_fare, 1) OVER w AS prev_avg_fare
  FROM series WINDOW w AS (PARTITION BY cluster_id ORDER BY time_bin)
)"""

FEATURES = LAGGED + """,
kept AS (SELECT * FROM lagged WHERE ft_5 IS NOT NULL),
averages AS (
  SELECT a.cluster_id, a.time_bin,
    sum(pow(0.7, a.pos - 1 - b.pos) * b.demand) / sum(pow(0.7, a.pos - 1 - b.pos)) AS exp_avg
  FROM kept a JOIN kept b ON a.cluster_id = b.cluster_id AND b.pos < a.pos
  GROUP BY a.cluster_id, a.time_bin
),
features AS (
  SELECT kept.*, averages.exp_avg FROM kept LEFT JOIN averages USING (cluster_id, time_bin)
)"""

FORECAST = FEATURES + """,
forecast AS (
  SELECT * EXCLUDE (pos, prev_avg_fare), round(exp_avg + 1e-9, 6) AS demand_pred,
    round(exp_avg * prev_avg_fare + 1e-9, 6) AS revenue_pred
  FROM features WHERE exp_avg IS NOT NULL
)"""

PREDICTIONS = FORECAST + """,
costed AS (
  SELECT *, revenue_pred / nullif(demand_pred, 0) AS avg_fare_pred, revenue_pred * 0.65 AS driver_costs,
    revenue_pred * 0.029 AS processing_fees, revenue_pred * 0.05 AS ops_costs,
    revenue_pred * 0.65 + revenue_pred * 0.029 + revenue_pred * 0.05 AS total_costs
  FROM forecast
),
predictions AS (
  SELECT *, revenue_pred - total_costs AS profit_pred,
    (revenue_pred - total_costs) / nullif(revenue_pred, 0) AS margin_pred
  FROM costed
)"""

ZONES = PREDICTIONS + """,
zones AS (
  SELECT cluster_id, sum(revenue_pred) AS revenue, sum(demand_pred) AS demand, avg(margin_pred) AS margin,
    sum(revenue_pred) / nullif(sum(demand_pred), 0) AS revenue_per_trip
  FROM predictions GROUP BY cluster_id
)"""

_centre_rows = ", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, a, b in CENTRES)
CENTRE_TABLE = f"centres(pickup_cluster, cluster_lat, cluster_lon) AS (VALUES {_centre_rows})"

LIBRARY_CLEAN = MEASURED + """,
library_clean AS (
  SELECT * REPLACE (coalesce(passenger_count, (SELECT quantile_cont(passenger_count, 0.5) FROM measured)) AS passenger_count)
  FROM measured
  WHERE pickup_longitude BETWEEN -74.15 AND -73.7004 AND pickup_latitude BETWEEN 40.5774 AND 40.9176
    AND dropoff_longitude BETWEEN -74.15 AND -73.7004 AND dropoff_latitude BETWEEN 40.5774 AND 40.9176
    AND trip_distance > 0 AND trip_distance < 23 AND trip_duration_minutes > 1 AND trip_duration_minutes < 720
    AND speed_mph > 0 AND speed_mph < 45.31 AND total_amount > 0 AND total_amount < 1000
)"""

NEAREST = LIBRARY_CLEAN + f""",
{CENTRE_TABLE},
distances AS (
  SELECT t.trip_id, c.pickup_cluster,
    (t.pickup_latitude - c.cluster_lat) * (t.pickup_latitude - c.cluster_lat)
    + (t.pickup_longitude - c.cluster_lon) * (t.pickup_longitude - c.cluster_lon) AS d
  FROM library_clean t, centres c
),
nearest AS (
  SELECT trip_id, pickup_cluster FROM distances
  QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY d, pickup_cluster) = 1
)"""

LIBRARY_CELLS = NEAREST + """,
library_binned AS (
  SELECT t.*, n.pickup_cluster,
    CAST(floor(date_diff('microsecond', date_trunc('month', (SELECT min(pickup_datetime) FROM library_clean)),
                         pickup_datetime) / 21600e6) AS INTEGER) AS pickup_bins
  FROM library_clean t JOIN nearest n USING (trip_id)
),
cells AS (
  SELECT pickup_cluster, pickup_bins, count(pickup_datetime) AS demand, sum(total_amount) AS total_amount,
    sum(trip_distance) AS trip_distance, sum(passenger_count) AS passenger_count,
    min(pickup_datetime) AS first_pickup, sum(total_amount) / count(pickup_datetime) AS avg_fare,
    sum(total_amount) AS revenue
  FROM library_binned GROUP BY pickup_cluster, pickup_bins
)"""

# US holidays of the years in ``years(year)``, with the observed days.
HOLIDAYS = """
month_days AS (
  SELECT CAST(d AS DATE) AS d FROM years, range(make_date(year, 1, 1), make_date(year + 1, 1, 1), INTERVAL 1 DAY) r(d)
),
ranked_days AS (
  SELECT d, year(d) AS y, month(d) AS m, day(d) AS dom, isodow(d) - 1 AS wd,
    (day(d) - 1) // 7 + 1 AS nth, month(d + INTERVAL 7 DAY) <> month(d) AS is_last
  FROM month_days
),
named AS (
  SELECT d, CASE
    WHEN m = 1 AND dom = 1 THEN 'New Year''s Day'
    WHEN m = 6 AND dom = 19 AND y >= 2021 THEN 'Juneteenth National Independence Day'
    WHEN m = 7 AND dom = 4 THEN 'Independence Day'
    WHEN m = 11 AND dom = 11 THEN 'Veterans Day'
    WHEN m = 12 AND dom = 25 THEN 'Christmas Day'
    WHEN m = 1 AND wd = 0 AND nth = 3 THEN 'Martin Luther King Jr. Day'
    WHEN m = 2 AND wd = 0 AND nth = 3 THEN 'Washington''s Birthday'
    WHEN m = 5 AND wd = 0 AND is_last THEN 'Memorial Day'
    WHEN m = 9 AND wd = 0 AND nth = 1 THEN 'Labor Day'
    WHEN m = 10 AND wd = 0 AND nth = 2 THEN 'Columbus Day'
    WHEN m = 11 AND wd = 3 AND nth = 4 THEN 'Thanksgiving Day'
  END AS name, wd FROM ranked_days
),
holidays AS (
  SELECT d AS date, name, 0 AS observed FROM named WHERE name IS NOT NULL
  UNION ALL
  SELECT CAST(CASE WHEN wd = 5 THEN d - INTERVAL 1 DAY ELSE d + INTERVAL 1 DAY END AS DATE), name, 1
  FROM named WHERE name IS NOT NULL AND wd IN (5, 6)
)"""

_quoted = ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS)
QUESTION_TEXTS = f"""
questions AS (
  SELECT conv_id, turn, replace(replace(replace(
      [{_quoted}][(conv_id * 3 + turn) % {len(QUESTIONS)} + 1],
      '{{z1}}', CAST(conv_id % 25 + 1 AS VARCHAR)),
      '{{z2}}', CAST((conv_id * 7 + turn) % 20 + 1 AS VARCHAR)),
      '{{h}}', CAST((conv_id + turn) % 12 + 1 AS VARCHAR)) || chr(10) || text AS text
  FROM conversations
)"""
