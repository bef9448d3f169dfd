"""The analytics tables, made from the driver's tables.

Trips come from ``events``. Trips, series, library cells and predictions are
written once per session and folder, as the pipeline itself does, and scanned
by every query that needs them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.operators.features import main_features
from faregrid.operators.forecast import naive_forecast, predictions_table
from faregrid.params import DEFAULTS
from faregrid.plans import revenue
from faregrid.storage import staged

# Events are sparse, so bins are six hours.
PARAMS = replace(DEFAULTS, bin_seconds=21_600)

# Centres for the nearest-centre operator, as (id, latitude, longitude).
CENTRES = (
    (0, 40.613, -74.087), (1, 40.621, -73.941), (2, 40.607, -73.803),
    (3, 40.704, -74.093), (4, 40.717, -73.962), (5, 40.709, -73.817),
    (6, 40.808, -74.104), (7, 40.799, -73.953), (8, 40.813, -73.811),
    (9, 40.887, -74.081), (10, 40.902, -73.947), (11, 40.894, -73.806),
)

# Questions put before the conversation texts, with zone and hour slots.
QUESTIONS = (
    "Name the zones with the highest revenue for us",
    "Give me the average profit margin of all zones",
    "Where would improvement help most, which zones need focus?",
    "Please compare zones {z1} and {z2}",
    "List zones of the lowest demand",
    "Compare zone {z1} and zone {z2}",
    "We want to deploy drivers on friday evening, but where?",
    "At {h}pm on Saturday, where are maximum rides?",
    "Most trips at {h} am?",
    "Show the busiest: top demand zones",
    "Which zones have the worst revenue?",
    "Which zone would benefit from a price increase?",
    "Tell me about zone {z1}",
    "Zone {z2} details at hour {h}",
    "How is the profit on monday morning?",
    "Overall summary for tonight, please",
    "What is the difference between cluster {z1} and cluster {z2}?",
    "Highest ranked neighbourhoods at {h}:00",
    "Optimize the night shift",
    "Margin of zone {z2} on sunday afternoon",
    "Hello there",
)

_written: dict[tuple[str, str, str], DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = staged(build(), name)
    return _written[key]


def trips_from_events(events: DataFrame) -> DataFrame:
    minutes = F.get_json_object("props", "$.k").cast("int")
    zone = (1 + F.floor(F.sqrt((F.col("event_id") * 7919) % 400))).cast("int")
    # Minutes as a day-time interval keep a naive timestamp naive.
    dropoff = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return events.withColumn("PULocationID", zone).select(
        F.col("event_id").alias("trip_id"),
        (1 + F.col("event_id") % 2).alias("VendorID"),
        F.col("ts").alias("pickup_datetime"),
        dropoff.alias("dropoff_datetime"),
        "PULocationID",
        (F.col("value") * 0.25).alias("trip_distance"),
        ((2.5 + F.col("value")) * (1 + F.lit(0.3) * (F.col("PULocationID") % 3))).alias("total_amount"),
        F.when(F.col("event_type") != "error", (F.col("user_id") % 5 + 1).cast("double")).alias("passenger_count"),
        (F.lit(40.56) + (F.col("user_id") % 37) * F.lit(0.01)).alias("pickup_latitude"),
        (F.lit(-74.16) + (F.col("user_id") % 47) * F.lit(0.01)).alias("pickup_longitude"),
        (F.lit(40.56) + (F.col("event_id") % 37) * F.lit(0.01)).alias("dropoff_latitude"),
        (F.lit(-74.16) + (F.col("event_id") % 47) * F.lit(0.01)).alias("dropoff_longitude"),
    )


def raw_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_events(read(spark, sf_dir, "events"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips, a projection of ``events``; nothing is copied."""
    return raw_trips(spark, sf_dir)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "series", lambda: revenue.main_series(trips(spark, sf_dir), PARAMS))


def rounded(forecast: DataFrame) -> DataFrame:
    """Six decimals, as the SQL has them: ties then don't depend on the order of summation."""
    return forecast.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 6) for c in ("demand_pred", "revenue_pred")})


def predictions_of(series: DataFrame) -> DataFrame:
    """The naive predictions of a written series, rounded before costs and profit follow."""
    features = main_features(series, PARAMS, previous=["avg_fare"])
    return predictions_table(rounded(naive_forecast(features)), PARAMS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "predictions", lambda: predictions_of(series(spark, sf_dir)))


def library_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        spark, sf_dir, "library-cells", lambda: revenue.library_cells_from_trips(trips(spark, sf_dir), CENTRES, PARAMS)
    )


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    pick = ((F.col("conv_id") * 3 + F.col("turn")) % len(QUESTIONS) + 1).cast("int")
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), pick)
    slots = {
        "{z1}": F.col("conv_id") % 25 + 1,
        "{z2}": (F.col("conv_id") * 7 + F.col("turn")) % 20 + 1,
        "{h}": (F.col("conv_id") + F.col("turn")) % 12 + 1,
    }
    for slot, value in slots.items():
        text = F.replace(text, F.lit(slot), value.cast("string"))
    return rows.select("conv_id", "turn", F.concat(text, F.lit("\n"), F.col("text")).alias("text"))


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts, two in three with lines that name an action."""
    kind = F.col("turn") % 3
    text = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("Part three, the recommended action:\n"), F.col("text")))
        .otherwise(F.replace(F.col("text"), F.lit("\n"), F.lit("\n  Possible Solution: ")))
    )
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))


def label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its embeddings."""
    parts = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding")).withColumnRenamed(
        "label", "query_id"
    )
