"""Time the revenue chain on many copies of the events, one zone being hot.

    python -m bindings.scale_check [copies] [events folder] [trees per model]

Each event becomes ``copies`` trips, spread over the month and over 260 zones;
a third of all trips start in zone 1. Bins are ten minutes. With 127 copies of
the largest events table that is 12.7 million trips.
"""

from __future__ import annotations

import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import tables
from faregrid.models.boosted import DEMAND, REVENUE, fit_stacked, score_stacked
from faregrid.operators.features import main_features
from faregrid.operators.metrics import metrics
from faregrid.operators.recommend import recommendation_feed
from faregrid.operators.splits import global_split
from faregrid.params import DEFAULTS
from faregrid.plans import revenue
from faregrid.session import build_session
from faregrid.storage import staged

ZONES = 260
MONTH_MICROS = 30 * 86_400 * 1_000_000


def many_trips(events: DataFrame, copies: int) -> DataFrame:
    spread = tables.trips_from_events(events.repartition(64)).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))
    )
    minutes = F.unix_micros(F.col("dropoff_datetime").cast("timestamp")) - F.unix_micros(
        F.col("pickup_datetime").cast("timestamp")
    )
    start = F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64("trip_id", "_copy"), F.lit(MONTH_MICROS))
    zone = F.when(F.col("_copy") % 3 == 0, F.lit(1)).otherwise(
        (F.pmod(F.xxhash64("_copy", "trip_id", F.lit(7)), F.lit(ZONES)) + 1).cast("int")
    )
    return spread.select(
        (F.col("trip_id") * copies + F.col("_copy")).alias("trip_id"),
        "VendorID",
        F.timestamp_micros(start).cast("timestamp_ntz").alias("pickup_datetime"),
        F.timestamp_micros(start + minutes).cast("timestamp_ntz").alias("dropoff_datetime"),
        zone.alias("PULocationID"),
        "trip_distance",
        "total_amount",
    )


def main(argv: list[str]) -> None:
    copies = int(argv[0]) if argv else 127
    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(
        "scale-check", "local[8]", spark__sql__shuffle__partitions="16", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    clock = [time.perf_counter()]
    total = 0.0

    def lap(name: str, note: object = "", counted: bool = True) -> None:
        nonlocal total
        now = time.perf_counter()
        seconds, clock[0] = now - clock[0], now
        total += seconds if counted else 0.0
        print(f"{name:16s} {seconds:8.2f}s {note}", flush=True)

    trips = staged(many_trips(tables.read(spark, folder, "events"), copies), "scale-trips")
    lap("make trips", f"{trips.count():,} trips, not counted", counted=False)
    series = staged(revenue.main_series(trips, DEFAULTS), "scale-series")
    lap("series")
    predictions = staged(revenue.naive_predictions(series, DEFAULTS), "scale-predictions")
    lap("predictions", f"{predictions.count():,} of {series.count():,} series rows")
    features = staged(main_features(series, DEFAULTS), "scale-features")
    labelled = staged(global_split(features, p=DEFAULTS), "scale-labelled")
    lap("features, split", {r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()})
    for table in revenue.monitoring_tables(predictions, DEFAULTS):
        table.collect()
    lap("monitoring")
    recommendation_feed(predictions, 10, DEFAULTS).collect()
    lap("recommendations")
    trees = int(argv[2]) if len(argv) > 2 else 0
    if trees:
        settings = (replace(DEMAND, trees=trees), replace(REVENUE, trees=trees))
        models = fit_stacked(labelled.where("split = 'train'"), *settings)
        lap("two models", f"{trees} trees each")
        scored = score_stacked(models, labelled)
        rows = metrics(scored, "demand", "demand_pred", ["wmape", "r2"], ["split"]).collect()
        lap("scoring", {r.split: round(r.wmape, 2) for r in rows})
    print(f"{'total':16s} {total:8.2f}s")


if __name__ == "__main__":
    main(sys.argv[1:])
