"""The revenue chain: trips to series to features to predictions to findings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.models.boosted import Booster, score_stacked
from faregrid.operators.anomalies import anomaly_feed, cycle_report, proposed_actions
from faregrid.operators.clean import clean_library, clean_main
from faregrid.operators.features import library_features, main_features
from faregrid.operators.forecast import naive_forecast, predictions_table
from faregrid.operators.portfolio import zone_statistics
from faregrid.operators.series import (
    add_month_bin,
    add_time_bin,
    enrich_cells,
    library_cells,
    zone_bin_series,
)
from faregrid.operators.zones import assign_nearest_centre, assign_zone
from faregrid.params import DEFAULTS, Params
from faregrid.storage import staged


def main_series(trips: DataFrame, p: Params = DEFAULTS, origin: datetime | None = None) -> DataFrame:
    """Clean, zone, bin and aggregate trips.

    Bins count from the earliest clean trip, found by a pass of its own, or from ``origin``.
    """
    cleaned = assign_zone(clean_main(trips, p))
    return zone_bin_series(add_time_bin(cleaned, p.bin_seconds, origin=origin), p)


def naive_predictions(series: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Features, naive forecast and profit from a written series."""
    features = main_features(series, p, previous=["avg_fare"])
    return predictions_table(naive_forecast(features), p)


def model_predictions(features: DataFrame, models: tuple[Booster, Booster], p: Params = DEFAULTS) -> DataFrame:
    """Stacked demand and revenue predictions with costs and profit, from feature rows."""
    return predictions_table(score_stacked(models, features), p)


def library_cells_from_trips(
    trips: DataFrame,
    centres: Sequence[tuple[int, float, float]],
    p: Params = DEFAULTS,
    origin: datetime | None = None,
) -> DataFrame:
    """Clean by the library rules, bin by month, assign centres, aggregate."""
    binned = add_month_bin(clean_library(trips, p), p.bin_seconds, origin=origin)
    return library_cells(assign_nearest_centre(binned, centres))


def library_feature_table(
    cells: DataFrame, centres: Sequence[tuple[int, float, float]], p: Params = DEFAULTS
) -> DataFrame:
    """Complete feature rows from written cells."""
    return library_features(enrich_cells(cells, centres, p), p)


def monitoring_tables(predictions: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Anomaly feed, the actions for its first entries, and the cycle report.

    The zone statistics and the feed are written once: a row per zone and a
    handful of rows, both read several times.
    """
    zones = staged(zone_statistics(predictions), "zone-statistics")
    feed = staged(anomaly_feed(zones, p), "anomaly-feed")
    actions = proposed_actions(feed.where(F.col("anomaly_no") <= p.feed_size), zones, p)
    return feed, actions, cycle_report(feed, actions, zones)
