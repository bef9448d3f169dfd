"""Sinks for summaries, zone mappings and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.operators.metrics import one_pass_metrics


def run_summary(predictions: DataFrame) -> DataFrame:
    """One row: metrics per model and the business means, as nested structs."""
    demand = one_pass_metrics("demand", "demand_pred")
    revenue = one_pass_metrics("revenue_total", "revenue_pred")
    flat = predictions.agg(
        *[expr.alias(f"d_{name}") for name, expr in demand.items()],
        *[expr.alias(f"r_{name}") for name, expr in revenue.items()],
        F.avg("demand_pred").alias("avg_predicted_demand"),
        F.avg("revenue_pred").alias("avg_predicted_revenue"),
        F.avg("profit_pred").alias("avg_predicted_profit"),
        F.avg("margin_pred").alias("avg_margin"),
    )
    keep = ("wmape", "mae", "rmse", "r2")
    return flat.select(
        F.struct(*[F.col(f"d_{name}").alias(name) for name in keep]).alias("demand_model"),
        F.struct(*[F.col(f"r_{name}").alias(name) for name in keep]).alias("revenue_model"),
        F.struct("avg_predicted_demand", "avg_predicted_revenue", "avg_predicted_profit", "avg_margin").alias(
            "business_metrics"
        ),
    )


def zone_mapping(trips: DataFrame) -> DataFrame:
    """Mean trip distance per zone."""
    return (
        trips.where(F.col("cluster_id").isNotNull())
        .groupBy(F.col("cluster_id").alias("zone_id"))
        .agg(F.avg("trip_distance").alias("avg_trip_distance"))
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a small report table as JSON lines."""
    df.write.mode(mode).json(path)
