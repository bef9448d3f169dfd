"""Aggregates over the predictions table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.functions.economics import per_unit


def portfolio_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.coalesce(F.sum("demand_pred"), F.lit(0.0)).alias("total_demand"),
        F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("profit_pred"), F.lit(0.0)).alias("total_profit"),
        F.avg("margin_pred").alias("avg_margin"),
    )


def zone_summary(df: DataFrame) -> DataFrame:
    """Totals, mean margin and revenue per trip of each zone."""
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(
            F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue"),
            F.coalesce(F.sum("demand_pred"), F.lit(0.0)).alias("demand"),
            F.avg("margin_pred").alias("margin"),
        )
        .withColumn("revenue_per_trip", per_unit(F.col("revenue"), F.col("demand")))
    )


def positive_revenue_zones(df: DataFrame) -> DataFrame:
    return zone_summary(df).where(F.col("revenue") > 0)


def zone_statistics(df: DataFrame) -> DataFrame:
    """Mean, sample deviation and total of demand and revenue; margin and fare too."""
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(
            F.avg("demand_pred").alias("demand_mean"),
            F.stddev_samp("demand_pred").alias("demand_std"),
            F.coalesce(F.sum("demand_pred"), F.lit(0.0)).alias("demand_sum"),
            F.avg("revenue_pred").alias("revenue_mean"),
            F.stddev_samp("revenue_pred").alias("revenue_std"),
            F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue_sum"),
            F.avg("margin_pred").alias("margin_mean"),
            F.stddev_samp("margin_pred").alias("margin_std"),
            F.avg("avg_fare_pred").alias("fare_mean"),
        )
    )


def most_variable_zone(df: DataFrame) -> DataFrame:
    """Zone with the largest revenue deviation; the lower id on a tie."""
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.stddev_samp("revenue_pred").alias("revenue_std"))
        .where(F.col("revenue_std").isNotNull())
        .orderBy(F.desc("revenue_std"), "cluster_id")
        .limit(1)
    )


def sanity_report(df: DataFrame) -> DataFrame:
    revenue, demand, profit = F.sum("revenue_pred"), F.sum("demand_pred"), F.sum("profit_pred")
    return df.agg(
        per_unit(revenue, demand).alias("revenue_per_trip"),
        (per_unit(profit, revenue) * 100.0).alias("profit_pct"),
        (revenue - profit).alias("total_costs"),
        per_unit(revenue - profit, demand).alias("cost_per_trip"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Zones by sign of revenue, distinct zones and rows, in two levels."""
    zones = df.groupBy("cluster_id").agg(
        F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("n")
    )
    known = F.col("cluster_id").isNotNull()
    return zones.agg(
        F.count_if(known & (F.col("revenue") < 0)).alias("negative_zones"),
        F.count_if(known & (F.col("revenue") > 0)).alias("positive_zones"),
        F.count("cluster_id").alias("zones"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


def reasonability_report(df: DataFrame, low: float = 10.0, high: float = 25.0) -> DataFrame:
    return df.agg(
        F.avg("avg_fare_pred").alias("mean_fare"),
        F.avg("avg_distance").alias("mean_distance"),
        F.avg("avg_duration").alias("mean_duration"),
        F.avg("avg_fare_pred").between(low, high).cast("int").alias("fare_is_usual"),
    )


def business_means(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("demand_pred").alias("avg_predicted_demand"),
        F.avg("revenue_pred").alias("avg_predicted_revenue"),
        F.avg("profit_pred").alias("avg_predicted_profit"),
        F.avg("margin_pred").alias("avg_margin"),
    )
