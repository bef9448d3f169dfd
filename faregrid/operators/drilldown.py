"""Per-zone views along time: periods, change and drill-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions.economics import pct_change, per_unit
from faregrid.plans.positions import with_positions
from faregrid.plans.thresholds import attach
from faregrid.storage import staged


def price_per_trip() -> Column:
    """Revenue per predicted trip, a demand of zero counting as one."""
    demand = F.col("demand_pred")
    return F.try_divide(F.col("revenue_pred"), F.when(demand == 0, F.lit(1.0)).otherwise(demand))


def add_periods(df: DataFrame) -> DataFrame:
    """Period number 1..n of each row in its zone, and price per trip."""
    return (
        with_positions(df, ["cluster_id"], "time_bin")
        .withColumnRenamed("pos", "period")
        .drop("n_rows")
        .withColumn("price_per_trip", price_per_trip())
    )


def zone_change(df: DataFrame) -> DataFrame:
    """First against last row of each zone, with the last row's calendar."""
    rows = df.where(F.col("cluster_id").isNotNull())
    ends = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("periods"),
        F.min_by("revenue_pred", "time_bin").alias("first_revenue"),
        F.max_by("revenue_pred", "time_bin").alias("last_revenue"),
        F.min_by("demand_pred", "time_bin").alias("first_demand"),
        F.max_by("demand_pred", "time_bin").alias("last_demand"),
        F.max_by("hour", "time_bin").alias("hour"),
        F.max_by("day_of_week", "time_bin").alias("day_of_week"),
        F.max_by("is_weekend", "time_bin").alias("is_weekend"),
        F.max_by("is_rush_hour", "time_bin").alias("is_rush_hour"),
    )
    rising = F.col("last_demand") > F.col("first_demand")
    change = pct_change(F.col("last_revenue"), F.col("first_revenue"))
    return (
        ends.where(F.col("periods") >= 2)
        .withColumn("change_pct", change)
        .withColumn("direction", F.when(change > 0, F.lit("increase")).otherwise(F.lit("decrease")))
        .withColumn("demand_trend", F.when(rising, F.lit("increasing")).otherwise(F.lit("decreasing")))
    )


def zone_drilldown(df: DataFrame) -> DataFrame:
    """Best and worst period, variation of revenue and price, price range.

    One aggregation finds the first bins with the highest and the lowest revenue of each zone; a
    period is the number of the zone's rows up to that bin, counted in a second one. Rows meet the
    per-zone values by :func:`attach` and are never shuffled on the zone.
    """
    rows = df.where(F.col("cluster_id").isNotNull()).withColumn("price", price_per_trip())
    revenue = F.col("revenue_pred")
    cards = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("periods"),
        F.max(revenue).alias("highest_revenue"),
        F.min(revenue).alias("lowest_revenue"),
        (F.try_divide(F.stddev_samp(revenue), F.avg(revenue)) * 100.0).alias("revenue_cv_pct"),
        (F.try_divide(F.stddev_samp("price"), F.avg("price")) * 100.0).alias("price_cv_pct"),
        F.avg("price").alias("mean_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        (F.max("price") - F.min("price")).alias("price_range"),
        F.max(F.struct(revenue.alias("revenue"), (-F.col("time_bin")).alias("back"))).alias("_high"),
        F.min(F.struct(revenue.alias("revenue"), F.col("time_bin").alias("bin"))).alias("_low"),
    )
    cards = staged(cards, "zone-cards")
    ends = cards.select("cluster_id", (-F.col("_high")["back"]).alias("_high"), F.col("_low")["bin"].alias("_low"))
    found = attach(rows.select("cluster_id", "time_bin"), ends, ["cluster_id"]).groupBy("cluster_id").agg(
        F.count_if(F.col("time_bin") <= F.col("_high")).alias("highest_period"),
        F.count_if(F.col("time_bin") <= F.col("_low")).alias("lowest_period"),
    )
    return cards.drop("_high", "_low").join(found, "cluster_id")


def insight_cards(df: DataFrame) -> DataFrame:
    """Means, row count and peak hour of every zone, in one aggregation.

    The peak hour is that of the row with most revenue, the earliest on a tie.
    """
    rows = df.where(F.col("cluster_id").isNotNull())
    return rows.groupBy("cluster_id").agg(
        F.avg("demand_pred").alias("avg_demand"),
        F.avg("revenue_pred").alias("avg_revenue"),
        F.avg("profit_pred").alias("avg_profit"),
        F.avg("margin_pred").alias("avg_margin"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.max_by("hour", F.struct(F.col("revenue_pred"), -F.col("time_bin"))).alias("peak_hour"),
    )
