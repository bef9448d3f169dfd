"""Peer-benchmark anomalies and the actions sized from them.

The predictions are aggregated per zone first; everything after that works on
one row per zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.functions.calendar import naive
from faregrid.functions.economics import pct_change, per_unit
from faregrid.operators.portfolio import zone_statistics
from faregrid.params import DEFAULTS, Params
from faregrid.plans.thresholds import attach

OPPORTUNITY = "REVENUE_OPPORTUNITY"
INEFFICIENT = "LOW_EFFICIENCY"
# Thirds as percentages brought back to fractions. With a zone
# exactly on an edge the last bit decides its tercile.
TERCILE_EDGES = (1.0 / 3.0 * 100.0 / 100.0, 2.0 / 3.0 * 100.0 / 100.0)


def high_impact_zones(zones: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Zones of :func:`zone_statistics` with revenue at or above the quantile."""
    cut = zones.agg(F.percentile("revenue_sum", F.lit(p.high_impact_quantile)).alias("_cut"))
    return attach(zones, cut).where(F.col("revenue_sum") >= F.col("_cut")).drop("_cut")


def enough_zones(high: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The same zones, or none if there are too few to compare."""
    n = high.agg(F.count(F.lit(1)).alias("n")).scalar()
    return high.where(n >= p.min_high_impact_zones)


def revenue_terciles(high: DataFrame) -> DataFrame:
    """Tercile by interpolated edges, upper edges included."""
    edges = high.agg(
        *[F.percentile("revenue_sum", F.lit(q)).alias(f"_e{i}") for i, q in enumerate(TERCILE_EDGES, 1)]
    )
    label = (
        F.when(F.col("revenue_sum") <= F.col("_e1"), F.lit("small"))
        .when(F.col("revenue_sum") <= F.col("_e2"), F.lit("medium"))
        .otherwise(F.lit("large"))
    )
    return attach(high, edges).withColumn("tercile", label).drop("_e1", "_e2")


def peer_benchmarks(terciles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Benchmark of each tercile with enough zones."""
    return (
        terciles.groupBy("tercile")
        .agg(
            F.percentile("revenue_sum", F.lit(p.benchmark_quantile)).alias("benchmark"),
            F.count(F.lit(1)).alias("peers"),
        )
        .where(F.col("peers") >= p.min_peers)
    )


def underperformers(terciles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """First zone by id of each tercile that falls short of its benchmark."""
    short = terciles.join(peer_benchmarks(terciles, p), "tercile").where(
        F.col("revenue_sum") < F.col("benchmark") * p.underperforming_below
    )
    first = Window.partitionBy("tercile").orderBy("cluster_id")
    target = F.col("benchmark") * p.target_of_benchmark
    return (
        short.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .select(
            "cluster_id",
            "tercile",
            F.col("revenue_sum").alias("current_value"),
            target.alias("expected_value"),
            (target - F.col("revenue_sum")).alias("potential_gain"),
            pct_change(target, F.col("revenue_sum")).alias("deviation_pct"),
        )
    )


def _as_anomaly(df: DataFrame, kind: str, metric: str, kind_order: int, rank: Column) -> DataFrame:
    return df.select(
        F.lit(kind_order).alias("kind_order"),
        rank.alias("kind_rank"),
        F.lit(kind).alias("type"),
        F.col("cluster_id").alias("zone_id"),
        F.lit("HIGH").alias("severity"),
        F.lit(metric).alias("metric"),
        "current_value",
        "expected_value",
        "deviation_pct",
        "potential_gain",
        F.lit("INVESTIGATING").alias("status"),
    )


def revenue_opportunities(terciles: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Underperformers by gain, the largest first; at most one per tercile."""
    found = underperformers(terciles, p)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("potential_gain"), "cluster_id"))
    rows = _as_anomaly(found, OPPORTUNITY, "revenue_pred", 1, rank)
    return rows.where(F.col("kind_rank") <= p.max_opportunities)


def low_efficiency(high: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """High-impact zones earning little per trip, by total revenue."""
    zones = high.withColumn("rpt", per_unit(F.col("revenue_sum"), F.col("demand_sum")))
    cut = zones.agg(F.percentile("rpt", F.lit(p.benchmark_quantile)).alias("_cut"))
    target = F.col("_cut") * p.target_of_benchmark
    found = (
        attach(zones, cut)
        .where(F.col("rpt") < F.col("_cut") * p.underperforming_below)
        .orderBy(F.desc("revenue_sum"), "cluster_id")
        .limit(p.max_inefficient)
        .select(
            "cluster_id",
            "revenue_sum",
            F.col("rpt").alias("current_value"),
            target.alias("expected_value"),
            ((target - F.col("rpt")) * F.col("demand_sum")).alias("potential_gain"),
            pct_change(target, F.col("rpt")).alias("deviation_pct"),
        )
    )
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("revenue_sum"), "cluster_id"))
    return _as_anomaly(found, INEFFICIENT, "revenue_per_trip", 2, rank)


def anomaly_feed(zones: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Numbered anomalies of :func:`zone_statistics`: opportunities, then inefficiencies."""
    high = enough_zones(high_impact_zones(zones, p), p)
    both = revenue_opportunities(revenue_terciles(high), p).unionByName(low_efficiency(high, p))
    number = F.row_number().over(Window.partitionBy().orderBy("kind_order", "kind_rank"))
    return both.withColumn("anomaly_no", number).drop("kind_order", "kind_rank")


def zone_context(df: DataFrame) -> DataFrame:
    """Totals, margin, peak hour and weekend and rush-hour weight of each zone.

    One pass over the rows, grouped by zone and hour; the rest works on at
    most 24 rows per zone.
    """
    demand = F.col("demand_pred")
    by_hour = (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "hour")
        .agg(
            F.coalesce(F.sum(demand), F.lit(0.0)).alias("demand"),
            F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue"),
            F.sum("margin_pred").alias("margin"),
            F.count("margin_pred").alias("margins"),
            F.sum(F.when(F.col("is_weekend") == 1, demand).otherwise(0.0)).alias("weekend"),
            F.sum(F.when(F.col("is_weekend") == 0, demand).otherwise(0.0)).alias("weekday"),
            F.sum(F.when(F.col("is_rush_hour") == 1, demand).otherwise(0.0)).alias("rush"),
        )
    )
    total, revenue = F.sum("demand"), F.sum("revenue")
    return by_hour.groupBy("cluster_id").agg(
        total.alias("total_demand"),
        revenue.alias("total_revenue"),
        F.when(total > 0, per_unit(revenue, total)).otherwise(0.0).alias("revenue_per_trip"),
        per_unit(F.sum("margin"), F.sum("margins")).alias("avg_margin"),
        F.max_by("hour", F.struct("demand", -F.col("hour"))).alias("peak_hour"),
        F.when(F.sum("weekend") > F.sum("weekday"), F.lit("weekend")).otherwise(F.lit("weekday")).alias("heavier_days"),
        (per_unit(F.sum("rush"), total) * 100.0).alias("rush_hour_pct"),
    )


def identified(feed: DataFrame, at: datetime) -> DataFrame:
    """Anomaly id and time of detection for the feed of one cycle."""
    number = F.lpad(F.col("anomaly_no").cast("string"), 3, "0")
    return feed.withColumns({"anomaly_id": F.concat(F.lit(f"{at:%Y%m%dT%H%M%S}-"), number), "detected_at": naive(at)})


def described(actions: DataFrame, at: datetime) -> DataFrame:
    """A line of text and the time of the proposal for each action."""
    said = F.lower(F.replace(F.col("action_type"), F.lit("_"), F.lit(" ")))
    text = F.concat(said, F.lit(" in zone "), F.col("zone_id").cast("string"))
    return actions.withColumns({"description": text, "proposed_at": naive(at)})


def proposed_actions(feed: DataFrame, zones: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Action type, expected impact and confidence for each anomaly of a feed.

    ``feed`` needs ``type``, ``zone_id`` and ``potential_gain``. The types LOW_REVENUE and
    UNDERPERFORMING are sized from the zone's totals in ``zones``, the zone statistics.
    """
    totals = zones.select(
        F.col("cluster_id").alias("zone_id"),
        F.coalesce("revenue_sum", F.lit(0.0)).alias("_revenue"),
        F.coalesce("demand_sum", F.lit(0.0)).alias("_demand"),
        F.col("fare_mean").alias("_fare"),
    )
    kind = F.col("type")

    def by_type(opportunity, inefficient, low_revenue, underperforming) -> Column:
        return (
            F.when(kind == OPPORTUNITY, opportunity)
            .when(kind == INEFFICIENT, inefficient)
            .when(kind == "LOW_REVENUE", low_revenue)
            .when(kind == "UNDERPERFORMING", underperforming)
        )

    return (
        feed.join(totals, "zone_id", "left")
        .withColumn(
            "action_type",
            by_type(
                F.lit("COMPREHENSIVE_OPTIMIZATION"), F.lit("PRICE_OPTIMIZATION"), F.lit("PRICE_INCREASE"), F.lit("DEMAND_BOOST")
            ),
        )
        .withColumn(
            "expected_impact",
            by_type(
                F.col("potential_gain") * p.opportunity_reach,
                F.col("potential_gain") * p.efficiency_reach,
                F.col("_revenue") * p.low_revenue_reach,
                F.col("_demand") * p.demand_boost_reach * F.col("_fare"),
            ),
        )
        .withColumn("confidence", by_type(F.lit("HIGH"), F.lit("HIGH"), F.lit("HIGH"), F.lit("MEDIUM")))
        .withColumn("action_status", F.lit("PROPOSED"))
        .drop("_revenue", "_demand", "_fare")
    )


def cycle_report(feed: DataFrame, actions: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones watched, anomalies found, actions proposed and their impact."""
    acted = actions.agg(
        F.count(F.lit(1)).alias("actions_proposed"),
        F.coalesce(F.sum("expected_impact"), F.lit(0.0)).alias("total_impact"),
    )
    watched = zones.agg(F.count(F.lit(1)).alias("zones_monitored"))
    found = feed.agg(
        F.count(F.lit(1)).alias("anomalies_detected"),
        F.count_if(F.col("type") == OPPORTUNITY).alias("opportunities"),
        F.count_if(F.col("type") == INEFFICIENT).alias("inefficiencies"),
    )
    return attach(attach(watched, found), acted)


def deviation(df: DataFrame, actual: str, expected: str) -> DataFrame:
    return df.withColumn("deviation_pct", pct_change(F.col(actual), F.col(expected)))


def alert_reasons(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Add ``reasons``: off forecast, with a negative margin, with a wide interval; empty where all is well.

    The interval test applies where ``relative_width`` is a column.
    """
    off = F.abs(per_unit(F.col("revenue_total") - F.col("revenue_pred"), F.col("revenue_pred")))
    tests = [(off > p.revenue_variance, "revenue_variance"), (F.col("margin_pred") < 0, "negative_margin")]
    if "relative_width" in df.columns:
        tests.append((F.col("relative_width") > p.interval_width, "wide_interval"))
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests])))


def threshold_alerts(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows with any reason for an alert (:func:`alert_reasons`)."""
    return alert_reasons(df, p).where(F.size("reasons") > 0)
