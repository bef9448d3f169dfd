"""Slices of the predictions and the aggregates that answer questions.

Rankings are an ordered limit over an aggregate, which keeps k rows per task;
ties go to the lower zone id (rows: the earlier bin, then the lower id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.functions.economics import per_unit
from faregrid.operators.portfolio import zone_summary
from faregrid.params import DEFAULTS, Params
from faregrid.plans.thresholds import attach

# Hours of each part of the day.
DAY_PART_HOURS = {
    "morning": (6, 7, 8, 9, 10, 11),
    "afternoon": (12, 13, 14, 15, 16),
    "evening": (17, 18, 19, 20, 21),
    "night": (22, 23, 0, 1, 2, 3, 4, 5),
}
ROW_ORDER = ("time_bin", "cluster_id")


def slice_rows(
    df: DataFrame, hour: int | None = None, weekday: int | None = None, day_part: str | None = None
) -> DataFrame:
    """Rows of an hour, a weekday, a part of the day (unless an hour is given)."""
    if hour is not None:
        df = df.where(F.col("hour") == hour)
    if weekday is not None:
        df = df.where(F.col("day_of_week") == weekday)
    if day_part is not None and hour is None:
        df = df.where(F.col("hour").isin(list(DAY_PART_HOURS[day_part])))
    return df


def compare_two_zones(df: DataFrame, first: int, second: int) -> DataFrame:
    """Totals, averages per period and differences of two zones, as one row.

    Empty unless both zones have rows.
    """
    totals = (
        df.where(F.col("cluster_id").isin(first, second))
        .groupBy("cluster_id")
        .agg(F.sum("demand_pred").alias("demand"), F.sum("revenue_pred").alias("revenue"), F.count(F.lit(1)).alias("periods"))
        .withColumn("avg_demand", F.col("demand") / F.col("periods"))
        .withColumn("avg_revenue", F.col("revenue") / F.col("periods"))
        .withColumn(
            "per_trip", F.when(F.col("demand") > 0, per_unit(F.col("revenue"), F.col("demand"))).otherwise(0.0)
        )
    )
    names = ["demand", "revenue", "periods", "avg_demand", "avg_revenue", "per_trip"]

    def of(zone: int, tag: str) -> list:
        return [F.max(F.when(F.col("cluster_id") == zone, F.col(n))).alias(f"{n}_{tag}") for n in names]

    def diff(name: str):
        base = F.col(f"{name}_2")
        return F.when(base > 0, per_unit(F.col(f"{name}_1") - base, base) * 100.0).otherwise(0.0)

    return (
        totals.agg(*of(first, "1"), *of(second, "2"))
        .where(F.col("periods_1").isNotNull() & F.col("periods_2").isNotNull())
        .withColumn("demand_diff_pct", diff("avg_demand"))
        .withColumn("revenue_diff_pct", diff("avg_revenue"))
        .select(F.lit(first).alias("zone_1"), F.lit(second).alias("zone_2"), "*")
    )


def deployment(df: DataFrame, k: int = 5) -> DataFrame:
    """Zones with most demand and their share of these k zones' demand."""
    top = zone_totals(df).orderBy(F.desc("demand"), "cluster_id").limit(k)
    return top.withColumn("pct_of_top", per_unit(F.col("demand"), F.sum("demand").over(Window.partitionBy())) * 100.0)


def zone_totals(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(
            F.coalesce(F.sum("demand_pred"), F.lit(0.0)).alias("demand"),
            F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue"),
        )
    )


def top_demand_rows(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("demand_pred"), *ROW_ORDER).limit(k)


def peak_cell(df: DataFrame) -> DataFrame:
    """The row with most demand."""
    return top_demand_rows(df, 1).select("cluster_id", "time_bin", "demand_pred", "revenue_pred")


def alternatives(df: DataFrame) -> DataFrame:
    """Of the three rows with most demand, up to two outside the first one's zone."""
    top = top_demand_rows(df, 3).select("cluster_id", "time_bin", "demand_pred")
    order = Window.partitionBy().orderBy(F.desc("demand_pred"), *ROW_ORDER)
    ranked = top.withColumn("_winner", F.first("cluster_id").over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    others = ranked.where((F.col("_n") == 3) & (F.col("cluster_id") != F.col("_winner")))
    return others.orderBy(F.desc("demand_pred"), *ROW_ORDER).limit(2).drop("_winner", "_n")


def coverage(df: DataFrame) -> DataFrame:
    """Rows and zones of the whole table, the answer when a slice is empty."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cluster_id").alias("zones"))


def ranked_zones(df: DataFrame, by: str, k: int = 5, ascending: bool = False) -> DataFrame:
    """Zones with most (or least) total ``demand`` or ``revenue``."""
    key = F.asc(by) if ascending else F.desc(by)
    return zone_totals(df).orderBy(key, "cluster_id").limit(k)


def improvement_zones(df: DataFrame, k: int = 5) -> DataFrame:
    """Below-median revenue with demand above the lower quartile."""
    zones = zone_summary(df)
    cuts = zones.agg(
        F.median("revenue").alias("_median"), F.percentile("demand", F.lit(0.25)).alias("_p25")
    )
    return (
        attach(zones, cuts)
        .where((F.col("revenue") < F.col("_median")) & (F.col("demand") > F.col("_p25")))
        .orderBy("revenue", "cluster_id")
        .limit(k)
        .select("cluster_id", "revenue", "demand", "margin")
    )


def price_increase_zones(df: DataFrame, k: int = 5, p: Params = DEFAULTS) -> DataFrame:
    """High-demand zones with a margin that can bear a price increase."""
    zones = zone_summary(df)
    cut = zones.agg(F.percentile("demand", F.lit(p.price_increase_quantile)).alias("_cut"))
    return (
        attach(zones, cut)
        .where((F.col("demand") >= F.col("_cut")) & (F.col("margin") >= p.price_increase_margin))
        .orderBy(F.desc("demand"), "cluster_id")
        .limit(k)
        .select("cluster_id", "demand", "revenue", "margin", (F.col("revenue") * p.price_increase).alias("upside"))
    )


def overall_averages(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg("demand_pred").alias("avg_demand"),
        F.avg("revenue_pred").alias("avg_revenue"),
        F.avg("margin_pred").alias("avg_margin"),
    )


def zone_means(df: DataFrame, zones: Sequence[int] | None = None) -> DataFrame:
    """Mean demand, revenue, profit and margin of the given zones, or of all."""
    rows = df.where(F.col("cluster_id").isNotNull())
    if zones is not None:
        rows = rows.where(F.col("cluster_id").isin(list(zones)))
    return rows.groupBy("cluster_id").agg(
        F.avg("demand_pred").alias("avg_demand"),
        F.avg("revenue_pred").alias("avg_revenue"),
        F.avg("profit_pred").alias("avg_profit"),
        F.avg("margin_pred").alias("avg_margin"),
    )


def highest_margin_rows(df: DataFrame, k: int = 5) -> DataFrame:
    return (
        df.where(F.col("margin_pred").isNotNull())
        .orderBy(F.desc("margin_pred"), *ROW_ORDER)
        .limit(k)
        .select("cluster_id", "time_bin", "margin_pred", "profit_pred")
    )


def unknown_zones(requested: DataFrame, df: DataFrame) -> DataFrame:
    """Requested ``zone_id`` values without rows, with the known range and count."""
    known = df.where(F.col("cluster_id").isNotNull()).groupBy(F.col("cluster_id").cast("bigint").alias("zone_id")).agg(F.count(F.lit(1)))
    extent = known.agg(
        F.min("zone_id").alias("first_zone"), F.max("zone_id").alias("last_zone"), F.count("zone_id").alias("zones")
    )
    missing = requested.select(F.col("zone_id").cast("bigint").alias("zone_id")).distinct()
    return attach(missing.join(known.select("zone_id"), "zone_id", "left_anti"), extent)


def executive_rows(df: DataFrame, k: int = 5) -> DataFrame:
    """The rows with most and with least revenue, tagged by side."""
    names = ["cluster_id", "time_bin", "revenue_pred"]
    rows = df.where(F.col("revenue_pred").isNotNull())
    top = rows.orderBy(F.desc("revenue_pred"), *ROW_ORDER).limit(k).select(F.lit("top").alias("side"), *names)
    bottom = rows.orderBy("revenue_pred", *ROW_ORDER).limit(k).select(F.lit("bottom").alias("side"), *names)
    return top.unionByName(bottom)


def top_summaries(df: DataFrame, k: int = 20) -> DataFrame:
    """Zone summaries of the zones with most revenue."""
    return zone_summary(df).orderBy(F.desc("revenue"), "cluster_id").limit(k)


# What each ranking question asks for, and the order of the zones.
RANKINGS = {
    "top_revenue": ("revenue", False),
    "top_demand": ("demand", False),
    "bottom_demand": ("demand", True),
    "bottom_revenue": ("revenue", True),
    "deployment": ("demand", False),
}
SLOT = ("asked_hour", "asked_weekday", "asked_day_part")


def slices_of_row() -> Column:
    """The six slices that hold a row: its hour, its part of the day or any time, each on its weekday or on any day."""
    part = F.lit(None).cast("string")
    for name, hours in DAY_PART_HOURS.items():
        part = F.when(F.col("hour").isin(list(hours)), F.lit(name)).otherwise(part)
    nobody, nothing = F.lit(None).cast("int"), F.lit(None).cast("string")
    slots = [
        F.struct(hour.alias("asked_hour"), day.alias("asked_weekday"), of_day.alias("asked_day_part"))
        for hour, of_day in ((F.col("hour"), nothing), (nobody, part), (nobody, nothing))
        for day in (F.col("day_of_week"), nobody)
    ]
    return F.array(*slots)


def slot_key(*more: str) -> Column:
    """Key of text of a slice, whose null slots mean any: with it, slices meet by an equi-join."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("any")) for c in (*SLOT, *more)])


def slice_totals(df: DataFrame) -> DataFrame:
    """Demand, revenue and rows per zone of every slice a question can name.

    Rows are aggregated per (zone, hour, weekday) first; each of these cells is in six slices.
    """
    cells = df.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id", "hour", "day_of_week").agg(
        F.coalesce(F.sum("demand_pred"), F.lit(0.0)).alias("demand"),
        F.coalesce(F.sum("revenue_pred"), F.lit(0.0)).alias("revenue"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    spread = cells.select("cluster_id", "demand", "revenue", "n_rows", F.inline(slices_of_row()))
    return spread.groupBy(*SLOT, "cluster_id").agg(F.sum("demand").alias("demand"), F.sum("revenue").alias("revenue"), F.sum("n_rows").alias("n_rows"))


def answered_questions(tagged: DataFrame, df: DataFrame, k: int = 5) -> DataFrame:
    """Answer rows of the ranking questions of a tagged table.

    One row per question and ranked zone of its slice, up to ``k``. A question about an empty slice
    gets one row with the rows and zones of the whole table instead (``from_slice`` false). The
    rankings are made once per slice, of which there are a thousand at most, and met by slot.
    """
    totals = slice_totals(df)
    ranked = []
    for intent, (measure, ascending) in RANKINGS.items():
        key = F.asc(measure) if ascending else F.desc(measure)
        rank = F.row_number().over(Window.partitionBy(*SLOT).orderBy(key, "cluster_id"))
        ranked.append(totals.withColumns({"intent": F.lit(intent), "rank": rank}).where(F.col("rank") <= k))
    answers = ranked[0]
    for more in ranked[1:]:
        answers = answers.unionByName(more)
    asked = tagged.where(F.col("intent").isin(list(RANKINGS)))
    slot = slot_key("intent")
    rows = asked.withColumn("_slot", slot).join(answers.withColumn("_slot", slot).drop(*SLOT, "intent"), "_slot", "left")
    whole = coverage(df).select(F.col("n_rows").alias("_all"), F.col("zones").alias("_zones"))
    found = F.col("rank").isNotNull()
    return attach(rows, whole).withColumns(
        {
            "from_slice": found,
            "n_rows": F.when(found, F.col("n_rows")).otherwise(F.col("_all")),
            "zones": F.when(~found, F.col("_zones")),
        }
    ).drop("_slot", "_all", "_zones")
