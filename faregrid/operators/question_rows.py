"""Answer rows of whole tables of tagged questions, beyond the rankings of :mod:`answers`.

Every question of a table is answered in one pass: what can be asked is worked out once per zone
or slice, and the questions meet it by key. ``tagged`` comes from :func:`tagging.tag_questions`; its
columns stay, so answers carry the question's key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.functions import questions as q
from faregrid.functions.economics import per_unit
from faregrid.operators.answers import (
    ROW_ORDER,
    SLOT,
    coverage,
    improvement_zones,
    overall_averages,
    price_increase_zones,
    slices_of_row,
    slot_key,
    zone_means,
)
from faregrid.params import DEFAULTS, Params
from faregrid.plans.thresholds import attach


def zone_periods(df: DataFrame) -> DataFrame:
    """Totals and averages per period of every zone."""
    totals = df.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.sum("demand_pred").alias("demand"), F.sum("revenue_pred").alias("revenue"), F.count(F.lit(1)).alias("periods")
    )
    per_trip = F.when(F.col("demand") > 0, per_unit(F.col("revenue"), F.col("demand"))).otherwise(0.0)
    return totals.withColumns(
        {
            "avg_demand": F.col("demand") / F.col("periods"),
            "avg_revenue": F.col("revenue") / F.col("periods"),
            "per_trip": per_trip,
        }
    )


def compared_zones(tagged: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """One row per question that compares two zones: both zones' figures and the differences in percent.

    The zones are the first two numbers of the text. A zone may be compared with itself.
    """
    pair = q.numbers("_q")
    asked = (
        tagged.where(F.col("intent") == "compare")
        .withColumn("_q", F.lower(F.col(text)))
        .withColumns({"zone_1": F.get(pair, F.lit(0)), "zone_2": F.get(pair, F.lit(1))})
        .drop("_q")
    )
    zones = zone_periods(df)
    for side in ("1", "2"):
        own = zones.select(F.col("cluster_id").cast("bigint").alias(f"zone_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in zones.columns[1:]])
        asked = asked.join(own, f"zone_{side}")

    def difference(name: str):
        base = F.col(f"{name}_2")
        return F.when(base > 0, per_unit(F.col(f"{name}_1") - base, base) * 100.0).otherwise(0.0)

    return asked.withColumns({"demand_diff_pct": difference("avg_demand"), "revenue_diff_pct": difference("avg_revenue")})


def best_rows_of_slices(df: DataFrame, measure: str, k: int) -> DataFrame:
    """The ``k`` rows with most ``measure`` of every slice, ranked; ties by bin, then zone.

    Rows are ranked per (hour, weekday) first, where tasks keep ``k`` rows before the shuffle, so
    that the slices meet some hundreds of rows only.
    """
    order = [F.desc(measure), *ROW_ORDER]
    rows = df.where(F.col(measure).isNotNull() & F.col("cluster_id").isNotNull())
    within = F.row_number().over(Window.partitionBy("hour", "day_of_week").orderBy(*order))
    best = rows.withColumn("_rank", within).where(F.col("_rank") <= k).drop("_rank")
    spread = best.select("*", F.inline(slices_of_row())).drop("hour", "day_of_week")
    rank = F.row_number().over(Window.partitionBy(*SLOT).orderBy(*order))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k)


def peak_rows(tagged: DataFrame, df: DataFrame) -> DataFrame:
    """Answers to "where is most demand": the row with most of it in the slice and up to two alternatives.

    Alternatives are those of the three best rows that lie outside the best one's zone. A question about
    an empty slice gets one row with the rows and zones of the whole table instead (``from_slice`` false).
    """
    best = best_rows_of_slices(df.select(*ROW_ORDER, "hour", "day_of_week", "demand_pred", "revenue_pred"), "demand_pred", 3)
    slice_ = Window.partitionBy(*SLOT)
    winner = F.max(F.when(F.col("rank") == 1, F.col("cluster_id"))).over(slice_)
    full = F.count(F.lit(1)).over(slice_) == 3
    told = best.withColumns({"_winner": winner, "_full": full}).where((F.col("rank") == 1) | (F.col("_full") & (F.col("cluster_id") != F.col("_winner"))))
    numbered = told.withColumn("rank", F.row_number().over(slice_.orderBy("rank"))).drop("_winner", "_full")
    asked = tagged.where(F.col("intent") == "peak_cell").withColumn("_slot", slot_key())
    rows = asked.join(numbered.withColumn("_slot", slot_key()).drop(*SLOT), "_slot", "left").drop("_slot")
    whole = coverage(df).select(F.col("n_rows").alias("_all"), F.col("zones").alias("_zones"))
    found = F.col("rank").isNotNull()
    return (
        attach(rows, whole)
        .withColumns({"from_slice": found, "n_rows": F.when(~found, F.col("_all")), "zones": F.when(~found, F.col("_zones"))})
        .drop("_all", "_zones")
    )


def advised_zones(tagged: DataFrame, df: DataFrame, k: int = 5, p: Params = DEFAULTS) -> DataFrame:
    """Zones that need improvement or can bear a price increase, for each question that asks for them.

    Both lists look at the whole table whatever the slot; ``upside`` belongs to price increases.
    """
    names = ["cluster_id", "demand", "revenue", "margin", "upside"]
    improve = improvement_zones(df, k).withColumn("upside", F.lit(None).cast("double"))
    price = price_increase_zones(df, k, p)
    ordered = (("improvement", improve, F.asc("revenue")), ("price_increase", price, F.desc("demand")))
    listed = [
        zones.select(F.lit(intent).alias("intent"), F.row_number().over(Window.orderBy(key, "cluster_id")).alias("rank"), *names)
        for intent, zones, key in ordered  # k rows each, so one window over all of them
    ]
    return tagged.join(listed[0].unionByName(listed[1]), "intent")


def general_rows(tagged: DataFrame, df: DataFrame, k: int = 5) -> DataFrame:
    """Answer rows of general questions, by ``part``: overall averages, one zone's means, rows of the slice with most margin.

    A question gets the parts its tags ask for, and may get none.
    """
    names = ("part", "rank", "cluster_id", "time_bin", "demand", "revenue", "profit", "margin", "n_rows")
    kinds = {"rank": "int", "cluster_id": "bigint", "n_rows": "bigint", "demand": "double", "revenue": "double", "profit": "double", "margin": "double"}

    def shaped(rows: DataFrame, part: str) -> DataFrame:
        rows = rows.withColumn("part", F.lit(part))
        for name in names:
            if name not in rows.columns:
                empty = F.lit(None).cast(dict(df.dtypes)["time_bin"]) if name == "time_bin" else F.lit(None).cast(kinds[name])
                rows = rows.withColumn(name, empty)
        return rows.select(*tagged.columns, *[F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in names])

    general = tagged.where(F.col("intent") == "general")
    means = {"avg_demand": "demand", "avg_revenue": "revenue", "avg_margin": "margin", "avg_profit": "profit"}
    overall = attach(general.where(F.col("wants_overall") == 1), overall_averages(df).withColumnsRenamed(means))
    zones = zone_means(df).withColumnsRenamed(means).withColumn("cluster_id", F.col("cluster_id").cast("bigint"))
    looked_up = general.join(zones, general["lookup_zone"] == zones["cluster_id"])
    best = best_rows_of_slices(df.select(*ROW_ORDER, "hour", "day_of_week", "profit_pred", "margin_pred"), "margin_pred", k)
    best = best.withColumn("_slot", slot_key()).drop(*SLOT).withColumnsRenamed({"profit_pred": "profit", "margin_pred": "margin"})
    asked = general.where(F.col("wants_margin") == 1).withColumn("_slot", slot_key())
    parts = [shaped(overall, "overall"), shaped(looked_up, "zone"), shaped(asked.join(best, "_slot"), "margin")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
