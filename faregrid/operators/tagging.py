"""Question tagging over a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.functions import questions as q
from faregrid.plans.columns import with_computed


def known_zone_ids(predictions: DataFrame) -> DataFrame:
    """One row with the array of zone ids; zones are a bounded dimension."""
    zones = predictions.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count(F.lit(1)))
    return zones.agg(F.array_sort(F.collect_list(F.col("cluster_id").cast("bigint"))).alias("known"))


def tag_questions(texts: DataFrame, predictions: DataFrame, text: str = "text") -> DataFrame:
    """Hour, weekday, part of the day, zones and intent of every question.

    General questions may ask for several things at once: overall averages,
    one zone's means and the rows with the highest margin.
    """
    lowered = with_computed(texts, {"_q": F.lower(F.col(text))}).withColumn("_known", known_zone_ids(predictions).scalar())
    slots = with_computed(
        lowered,
        {
            "asked_hour": q.asked_hour("_q"),
            "asked_weekday": q.asked_weekday("_q"),
            "named_zones": q.named_zones("_q"),
            "_high": q.has_any("_q", q.HIGH),
            "_low": q.has_any("_q", q.LOW),
        },
    )
    slot_names = ("asked_hour", "asked_weekday", "named_zones", "_high", "_low")
    tagged = with_computed(
        slots,
        {
            "asked_day_part": q.asked_day_part("_q", F.col("asked_hour")),
            "intent": q.intent("_q", F.col("_known"), *[F.col(c) for c in slot_names]),
        },
    )
    general = F.col("intent") == "general"
    open_time = F.col("asked_hour").isNull() & F.col("asked_weekday").isNull()
    overall = open_time & (F.col("asked_day_part").isNull() | q.has_any("_q", q.OVERALL))
    looked_up = F.regexp_extract("_q", q.LOOKUP_PATTERN, 1)
    lookup = F.when(
        general & (looked_up != "") & ~q.has_any("_q", q.OPEN_ZONE), looked_up.try_cast("bigint")
    )
    return tagged.withColumns(
        {
            "wants_overall": (general & overall).cast("int"),
            "lookup_zone": lookup,
            "wants_margin": (general & q.has_any("_q", q.MARGIN)).cast("int"),
        }
    ).drop("_q", "_known", "_high", "_low")
