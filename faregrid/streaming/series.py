"""Streaming zone x bin series and monitoring per trigger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faregrid.functions.calendar import calendar_columns, elapsed_micros, naive
from faregrid.operators.clean import clean_main
from faregrid.operators.zones import assign_zone
from faregrid.params import DEFAULTS, Params
from faregrid.plans.revenue import monitoring_tables
from faregrid.storage import newest, staged

CELL = ("cluster_id", "bin_start")


def windowed_series(trips: DataFrame, p: Params = DEFAULTS, late: str = "10 minutes") -> DataFrame:
    """The columns of the batch series per zone and epoch-aligned bin, from raw trips.

    Works on streams and on tables. Trips are cleaned first. On a stream the state is one row per
    open (bin, zone); a bin is open until the watermark has passed its end.
    """
    # The event time is the clock reading as an instant, whatever the session zone.
    instant = F.timestamp_micros(elapsed_micros(naive(datetime(1970, 1, 1)), F.col("pickup_datetime")))
    stamped = assign_zone(clean_main(trips, p)).where(F.col("cluster_id").isNotNull()).withColumn("_instant", instant)
    cells = (
        stamped.withWatermark("_instant", late)
        .groupBy(F.window("_instant", f"{p.bin_seconds} seconds").alias("w"), "cluster_id")
        .agg(
            F.count("VendorID").alias("demand"),
            F.sum("total_amount").alias("revenue_total"),
            F.avg("total_amount").alias("avg_fare"),
            F.avg("trip_distance").alias("avg_distance"),
            F.avg("trip_duration_minutes").alias("avg_duration"),
            F.min("pickup_datetime").alias("_first"),
        )
    )
    parts = calendar_columns(F.col("_first"), p.rush_hours)
    flags = {name: parts[name] for name in ("hour", "day_of_week", "is_weekend", "is_rush_hour")}
    edges = {"bin_start": F.unix_seconds("w.start"), "bin_end": F.unix_seconds("w.end")}
    return cells.withColumns(flags | edges).drop("w", "_first")


# Sums that make up a cell; each is a column of the parts a batch adds to it.
_MEANS = {"avg_fare": "total_amount", "avg_distance": "trip_distance", "avg_duration": "trip_duration_minutes"}
CLOSED = "_closed"


def _stamped(trips: DataFrame, p: Params) -> DataFrame:
    """Clean trips with a zone, and the first second of their epoch-aligned bin."""
    seconds = F.floor(elapsed_micros(naive(datetime(1970, 1, 1)), F.col("pickup_datetime")) / F.lit(1_000_000))
    bins = (F.floor(seconds / F.lit(p.bin_seconds)) * F.lit(p.bin_seconds)).cast("long")
    return assign_zone(clean_main(trips, p)).where(F.col("cluster_id").isNotNull()).withColumn("bin_start", bins)


def _parts(stamped: DataFrame) -> DataFrame:
    """What trips add to their cells."""
    sums = {f"sum_{c}": F.sum(c) for c in _MEANS.values()} | {f"n_{c}": F.count(c) for c in _MEANS.values()}
    return stamped.groupBy(*CELL).agg(
        F.count("VendorID").alias("demand"), F.min("pickup_datetime").alias("first"), *(c.alias(n) for n, c in sums.items())
    )


def _added(parts: DataFrame) -> DataFrame:
    """Parts of a cell as one row."""
    sums = ["demand", *(f"{kind}_{c}" for c in _MEANS.values() for kind in ("sum", "n"))]
    return parts.groupBy(*CELL).agg(F.min("first").alias("first"), *(F.sum(c).alias(c) for c in sums))


def start_additive(trips: DataFrame, path: str, checkpoint: str, p: Params = DEFAULTS, late_seconds: int = 600) -> StreamingQuery:
    """Take what is available and stop, adding each batch's trips to their cells, however late they come.

    A cell is made of counts, sums and a minimum, so a trip that comes after its bin's end only adds to
    it: :func:`added_cells` equals the batch series whatever the order of arrival, and no
    state grows with open bins. Trips that come more than ``late_seconds`` after a bin's end, by the latest
    pickup of earlier batches, are also listed (:func:`late_trips`). A batch writes folders of its own, so
    one that is repeated overwrites what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stamped = staged(_stamped(batch, p), "arrived-trips")
        latest = F.max(F.col("bin_start")).alias("latest")
        before = spark.read.schema("latest long, batch long").parquet(f"{path}/marks") if batch_id else None
        mark = before.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0] if before is not None else None
        if mark is not None:
            closed = F.col("bin_start") + F.lit(p.bin_seconds + late_seconds) <= F.lit(mark)
            late = stamped.where(closed).withColumn(CLOSED, F.lit(mark))
            late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        _parts(stamped).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        stamped.agg(latest).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")

    return trips.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, path: str) -> int:
    """Add up the parts so far under the last batch's number, so that readers take them instead; the number, or -1.

    Parts stay until a later clean-up, so readers that began before still find them.
    """
    last = newest(spark, f"{path}/parts", "batch")
    done = newest(spark, f"{path}/compacted", "upto")
    if last > done:
        _added(_current_parts(spark, path)).write.mode("overwrite").parquet(f"{path}/compacted/upto={last}")
    return last


def _current_parts(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts")
    done = newest(spark, f"{path}/compacted", "upto")
    if done < 0:
        return parts.drop("batch")
    return spark.read.parquet(f"{path}/compacted/upto={done}").unionByName(parts.where(F.col("batch") > done).drop("batch"))


def added_cells(spark: SparkSession, path: str, p: Params = DEFAULTS) -> DataFrame:
    """The series of all trips that have arrived, with the columns of :func:`windowed_series`."""
    cells = _added(_current_parts(spark, path))
    parts = calendar_columns(F.col("first"), p.rush_hours)
    means = {name: F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}").cast("double")) for name, c in _MEANS.items()}
    flags = {name: parts[name] for name in ("hour", "day_of_week", "is_weekend", "is_rush_hour")}
    named = cells.withColumns(means | flags | {"revenue_total": F.col("sum_total_amount"), "bin_end": F.col("bin_start") + F.lit(p.bin_seconds)})
    return named.select(*CELL, "demand", "revenue_total", *_MEANS, "bin_end", *flags)


def late_trips(spark: SparkSession, path: str) -> DataFrame | None:
    """Trips that came after their bin had closed, each with its ``batch``; None if no batch could have any."""
    return spark.read.parquet(f"{path}/late") if newest(spark, f"{path}/late", "batch") >= 0 else None


def start_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take what is available and stop, writing the cells each batch has changed.

    Open bins are written too, so nothing waits for a watermark that no further trip moves. A
    batch writes its own folder, so one that is repeated overwrites what it wrote before.
    """

    def write(cells: DataFrame, batch_id: int) -> None:
        cells.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_cells(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each cell that :func:`start_to_table` has written."""
    written = spark.read.parquet(path)
    rest = [c for c in written.columns if c not in (*CELL, "batch")]
    latest = written.groupBy(*CELL).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return latest.select(*CELL, "last.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had closed their bin, in the recent batches."""
    return sum(int(s["numRowsDroppedByWatermark"]) for x in query.recentProgress for s in x["stateOperators"])


def start_monitoring(
    arrivals: DataFrame,
    update_predictions: Callable[[DataFrame, int], DataFrame],
    report_path: str,
    checkpoint: str,
    p: Params = DEFAULTS,
    available_now: bool = False,
    every: str = "60 minutes",
) -> StreamingQuery:
    """Take each trigger's arrivals into the predictions and run the monitoring cycle on them.

    ``update_predictions`` gets the arrivals of the batch and its id and returns the predictions
    that are current with them. A batch id names its own output folder, so a repeated batch overwrites
    what it wrote before.
    """

    def cycle(batch: DataFrame, batch_id: int) -> None:
        feed, actions, report = monitoring_tables(update_predictions(batch, batch_id), p)
        target = f"{report_path}/batch={batch_id}"
        feed.write.mode("overwrite").parquet(f"{target}/kind=feed")
        actions.write.mode("overwrite").parquet(f"{target}/kind=actions")
        report.write.mode("overwrite").parquet(f"{target}/kind=report")

    writer = arrivals.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
