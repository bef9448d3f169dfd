"""Alerts on arriving cells, against predictions that change while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faregrid.operators.anomalies import alert_reasons
from faregrid.params import DEFAULTS, Params
from faregrid.storage import newest, staged

CELL = ("cluster_id", "time_bin")


def start_alerts(
    arrivals: DataFrame, current: Callable[[int], DataFrame], path: str, checkpoint: str, p: Params = DEFAULTS
) -> StreamingQuery:
    """Take what is available and stop, testing every arriving cell (cluster_id, time_bin, revenue_total).

    ``current`` gets the batch's number and returns the predictions of that time, one row a cell, with
    revenue_pred, margin_pred and, for the interval test, relative_width. A cell without a prediction waits and is
    tested again with each later batch. A cell that arrives again, with corrected revenue, is judged anew;
    of a cell's rows within one batch the one with most revenue counts, and one that arrives outdoes one that waits.

    A trigger reads its arrivals, the cells that wait and the predictions, not the history. A batch reads
    what the one before it left and writes folders of its own, so one that is repeated gives the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*CELL, "revenue_total").withColumn("arrived", F.lit(batch_id).cast("long"))
        if batch_id:
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{path}/waiting/batch={batch_id - 1}"))
        latest = F.max(F.struct("arrived", F.col("revenue_total"))).alias("last")
        keyed = fresh.where(F.col("cluster_id").isNotNull() & F.col("time_bin").isNotNull())
        cells = staged(keyed.groupBy(*CELL).agg(latest).select(*CELL, "last.*"), "arrived-cells")
        # Few cells against many predictions: the semi join keeps the predictions where they are.
        known = current(batch_id).drop("revenue_total").join(cells.select(*CELL), list(CELL), "left_semi")
        tested = staged(alert_reasons(cells.join(known.withColumn("_known", F.lit(True)), list(CELL), "left"), p), "tested-cells")
        found = tested.where("_known").select(*CELL, "revenue_total", "revenue_pred", "reasons")
        found.write.mode("overwrite").parquet(f"{path}/tested/batch={batch_id}")
        waits = tested.where("_known is null").select(*CELL, "revenue_total", "arrived")
        waits.write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Cells whose latest test gave a reason, with ``batch``, the trigger that tested them last."""
    tested = spark.read.parquet(f"{path}/tested")
    rest = [c for c in tested.columns if c not in CELL and c != "batch"]
    last = tested.groupBy(*CELL).agg(F.max("batch").alias("batch"), F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*CELL, "batch", "last.*").where(F.size("reasons") > 0)


def waiting_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells that have arrived but have no prediction yet, with the batch they ``arrived`` in."""
    return spark.read.parquet(f"{path}/waiting/batch={newest(spark, f'{path}/waiting', 'batch')}")
