"""Features of a series that grows, from state of a fixed size per zone.

A feature looks back a bounded number of rows. So the state between triggers is the last rows of
each zone with their positions: a trigger reads that state and the cells that have arrived, and
computes features for those cells alone, however long the history is.

Cells come in any order inside a batch. A zone whose cells arrive at or before its last bin has
changed its past: its rows are taken from the stored cells and all its features are written
again. Of a cell that arrives twice the later batch holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faregrid.operators.features import look_back_rows, placed_features
from faregrid.params import DEFAULTS, Params
from faregrid.plans.positions import with_positions
from faregrid.storage import newest, staged


def _latest(rows: DataFrame, zone: str, bins: str) -> DataFrame:
    """Each cell as the last batch has it."""
    rest = [c for c in rows.columns if c not in (zone, bins, "batch")]
    one = rows.groupBy(zone, bins).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return one.select(zone, bins, *(F.col(f"_last.{c}").alias(c) for c in rest))


def advance(
    cells: DataFrame,
    batch_id: int,
    path: str,
    zone: str = "cluster_id",
    bins: str = "time_bin",
    target: str = "demand",
    p: Params = DEFAULTS,
    previous: Sequence[str] = (),
) -> DataFrame:
    """Features of the ``cells`` of a batch, and of all cells of a zone whose past they change.

    Writes cells, features and the state after the batch below ``path``. A repeated batch starts from
    the state before it and overwrites what it wrote.
    """
    spark = cells.sparkSession
    columns = cells.columns
    folder = {name: f"{path}/{name}/batch={batch_id}" for name in ("cells", "features", "state")}
    cells.write.mode("overwrite").parquet(folder["cells"])
    cells = spark.read.parquet(folder["cells"])
    before = newest(spark, f"{path}/state", "batch", below=batch_id)
    if before < 0:
        placed = with_positions(cells, [zone], bins).drop("n_rows").withColumn("_new", F.lit(True))
    else:
        state = spark.read.parquet(f"{path}/state/batch={before}")
        ends = state.groupBy(zone).agg(F.max("pos").alias("_end"), F.max(bins).alias("_last"))
        changed = staged(cells.join(ends, zone).where(F.col(bins) <= F.col("_last")).select(zone).distinct(), "changed-zones")
        ahead = with_positions(cells.join(changed, zone, "left_anti"), [zone], bins).drop("n_rows")
        ahead = ahead.join(ends, zone, "left").withColumn("pos", F.col("pos") + F.coalesce("_end", F.lit(0))).drop("_end", "_last")
        placed = ahead.withColumn("_new", F.lit(True)).unionByName(state.join(changed, zone, "left_anti").withColumn("_new", F.lit(False)))
        if not changed.isEmpty():
            stored = spark.read.parquet(f"{path}/cells").where(F.col("batch") <= batch_id).join(changed, zone, "left_semi")
            again = with_positions(staged(_latest(stored, zone, bins).select(columns), "changed-cells"), [zone], bins).drop("n_rows")
            placed = placed.unionByName(again.withColumn("_new", F.lit(True)))
    placed = staged(placed, "placed-cells")
    ends = placed.groupBy(zone).agg(F.max("pos").alias("_end"))
    kept = placed.join(ends, zone).where(F.col("pos") > F.col("_end") - look_back_rows(p)).drop("_end", "_new")
    placed_features(placed, zone, target, p, previous).where("_new").drop("_new").write.mode("overwrite").parquet(folder["features"])
    kept.write.mode("overwrite").parquet(folder["state"])
    return spark.read.parquet(folder["features"])


def start_features(cells: DataFrame, path: str, checkpoint: str, **names) -> StreamingQuery:
    """Take the cells that have arrived, a batch at a time, and stop; ``names`` as for :func:`advance`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        advance(batch, batch_id, path, **names)

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_features(spark: SparkSession, path: str, zone: str = "cluster_id", bins: str = "time_bin") -> DataFrame:
    """Features of all cells that have arrived."""
    return _latest(spark.read.parquet(f"{path}/features"), zone, bins)
