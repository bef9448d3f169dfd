"""Positions in a total order without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm.common import written


def with_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add ``name``: 1..n in ``order`` within ``keys``. ``df`` has slim rows.

    Rows are dealt by ranges of (keys, order), so a hot key spans many ranges. Each range counts
    its rows per key; offsets are running totals over these counts.
    """
    sort = [F.col(k) for k in keys] + list(order)
    dealt = written(df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per key and range: as many as ranges and keys together.
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    left, right = dealt.withColumn("_inner", F.row_number().over(inside)).alias("l"), before.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    columns = [F.col(f"l.{c}").alias(c) for c in df.columns]
    return left.join(right, same).select(*columns, (F.col("_before") + F.col("_inner")).alias(name))
