"""Row positions and windows without one task per key.

A zone can hold a large share of all rows, so a window partitioned by zone
alone puts that share into one task. Positions are counted per (key, range of
the ordering column) and offset by a running total over the small table of
range sizes. Windows with a bounded look-back then run over fixed-size blocks
of positions, each preceded by a copy of the rows it looks back to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANGE_WIDTH = 4096


def with_positions(
    df: DataFrame, key: Sequence[str], order: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Add ``pos`` (1..n in ``order`` within ``key``) and ``n_rows`` per key.

    ``df`` is read twice, so it should be a scan or otherwise cheap.
    """
    key = list(key)
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    sizes = cut.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *key,
        "_range",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(*key)).alias("n_rows"),
    )
    inside = Window.partitionBy(*key, "_range").orderBy(order)
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*key, "_range"])
        .withColumn("pos", F.col("_before") + F.col("_rank"))
        .drop("_range", "_rank", "_before")
    )


def in_blocks(df: DataFrame, size: int, halo: int) -> DataFrame:
    """Copy the last ``halo`` rows of each block of ``size`` positions onward.

    Adds ``_block`` (the block this copy serves) and ``_own`` (false on the
    copies). Compute over :func:`block_window`, then call :func:`out_of_blocks`.
    """
    if halo > size:
        raise ValueError("the look-back must fit in one block")
    offset = F.col("pos") - 1
    block = F.floor(offset / F.lit(size))
    near_end = (offset % F.lit(size)) >= F.lit(size - halo)
    own = F.struct(block.alias("_block"), F.lit(True).alias("_own"))
    copy = F.struct((block + 1).alias("_block"), F.lit(False).alias("_own"))
    return df.select("*", F.inline(F.when(near_end, F.array(own, copy)).otherwise(F.array(own))))


def block_window(key: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key, "_block").orderBy("pos")


def out_of_blocks(df: DataFrame) -> DataFrame:
    """Keep each row once, in its own block."""
    return df.where(F.col("_own")).drop("_block", "_own")


def running_offsets(counts: DataFrame, order: str, size: str, width: int = RANGE_WIDTH) -> DataFrame:
    """Add ``before``: total ``size`` of all rows with a smaller ``order``.

    Two levels, so only the table of range totals is ordered in one task.
    """
    cut = counts.withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    totals = cut.groupBy("_range").agg(F.sum(size).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inner", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(offsets, "_range")
        .withColumn("before", F.col("_base") + F.col("_inner"))
        .drop("_range", "_base", "_inner")
    )
