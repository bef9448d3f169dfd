"""Chronological train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.params import DEFAULTS, Params
from faregrid.plans.positions import running_offsets, with_positions
from faregrid.plans.thresholds import attach


def _cut(n: Column, ratio: float) -> Column:
    return F.floor(n * F.lit(ratio))


def _ratios(p: Params) -> tuple[float, float]:
    return p.train_ratio, p.train_ratio + p.validation_ratio


def global_split(df: DataFrame, zone: str = "cluster_id", bins: str = "time_bin", p: Params = DEFAULTS) -> DataFrame:
    """Label rows by position after a sort on (bin, zone).

    Only the first cell of the validation and of the test part is looked up:
    counts per bin give the bin that holds it, and the zones of that one bin
    are ranked. The rows themselves are then labelled by comparison, with no
    shuffle and no sort of the whole table. The keys of ``df`` are read a few
    times, so it should be a written table.
    """
    first_ratio, second_ratio = _ratios(p)
    counts = df.groupBy(bins).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all")).select(
        _cut(F.col("_all"), first_ratio).alias("_cut1"), _cut(F.col("_all"), second_ratio).alias("_cut2")
    )
    placed = attach(running_offsets(counts, bins, "_n"), total)

    def first_cell(cut: str) -> DataFrame:
        holding = placed.where((F.col("before") <= F.col(cut)) & (F.col(cut) < F.col("before") + F.col("_n")))
        target = holding.agg(F.max(bins).alias("_bin"), F.max(F.col(cut) - F.col("before")).alias("_skip"))
        inside = attach(df.select(bins, zone), target).where(F.col(bins) == F.col("_bin"))
        ranked = inside.withColumn("_rank", F.row_number().over(Window.partitionBy(bins).orderBy(zone)) - 1)
        return ranked.where(F.col("_rank") == F.col("_skip")).agg(
            F.max(bins).alias(f"{cut}_bin"), F.max(zone).alias(f"{cut}_zone")
        )

    marked = attach(attach(df, first_cell("_cut1")), first_cell("_cut2"))

    def earlier(cut: str) -> Column:
        bin_edge, zone_edge = F.col(f"{cut}_bin"), F.col(f"{cut}_zone")
        test = (F.col(bins) < bin_edge) | ((F.col(bins) == bin_edge) & (F.col(zone) < zone_edge))
        return F.coalesce(test, F.lit(True))

    label = F.when(earlier("_cut1"), F.lit("train")).when(earlier("_cut2"), F.lit("validation")).otherwise(F.lit("test"))
    return marked.withColumn("split", label).select(*df.columns, "split")


def zone_split(df: DataFrame, zone: str = "cluster_id", bins: str = "time_bin", p: Params = DEFAULTS) -> DataFrame:
    """Label rows by position within their zone."""
    first_ratio, second_ratio = _ratios(p)
    base = df.drop("pos", "n_rows")
    placed = with_positions(base, [zone], bins)
    index = F.col("pos") - 1
    label = (
        F.when(index < _cut(F.col("n_rows"), first_ratio), F.lit("train"))
        .when(index < _cut(F.col("n_rows"), second_ratio), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return placed.withColumn("split", label).select(*base.columns, "split")
