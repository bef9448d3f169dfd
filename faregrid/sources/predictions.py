"""Predictions table: schema, scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.storage import staged

PREDICTIONS_SCHEMA = """
    cluster_id int, time_bin int, demand bigint, revenue_total double,
    avg_fare double, avg_distance double, avg_duration double,
    hour int, day_of_week int, is_weekend int, is_rush_hour int,
    ft_1 bigint, ft_2 bigint, ft_3 bigint, ft_4 bigint, ft_5 bigint, exp_avg double,
    demand_pred double, revenue_pred double, avg_fare_pred double,
    driver_costs double, processing_fees double, ops_costs double,
    total_costs double, profit_pred double, margin_pred double
"""


def read_predictions_csv(spark: SparkSession, path: str, schema: str = PREDICTIONS_SCHEMA) -> DataFrame:
    """CSV predictions with a declared schema, so no inference pass."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_predictions_with_rejects(spark: SparkSession, path: str, schema: str = PREDICTIONS_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV predictions that fit the schema, and the lines that don't as (file, line).

    The files are parsed once, and both tables are scans of what was written.
    """
    reader = spark.read.schema(f"{schema}, {REJECTED} string").option("header", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)
    parsed = staged(reader.csv(path).withColumn("_file", F.col("_metadata.file_path")), "parsed-predictions")
    bad = F.col(REJECTED).isNotNull()
    return parsed.where(~bad).drop(REJECTED, "_file"), parsed.where(bad).select(F.col("_file").alias("file"), F.col(REJECTED).alias("line"))


REJECTED = "_rejected"


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write the partitions that ``df`` has rows of in place of what they held; the others keep their files.

    So a run that is repeated leaves one copy. Rows per partition are listed beside the data, in
    a folder that scans of the table pass over; returns that list.
    """
    if not partition_by:
        raise ValueError("expected partition columns")
    writer = df.hint("rebalance", *partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    spark = df.sparkSession
    # Partition values and row counts come from folder names and file footers.
    sizes = spark.read.parquet(path).groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return spark.read.json(f"{path}/_manifest")


def write_predictions(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write predictions as Parquet or CSV, optionally partitioned.

    With partition columns the rows are first brought together by them, so a
    partition folder gets few files rather than one per task. It is a rebalance:
    adaptive execution splits the rows of a large partition value over tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
