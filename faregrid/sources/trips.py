"""Trip scans and column normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Provider column names and the names used here.
PROVIDER_NAMES = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
}
TIMESTAMPS = ("pickup_datetime", "dropoff_datetime")


def load_trips(spark: SparkSession, *paths: str) -> DataFrame:
    """Scan trip files or folders and normalise their columns."""
    return normalise_trips(spark.read.parquet(*paths))


def load_by_role(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> DataFrame:
    """Scan several file lists, tagging each row with the role of its list."""
    parts = [load_trips(spark, *paths).withColumn("role", F.lit(role)) for role, paths in files.items() if paths]
    if not parts:
        raise ValueError("no files given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def normalise_trips(df: DataFrame) -> DataFrame:
    """Canonical names, timestamps instead of strings, NULL instead of NaN.

    Text that is no timestamp becomes NULL and is removed by the cleaning.
    """
    df = df.withColumnsRenamed(PROVIDER_NAMES)
    fixed = {}
    for field in df.schema.fields:
        column = F.col(field.name)
        if field.name in TIMESTAMPS and isinstance(field.dataType, T.StringType):
            fixed[field.name] = F.try_to_timestamp(column)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            fixed[field.name] = F.when(~F.isnan(column), column)
    return df.withColumns(fixed) if fixed else df
