"""Columns that are computed once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that later filters and columns use repeatedly.

    A column added by projection is copied into every filter and expression
    that refers to it, and computed there again. One element of ``inline`` per
    row is not merged with what follows, and it stays in the compiled stage.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
