"""Registry of queries with the SQL that states the same result.

Both sides round the named double columns the same way. The nudge decides
half-way cases, which two engines may sum to either side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
NUDGE = "2e-8"
DECIMALS = 4


@dataclass(frozen=True)
class Entry:
    query: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _rounded_sql(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    parts = ", ".join(f"(round({c} + {NUDGE}, {DECIMALS}) + 0.0) AS {c}" for c in doubles)
    head, body = _split_with(sql)
    return f"{head} SELECT * REPLACE ({parts}) FROM ({body}) AS result"


def _split_with(sql: str) -> tuple[str, str]:
    """Common table expressions and final query, marked by ``-- result``."""
    head, mark, body = sql.partition("-- result")
    return (head, body) if mark else ("", sql)


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the columns rounded on both sides."""
    columns = doubles.split()

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if columns:
                df = df.withColumns({c: F.round(F.col(c) + F.lit(float(NUDGE)), DECIMALS) for c in columns})
            return df

        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(run, _rounded_sql(sql, columns) if sql else None)
        return fn

    return register
