"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.storage import staged

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
# Ids of one long each: some tens of MB in an executor's hash table.
BROADCAST_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_ids(df: DataFrame, column: str, ids: DataFrame, keep: bool) -> DataFrame:
    """Rows of ``df`` whose ``column`` is (``keep``) or isn't among the written ``ids``.

    ``ids`` has one column of distinct longs and is a scan. Up to BROADCAST_IDS of them
    go to the executors, and the rows of ``df`` stay where they are; more are joined by shuffle.
    Null is never among the ids.
    """
    name = unused(df, "id")
    ids = ids.toDF(name)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    else:
        ids = ids.hint("merge")
    return df.join(ids, df[column] == ids[name], "left_semi" if keep else "left_anti")


# Tasks per core for tables of a few numbers per row that come out of a shuffle.
FOLD = 4


def folded(df: DataFrame, label: str) -> DataFrame:
    """:func:`written` for slim tables after a shuffle: no more tasks and files than cores can use."""
    return written(df.coalesce(FOLD * df.sparkSession.sparkContext.defaultParallelism), label)


# Rows that go to Python at once where each has a text: Spark's 10,000 are tens of MB beside the heap and as many in the worker.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile hands no more than TEXT_ROWS rows to Python at once."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(TEXT_ROWS if int(before) <= 0 else min(TEXT_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_GROUP = "parquet.block.row.count.limit"


@contextmanager
def row_groups(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is written meanwhile has up to ``rows`` rows in a row group: a reader takes up to 4,096 rows of one at once, however large they are."""
    before = spark.conf.get(_GROUP, None)
    spark.conf.set(_GROUP, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_GROUP) if before is None else spark.conf.set(_GROUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return staged(df, f"llm-{label}")
