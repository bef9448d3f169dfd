"""From raw documents to packed sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between
stages the documents are written and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faregrid.llm.common import table, written
from faregrid.llm.exact_dedup import drop_exact_copies
from faregrid.llm.minhash import drop_near_copies
from faregrid.llm.mixing import mixed
from faregrid.llm.packing import packed
from faregrid.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, row by row."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, also among those without an id."""
    return drop_near_copies(docs, by_row=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, one row each."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# Training, MinHash and tokenizing aren't SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
