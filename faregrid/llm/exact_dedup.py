"""Exact duplicates by two passes over a Bloom filter.

Pass one reduces each text to a digest and counts its fingerprint: a word of the filter and
four bits in it. Fingerprints that occur more than once set their bits. Pass two holds every
digest against the filter: a row whose bits aren't all set has no copy and goes straight
through; only the others are shuffled by digest and compared. The filter never misses a copy,
so a full filter costs time, not results.

Defined results: null text counts as empty, so empty and null texts are copies. A null id ranks
after all others. Of rows that share the smallest id exactly one stays. Other columns, whatever
their names, take no part. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import SPACE, folded, unused, with_ids, written

# 2**20 words of 64 bits: the filter that goes to the executors has at most 16 bytes a word.
FILTER_WORDS = 1 << 20
_BITS = 4


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def _fingerprint(digest_col: str, words: int) -> tuple[Column, Column]:
    """Word of the filter and the bits in it, from separate parts of the digest."""
    part = lambda at, n: F.conv(F.substring(F.col(digest_col), at, n), 16, 10).cast("long")
    mask = F.lit(0).cast("long")
    for i in range(_BITS):
        shift = F.shiftright(part(9, 6), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), shift))
    return F.pmod(part(1, 8), F.lit(words)), mask


def repeated_filter(hashed: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """Words (``word``, ``bits``) of the filter of fingerprints that occur more than once."""
    word, mask = _fingerprint("digest", words)
    seen = hashed.select(word.alias("word"), mask.alias("mask")).groupBy("word", "mask").agg(F.count(F.lit(1)).alias("n"))
    return seen.where("n > 1").groupBy("word").agg(F.bit_or("mask").alias("bits"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = FILTER_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = written(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "digests",
    )
    bits = F.broadcast(folded(repeated_filter(hashed, words), "filter"))
    word, mask = _fingerprint("digest", words)
    probed = hashed.withColumns({"word": word, "mask": mask}).join(bits, "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    slim = ["doc_id", "digest", "row"]
    rest = probed.where(maybe).select(*slim)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = folded(
        rest.groupBy("digest")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")),
        "groups",
    )
    alone = probed.where(~maybe).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    # A digest of many copies meets one row of its group, so adaptive execution can split it.
    copies = rest.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"
    )
    return alone.unionByName(copies).withColumnRenamed("digest", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without exact copies; all columns stay.

    Copies under another id go by id, in place. Rows that repeat an id and its text are folded
    to one, which concerns those rows only. Where one id has several texts, a text goes with its
    own group alone.
    """
    groups = folded(exact_groups(docs, id_col, text_col).where("group_size > 1 and not kept"), "copies")
    clean = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    mark, gone_id, gone_mark = (unused(docs, x) for x in ("digest", "gone_id", "gone_digest"))
    hit = folded(groups.where("doc_id is not null").select("doc_id").distinct(), "hit")
    nulls = docs[id_col].isNull()
    passed = with_ids(docs, id_col, hit, keep=False).where(~nulls)
    touched = with_ids(docs, id_col, hit, keep=True).unionByName(docs.where(nulls)).withColumn(mark, digest(docs[text_col]))
    gone = groups.where(~clean).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_mark)).distinct()
    left = touched.join(gone, touched[id_col].eqNullSafe(gone[gone_id]) & (touched[mark] == gone[gone_mark]), "left_anti")
    # What is left here repeats an id; identical pairs of id and text become one row.
    return passed.unionByName(left.dropDuplicates([id_col, mark]).drop(mark))
