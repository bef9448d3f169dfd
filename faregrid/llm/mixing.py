"""Mixing sources to target weights by systematic sampling.

Sources share a total by weight; none gets more than ``most`` times its size, and what that
leaves over is shared again. Within a source every document expects target / source size
copies. Documents are lined up by size and id, their expected copies are summed along the
line from one random offset, and a document comes out once for each integer its stretch crosses.
Lining up by size keeps the words taken within about one document of the target.

Defined results: null text has size 0, null source is a source of its own and comes last, null ids
rank last. Rows that repeat an id take part each on its own, alike ones in the order of their texts'
hashes where the mix itself is asked for. A source without words gets target 0
and no copies. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import BROADCAST_IDS, folded, n_words, unused, written
from faregrid.llm.ranks import with_ranks

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
_OFFSET_DIGITS = 5  # hex digits of the offset: sums stay exact over 2**33 documents


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``weight`` and ``target`` to (source, source_size), one row per source."""
    known = sizes.withColumn("none", F.col("source").isNull())
    ranked = with_ranks(known, [], [F.col("none"), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = folded(
        ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")),
        "sources",
    )
    # Each round adds sources that reach their cap; one row of sums comes back.
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        now = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap"))).alias("cap"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if now["capped"] == capped or not now["weight"]:
            break
        capped = now["capped"]
        level = ((now["all"] or 0) - (now["cap"] or 0)) / now["weight"]
    share = F.lit(float(level)) * F.col("weight")
    target = F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share)
    return folded(sources.select("source", "source_size", "weight", target.alias("target")), "targets")


def _drawn(sized: DataFrame, weights: Sequence[int], most: int, seed: str, ties: Sequence[str] = ()) -> DataFrame:
    """Add source_size, weight, target and copies to written rows (doc_id, source, size, ...)."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    order = [F.col("size"), F.col("doc_id").asc_nulls_last(), *map(F.col, ties)]
    lined = with_ranks(sized, ["source"], order)
    # One row per source on the right; a hot source can be split.
    joined = lined.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("d.source"), F.lit("")))), 1, _OFFSET_DIGITS), 16, 10)
    start = offset.cast("double") / F.lit(float(16**_OFFSET_DIGITS))
    crossed = F.floor(start + rate * F.col("rank")) - F.floor(start + rate * (F.col("rank") - 1))
    return joined.select(
        *[F.col(f"d.{c}").alias(c) for c in sized.columns],
        "source_size",
        "weight",
        "target",
        F.least(crossed, F.lit(most)).cast("long").alias("copies"),
    )


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, copies, taken for each row of ``docs``."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    drawn = _drawn(written(sized, "sizes"), weights, most, seed)
    return drawn.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it has copies, columns as they were.

    Rows are written with a number of their own. The draw works on slim rows; numbers and
    copies then go to the rows, by broadcast up to BROADCAST_IDS and by a shuffle on the number beyond it.
    """
    number, size, tie = (unused(docs, x) for x in ("number", "size", "tie"))
    own = {number: F.monotonically_increasing_id(), size: n_words(docs[text_col]), tie: F.xxhash64(docs[text_col])}
    numbered = written(docs.withColumns(own), "numbered")
    names = {"doc_id": id_col, "source": source_col, "size": size, "tie": tie, "number": number}
    slim = numbered.select(*[numbered[c].alias(name) for name, c in names.items()])
    drawn = _drawn(slim, weights, most, seed, ["tie", "number"]).where("copies > 0")
    copies = unused(docs, "copies")
    drawn = folded(drawn.select(F.col("number").alias(number), F.col("copies").cast("int").alias(copies)), "drawn")
    drawn = F.broadcast(drawn) if drawn.count() <= BROADCAST_IDS else drawn.hint("merge")
    copy = unused(docs, "copy")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return numbered.join(drawn, number).select(*kept, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)).drop(copy)
