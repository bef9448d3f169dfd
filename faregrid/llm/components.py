"""Connected components by alternating large-star and small-star.

Edges point from a larger to a smaller node. Large-star links each larger neighbour of a node
to the smallest neighbour; small-star links the smaller ones, and the node itself, to the
smallest. Both keep components whole, and together they end at one star per component
after a number of rounds logarithmic in its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import folded, written


# Rows of two longs that a task takes at least; fewer tasks for the small tables of late rounds.
EDGES_PER_TASK = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join below deals both sides out and a hot node can be split.
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "least")
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars: one edge up from a node, none from its end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("up")), F.struct(F.col("v").alias("n"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.n").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("low"))
    found = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") == 0)))).first()
    return found[0] or 0, not found[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node."""
    edges = folded(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while True:
        n, stars = _shape(edges)
        if stars:
            break
        tasks = max(1, -(-n // EDGES_PER_TASK))
        large = written(_large_star(edges, tasks).coalesce(tasks), "edges")
        edges = written(_small_star(large, tasks).coalesce(tasks), "edges")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
