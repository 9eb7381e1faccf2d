"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behavior_spark.llm.common import written


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select(F.col("v").alias("u"), F.col("m").alias("v")).union(edges.select(F.col("m").alias("u"), "v"))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    joined = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("n"))
    return joined.select("v", F.least("m", "u").alias("m")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy(F.col("v").alias("n")).agg(F.min("m").alias("least"))
    moved = edges.join(least, F.col("v") == F.col("n")).where(F.col("m") != F.col("least")).select(F.col("m").alias("v"), F.col("least").alias("m"))
    return moved.union(least.select(F.col("n").alias("v"), F.col("least").alias("m"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b; longs), root being the smallest node of its component.

    Each round is a few joins and a written table; the number of rounds grows with the logarithm of the longest path. A
    node with very many edges is pre-aggregated (its minimum) and its join is split by AQE. Loops and repeated edges do
    no harm; an empty table gives an empty one.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")), F.lit(0))).first()
        if seen == tuple(state):
            break
        seen = tuple(state)
        now = written(_small(_large(now)), "edges")
    roots = now.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).union(roots)
