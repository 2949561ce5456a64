"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round is two joins with the least neighbour of every node, found by a partial aggregation; no node's neighbours are gathered. A round's
edges are written to the shared folder, so lineage stays short and lost executors cost one round at most. The number of rounds grows with the
logarithm of the number of nodes squared at most; it is not capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thalweg.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node is linked to its least neighbour or itself. Small: itself and every smaller one are."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "__n")
    joined = both.join(least, F.col("u") == F.col("__n"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("__n").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component): every node with an edge to another, with the least node that it reaches."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        now = written(_stars(_stars(now, True), False), "components")
        # Done when every node hangs on one centre, and no centre on another: the edges then stay as they are.
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
