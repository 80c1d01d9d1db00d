"""Connected components of a graph given as edges, by minimum-label stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltgate.session import scratch_table


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest reachable node.

    ``edges`` has the long columns ``a`` and ``b``. Each round links every node's larger
    neighbours, then its smaller ones, to its smallest neighbour, until every edge joins a node
    to the smallest of its component. Rounds are logarithmic in the number of nodes in practice.
    Each round is written to the scratch folder, which cuts lineage. Only minima are grouped,
    so a node with very many edges costs its task no more than others after the partial step.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = scratch_table(now, label)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # after the first half every edge points down; a node's smaller neighbours meet at the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = scratch_table(small.select("e.u", "e.v").where("u <> v").distinct(), label)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
