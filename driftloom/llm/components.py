"""Connected components of a graph held in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.arrowkit import cut_lineage, forget


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of some edge. edges: a, b (of one type that has an order).

    Each step hangs the neighbours of a node on the least one among them, until every edge joins a
    node to its root. Nothing reaches the driver but two sums for each step; a node with very many
    neighbours makes one row each, folded by partial aggregation to a minimum, and the inner joins that bring
    it back are of the kind that adaptive execution splits where one key outgrows the others. Null ends and loops drop out.
    """
    links = cut_lineage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every neighbour larger than the node is hung on the node's least neighbour
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour, and the node, is hung on the least of them
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = cut_lineage(small)
        forget(links)
        links = after
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
        before = now
