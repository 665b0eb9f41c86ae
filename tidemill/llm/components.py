"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import store


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links the neighbours of each node ``u`` to the least of them and of ``u`` itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = pairs.where("v > u") if larger_only else pairs
    return near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is connected to, for each node of ``edges`` (a, b).

    Edges that link a node to itself, and nulls, are passed over. Each round is two
    groupings with partial minima; rounds grow with the logarithm of the graph.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct()

    now, before = store(oriented(edges), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = oriented(_star(both, larger_only=True))
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        own = roots.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = store(oriented(small.union(own)), "edges")
