"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, written


def _stars(edges: DataFrame) -> DataFrame:
    """A large star and a small one over (a, b) edges, a > b, each row once: neighbours are hung on the smallest node that a node sees.

    As every edge points downwards, neither star needs it both ways round but for the first minima, and rows that repeat go at the end alone: an edge
    makes one row in the large star and two in the small one.
    """
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    large = edges.join(least, "b").select("a", F.col("m").alias("b"))
    hung = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
    both = F.explode_outer(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return hung.select(both.alias("e")).select("e.*").filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): each node of the (a, b) edges with the smallest node it is connected to; that node itself is not listed.

    Each pair of rounds is written to the shared folder. A node's neighbours are never gathered: minima are aggregated
    before they are shuffled, and large joins are left to adaptive skew splitting. Rounds grow with the logarithm of the longest
    path, and end once all edges are stars: edges that come as stars take none. More than `rounds` pairs of them raise, so unfinished
    components are never returned.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if nodes.filter("below > 1 or below = 1 and above = 1").isEmpty():
            return edges
        after = written(_stars(edges), "edges")
        dropped(edges)
        edges = after
    raise RuntimeError(f"components are not finished after {rounds} rounds")
