"""Connected components of an edge table by alternating stars, wholly in Spark.

Each round lets every node point its larger neighbours, then its smaller ones, to the least node it
knows; the number of rounds grows with the logarithm of the longest path. Each round's edges and least
nodes are written to the shared folder, so that joins have plain sides: small ones are broadcast, and
a node with very many edges is the larger side of a join, which Spark splits where it is skewed.
Edges of a node with itself count for nothing; without edges there are no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _proper(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return _proper(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _proper(moved.unionByName(least.select("u", F.col("m").alias("v"))))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (least node of the component) for every node of ``edges`` (u, v)."""
    now = materialise(_proper(edges))
    seen = _digest(now)
    while seen[0]:
        now = materialise(_small_star(_large_star(now)))
        after = _digest(now)
        if after == seen:
            break
        seen = after
    # at the fixed point every node other than a root has one edge, to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
