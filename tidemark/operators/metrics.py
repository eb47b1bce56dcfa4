"""Weighted average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_precision(df: DataFrame, score: str = "score", target: str = "target", weight: str | None = None, bins: int = 1024) -> DataFrame:
    """One row: the sum over distinct scores of (recall gained) x (precision there), n and positives.

    Scores are first grouped, then dealt into ranges of scores. A range's totals (one row a range) are
    carried into the next, so running sums need no single task.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    groups = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(target) == 1, w).otherwise(0.0)).alias("p"), F.sum(w).alias("a"), F.count("*").alias("n"))
    edges = df.approxQuantile(score, [i / bins for i in range(1, bins)], 0.001)
    bounds = sorted(set(edges))
    ranged = groups.withColumn("r", F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("score"))) if bounds else F.lit(0))
    totals = ranged.groupBy("r").agg(F.sum("p").alias("rp"), F.sum("a").alias("ra"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
    carried = totals.select("r", F.coalesce(F.sum("rp").over(above), F.lit(0.0)).alias("p0"), F.coalesce(F.sum("ra").over(above), F.lit(0.0)).alias("a0"), F.sum("rp").over(Window.partitionBy()).alias("all_p"))
    inner = Window.partitionBy("r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = ranged.join(F.broadcast(carried), "r").select("p", "n", "all_p", ((F.col("p0") + F.sum("p").over(inner)) / (F.col("a0") + F.sum("a").over(inner))).alias("precision"))
    return steps.agg(F.sum(F.try_divide("p", "all_p") * F.col("precision")).alias("average_precision"), F.sum("n").alias("n"), F.max("all_p").alias("positive_weight"))


def average_precisions(df: DataFrame, by: list[str], score: str = "score", target: str = "target", weight: str | None = None) -> DataFrame:
    """The same for each group of rows: the columns ``by`` and average_precision. A group's distinct scores are sorted
    together, which spills where they are many."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    return average_precisions_of_sums(df.select(*by, F.col(score).alias("score"), F.when(F.col(target) == 1, w).otherwise(0.0).alias("p"), w.alias("a")), by)


def average_precisions_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """The same from score and weights of positive (p) and all rows (a) of each score; a score can have several sums."""
    groups = sums.groupBy(*by, "score").agg(F.sum("p").alias("p"), F.sum("a").alias("a"))
    down = Window.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = groups.select(*by, "p", (F.sum("p").over(down) / F.sum("a").over(down)).alias("precision"))
    return steps.groupBy(*by).agg((F.try_divide(F.sum(F.col("p") * F.col("precision")), F.sum("p"))).alias("average_precision"))
