"""Time-based split: the newest whole days that hold a share of the rows are for validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARE = 0.15


def rows_per_day(df: DataFrame, seconds: str = "t") -> DataFrame:
    return df.where(F.col(seconds).isNotNull()).groupBy(F.to_date(F.timestamp_seconds(seconds)).alias("day")).agg(F.count("*").alias("n"))


def cutoff(df: DataFrame, seconds: str = "t", share: float = SHARE) -> DataFrame:
    """One row: cutoff_day (first day of validation), n_validation, n_total. A row a day meets in one task."""
    days = rows_per_day(df, seconds)
    newest = Window.orderBy(F.desc("day"))
    run = days.select("day", F.sum("n").over(newest).alias("covered"), F.sum("n").over(Window.partitionBy()).alias("n_total"))
    enough = run.where(F.col("covered") >= F.greatest(F.lit(1), F.floor(F.col("n_total") * share)))
    return enough.agg(F.max("day").alias("cutoff_day"), F.min("covered").alias("n_validation"), F.max("n_total").alias("n_total"))


def with_split(df: DataFrame, seconds: str = "t", share: float = SHARE, of: DataFrame | None = None) -> DataFrame:
    """Adds ``validation``; rows without a time are for validation. The days are counted in ``of``, which has the same rows but need not have what is
    dear to compute; by default in ``df``."""
    one = cutoff(df if of is None else of, seconds, share).select(F.unix_seconds(F.col("cutoff_day").cast("timestamp")).alias("_cut"))
    return df.join(F.broadcast(one)).withColumn("validation", ~F.coalesce(F.col(seconds) < F.col("_cut"), F.lit(False))).drop("_cut")  # one row
