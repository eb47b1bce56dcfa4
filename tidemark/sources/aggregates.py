"""The stored aggregate tables: written once from fitted rows, read and checked by every job that looks them up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import axes
from tidemark.sources.tables import existing

# File of each axis, its key columns, and the names of its statistics.
FILES = {
    "mcc": ("mcc", ["mcc_code"]),
    "channel": ("channel_subtype", ["channel_indicator_type", "channel_indicator_subtype"]),
    "tz_currency": ("timezone", ["timezone", "currency_iso_cd"]),
    "event_type_currency": ("event_type_nm", ["event_type_nm", "currency_iso_cd"]),
    "event_descr": ("event_descr", ["event_descr"]),
    "pos_cd": ("pos_cd", ["pos_cd"]),
    "tz_alone": ("timezone_alone", ["timezone"]),
}
COUNTS = ["mcc_totals", "mcc_channel_joint", "mcc_currency_joint", "mcc_tz_joint", "channel_mcc_top3", "channel_mcc_pair"]
POPULATION = "global_population_meta"
STATISTIC = {
    "mean": "global_mean_amount", "std": "global_std_amount", "median": "global_median_amount", "q25": "global_q25", "q75": "global_q75", "q95": "global_q95",
    "cnt": "global_cnt", "cv": "global_cv", "label_rate": "fraud_rate", "label_count": "fraud_count", "train_count": "train_total_count", "woe": "woe",
    "cnt_clean": "global_cnt_clean", "q90": "global_q90", "q99": "global_q99", "log_frequency": "global_type_frequency_log",
}
KEY_NAMES = {"mcc_key": "mcc_code", "ch_type": "channel_indicator_type", "ch_sub": "channel_indicator_subtype", "ccy": "currency_iso_cd", "tz": "timezone"}


@dataclass
class Aggregates:
    """axis, k1, k2 and statistics of all axes; the five count tables by their keys."""

    statistics: DataFrame
    mcc_totals: DataFrame
    channel: DataFrame
    currency: DataFrame
    timezone: DataFrame
    top3: DataFrame


def fitted(tx: DataFrame) -> Aggregates:
    """All aggregates of the pretrain and train rows of ``tx``, not computed yet."""
    return Aggregates(axes.axis_statistics(tx), axes.mcc_totals(tx), axes.cooccurrence(tx, "ch_type", "ch_sub"), axes.cooccurrence(tx, "ccy"), axes.cooccurrence(tx, "tz"), axes.channel_top3(tx))


def _numeric_key(axis: str, k1: Column) -> Column:
    if axis == "mcc":  # the population row has the least number as its key
        return F.when(k1 == S.GLOBAL, F.lit(S.MCC_GLOBAL)).otherwise(k1.try_cast("bigint"))
    if axis == "event_type_currency":  # missing types and the population row have none; the latter has no currency either
        return k1.try_cast("double")
    return k1


def _axis_table(statistics: DataFrame, axis: str) -> DataFrame:
    file, keys = FILES[axis]
    names = [n for n in STATISTIC if n != "log_frequency" or axis == "event_type_currency"]
    parts = [_numeric_key(axis, F.col("k1")), F.when(F.col("k1") == S.GLOBAL, "").otherwise(F.col("k2"))]
    return statistics.where(F.col("axis") == axis).select(*[p.alias(k) for p, k in zip(parts, keys)], *[F.col(n).cast("double").alias(f"{STATISTIC[n]}_{axis}") for n in names]).orderBy(*keys)


def write(tx: DataFrame, root: str) -> None:
    """Writes all tables of the pretrain and train rows of ``tx``, each in the order of its keys, and the population totals."""
    from tidemark.sources.scratch import stored

    found = fitted(tx)
    statistics = stored(found.statistics)
    for axis, (file, _) in FILES.items():
        _axis_table(statistics, axis).write.mode("overwrite").parquet(f"{root}/{file}.parquet")
    pair = found.channel.select("ch_type", "ch_sub", "mcc_key", "cnt")
    for file, table in zip(COUNTS, (found.mcc_totals, found.channel, found.currency, found.timezone, found.top3, pair)):
        named = table.withColumnsRenamed({k: v for k, v in KEY_NAMES.items() if k in table.columns})
        keys = [c for c in named.columns if c in KEY_NAMES.values()]
        named.orderBy(*[F.concat_ws("\u001f", *[F.col(k).cast("string") for k in keys])]).write.mode("overwrite").parquet(f"{root}/{file}.parquet")
    axes.population_totals(tx).write.mode("overwrite").parquet(f"{root}/{POPULATION}.parquet")


#: Files of what a refresh adds up: bucket sums and quantile sketches of all keys.
BUCKETS, SKETCHES = "axis_buckets", "axis_sketches"


def write_summary(tx: DataFrame, root: str) -> None:
    """Writes what statistics can be brought up to date from when a part of rows arrives, without reading the rows before: sums by
    key and bucket of values, and a quantile sketch of each key."""
    rows = axes.keyed(tx, axes.axis_keys())
    axes.bucket_sums(axes.value_counts(rows)).write.mode("overwrite").parquet(f"{root}/{BUCKETS}.parquet")
    axes.sketches(rows).write.mode("overwrite").parquet(f"{root}/{SKETCHES}.parquet")


def merge(spark: SparkSession, old: str, new: str, root: str) -> None:
    """Writes the summary of two parts of the rows, from their summaries."""
    for file, merged in ((BUCKETS, axes.merged_buckets), (SKETCHES, axes.merged_sketches)):
        merged(*[spark.read.parquet(f"{r}/{file}.parquet") for r in (old, new)]).write.mode("overwrite").parquet(f"{root}/{file}.parquet")


def summary_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics of a summary: exact, but for the quantiles, whose ranks are off by the sketches' error at most."""
    buckets, sketched = (spark.read.parquet(f"{root}/{f}.parquet") for f in (BUCKETS, SKETCHES))
    return axes.statistics_of(buckets, axes.quantiles_of(sketched, axes.QUANTILES), list(FILES))


def _stored_keys(axis: str, keys: list[str]) -> tuple[Column, Column]:
    """Both key parts of a stored row, as text."""
    first, second = F.col(keys[0]), F.coalesce(F.trim(F.col(keys[1])), F.lit("")) if len(keys) > 1 else F.lit("")
    if axis == "mcc":
        return F.when(first == S.MCC_GLOBAL, S.GLOBAL).otherwise(first.cast("string")), second
    if axis == "event_type_currency":
        known = first.isNotNull() & ~F.isnan(first)
        return F.when(known, first.cast("string")).when(second == "", S.GLOBAL).otherwise(S.MISSING_ET), second
    text = F.trim(first)
    if len(keys) > 1:
        return text, second
    return F.when(text == "", S.MISSING_TZ_ALONE if axis == "tz_alone" else S.MISSING).otherwise(text), second


def read(spark: SparkSession, root: str) -> Aggregates:
    """Reads the 13 tables; raises if one is absent, an axis is empty, or an axis lacks its population row."""
    files = [f"{root}/{f}.parquet" for f in [*(f for f, _ in FILES.values()), *COUNTS]]
    if missing := sorted(set(files) - set(existing(spark, files))):
        raise FileNotFoundError("; ".join(missing))
    statistics = None
    for axis, (file, keys) in FILES.items():
        table = spark.read.parquet(f"{root}/{file}.parquet")
        k1, k2 = _stored_keys(axis, keys)
        one = table.select(F.lit(axis).alias("axis"), k1.alias("k1"), k2.alias("k2"), *[(F.col(f"{c}_{axis}") if f"{c}_{axis}" in table.columns else F.lit(None).cast("double")).alias(n) for n, c in STATISTIC.items()])
        statistics = one if statistics is None else statistics.unionByName(one)
    rows = {r.axis: r for r in statistics.groupBy("axis").agg(F.count("*").alias("n"), F.count(F.when(F.col("k1") == S.GLOBAL, 1)).alias("population")).collect()}
    if faults := [a for a in FILES if a not in rows or rows[a].n <= rows[a].population or rows[a].population != 1]:
        raise ValueError(f"aggregate tables without rows, or without one population row: {', '.join(faults)}")

    def counts(file: str) -> DataFrame:
        table = spark.read.parquet(f"{root}/{file}.parquet")
        return table.withColumnsRenamed({v: k for k, v in KEY_NAMES.items() if v in table.columns})

    return Aggregates(statistics, *[counts(f) for f in COUNTS[:5]])
