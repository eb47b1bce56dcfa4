"""Data-quality audits: profiles, smoke checks, parity of two implementations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tidemark.operators.axes import exact_quantiles
from tidemark.sources.footers import FooterSource
from tidemark.sources.scratch import stored
from tidemark.sources.tables import META_COLUMNS


def _long(df: DataFrame, columns: dict[str, dict]) -> DataFrame:
    """One row a column, from one aggregation over all of them."""
    flat = [e.alias(f"{c}__{s}") for c, stats in columns.items() for s, e in stats.items()]
    one = df.agg(*flat)
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c, stats in columns.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_profile(df: DataFrame) -> DataFrame:
    """column_name, n, n_null, n_distinct, and least and largest value or length."""
    stats = {}
    for f in df.schema:
        c = F.col(f.name)
        size = F.length(c).cast("double") if isinstance(f.dataType, StringType) else c.cast("double") if isinstance(f.dataType, NumericType) else F.lit(None).cast("double")
        stats[f.name] = {"n": F.count("*"), "n_null": F.count(F.when(c.isNull(), 1)), "n_distinct": F.count_distinct(c), "least": F.min(size), "largest": F.max(size)}
    return _long(df, stats)


def feature_health(df: DataFrame, features: list[str], exempt: tuple[str, ...] = ("battery_level",), limit: float = 0.99) -> DataFrame:
    """column_name, missing_share, n_infinite, n_suspicious (over 1e7), ok."""
    stats = {}
    for n in features:
        c = F.col(n).cast("double")
        stats[n] = {"missing_share": F.avg(F.when(c.isNull() | F.isnan(c), 1.0).otherwise(0.0)), "n_infinite": F.count(F.when(F.abs(c) == float("inf"), 1)), "n_suspicious": F.count(F.when(F.abs(c) > 1e7, 1))}
    return _long(df, stats).withColumn("ok", (F.col("n_infinite") == 0) & ((F.col("missing_share") < limit) | F.col("column_name").isin(*exempt)))


def duplicate_ids(df: DataFrame, key: str = "event_id") -> DataFrame:
    """n, n_distinct, n_repeated (ids that occur more than once)."""
    counts = df.groupBy(key).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.count(F.when(F.col("c") > 1, 1)).alias("n_repeated"))


def decile_profile(df: DataFrame, column: str) -> DataFrame:
    """decile (0 to 10) and value, interpolated between neighbours; found by rank among counted values, so that no task holds all."""
    key = [F.lit("").alias(c) for c in ("axis", "k1", "k2")]
    counts = stored(df.where(F.col(column).isNotNull()).select(*key, F.col(column).cast("double").alias("x")).groupBy("axis", "k1", "k2", "x").agg(F.count("*").alias("c")))
    one = exact_quantiles(counts, {f"d{i}": i / 10 for i in range(11)})
    return one.select(F.posexplode(F.array(*[f"d{i}" for i in range(11)])).alias("decile", "value"))


def parity(a: DataFrame, b: DataFrame, columns: list[str], key: str = "event_id", rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """column_name, n_compared, n_different: two implementations of the same columns, both missing being equal."""
    joined = a.select(key, *[F.col(c).alias(f"a_{i}") for i, c in enumerate(columns)]).join(b.select(key, *[F.col(c).alias(f"b_{i}") for i, c in enumerate(columns)]), key)
    stats = {}
    for i, c in enumerate(columns):
        x, y = F.col(f"a_{i}").cast("double"), F.col(f"b_{i}").cast("double")
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        stats[c] = {"n_compared": F.count("*"), "n_different": F.count(F.when(~same, 1))}
    return _long(joined, stats)


def sentinels(df: DataFrame, values: dict[str, int]) -> DataFrame:
    """How often reserved values occur: column_name, n_reserved."""
    return _long(df, {c: {"n_reserved": F.count(F.when(F.col(c) == v, 1))} for c, v in values.items()})


def schema_listing(df: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema)]
    return df.agg(F.count("*").alias("rows")).select(F.explode(F.array(*rows)).alias("r"), "rows").select("r.*", "rows")


def all_columns_there(df: DataFrame, expected: list[str]) -> list[str]:
    """Order contract of the matrix: what differs from the expected columns."""
    found = df.columns
    if found == expected:
        return []
    return [f"missing {c}" for c in expected if c not in found] + [f"unexpected {c}" for c in found if c not in expected] or ["order differs"]


def matrix_health(df: DataFrame, features: list[str], limit: float = 0.01) -> DataFrame:
    """One row: name, n_missing_columns, n, null_time_share, n_repeated_ids, ok (all columns there, few times missing, ids distinct)."""
    missing = len([c for c in [*features, *META_COLUMNS] if c not in df.columns])
    sums = df.agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_dttm").isNull(), 1.0).otherwise(0.0)).alias("null_time_share"), (F.count("*") - F.count_distinct("event_id")).alias("n_repeated_ids"))
    good = F.lit(not missing) & (F.coalesce("null_time_share", F.lit(0.0)) <= limit) & (F.col("n_repeated_ids") == 0)
    return sums.select(F.lit("training matrix").alias("name"), F.lit(missing).alias("n_missing_columns"), "*", good.alias("ok"))


def examples(df: DataFrame, columns: list[str], rows: int = 3, key: str = "event_id") -> DataFrame:
    """The first rows by key, of the named columns: a report."""
    return df.select(*columns).orderBy(key).limit(rows)


def footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, position, name, type, rows, nulls, least and largest (as text; null where the file does not say) of every column of the
    files: a task a file, which reads its footer only."""
    spark.dataSource.register(FooterSource)
    return spark.read.format(FooterSource.name()).option("paths", json.dumps(paths)).load()


def footer_profile(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, type, n, n_null of every column over all files, from footers."""
    return footers(spark, paths).groupBy("name").agg(F.max("type").alias("type"), F.sum("rows").alias("n"), F.sum("nulls").alias("n_null"))


def file_schemas(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path, position, name and type of the columns of each parquet file or table in a folder; only footers are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", recursive).load(root).select("path")
    return footers(spark, [r.path for r in listed.collect()]).select("path", "position", "name", "type")


def profile(df: DataFrame, mode: str = "full") -> DataFrame:
    """Column reports in three depths: schema (names and types), light (numbers of rows and nulls), full (column_profile)."""
    if mode == "schema":
        return schema_listing(df)
    found = column_profile(df)
    return found if mode == "full" else found.select("column_name", "n", "n_null")
