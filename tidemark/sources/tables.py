"""Sources and sinks: transaction, label and matrix tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DataType, DateType, DecimalType, FractionalType, IntegralType, ShortType, StringType, TimestampNTZType, TimestampType

from tidemark.functions import scalars as S

# Input columns, whether each is required, and the class of its type. Two have two spellings.
COLUMNS = {
    "customer_id": (True, "text"), "event_id": (True, "key"), "operaton_amt": (True, "amount"), "event_dttm": (True, "text"),
    "operating_system_type": (False, "text"), "device_system_version": (False, "text"), "mcc_code": (False, "text"),
    "channel_indicator_type": (False, "text"), "channel_indicator_sub_type": (False, "text"), "channel_indicator_subtype": (False, "text"),
    "timezone": (False, "text"), "compromised": (False, "text"), "web_rdp_connection": (False, "text"), "phone_voip_call_state": (False, "text"),
    "session_id": (False, "text"), "browser_language": (False, "text"), "accept_language": (False, "text"), "event_type_nm": (False, "amount"),
    "event_descr": (False, "text"), "event_desc": (False, "text"), "currency_iso_cd": (False, "text"), "pos_cd": (False, "text"),
    "screen_size": (False, "text"), "battery": (False, "amount"), "developer_tools": (False, "text"),
}
LABEL_COLUMNS = {"event_id": (True, "key"), "target": (True, "key")}
PHASE_RANK = {"pretrain": 0, "train": 1, "pretest": 2, "test": 3}


def accepts(kind: str, of: DataType) -> bool:
    """Whether a type belongs to a class: key, amount or text."""
    if kind == "key":
        return isinstance(of, (IntegralType, StringType))
    if kind == "amount":
        return isinstance(of, (IntegralType, FractionalType, DecimalType, StringType))
    return isinstance(of, (IntegralType, FractionalType, DecimalType, StringType, BinaryType, BooleanType, TimestampType, TimestampNTZType, DateType))


def schema_faults(df: DataFrame, spec: dict[str, tuple[bool, str]] = COLUMNS) -> list[str]:
    """What is missing or of a wrong type."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {n}" for n, (needed, _) in spec.items() if needed and n not in kinds]
    return out + [f"column {n} has type {kinds[n].simpleString()}, not {k}" for n, (_, k) in spec.items() if n in kinds and not accepts(k, kinds[n])]


def validate(df: DataFrame, spec: dict[str, tuple[bool, str]] = COLUMNS) -> DataFrame:
    if faults := schema_faults(df, spec):
        raise ValueError("; ".join(faults))
    return df


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that exist, in any file system Spark reads."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if (path := make(p)).getFileSystem(hadoop).exists(path)]


def read_transactions(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
    """Union of the existing files of each phase, checked, with the columns phase and part."""
    parts = []
    for phase, files in paths.items():
        for part in existing(spark, files):
            df = validate(spark.read.parquet(part))
            kept = [c for c in COLUMNS if c in df.columns]
            parts.append(df.select(*[F.decode(c, "UTF-8").alias(c) if isinstance(df.schema[c].dataType, BinaryType) else c for c in kept], F.lit(phase).alias("phase"), F.lit(part).alias("part")))
    if not parts:
        raise ValueError("no transaction file exists")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def as_number(c: Column, of: DataType) -> Column:
    """Finite double of a column; types that are no amounts (boolean, one- and two-byte integers, times) give null."""
    if isinstance(of, StringType):
        return S.parse_double(c)
    if isinstance(of, (BooleanType, ByteType, ShortType, TimestampType, TimestampNTZType, DateType, BinaryType)):
        return F.lit(None).cast("double")
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def as_id(c: Column, of: DataType) -> Column:
    """Whole number of a column, null where it has none; text may go on after the number."""
    if isinstance(of, StringType):
        return F.regexp_extract(F.trim(c, F.lit(" \t")), r"^[+-]?\d+", 0).try_cast("bigint")
    return c.try_cast("bigint")


def conform(df: DataFrame) -> DataFrame:
    """Canonical transaction columns: trimmed text (null if empty), finite numbers, whole seconds, the time as it was given.

    Rows without a customer are dropped; those without an event id stay, with a null id. The phase, if there, stays, as do label columns.
    """
    have = set(df.columns)
    kinds = dict(df.dtypes)

    def text(*names: str):
        found = [S.clean_text(F.col(n).cast("int") if isinstance(df.schema[n].dataType, BooleanType) else F.col(n)) for n in names if n in have]  # booleans are written 1 and 0
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    def number(name: str):
        return as_number(F.col(name), df.schema[name].dataType) if name in have else F.lit(None).cast("double")

    return df.where(F.coalesce(F.col("customer_id").cast("string"), F.lit("")) != "").select(
        F.col("customer_id").cast("string").alias("customer_id"),
        as_id(F.col("event_id"), df.schema["event_id"].dataType).alias("event_id"),
        S.parse_seconds(F.col("event_dttm"), kinds["event_dttm"]).alias("t"),
        F.col("event_dttm").cast("string").alias("event_dttm"),
        number("operaton_amt").alias("amt"),
        text("mcc_code").alias("mcc"),
        (S.mcc_key(F.col("mcc_code")) if "mcc_code" in have else F.lit(S.MCC_MISSING).cast("bigint")).alias("mcc_key"),
        text("channel_indicator_type").alias("ch_type"),
        text("channel_indicator_sub_type", "channel_indicator_subtype").alias("ch_sub"),
        text("timezone").alias("tz"),
        text("currency_iso_cd").alias("ccy"),
        number("event_type_nm").alias("et"),
        text("event_descr", "event_desc").alias("descr"),
        text("pos_cd").alias("pos"),
        text("operating_system_type").alias("os"),
        text("device_system_version").alias("ver"),
        text("session_id").alias("sess"),
        text("browser_language").alias("bl"),
        text("accept_language").alias("al"),
        text("screen_size").alias("screen"),
        number("battery").alias("battery"),
        text("developer_tools").alias("dev_tools"),
        text("phone_voip_call_state").isNotNull().alias("voip"),
        text("web_rdp_connection").isNotNull().alias("rdp"),
        *[F.col(c) for c in ("phase", "labelled", "label") if c in have],
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """event_id, label; one row an event, both fields known; of several labels the last in the file."""
    df = validate(spark.read.parquet(path), LABEL_COLUMNS)
    known = df.select(as_id(F.col("event_id"), df.schema["event_id"].dataType).alias("event_id"), F.col("target").try_cast("int").alias("label"), F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))
    return known.where("event_id IS NOT NULL AND label IS NOT NULL").groupBy("event_id").agg(F.max_by("label", "_at").alias("label"))


def read_label_ids(spark: SparkSession, path: str) -> DataFrame:
    """event_id of all labelled events, those with an unknown target too."""
    df = validate(spark.read.parquet(path), LABEL_COLUMNS)
    return df.select(as_id(F.col("event_id"), df.schema["event_id"].dataType).alias("event_id")).where("event_id IS NOT NULL").distinct()


def row_count(spark: SparkSession, paths: list[str]) -> int:
    """Rows of the existing files; no column is read, only the files' footers."""
    found = existing(spark, paths)
    return spark.read.parquet(*found).select().count() if found else 0


def dataset_paths(spark: SparkSession, root: str) -> list[str]:
    """A single file, else numbered parts in the new or old folder, else the single file of old."""
    for pattern in (f"{root}/full_dataset.parquet", f"{root}/parts/full_dataset_part_*.parquet", f"{root}/full_dataset_part_*.parquet", f"{root}/dataset.parquet"):
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(hadoop).globStatus(path)
        if found:
            return sorted(str(s.getPath()) for s in found)
    raise FileNotFoundError(root)


def load_matrix(spark: SparkSession, root: str) -> DataFrame:
    """The training matrix of all parts, weights remapped."""
    df = spark.read.parquet(*dataset_paths(spark, root))
    return df.withColumn("sample_weight", S.remap_weight(F.col("sample_weight"))) if "sample_weight" in df.columns else df


def write_matrix(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_axis(df: DataFrame, keys: list[str], path: str) -> None:
    """An aggregate table in the order of its keys."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)


def write_predictions(df: DataFrame, path: str) -> DataFrame:
    """Writes event_id and predict as CSV, once; returns the table as it is read back."""
    out = df.select("event_id", "predict")
    out.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(out.schema).option("header", True).csv(path)


# Columns of the matrix that are no features, in their order.
META_COLUMNS = [
    "mcc_code", "event_type_nm", "event_descr", "currency_iso_cd", "pos_cd", "accept_language", "screen_size", "timezone",
    "channel_indicator_type", "channel_indicator_subtype", "customer_id", "event_id", "target", "sample_weight", "event_dttm",
]


def feature_columns(df: DataFrame) -> list[str]:
    """The features of a matrix: all columns but the meta columns, of which time, target and weight must be there."""
    if missing := [c for c in ("event_dttm", "target", "sample_weight") if c not in df.columns]:
        raise ValueError(f"the matrix lacks {', '.join(missing)}")
    return [c for c in df.columns if c not in META_COLUMNS]


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """Settings over their defaults; the defaults alone where the file is absent."""
    return defaults | (json.loads(spark.read.text(path).first()[0]) if existing(spark, [path]) else {})


def head_slice(df: DataFrame, path: str, rows: int = 5000) -> None:
    df.limit(rows).write.mode("overwrite").option("compression", "snappy").parquet(path)
