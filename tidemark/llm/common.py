"""Shared helpers: column picking, Arrow row maps; tables that cut lineage are those of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import new_path, stored

#: Rows, and bytes about, that a Python step holds at once; a longer row comes alone.
SLICE_ROWS, SLICE_BYTES = 256, 1_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, by exact name and first position.

    Works where other columns clash with them (same name in another case, or twice).
    """
    columns = df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return plain.select(*[F.col(f"_c{columns.index(n)}").alias(n) for n in names])


def as_bytes(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Columns ``keep`` and the text as UTF-8 bytes; a null text is empty."""
    return pick(df, *keep, text).select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while parts:
            part = parts.pop()
            if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                half = part.num_rows // 2
                parts += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies a function to every few hundred rows, without a shuffle. ``make`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for part in slices(batches):
            yield apply(part)

    return df.mapInArrow(run, schema)


def map_whole(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over all columns by position, so clashing names do no harm; the schema stays."""
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


materialise = stored
__all__ = ["as_bytes", "documents", "map_slices", "map_whole", "materialise", "new_path", "pick", "slices"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
