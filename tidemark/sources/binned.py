"""The training matrix in one byte a value: quantile cuts from sketches, bins as Parquet, read in batches of bounded rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of known values at most; the last code is that of a missing value.
BINS, MISSING = 255, 255
SKETCH = 2048


def cuts_of(df: DataFrame, features: list[str], bins: int = BINS, sketch: int = SKETCH) -> list[np.ndarray]:
    """Ascending cuts of each feature: a value's bin is the number of cuts at or below it. From one pass of mergeable quantile sketches;
    a row of ``bins`` numbers a feature is read. Values that are missing or not finite don't count."""
    finite = {c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double")) for c in features}
    sketched = df.agg(*[F.kll_sketch_agg_double(e, sketch).alias(f"s{i}") for i, e in enumerate(finite.values())], *[F.count(e).alias(f"n{i}") for i, e in enumerate(finite.values())])
    levels = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = sketched.select(*[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", levels)).alias(f"q{i}") for i in range(len(features))]).first()
    return [np.unique(np.array(q, float)) if q else np.zeros(0) for q in row]


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``bins``, a byte a feature. Arrow batches in tasks; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, len(features)), np.uint8)
            for i, c in enumerate(cuts):
                values = batch.column(len(keep) + i).fill_null(float("nan")).to_numpy(zero_copy_only=False)
                out[:, i] = np.where(np.isfinite(values), np.searchsorted(c, values, "right"), MISSING)
            packed = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], packed], names=[*keep, "bins"])

    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "bins binary"])
    return df.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in features]).mapInArrow(run, kinds)


def matrix_of(batch: pa.RecordBatch, features: int, column: str = "bins") -> np.ndarray:
    """The bins of a batch, a row a row, without a copy."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return np.zeros((0, features), np.uint8)
    _, offsets, data = values.buffers()
    first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(values.type) else np.int32)[values.offset]
    return np.frombuffer(data, np.uint8, len(values) * features, first).reshape(len(values), features)
