"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of id and content, whatever files and partitions they come
from. A Feistel network permutes the numbers below the next power of four; a number that lands at n or
above is permuted again until it is below (cycle walking), which makes it a permutation of 0 to n - 1.
The permuted number p has shard p mod shards and slot p div shards, so shards differ by one row at most,
slots have no gaps, and either direction is computed without a table: ``place`` gives shard and slot
of a row number, ``row_at`` the row number of a shard and slot.

A null id comes first; rows of the same id are in the order of their content, and rows equal in every column are
interchangeable. Null texts count as empty. Texts of any length, extra and clashing columns are carried along.
An empty table has no rows and no shards. Columns of maps can't be hashed and are refused by Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.scratch import stored

SHARDS, SEED, ROUNDS = 40, 42, 6
#: Rows in a range that is numbered by one task, about.
RANGE_ROWS = 1_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The round function: a 64-bit finaliser, by wrapping arithmetic."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A permutation of 0 to n - 1 given by a seed."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, math.ceil(max(n - 1, 1).bit_length() / 2)))
        self.low = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = [_mixed(np.uint64(seed & 2**64 - 1) + _MIX[0] * np.uint64(r + 1)) for r in range(rounds)]

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.low
        with np.errstate(over="ignore"):
            if back:
                for key in reversed(self.keys):
                    left, right = right ^ (_mixed(left + key) & self.low), left
            else:
                for key in self.keys:
                    left, right = right, left ^ (_mixed(right + key) & self.low)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(x, dtype=np.uint64), back)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._network(out[outside], back)
        return out.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def backward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, True)


def place(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    slot, shard = divmod(int(Permutation(n, seed).forward(np.array([number]))[0]), shards)
    return shard, slot


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard and slot."""
    return int(Permutation(n, seed).backward(np.array([slot * shards + shard]))[0])


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The table with ``row_number`` from 0 in the order of ``key`` and of all columns, and its number of rows.

    Rows are dealt into ranges of the order, sorted there and stored with their place in the range; the ranges' counts
    (one row each) then shift the places. A key that very many rows share is cut by content, and equal rows by chance.
    """
    spark, names = df.sparkSession, df.columns
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    id_col = f"_c{names.index(key)}"
    # a first hash orders rows of a key; a second one tells different rows with the same first
    ordered = plain.withColumns({"_h": F.xxhash64(*plain.columns), "_g": F.xxhash64(F.lit(1), *plain.columns), "_any": F.rand(7)})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE_ROWS))
    order = [F.col(id_col).asc_nulls_first(), "_h", "_g"]
    dealt = ordered.repartitionByRange(parts, *order, "_any").sortWithinPartitions(*order)
    held = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_h", "_g", "_any"))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a range
    starts, n = [], 0
    for p in sorted(counts):
        starts.append((p, n))
        n += counts[p]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    out = held.join(F.broadcast(offsets), part == F.col("_part")).select(*plain.columns, (F.col("_start") + at).alias("row_number"))
    return out.toDF(*names, "row_number"), n


def assigned(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The table with row_number, shard and slot."""
    rows, n = numbered(df, key)
    permutation = Permutation(n, seed)

    @F.pandas_udf("long")
    def permuted(number: pd.Series) -> pd.Series:
        return pd.Series(permutation.forward(number.to_numpy()))

    names = rows.columns
    plain = rows.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("_p", permuted(f"_c{len(names) - 1}"))
    out = plain.select("*", F.pmod("_p", F.lit(shards)).cast("int").alias("_shard"), F.floor(F.col("_p") / shards).cast("long").alias("_slot")).drop("_p")
    return out.toDF(*names, "shard", "slot")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED, parts: int = 8) -> None:
    """Writes the table as Parquet, a folder a shard, its rows in the order of their slots in about ``parts`` files.

    Parquet has no two columns of one name, so a table with such columns, or with one of the three that are added, is refused.
    """
    rows = assigned(df, key, shards, seed)
    if len({c.lower() for c in rows.columns}) < len(rows.columns):
        raise ValueError(f"column names clash: {rows.columns}")
    last = rows.agg(F.max("slot").alias("last")).first()["last"] or 0
    piece = F.floor(F.col("slot") * parts / (last + 1))
    dealt = rows.repartitionByRange(shards * parts, "shard", piece).sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (bytes of the text and 16), text_crc32: what the report needs of each row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows': shards' counts differ by one at most), shard, slot, grown_shard (null), row_number."""
    return assigned(stored(sizes(docs)), "doc_id", shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
