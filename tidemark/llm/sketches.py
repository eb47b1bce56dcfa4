"""Bottom-k document fingerprints, with DataFrame functions only.

A fingerprint holds the k least hashes of a text's five-word shingles (a text of fewer words has
one shingle, one without words none). Fingerprints of parts merge into that of the whole; from two
of them resemblance, containment and distinct shingle counts are estimated.

Null texts are empty; two fingerprints without shingles resemble each other fully, one with and one
without not at all. Documents with the same id follow each other in the order of a hash of their texts (rows of equal ids
and texts in any order); a null id comes first. Repeated rows each give a row, an empty table none. Texts of any length
are read whole; columns are picked by exact name and first position, so clashing ones do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick

K = 128
SHINGLE = 5
#: Documents in a range of ids, about, and ranges at most (beyond, they grow; a range is sorted with spilling).
RANGE_ROWS, RANGES = 20_000, 65_536
_SPACE = "[\\x20\\x09-\\x0D]+"
_SMALLEST = -(2**63)


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def shingle_hashes(tokens: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of a column of words (pass a plain column: it is read many times)."""
    n = F.size(tokens)
    spans = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(size)]))
    return F.when(n >= size, spans).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of a text column; words, hashes and fingerprint are computed once each."""
    return (
        df.withColumn("_words", words(F.col(text)))
        .withColumn(name, least(shingle_hashes(F.col("_words"), size), k))
        .drop("_words")
    )


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of two parts taken together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all (Jaccard)."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.size(merge(a, b, k)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    full = (k - 1) / ((F.get(a, F.size(a) - 1).cast("double") - _SMALLEST) / F.lit(2.0**64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: of a's hashes up to where both fingerprints are complete, those that b has
    (a common hash always is below). 1 for an a without shingles, null where a has no hash so small."""
    whole = F.lit(2**63 - 1)
    complete = F.when(F.size(b) < k, whole).otherwise(F.get(b, F.size(b) - 1))
    below = F.size(F.filter(a, lambda h: h <= complete))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(below > 0, F.size(F.array_intersect(a, b)) / below)


def range_of(key: Column, bounds: list, above: int | str = 2**63 - 1) -> Column:
    """Number of bounds at or below the key, by bisection; ``above`` exceeds every key."""
    depth = max(1, math.ceil(math.log2(len(bounds) + 1)))
    padded = F.lit(bounds + [above] * (2**depth - len(bounds)))

    def step(low: Column, half: Column) -> Column:
        return F.when(F.get(padded, low + half - 1) <= key, low + half).otherwise(low)

    return F.aggregate(F.lit([2 ** (depth - 1 - i) for i in range(depth)]), F.lit(0), step)


#: Parts of a range of ids at most, where one id has many rows.
PARTS = 4096


def _ranged(rows: DataFrame, key: str, quantiles: list) -> DataFrame:
    """Adds _range, a number in the order of (key, _hash). A key that several quantiles fall on is cut by the hash into as many parts."""
    bounds = sorted({int(q) for q in quantiles})
    base = range_of(F.col(key), bounds) if bounds else F.lit(0)
    hot = {b: n for b in bounds if (n := quantiles.count(b)) > 1}
    part = F.lit(0)
    if hot:
        own = F.lit([min(hot.get(b, 1), PARTS - 1) for b in [0, *bounds]])
        parts = F.get(own, base)
        share = (F.shiftright("_hash", 10).cast("double") / 2.0**53 * parts).cast("int")
        part = F.when(F.col(key).isin(*hot), share).when(parts > 1, parts).otherwise(0)
    return rows.withColumn("_range", base.cast("long") * PARTS + part)


def with_next(rows: DataFrame, key: str, text: str, prepare: Callable[[DataFrame], DataFrame], carried: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds next_<c> of the row that follows in the order of key and hash of the text; the last row's next is the first row.

    ``prepare`` adds the columns ``carried`` that the next row is to bring along.

    Rows are dealt into ranges of about equal counts. The first row of each range is also
    sent to the end of the range before it, so each range is complete on its own and one shuffle
    moves each row once.
    """
    spark = rows.sparkSession
    count = rows.count()
    parts = min(RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / range_rows)))
    quantiles = rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts) if count else []
    # the hash is compared as an unsigned number, as its parts are
    ranged = _ranged(rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(text), 1)), key, [int(q) for q in quantiles if q is not None])
    firsts = ranged.groupBy("_range").agg(F.min(F.struct(key, "_hash")).alias("_first"))
    around = Window.partitionBy(F.lit(0)).orderBy("_range")  # at most one row a range
    before = firsts.select("_first", F.coalesce(F.lag("_range").over(around), F.max("_range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    heads = (
        ranged.join(F.broadcast(before), (F.col(key) == F.col(f"_first.{key}")) & (F.col("_hash") == F.col("_first._hash")))
        .groupBy("_to")
        .agg(F.min(text).alias(text))
        .select(F.lit(None).cast(rows.schema[key].dataType).alias(key), text, F.lit(0).cast("long").alias("_hash"), F.col("_to").alias("_range"), F.lit(1).alias("_ghost"))
    )
    kept = ranged.select(key, text, "_hash", "_range", F.lit(0).alias("_ghost"))
    own = Window.partitionBy("_range").orderBy("_ghost", key, "_hash", text)
    led = prepare(kept).unionByName(prepare(heads)).select("*", *[F.lead(c).over(own).alias(f"next_{c}") for c in (text, *carried)])
    return led.where(F.col("_ghost") == 0).drop("_ghost", "_range", "_hash")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Row per document: id, sketch, and for the edited text (its second half is replaced by the beginning
    of the next document) sketch and text; and the next document's sketch."""
    rows = pick(docs, id_col, text_col).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_SMALLEST)).alias("_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    led = with_next(rows, "_key", "text", lambda df: with_sketch(df, "text", "sketch", k), ["sketch"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = led.select(
        F.when(F.col("_key") != _SMALLEST, F.col("_key")).alias(id_col),
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
        "sketch",
        "next_sketch",
    )
    return with_sketch(edited, "edited", "edited_sketch", k)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (digests of the sketches), near_edited, near_next,
    contained_edited, contained_next (share of its shingles that the edited text, the next document has, estimated), n_shingles (distinct, estimated),
    sketch (what ``merge`` takes)."""
    found = edited_fingerprints(docs, id_col, text_col)

    def written(sketch: str) -> Column:
        return F.sha2(F.concat_ws(",", F.col(sketch).cast("array<string>")), 256)

    return found.select(
        id_col,
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("sketch").alias("fingerprint"),
        written("edited_sketch").alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        F.col("sketch"),
    )
