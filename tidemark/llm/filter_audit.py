"""Filter interaction audit: what each of five filters removes, in every order of applying them.

A document is reduced to its mask, the set of filters that it fails, and documents are counted by part
and mask. For a mask, the orders in which step k removes it are those whose first k letters are a
prefix with only the last letter in the mask. In the lexicographic list of orders (ranks from the
Lehmer code) a prefix of k letters covers one interval of (5 - k)! ranks. So a mask's count is added
at the start of each of its intervals and taken off at the end; prefix sums over the ranks then give
the documents removed, for each order and step.

Null texts are empty, a null source is the empty string. A document is a copy if a smaller id has its text;
a null id is the largest, and of rows with the same id and text none is smaller. Several label rows
of an id count as one that has all their ones; ids without labels, and null ids, are neither good nor toxic.
Texts of any length are read whole. Repeated rows count each; an empty table has no parts and no rows.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.scratch import stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_WORD = r"[^\x20\x09-\x0D]+"
#: Values over which rows without an id are spread in joins by id.
SPREAD = 1024


def rank(order: str) -> int:
    """Place of an order in the lexicographic list: its Lehmer code in the factorial number system."""
    n = len(order)
    return sum(sum(b < a for b in order[i + 1 :]) * math.factorial(n - 1 - i) for i, a in enumerate(order))


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, start, end): the ranks, end exclusive, of the orders in which that step removes the mask's documents."""
    failing = {f for i, f in enumerate(FILTERS) if mask >> i & 1}
    passing = [f for f in FILTERS if f not in failing]
    out = []
    for step in range(1, len(FILTERS) + 1):
        for before in itertools.permutations(passing, step - 1):
            for f in failing:
                prefix = "".join(before) + f
                start = rank(prefix + "".join(sorted(set(FILTERS) - set(prefix))))
                out.append((step, start, start + math.factorial(len(FILTERS) - step)))
    return out


def failures(text: Column) -> dict[str, Column]:
    """Failure of the filters that need only the text."""
    found = F.regexp_extract_all(text, F.lit(_WORD), 0)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the set of filters they fail (bit i for the i-th filter).

    Texts stay in their tasks as hashes (256 bits). Rows that agree in id, text and part are counted before the shuffle,
    so neither repeated rows nor rows without an id gather in one task, and copies travel as one row a group, part and mask.
    """
    rows = pick(docs, "doc_id", "text", "source").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    bits = [F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures(F.col("text")).values())]
    narrow = rows.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("key"), sum(bits[1:], bits[0]).alias("mask"))
    counted = narrow.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    marks = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key", "part"), F.lit(SPREAD))).otherwise(F.lit(0))
    marked = counted.withColumn("_spread", spread).join(marks.withColumn("_spread", F.lit(0).cast("bigint")), ["doc_id", "_spread"], "left").drop("_spread")
    largest = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = stored(
        marked.groupBy("key", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"), F.min(largest).alias("least"), F.min_by("n", largest).alias("n_least"))
    )
    firsts = groups.groupBy("key").agg(F.min("least").alias("first"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    own = F.when(F.col("first").isNull() | (F.col("least") == F.col("first")), F.col("n_least")).otherwise(0)
    split = groups.join(firsts, "key", "left").withColumn("own", own)
    copied = 1 << FILTERS.index("E")
    each = split.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - F.col("own")).alias("n")))))
    ones = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), ones("good").alias("good"), ones("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and filter, with the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (documents the filter removes, over all orders): a row for every part, order and step."""
    spark = docs.sparkSession
    counts = stored(mask_counts(docs, labels))
    # fixed sizes: ends of the intervals of 31 masks, 600 rows of orders and steps
    ends = [(mask, step, at, sign) for mask in range(1, 2 ** len(FILTERS)) for step, start, end in intervals(mask) for at, sign in ((start, 1), (end, -1))]
    marks = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    steps = spark.createDataFrame([(r, o, i + 1, f) for r, o in enumerate(ORDERS) for i, f in enumerate(o)], "rank int, filter_order string, step int, filter string")
    filters = spark.createDataFrame([(f, 1 << i) for i, f in enumerate(FILTERS)], "filter string, bit int")

    added = counts.join(F.broadcast(marks), "mask").groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in ("n", "good", "toxic")])
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"))
    failing = (
        counts.crossJoin(F.broadcast(filters))  # five rows
        .groupBy("part", "filter")
        .agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("unique_fails"))
    )
    grid = totals.join(failing, "part").join(F.broadcast(steps), "filter").join(added, ["part", "step", "rank"], "left")
    over_ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = grid.withColumns({name: F.coalesce(F.sum(c).over(over_ranks), F.lit(0)) for name, c in (("removed", "n"), ("good_lost", "good"), ("toxic_lost", "toxic"))})
    over_steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return summed.select(
        "part", "filter_order", "step", "filter",
        (F.col("total") - F.sum("removed").over(over_steps)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
