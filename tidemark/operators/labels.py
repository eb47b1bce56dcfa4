"""Labels: joins by presence, cohort checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of rows labelled 1, labelled 0, and not labelled.
WEIGHTS = (5.0, 2.0, 1.0)


def with_target(tx: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """target (1 where a label is there, of either value) and sample_weight. The label side is one row an event;
    Spark broadcasts it where its own size estimate allows."""
    rows = tx if labels is None else tx.drop("label", "labelled").join(labels, "event_id", "left").withColumn("labelled", F.col("label").isNotNull())
    one, zero, none = WEIGHTS
    return rows.withColumns({"target": F.col("label").isNotNull().cast("int"), "sample_weight": F.when(F.col("label") == 1, one).when(F.col("label").isNotNull(), zero).otherwise(none)})


def presence(tx: DataFrame) -> DataFrame:
    """Rows with and without a label, and without an id (counted apart), and their shares."""
    known = F.col("event_id").isNotNull()
    labelled = F.coalesce("labelled", F.lit(False))
    sums = tx.agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(n) for n, c in (("n_labelled", known & labelled), ("n_unlabelled", known & ~labelled), ("n_null_id", ~known))])
    return sums.select("*", *[(100 * F.try_divide(f"n_{c}", "n")).alias(f"pct_{c}") for c in ("labelled", "unlabelled", "null_id")])


def unmatched_labels(labels: DataFrame, tx: DataFrame) -> DataFrame:
    """Labels of events that aren't there."""
    return labels.join(tx.select("event_id"), "event_id", "left_anti")


def matched_rows(tx: DataFrame, labels: DataFrame) -> DataFrame:
    return tx.join(labels.select("event_id"), "event_id", "left_semi")


def cohort_overlap(tx: DataFrame, cohorts: dict[str, Column], key: str = "customer_id", samples: int = 0) -> DataFrame:
    """Number of customers that each two cohorts share: left, right, n_shared, and on request their least ids (at most
    ``samples``). Cohorts are conditions on one table, which is scanned once: one aggregation makes a bit set for each
    customer, and pairs are counted without a join."""
    names = sorted(cohorts)
    bits = F.lit(0)
    for i, n in enumerate(names):
        bits = bits.bitwiseOR(F.when(cohorts[n], 1 << i).otherwise(0))
    sets = tx.select(F.col(key).alias("k"), bits.alias("bits")).groupBy("k").agg(F.bit_or("bits").alias("bits"))
    counts = sets.groupBy("bits").agg(F.count("*").alias("c"))
    if samples:  # each task passes on its least ids only
        place = F.row_number().over(Window.partitionBy("bits").orderBy("k"))
        least = sets.where("k IS NOT NULL").withColumn("_place", place).where(F.col("_place") <= samples).groupBy("bits").agg(F.collect_list("k").alias("ids"))
        counts = counts.join(least, "bits", "left")
    pairs = [(a, b, (1 << i) | (1 << j)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    entries = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(m).alias("mask")) for a, b, m in pairs])
    shared = F.col("bits").bitwiseAND(F.col("p.mask")) == F.col("p.mask")
    found = counts.select("*", F.explode(entries).alias("p")).groupBy("p.left", "p.right")
    ids_of = sets.schema["k"].dataType.simpleString()
    ids = F.slice(F.sort_array(F.flatten(F.collect_list(F.when(shared, F.coalesce("ids", F.array().cast(f"array<{ids_of}>")))))), 1, samples) if samples else None
    return found.agg(F.sum(F.when(shared, F.col("c")).otherwise(0)).alias("n_shared"), *([ids.alias("sample_ids")] if samples else []))


def check_disjoint(overlap: DataFrame, allowed: Callable[[str, str], bool]) -> None:
    """Raises if two cohorts share customers that may not; the message has the pairs and their sample ids. A row a pair is read."""
    bad = [r for r in overlap.where("n_shared > 0").collect() if not allowed(r["left"], r["right"])]
    if bad:
        raise ValueError("; ".join(f"{r['left']} and {r['right']} share {r.n_shared} customers" + (f", such as {', '.join(r.sample_ids)}" if "sample_ids" in r else "") for r in bad))


def id_sets(a: DataFrame, b: DataFrame, key: str = "customer_id") -> DataFrame:
    """How many distinct ids are in both, only in the first, only in the second."""
    both = a.select(key, F.lit(1).alias("bit")).unionByName(b.select(key, F.lit(2).alias("bit"))).groupBy(key).agg(F.bit_or("bit").alias("bits"))
    return both.agg(*[F.count(F.when(F.col("bits") == m, 1)).alias(n) for n, m in (("n_both", 3), ("n_only_first", 1), ("n_only_second", 2))])
