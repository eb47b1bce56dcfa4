"""Population statistics over seven category axes, co-occurrence counts and top merchants.

Every row enters each axis once, so one scan serves all of them; partial aggregates keep hot keys and
the population row from meeting in one task as rows. Exact quantiles are found by rank among counted
values, dealt by key and magnitude, so that no task holds all values of a key.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.scratch import stored

QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}
STATS = ["mean", "std", "median", "q25", "q75", "q95", "cnt", "cv", "label_rate", "label_count", "train_count", "woe", "cnt_clean", "q90", "q99"]


def _or(c: str, missing: str) -> Column:
    return F.coalesce(F.col(c), F.lit(missing))


def channel_parts() -> tuple[Column, Column]:
    known = F.col("ch_type").isNotNull() | F.col("ch_sub").isNotNull()
    return F.when(known, _or("ch_type", "")).otherwise(S.MISSING), F.when(known, _or("ch_sub", "")).otherwise("")


def axis_keys() -> dict[str, tuple[Column, Column]]:
    """Both key parts of each axis, as text; a missing value has its reserved key."""
    return {
        "mcc": (F.col("mcc_key").cast("string"), F.lit("")),
        "channel": channel_parts(),
        "tz_currency": (_or("tz", S.MISSING_TZ), _or("ccy", S.MISSING_CCY)),
        "event_type_currency": (F.coalesce(F.col("et").cast("string"), F.lit(S.MISSING_ET)), _or("ccy", S.MISSING_CCY)),
        "event_descr": (_or("descr", S.MISSING), F.lit("")),
        "pos_cd": (_or("pos", S.MISSING), F.lit("")),
        "tz_alone": (_or("tz", S.MISSING_TZ_ALONE), F.lit("")),
    }


def keyed(tx: DataFrame, axes: dict[str, tuple[Column, Column]], population: bool = True) -> DataFrame:
    """Each row once for each axis, and once for the population."""
    entries = [F.struct(F.lit(a).alias("axis"), k1.alias("k1"), k2.alias("k2")) for a, (k1, k2) in axes.items()]
    if population:
        entries.append(F.struct(F.lit(S.GLOBAL).alias("axis"), F.lit(S.GLOBAL).alias("k1"), F.lit("").alias("k2")))
    return tx.where(F.col("phase").isin("pretrain", "train")).select("phase", "amt", "labelled", F.explode(F.array(*entries)).alias("e")).select("phase", "amt", "labelled", "e.*")


_KEY = ["axis", "k1", "k2"]


def _same_key(other: str) -> Column:
    out = F.col("axis") == F.col(f"{other}.axis")
    for k in ("k1", "k2"):
        out = out & F.col(k).eqNullSafe(F.col(f"{other}.{k}"))
    return out


def value_counts(rows: DataFrame) -> DataFrame:
    """axis, k1, k2, x (the amount of a clean row, else null) with the numbers of rows c, train and hit rows."""
    train, hit = F.col("phase") == "train", (F.col("phase") == "train") & F.coalesce("labelled", F.lit(False))
    clean = F.when(~hit, F.col("amt"))
    ones = [F.count(F.when(c, 1)).alias(n) for n, c in (("train", train), ("hit", hit))]
    return rows.select(*_KEY, clean.alias("x"), "phase", "labelled").groupBy(*_KEY, "x").agg(F.count("*").alias("c"), *ones)


def bucket_sums(counts: DataFrame) -> DataFrame:
    """The counts by key and bucket b of values that differ by about a hundredth (null: rows without a value): n, train and hit rows, and
    sums of the values' distances from the bucket's bound and of their squares, so that nothing cancels. Sums of parts of the rows add up."""
    off = F.col("x") - _bound()
    sums = [F.sum(c).alias(n) for c, n in (("c", "n"), ("train", "train"), ("hit", "hit"))]
    return _with_moments(counts.withColumn("b", bucket_of(F.col("x"))).groupBy(*_KEY, "b").agg(*sums, F.sum(F.col("c") * off).alias("s1"), F.sum(F.col("c") * off * off).alias("s2")))


def _bound() -> Column:
    return F.signum("b") * (F.pow(F.lit(2.0), F.abs("b") / 64) - 1)


def _with_moments(sums: DataFrame) -> DataFrame:
    """Adds the mean of a bucket's values, and the sum of squared deviations from it."""
    return sums.withColumns({"own": _bound() + F.col("s1") / F.col("n"), "spread": F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"))})


def bucket_of(x: Column) -> Column:
    return F.floor(F.signum(x) * F.log2(1 + F.abs(x)) * 64)


def exact_quantiles(counts: DataFrame, levels: dict[str, float], buckets: DataFrame | None = None) -> DataFrame:
    """axis, k1, k2 and the named quantiles (interpolated between neighbours) of values x that occur c times; null values don't count.

    Sums of buckets of about a hundredth of a value say which buckets a key's ranks fall
    into; only the values in those are then put in order, a bucket at a time.
    """
    known = counts.where("x IS NOT NULL").select(*_KEY, "x", "c").withColumn("b", bucket_of(F.col("x")))
    sums = (known.groupBy(*_KEY, "b").agg(F.sum("c").alias("n")) if buckets is None else buckets.where("b IS NOT NULL")).select(*_KEY, "b", "n")
    up = Window.partitionBy(*_KEY).orderBy("b")
    placed = sums.select(*_KEY, "b", "n", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(*_KEY)).alias("total"))
    rank = {n: q * (F.col("total") - 1) for n, q in levels.items()}
    wanted = F.lit(False)
    for r in rank.values():
        wanted = wanted | ((F.ceil(r) >= F.col("base")) & (F.floor(r) < F.col("base") + F.col("n")))
    found = placed.where(wanted).select(F.struct(*_KEY).alias("key"), F.col("b").alias("bucket"), "base", "total")
    inside = known.join(found, _same_key("key") & (F.col("b") == F.col("bucket")))
    ordered = inside.withColumn("end", F.col("base") + F.sum("c").over(Window.partitionBy(*_KEY, "b").orderBy("x")))
    ends = [F.min(F.when(F.col("end") > f(r), F.col("x"))).alias(f"{n}_{s}") for n, r in rank.items() for s, f in (("low", F.floor), ("high", F.ceil))]
    near = ordered.groupBy(*_KEY).agg(F.first("total").alias("total"), *ends)
    return near.select(*_KEY, *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (r - F.floor(r))).alias(n) for n, r in rank.items()])


#: Size of a sketch; its rank error is about 2.3 / SKETCH of the number of values.
SKETCH = 1024


def sketches(rows: DataFrame, k: int = SKETCH) -> DataFrame:
    """axis, k1, k2, sketch: a mergeable quantile sketch (KLL) of each key's clean amounts, with partial sketches before the shuffle."""
    hit = (F.col("phase") == "train") & F.coalesce("labelled", F.lit(False))
    return rows.where(~hit & F.col("amt").isNotNull()).groupBy(*_KEY).agg(F.kll_sketch_agg_double("amt", k).alias("sketch"))


def quantiles_of(sketched: DataFrame, levels: dict[str, float]) -> DataFrame:
    """axis, k1, k2 and the named quantiles, each a value whose rank is off by the sketch's error at most."""
    return sketched.select(*_KEY, *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(n) for n, q in levels.items()])


def merged_buckets(*parts: DataFrame) -> DataFrame:
    """Bucket sums of parts of the rows as those of the whole."""
    every = functools.reduce(DataFrame.unionByName, [p.select(*_KEY, "b", "n", "train", "hit", "s1", "s2") for p in parts])
    return _with_moments(every.groupBy(*_KEY, "b").agg(*[F.sum(c).alias(c) for c in ("n", "train", "hit", "s1", "s2")]))


def merged_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of parts of the rows as those of the whole; no row is read again."""
    every = functools.reduce(DataFrame.unionByName, [p.select(*_KEY, "sketch") for p in parts])
    return every.groupBy(*_KEY).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def axis_statistics(tx: DataFrame, axes: dict[str, tuple[Column, Column]] | None = None, approximate: bool = False) -> DataFrame:
    """axis, k1, k2 and the statistics of each key; the population row has the key __GLOBAL__ on every axis.

    Clean rows are those without a label and with a finite amount. Every row goes out once an axis, once only: amounts are counted
    by key and value, and stored; all statistics come from these counts. Quantiles are exact or, on request,
    those of sketches. The event-type axis also has the log frequency of its keys.
    """
    axes = axis_keys() if axes is None else axes
    rows = keyed(tx, axes)
    counts = stored(value_counts(rows))
    buckets = bucket_sums(counts)
    return statistics_of(buckets, quantiles_of(sketches(rows), QUANTILES) if approximate else exact_quantiles(counts, QUANTILES, buckets), list(axes))


def statistics_of(buckets: DataFrame, quantiles: DataFrame, names: list[str]) -> DataFrame:
    """The statistics from bucket sums and quantiles; ``names`` are the axes that the population row is repeated for."""
    whole = Window.partitionBy(*_KEY)
    known = F.when(F.col("b").isNotNull(), F.col("n"))
    placed = buckets.withColumn("clean", F.sum(known).over(whole)).withColumn("mean", F.sum(known * F.col("own")).over(whole) / F.col("clean"))
    apart = F.col("own") - F.col("mean")
    sums = placed.groupBy(*_KEY).agg(
        F.first("mean").alias("mean"), F.first("clean").alias("clean"), F.sum(F.col("spread") + known * apart * apart).alias("squares"),
        F.sum("n").alias("cnt"), F.sum("train").alias("train_count"), F.sum("hit").alias("label_count"),
    )
    sums = sums.withColumns({"cnt_clean": F.coalesce("clean", F.lit(0)), "std": F.when(F.col("clean") > 1, F.sqrt(F.col("squares") / (F.col("clean") - 1)))}).drop("clean", "squares")
    sums = sums.join(quantiles.select(F.struct(*_KEY).alias("key"), *QUANTILES), _same_key("key"), "left").drop("key")
    every = sums.where(F.col("axis") == S.GLOBAL)
    odds = every.select(((F.col("label_count") + 0.5) / (F.greatest(F.lit(1), F.col("train_count")) - F.col("label_count") + 0.5)).alias("odds"), F.col("cnt").alias("total"))
    copies = every.withColumn("axis", F.explode(F.array(*map(F.lit, names))))
    both = sums.where(F.col("axis") != S.GLOBAL).unionByName(copies)
    t, h = F.col("train_count"), F.col("label_count")
    own = (h + 0.5) / (F.greatest(F.lit(1), t - h) + 0.5)
    return both.crossJoin(F.broadcast(odds)).select(  # the other side is the one population row
        *_KEY, "mean", "std", *QUANTILES, "cnt",
        F.when(F.abs("mean") > S.EPS, F.col("std") / F.col("mean")).alias("cv"), F.when(t > 0, h / t).alias("label_rate"), "label_count", "train_count",
        F.log(own / F.col("odds")).alias("woe"), "cnt_clean", F.when(F.col("axis") == "event_type_currency", -F.log((F.col("cnt") + 1) / (F.col("total") + 1))).alias("log_frequency"),
    )


def population_totals(tx: DataFrame) -> DataFrame:
    train = F.col("phase") == "train"
    return tx.agg(F.count(F.when(F.col("phase") == "pretrain", 1)).alias("total_pretrain_rows"), F.count(F.when(train, 1)).alias("total_train_rows"), F.count(F.when(train & F.col("labelled"), 1)).alias("total_train_rows_with_label"))


def _fitted(tx: DataFrame) -> DataFrame:
    c1, c2 = channel_parts()
    return tx.where(F.col("phase").isin("pretrain", "train")).select("mcc_key", c1.alias("ch_type"), c2.alias("ch_sub"), _or("ccy", S.MISSING_CCY).alias("ccy"), _or("tz", S.MISSING_TZ_ALONE).alias("tz"))


def mcc_totals(tx: DataFrame) -> DataFrame:
    return _fitted(tx).groupBy("mcc_key").agg(F.count("*").alias("n_rows"))


def cooccurrence(tx: DataFrame, *by: str) -> DataFrame:
    """Counts of a merchant group with channel (ch_type, ch_sub), currency (ccy) or timezone (tz)."""
    return _fitted(tx).groupBy("mcc_key", *by).agg(F.count("*").alias("cnt"))


def channel_top3(tx: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The three most frequent merchant groups of each channel (ties: the smaller), -2 where there are fewer; from its counts, if they are there."""
    pairs = cooccurrence(tx, "ch_type", "ch_sub") if pairs is None else pairs
    best = Window.partitionBy("ch_type", "ch_sub").orderBy(F.desc("cnt"), "mcc_key")
    ranked = pairs.withColumn("r", F.row_number().over(best))
    tops = [F.coalesce(F.max(F.when(F.col("r") == i, F.col("mcc_key"))), F.lit(S.MCC_MISSING)).cast("bigint").alias(f"top{i}_mcc") for i in (1, 2, 3)]
    return ranked.groupBy("ch_type", "ch_sub").agg(*tops, F.sum("cnt").alias("ch_row_total"))
