"""The 146 population features: axis rows by key, with fallback to the population row.

Axis and count tables hold one row a key. They are stored first, so that Spark knows their sizes: it
broadcasts those within its threshold (``spark.sql.autoBroadcastJoinThreshold``) and joins others by
shuffle. The population rows of all axes come as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import axes as A
from tidemark.sources import aggregates
from tidemark.sources.scratch import stored

# For each axis the layout of its features after the first twelve, and the name of its median feature.
_RATIOS, _COUNTS = ["ratio", "z", "inv"], ["clean", "q90", "q99"]
LAYOUT = {
    "mcc": [*_RATIOS, *_COUNTS, "robust", "position"],
    "channel": [*_RATIOS, *_COUNTS, "median_z", "position"],
    "tz_currency": [*_COUNTS, "median_z", "position", "inv", "robust"],
    "event_type_currency": [*_COUNTS, "log_frequency", *_RATIOS, "median_z", "position", "robust"],
    "event_descr": [*_RATIOS, *_COUNTS, "median_z", "position"],
    "pos_cd": [*_RATIOS, *_COUNTS, "median_z", "position"],
    "tz_alone": [*_RATIOS, *_COUNTS, "median_z", "position"],
}
MEDIAN_NAME = {"tz_currency": "tz", "event_type_currency": "event_type"}


# Feature names; the first twelve are the same on each axis.
_FIRST = {
    "mean": "global_mean_amount", "std": "global_std_amount", "median": "global_median_amount", "q25": "global_q25", "q75": "global_q75", "q95": "global_q95",
    "cnt": "global_cnt", "cv": "global_cv", "label_rate": "fraud_rate", "label_count": "fraud_count", "train_count": "train_total_count", "woe": "woe",
}
_REST = {
    "ratio": "amount_ratio_global_mean_{axis}", "z": "global_zscore_{axis}", "inv": "inv_global_cnt_{axis}", "clean": "global_cnt_clean_{axis}",
    "q90": "global_q90_{axis}", "q99": "global_q99_{axis}", "robust": "global_zscore_median_iqr_{axis}", "position": "amount_percentile_in_{axis}",
    "median_z": "amount_z_vs_{median}_median", "log_frequency": "global_type_frequency_log_{axis}",
}


def block_names(axis: str) -> list[str]:
    return [f"{n}_{axis}" for n in _FIRST.values()] + [_REST[k].format(axis=axis, median=MEDIAN_NAME.get(axis, axis)) for k in LAYOUT[axis]]


def block(axis: str) -> dict[str, Column]:
    """Name and expression of an axis's features, over amt and s_<axis> (its statistics, an array in the order of _ROW)."""
    a, s = F.col("amt"), {n: F.get(f"s_{axis}", F.lit(i)) for i, n in enumerate(_ROW)}
    z = lambda centre: F.when(s["std"] > S.EPS, (a - centre) / s["std"])
    rest = {
        "ratio": F.when(F.abs(s["mean"]) > S.EPS, a / s["mean"]), "z": z(s["mean"]), "inv": 1 / (s["cnt"] + 1), "clean": s["cnt_clean"], "q90": s["q90"], "q99": s["q99"],
        "robust": S.robust_z(a, s["median"], s["q25"], s["q75"]), "position": S.clipped_position(a, s["q25"], s["q75"]), "median_z": z(s["median"]), "log_frequency": s["log_frequency"],
    }
    columns = [s[n] for n in _FIRST] + [rest[k] for k in LAYOUT[axis]]
    return {n: c.cast("double") for n, c in zip(block_names(axis), columns)}


_ROW = [*A.STATS, "log_frequency"]


def _with_statistics(rows: DataFrame, statistics: DataFrame, names: list[str]) -> DataFrame:
    """Adds s_<axis> for each named axis; a key that isn't there takes the population row. Statistics are one array, so that
    rows stay narrow from join to join."""
    row = F.array(*[F.col(n).cast("double") for n in _ROW])
    every = statistics.where(F.col("k1") == S.GLOBAL).agg(*[F.first(F.when(F.col("axis") == a, row), True).alias(f"_all_{a}") for a in names])
    out = rows
    for a in names:
        k1, k2 = A.axis_keys()[a]
        own = statistics.where((F.col("axis") == a) & (F.col("k1") != S.GLOBAL)).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), row.alias(f"_own_{a}"))
        out = out.withColumns({"_a": k1, "_b": k2}).join(own, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left").drop("_a", "_b", "_k1", "_k2")
    out = out.join(F.broadcast(every), how="left")  # one row
    return out.select(*rows.columns, *[F.coalesce(f"_own_{a}", f"_all_{a}").alias(f"s_{a}") for a in names])


def with_axis(rows: DataFrame, stats: DataFrame, axis: str) -> DataFrame:
    """Adds an axis's features."""
    return _with_statistics(rows, stats, [axis]).select(*rows.columns, *[c.alias(n) for n, c in block(axis).items()])


def with_joint(rows: DataFrame, counts: aggregates.Aggregates) -> DataFrame:
    """Adds the five features of merchant group with channel, currency and timezone; absent counts are 0."""
    c1, c2 = A.channel_parts()
    out = rows.withColumns({"_c1": c1, "_c2": c2, "_ccy": F.coalesce("ccy", F.lit(S.MISSING_CCY)), "_tz": F.coalesce("tz", F.lit(S.MISSING_TZ_ALONE))})

    def look(df: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
        renamed = table.withColumnsRenamed({v: f"_r_{v}" for v in on.values()})
        cond = None
        for left, right in on.items():
            one = F.col(left) == F.col(f"_r_{right}")
            cond = one if cond is None else cond & one
        return df.join(renamed, cond, "left").drop(*[f"_r_{v}" for v in on.values()])

    channel = {"_c1": "ch_type", "_c2": "ch_sub"}
    out = look(out, counts.mcc_totals, {"mcc_key": "mcc_key"})
    out = look(out, counts.channel.withColumnRenamed("cnt", "_n_ch"), {"mcc_key": "mcc_key", **channel})
    out = look(out, counts.currency.withColumnRenamed("cnt", "_n_ccy"), {"mcc_key": "mcc_key", "_ccy": "ccy"})
    out = look(out, counts.timezone.withColumnRenamed("cnt", "_n_tz"), {"mcc_key": "mcc_key", "_tz": "tz"})
    out = look(out, counts.top3, channel)
    total, n = F.coalesce("n_rows", F.lit(0)), lambda c: F.coalesce(c, F.lit(0))
    top = (F.col("mcc_key") == F.col("top1_mcc")) | (F.col("mcc_key") == F.col("top2_mcc")) | (F.col("mcc_key") == F.col("top3_mcc"))
    return out.select(
        *rows.columns,
        S.neglog_smooth(n("_n_ch"), total).alias("channel_rarity_neglog_in_mcc"),
        F.when(total > 0, n("_n_ccy") / total).alias("currency_freq_in_mcc"),
        F.when(total > 0, n("_n_tz") / total).alias("timezone_freq_in_mcc"),
        S.neglog_smooth(n("_n_ch"), n("ch_row_total")).alias("surprise_mcc_given_channel_neglog"),
        F.when(F.col("top1_mcc").isNotNull(), F.when(top, 0.0).otherwise(1.0)).alias("mcc_not_in_channel_top3_flag"),
    )


JOINT = ["channel_rarity_neglog_in_mcc", "currency_freq_in_mcc", "timezone_freq_in_mcc", "surprise_mcc_given_channel_neglog", "mcc_not_in_channel_top3_flag"]


def feature_names() -> list[str]:
    """All 146, in order."""
    first = ["mcc", "channel", "tz_currency", "event_type_currency"]
    return [n for a in first for n in block_names(a)] + JOINT + [n for a in LAYOUT if a not in first for n in block_names(a)]


def population_features(rows: DataFrame, fitted: aggregates.Aggregates) -> DataFrame:
    """``rows`` with all 146 features; stored aggregates are read, others (``stored_once``) written first."""
    out = with_joint(_with_statistics(rows, fitted.statistics, list(LAYOUT)), fitted)
    return out.select(*rows.columns, *JOINT, *[c.alias(n) for axis in LAYOUT for n, c in block(axis).items()]).select(*rows.columns, *feature_names())


def stored_counts(tx: DataFrame) -> aggregates.Aggregates:
    """The five count tables, each written once, all from the stored channel, currency and timezone counts; no statistics."""
    channel, currency, timezone = (stored(A.cooccurrence(tx, *by)) for by in (("ch_type", "ch_sub"), ("ccy",), ("tz",)))
    totals = stored(channel.groupBy("mcc_key").agg(F.sum("cnt").alias("n_rows")))
    return aggregates.Aggregates(None, totals, channel, currency, timezone, stored(A.channel_top3(tx, channel)))


def stored_once(tx: DataFrame) -> aggregates.Aggregates:
    """The aggregates of the pretrain and train rows of ``tx``, each table written once."""
    found = aggregates.fitted(tx)
    return aggregates.Aggregates(*[stored(t) for t in (found.statistics, found.mcc_totals, found.channel, found.currency, found.timezone, found.top3)])
