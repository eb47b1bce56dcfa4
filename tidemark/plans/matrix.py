"""The training matrix: history features, population features, targets and meta columns of every train row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import history, labels, lookups, sampling
from tidemark.sources import aggregates
from tidemark.sources.tables import META_COLUMNS

#: Where the meta columns that are not named alike come from.
META = {
    "mcc_code": "mcc", "event_type_nm": "et", "event_descr": "descr", "currency_iso_cd": "ccy", "pos_cd": "pos", "accept_language": "al",
    "screen_size": "screen", "timezone": "tz", "channel_indicator_type": "ch_type", "channel_indicator_subtype": "ch_sub",
}


def training_matrix(tx: DataFrame, distribution: DataFrame | None = None, cap: int | None = history.CAP, phase: str = "train", fitted: aggregates.Aggregates | None = None) -> DataFrame:
    """244 features, then the meta columns in their order, then t.

    Windows run over all phases; rows of other phases then go. With a length distribution each row
    sees only its own draw of newest rows. Aggregates come from ``fitted``, or else from the pretrain and train rows of ``tx``.
    """
    rows = labels.with_target(tx)
    suffix = None
    if distribution is not None:
        rows, suffix = sampling.sampled_lengths(rows, distribution), "length"
    keep = [*META.values(), "mcc_key", "amt", "customer_id", "target", "sample_weight", "event_dttm", "t", "phase"]
    local = history.packed_features(rows, cap=cap, suffix=suffix, keep=keep, rows=f"phase = '{phase}'").drop("phase")
    out = history.unpacked(lookups.population_features(local, fitted or lookups.stored_once(tx)))
    names = [*history.FEATURES, *lookups.feature_names()]
    return out.select(*names, *[F.col(META.get(c, c)).alias(c) for c in META_COLUMNS], "t")


def scoring_rows(tx: DataFrame, fitted: aggregates.Aggregates) -> DataFrame:
    """event_id and the 244 features of every test row. Its history is its customer's pretest rows, with or without an event id, and earlier
    test rows with one, of any number; test rows without an event id are neither scored nor part of a history."""
    later = tx.where("phase = 'pretest' OR (phase = 'test' AND event_id IS NOT NULL)")
    rows = history.packed_features(later, cap=None, keep=[*META.values(), "mcc_key", "amt"], rows="phase = 'test'")
    return history.unpacked(lookups.population_features(rows, fitted)).select("event_id", *history.FEATURES, *lookups.feature_names())
