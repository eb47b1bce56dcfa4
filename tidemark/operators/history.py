"""The 98 history features: statistics over a customer's bounded past, for every row.

The past H of a row is the array of at most ``cap`` rows that precede it (oldest first), optionally
cut to the row's own number of newest rows; without a cap it is all of them. The expressions below say what each feature
is. ``history_features`` computes those that look at the past in Arrow batches of whole customers (``history_kernel``), after one shuffle and one sort,
in about log(rows) steps a row whatever the length of the past; features of the row alone need no shuffle. ``array_features`` evaluates the same
expressions over arrays from one window, in the JVM: time and key conditions are higher-order functions, and
arrays that several features need are columns of their own. It is quadratic in the length of the past, and the other's check.

A customer with very many rows is cut into ranges of hours, and the ``cap`` rows before a range are
sent to it too, so that no customer is a single task.

Order within a customer: phase, time, event id. Missing values are null; text columns are trimmed and
null where empty.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import history_kernel as kernel
from tidemark.sources.scratch import stored
from tidemark.sources.tables import PHASE_RANK

CAP = 512
DAY = 86_400


def mean(a: str) -> str:
    return f"(aggregate({a}, 0D, (s, x) -> s + x) / nullif(size({a}), 0))"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x)"


def deviation(a: str) -> str:
    """Sample standard deviation of an array (null below two), in one pass."""
    step = "named_struct('n', s.n + 1D, 'm', s.m + (x - s.m) / (s.n + 1D), 'q', s.q + (x - s.m) * (x - (s.m + (x - s.m) / (s.n + 1D))))"
    return f"if(size({a}) > 1, aggregate({a}, named_struct('n', 0D, 'm', 0D, 'q', 0D), (s, x) -> {step}, s -> sqrt(s.q / (s.n - 1D))), null)"


def median(sorted_a: str) -> str:
    return f"if(size({sorted_a}) > 0, (get({sorted_a}, (size({sorted_a}) - 1) div 2) + get({sorted_a}, size({sorted_a}) div 2)) / 2, null)"


def tail(a: str, n: int) -> str:
    return f"slice({a}, greatest(size({a}) - {n - 1}, 1), {n})"


def safe(d: str) -> str:
    return f"if(abs({d}) <= {S.EPS}, {S.EPS}, {d})"


def count(a: str, cond: str) -> str:
    return f"size(filter({a}, x -> {cond}))"


def flag(cond: str) -> str:
    return f"if(coalesce({cond}, false), 1D, 0D)"


def amounts(a: str) -> str:
    return f"transform(filter({a}, x -> x.amt IS NOT NULL), x -> x.amt)"


def distinct(a: str, field: str) -> str:
    return f"size(array_distinct(transform(filter({a}, x -> x.{field} IS NOT NULL), x -> x.{field})))"


def switches(field: str) -> str:
    return f"if(n > 1, aggregate(sequence(1, size(H20) - 1), 0, (s, i) -> s + if(get(H20, i).{field} <=> get(H20, i - 1).{field}, 0, 1)), 0)"


def streak(op: str) -> str:
    """Steps of the newest strictly monotone run of A."""
    return f"if(size(A) > 1, aggregate(sequence(size(A) - 1, 1, -1), named_struct('n', 0, 'on', true), (s, i) -> if(s.on AND get(A, i) {op} get(A, i - 1), named_struct('n', s.n + 1, 'on', true), named_struct('n', s.n, 'on', false)), s -> s.n), 0)"


def hour(t: str) -> str:
    return f"cast(floor(pmod({t}, {DAY}) / 3600) AS int)"


def weekday(t: str) -> str:
    return f"cast(pmod(floor({t} / {DAY}) + 3, 7) AS int)"


def since(seconds: int) -> str:
    return f"filter(H, x -> x.t >= t - {seconds})"


#: Arrays that features share, in layers: each layer may use the ones before it.
LAYERS: list[dict[str, str]] = [
    {"n": "size(H)", "A": amounts("H"), "T24": since(DAY), "T5": since(5 * DAY), "T7": since(7 * DAY), "M": "filter(H, x -> x.mcc = mcc)", "TT": "transform(filter(H, x -> x.t IS NOT NULL), x -> x.t)", "P": "get(H, size(H) - 1)", "H20": tail("H", 20)},
    {
        "T1": "filter(T24, x -> x.t >= t - 3600)", "T6": "filter(T24, x -> x.t >= t - 21600)", "A24": amounts("T24"), "S": "sort_array(A)", "MA": amounts("M"),
        "M5": "sort_array(transform(filter(T5, x -> x.mcc = mcc AND x.amt IS NOT NULL), x -> x.amt))",
        "D": "if(size(TT) > 1, transform(sequence(1, size(TT) - 1), i -> cast(get(TT, i) - get(TT, i - 1) AS double)), cast(array() AS array<double>))",
        "SS": "filter(H, x -> x.sess = sess)",
    },
    {"A1": amounts("T1"), "mean_a": mean("A"), "std_a": deviation("A"), "med_a": median("S"), "mean_m": mean("MA"), "std_m": deviation("MA"), "std_d": deviation("D"), "span": "cast(array_max(TT) - array_min(TT) AS double)", "hm": "transform(M, x -> if(x.t IS NULL, -1D, cast(" + hour("x.t") + " AS double)))"},
]

#: Features in their order, by name.
FEATURES: dict[str, str] = {
    "operation_amt": "amt",
    "log_1_plus_transactions_seen": "log1p(n)",
    "amount_zscore": "if(std_a > 0, (amt - mean_a) / std_a, null)",
    "transactions_last_24h": "size(A24)",
    "sum_amount_last_1h": total("A1"),
    "max_amount_last_24h": "coalesce(array_max(A24), 0D)",
    "is_new_device": flag("dev_known AND NOT exists(H, x -> x.dev = dev)"),
    "is_new_mcc": flag("mcc IS NOT NULL AND size(M) = 0"),
    "is_new_channel": flag("ch_known AND NOT exists(H, x -> x.ch = ch)"),
    "phone_voip_call_state": flag("voip"),
    "hour": hour("t"),
    "day_of_week": weekday("t"),
    "is_night_transaction": f"if(t IS NULL, null, if({hour('t')} >= 22 OR {hour('t')} < 6, 1D, 0D))",
    "is_weekend": f"if(t IS NULL, null, if({weekday('t')} >= 5, 1D, 0D))",
    "sum_amount_last_24h": total("A24"),
    "time_since_prev_transaction": "coalesce(t - get(TT, size(TT) - 1), -1)",
    "timezone_missing": flag("tz IS NULL"),
    "trend_mean_last_3_to_10": f"{mean(tail('A', 3))} / {safe(mean(tail('A', 10)))}",
    "amount_percentile_rank": f"{count('A', 'x <= amt')} / nullif(if(amt IS NULL, 0, size(A)), 0)",
    "std_time_deltas": "std_d",
    "is_device_switch": flag("dev_known AND (n = 0 OR P.dev != dev)"),
    "is_mcc_switch": flag("P.mcc != mcc"),
    "session_mean_amount": f"{total(amounts('SS'))} / nullif(size(SS), 0)",
    "device_freq": f"if(dev_known, {count('H', 'x.dev = dev')}, 0) / nullif(n, 0)",
    "delta_1": "get(D, size(D) - 1)",
    "delta_2": "if(size(D) > 1, get(D, size(D) - 2), null)",
    "acceleration_delta_1_over_2": f"if(size(D) > 1, get(D, size(D) - 1) / {safe('get(D, size(D) - 2)')}, null)",
    "std_delta_last_k": deviation(tail("D", 10)),
    "time_since_last_device_change": "if(dev_known, t - get(filter(reverse(H), x -> x.t IS NOT NULL AND x.dev != dev), 0).t, null)",
    "time_since_last_mcc_change": "if(mcc IS NOT NULL, t - get(filter(reverse(H), x -> x.t IS NOT NULL AND NOT x.mcc <=> mcc), 0).t, null)",
    "event_descr_freq_last_1h": count("T1", "x.descr = descr"),
    "event_descr_freq_last_6h": count("T6", "x.descr = descr"),
    "event_descr_freq_last_24h": count("T24", "x.descr = descr"),
    "event_type_nm_freq_last_1h": count("T1", "x.et = et"),
    "event_type_nm_freq_last_6h": count("T6", "x.et = et"),
    "event_type_nm_freq_last_24h": count("T24", "x.et = et"),
    "mcc_freq_last_6h": count("T6", "x.mcc = mcc"),
    "mcc_freq_last_24h": count("T24", "x.mcc = mcc"),
    "mcc_event_descr_pair_new": flag("mcc IS NOT NULL AND descr IS NOT NULL AND NOT exists(M, x -> coalesce(x.descr = descr, false))"),
    "high_amount_ratio_last_24h": f"coalesce({count('A24', 'x > get(S, cast(floor(0.95D * (size(S) - 1)) AS int))')} / nullif(size(A24), 0), 0)",
    "amount_relative_to_mcc_median_5_days": f"amt / nullif({median('M5')}, 0)",
    "amount_ratio_to_window_median": "amt / nullif(med_a, 0)",
    "amount_iqr_normalized": "if(size(S) > 1, (amt - get(S, (size(S) - 1) div 4)) / if(abs(get(S, (3 * (size(S) - 1)) div 4) - get(S, (size(S) - 1) div 4)) < 1e-9, 1e-9, get(S, (3 * (size(S) - 1)) div 4) - get(S, (size(S) - 1) div 4)), null)",
    "amount_cv_in_window": "if(abs(mean_a) > 1e-9, std_a / mean_a, null)",
    "transactions_last_1h": "size(A1)",
    "unique_mcc_count_suffix": distinct("H", "mcc"),
    "unique_device_key_count_suffix": "size(array_distinct(transform(filter(H, x -> x.dev_known), x -> x.dev)))",
    "unique_channel_key_count_suffix": "size(array_distinct(transform(filter(H, x -> x.ch_known), x -> x.ch)))",
    "unique_timezone_count_suffix": distinct("H", "tz"),
    "mcc_switch_count_last_20_tx": switches("mcc"),
    "device_switch_count_last_20_tx": switches("dev"),
    "channel_switch_count_last_20_tx": switches("ch"),
    "distinct_hours_active_last_24h": f"size(array_distinct(transform(T24, x -> {hour('x.t')}))) / 24",
    "mean_amount_last_3_transactions": mean(tail("A", 3)),
    "amount_ratio_to_min_amount_24h": "if(array_min(A24) > 1e-9, amt / array_min(A24), null)",
    "web_rdp_count_last_24h": count("T24", "x.rdp"),
    "voip_flag_count_last_24h": count("T24", "x.voip"),
    "channel_relative_freq": f"if(ch_known, {count('H', 'x.ch = ch')}, 0) / nullif(n, 0)",
    "timezone_relative_freq": f"{count('H', 'x.tz = tz')} / nullif(n, 0)",
    "browser_language_relative_freq": f"{count('H', 'x.bl = bl')} / nullif(n, 0)",
    "event_type_nm_share_in_suffix": f"coalesce({count('H', 'x.et = et')} / nullif(n, 0), 0)",
    "mcc_consecutive_streak_length": "if(mcc IS NULL, 0, aggregate(reverse(H), named_struct('n', 0, 'on', true), (s, x) -> if(s.on AND x.mcc <=> mcc, named_struct('n', s.n + 1, 'on', true), named_struct('n', s.n, 'on', false)), s -> s.n))",
    "mean_gap_seconds_last_5_intervals": mean(tail("D", 5)),
    "suffix_time_span_hours_log1p": "if(span IS NULL, null, log1p(greatest(0D, span / 3600)))",
    "transactions_per_span_hour": "if(span IS NULL, null, n / greatest(span / 3600, 1e-9))",
    "mcc_amount_std_same_5d": deviation("M5"),
    "weekend_transaction_share_last_7d": f"coalesce({count('T7', weekday('x.t') + ' >= 5')} / nullif(size(T7), 0), 0)",
    "distinct_event_descr_count_last_24h_norm": f"{distinct('T24', 'descr')} / greatest(1, size(T24))",
    "battery_level": "battery",
    "developer_tools_flag": "dev_flag",
    "accept_lang_browser_lang_mismatch": flag("al != bl"),
    "amount_diff_prev": "amt - P.amt",
    "amount_ratio_prev": f"amt / {safe('P.amt')}",
    "amount_increase_streak_suffix": streak(">"),
    "amount_decrease_streak_suffix": streak("<"),
    "is_new_session_id": flag("sess IS NOT NULL AND size(SS) = 0"),
    "session_switch_count_last_20_tx": switches("sess"),
    "seconds_since_session_start_in_window": "if(sess IS NULL, null, t - coalesce(array_min(transform(SS, x -> x.t)), t))",
    "mcc_same_count_suffix": "size(M)",
    "sum_amount_same_mcc_suffix": total("MA"),
    "mean_amount_same_mcc_suffix": "mean_m",
    "std_amount_same_mcc_suffix": "std_m",
    "min_amount_same_mcc_suffix": "array_min(MA)",
    "max_amount_same_mcc_suffix": "array_max(MA)",
    "share_mcc_cnt_suffix": "if(mcc IS NULL, null, size(M) / nullif(n, 0))",
    "share_mcc_sum_suffix": f"if(mcc IS NOT NULL AND {total('A')} > 1e-9, {total('MA')} / {total('A')}, null)",
    "amount_ratio_mean_same_mcc": "if(abs(mean_m) > 1e-9, amt / mean_m, null)",
    "amount_minus_mean_same_mcc": "amt - mean_m",
    "zscore_amount_same_mcc": "if(std_m > 1e-9, (amt - mean_m) / std_m, null)",
    "days_since_last_same_mcc": f"(t - get(filter(reverse(M), x -> x.t IS NOT NULL), 0).t) / {DAY}",
    "mcc_channel_same_count_suffix": f"if(ch_known, {count('M', 'x.ch = ch')}, 0)",
    "is_new_mcc_channel_pair": flag("mcc IS NOT NULL AND ch_known AND NOT exists(M, x -> x.ch = ch)"),
    "mcc_device_same_count_suffix": f"if(dev_known, {count('M', 'x.dev = dev')}, 0)",
    "is_new_mcc_device_pair": flag("mcc IS NOT NULL AND dev_known AND NOT exists(M, x -> x.dev = dev)"),
    "mcc_rdp_count_suffix": count("M", "x.rdp"),
    "share_mcc_rdp_suffix": f"{count('M', 'x.rdp')} / nullif(size(M), 0)",
    "hour_mean_same_mcc_suffix": mean("hm"),
    "hour_std_same_mcc_suffix": deviation("hm"),
}

_FIELDS = ["t", "amt", "mcc", "descr", "et", "ch", "ch_known", "dev", "dev_known", "tz", "bl", "sess", "rdp", "voip"]


#: A customer with more rows is cut into ranges of about so many.
RANGE_ROWS = 100_000


def _rank() -> Column:
    return F.create_map(*[F.lit(x) for p in PHASE_RANK.items() for x in p])[F.col("phase")]


def _order(*by: str) -> Window:
    """Rows of a customer by phase, time and id; a missing id counts as 0."""
    return Window.partitionBy("customer_id", *by).orderBy(_rank(), "t", F.coalesce("event_id", F.lit(0)))


def _ranges(tx: DataFrame, cap: int) -> DataFrame | None:
    """customer_id, phase_rank, hour, to, ghost: the ranges that an hour of a large customer belongs to, and those that need it as history.

    Only hours of large customers have rows here; there are none, and no table, where no customer is large.
    """
    large = stored(tx.groupBy("customer_id").agg(F.count("*").alias("rows")).where(F.col("rows") > RANGE_ROWS).select("customer_id"))
    if large.isEmpty():
        return None
    hours = tx.join(large, "customer_id", "left_semi").groupBy("customer_id", _rank().alias("phase_rank"), F.floor(F.col("t") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("customer_id").orderBy("phase_rank", "hour")
    ends = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = stored(hours.withColumn("end", ends).withColumn("to", F.floor((F.col("end") - F.col("n")) / RANGE_ROWS)))
    starts = found.groupBy("customer_id", F.col("to").alias("later")).agg(F.min(F.col("end") - F.col("n")).alias("start"))
    # an hour that ends within cap rows before the start of a later range is history of it
    before = found.join(starts, "customer_id").where((F.col("to") < F.col("later")) & (F.col("end") > F.col("start") - cap))
    keys = ["customer_id", "phase_rank", "hour"]
    return stored(found.select(*keys, "to", F.lit(False).alias("ghost")).unionByName(before.select(*keys, F.col("later").alias("to"), F.lit(True).alias("ghost"))))


def _with_keys(tx: DataFrame) -> DataFrame:
    pair = lambda a, b: F.concat_ws("\u001f", F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    return tx.withColumns({
        "dev": pair(F.col("os"), F.col("ver")), "dev_known": F.col("os").isNotNull() | F.col("ver").isNotNull(),
        "ch": pair(F.col("ch_type"), F.col("ch_sub")), "ch_known": F.col("ch_type").isNotNull() | F.col("ch_sub").isNotNull(),
        "dev_flag": S.developer_flag(F.col("dev_tools")),
    })


def _dealt(rows: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """The rows with _range, and copies with _ghost for the ranges that only need them as history."""
    if ranges is None:
        return rows.withColumns({"_range": F.lit(0).cast("bigint"), "_ghost": F.lit(False)})
    named = ranges.withColumnsRenamed({"customer_id": "_customer", "phase_rank": "_phase", "hour": "_hour", "to": "_range", "ghost": "_ghost"})
    same = (F.col("customer_id") == F.col("_customer")) & _rank().eqNullSafe(F.col("_phase")) & F.floor(F.col("t") / 3600).eqNullSafe(F.col("_hour"))
    joined = rows.join(named, same, "left").drop("_customer", "_phase", "_hour")
    return joined.withColumns({"_range": F.coalesce("_range", F.lit(0)), "_ghost": F.coalesce("_ghost", F.lit(False))})


def with_past(tx: DataFrame, cap: int | None = CAP, suffix: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Adds H, the preceding rows (oldest first), with all or the named fields. ``suffix`` names a column with each row's own number of newest rows.

    Without a cap a customer's rows stay together, as each needs all before it.
    """
    ranges = _ranges(tx.select("customer_id", "phase", "t"), cap) if cap is not None else None
    past = F.collect_list(F.struct(*(fields or _FIELDS))).over(_order("_range").rowsBetween(Window.unboundedPreceding if cap is None else -cap, -1))
    past = _dealt(_with_keys(tx), ranges).withColumn("H", past).where("NOT _ghost").drop("_range", "_ghost")
    if suffix:
        past = past.withColumn("H", F.expr(f"slice(H, greatest(size(H) - greatest({suffix}, 0) + 1, 1), greatest({suffix}, 0))"))
    return past


def _used(names: list[str]) -> tuple[list[dict[str, str]], list[str]]:
    """The arrays of each layer that the named features use, and the fields of past rows that these and the features read."""
    texts, layers = [FEATURES[n] for n in names], []
    for layer in reversed(LAYERS):
        kept = {n: e for n, e in layer.items() if any(re.search(rf"\b{n}\b", t) for t in texts)}
        layers.insert(0, kept)
        texts += kept.values()
    return layers, [f for f in _FIELDS if any(re.search(rf"\.{f}\b", t) for t in texts)] or ["t"]


def array_features(tx: DataFrame, names: list[str] | None = None, cap: int | None = CAP, suffix: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """What ``history_features`` gives, by expressions over the array of the past."""
    layers, fields = _used(list(names or FEATURES))
    out = with_past(tx, cap, suffix, fields)
    for layer in layers:
        out = out.withColumns({name: F.expr(e) for name, e in layer.items()})
    return out.select("event_id", *(keep or []), *[F.expr(FEATURES[n]).cast("double").alias(n) for n in names or FEATURES])


#: Rows of whole customers that a task answers at once, about; a larger customer comes alone.
CHUNK_ROWS = 50_000
_FLAGS = ("ch_known", "dev_known", "rdp", "voip")


def columns_of(table: pa.Table, prefix: str = "_h_") -> Callable[[str], np.ndarray]:
    """The kernel's view of a table: times and amounts as numbers, flags, and codes of all other values."""
    kept: dict[str, np.ndarray] = {}

    def column(name: str) -> np.ndarray:
        if name not in kept:
            values = table.column(prefix + name).combine_chunks()
            if name in ("t", "amt"):
                kept[name] = values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            elif name in _FLAGS:
                kept[name] = values.fill_null(False).to_numpy(zero_copy_only=False)
            else:
                kept[name] = values.dictionary_encode().indices.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return kept[name]

    return column


def opens_segment(table: pa.Table) -> np.ndarray:
    """Whether a row is the first of its customer, or range of a large customer, in a sorted table."""
    codes = table.column("_customer").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    ranges = table.column("_range").to_numpy()
    return np.concatenate((np.ones(min(1, len(codes)), bool), (codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1])))


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole customers of about so many rows."""
    held: list[pa.Table] = []
    count, enough = 0, rows
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count >= enough:
            table = pa.concat_tables(held)
            last = int(np.flatnonzero(opens_segment(table))[-1])
            if last:
                yield table.slice(0, last)
                held, count, enough = [table.slice(last)], count - last, rows
            else:
                held, enough = [table], 2 * count  # so that a long customer is not put together again at each batch
    if count:
        yield pa.concat_tables(held)


def _inputs(names: list[str]) -> list[str]:
    """The fields that the named features read, of the row or its past."""
    layers, _ = _used(names)
    texts = [FEATURES[n] for n in names] + [e for layer in layers for e in layer.values()]
    return [f for f in _FIELDS if any(re.search(rf"\b{f}\b", t) for t in texts)] or ["t"]


def history_features(tx: DataFrame, names: list[str] | None = None, cap: int | None = CAP, suffix: str | None = None, keep: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """event_id (and the columns ``keep``) with the named features (default: all), as doubles; of all rows, or of those that the condition
    ``rows`` holds for (the others are history only). ``suffix`` names a column with each row's own number of newest rows.

    Without a cap a customer's rows are in one task, some hundred bytes each.
    """
    return unpacked(packed_features(tx, names, cap, suffix, keep, rows), names).select("event_id", *(keep or []), *(names or FEATURES))


def unpacked(packed: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named features (default: all) as columns, instead of the array of ``packed_features``."""
    past = [n for n in names or FEATURES if n in kernel.FEATURES]
    return packed.select(*[c for c in packed.columns if c != PACKED], *[F.get(PACKED, F.lit(i)).alias(n) for i, n in enumerate(past)]) if past else packed


#: Column of the features of the past, in the order of the names.
PACKED = "_past"


def packed_features(tx: DataFrame, names: list[str] | None = None, cap: int | None = CAP, suffix: str | None = None, keep: list[str] | None = None, rows: str | None = None) -> DataFrame:
    """What ``history_features`` gives, but for the features that look at the past one array of doubles, which joins copy as a whole."""
    names, kept = list(names or FEATURES), list(keep or [])
    past = [n for n in names if n in kernel.FEATURES]
    keyed = _with_keys(tx)
    if not past:
        chosen = keyed.where(rows) if rows else keyed
        return chosen.select("event_id", *kept, *[F.expr(FEATURES[n]).cast("double").alias(n) for n in names])
    ranges = _ranges(tx.select("customer_id", "phase", "t"), cap) if cap is not None else None
    lengths = F.col(suffix).cast("bigint") if suffix else F.lit(0).cast("bigint")
    inputs = {"_customer": F.col("customer_id").cast("string"), "_wanted": F.coalesce(F.expr(rows), F.lit(False)) & ~F.col("_ghost") if rows else ~F.col("_ghost"), "_length": lengths}
    inputs |= {f"_h_{f}": F.col(f) for f in _inputs(past)}
    dealt = _dealt(keyed, ranges).repartition("customer_id", "_range").sortWithinPartitions("customer_id", "_range", _rank(), "t", F.coalesce("event_id", F.lit(0)))
    shown = ["event_id", *[c for c in kept if c != "event_id"], *[n for n in names if n not in past]]
    own = [F.expr(FEATURES[n]).cast("double").alias(n) for n in names if n not in past]
    inner = dealt.select("event_id", *[c for c in kept if c != "event_id"], *own, "_range", *[c.alias(n) for n, c in inputs.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, CHUNK_ROWS):
            wanted = table.column("_wanted").combine_chunks()
            found = kernel.History(opens_segment(table), columns_of(table), cap, table.column("_length").to_numpy() if suffix else None)
            chosen = wanted.to_numpy(zero_copy_only=False)
            out = {c: table.column(c).filter(wanted) for c in shown}
            values = np.empty((int(chosen.sum()), len(past)))
            for j, name in enumerate(past):
                values[:, j] = np.asarray(kernel.FEATURES[name](found), float)[chosen]
            flat = values.ravel()
            for first in range(0, len(values), 10_000):
                part = {c: column.slice(first, 10_000) for c, column in out.items()}
                some = flat[first * len(past) : (first + 10_000) * len(past)]
                part[PACKED] = pa.ListArray.from_arrays(np.arange(0, len(some) + 1, len(past), dtype=np.int32), pa.array(some, mask=np.isnan(some)))
                yield from pa.table(part).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in inner.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in shown) + f", {PACKED} array<double>"
    return inner.mapInArrow(run, schema)


def recent_by_prefix(tx: DataFrame, seconds: int = DAY) -> DataFrame:
    """Count and sum of amounts of a customer's preceding rows of the last seconds, without arrays: all preceding
    rows less those before the time range. Holds where row order is time order and all times are known."""
    before = _order().rowsBetween(Window.unboundedPreceding, -1)
    older = Window.partitionBy("customer_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -(seconds + 1))
    zero = F.lit(0.0)
    return tx.select(
        "event_id",
        (F.count("amt").over(before) - F.count("amt").over(older)).alias("n_recent"),
        (F.coalesce(F.sum("amt").over(before), zero) - F.coalesce(F.sum("amt").over(older), zero)).alias("sum_recent"),
    )
