"""Registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import audits, axes, history, labels, lookups, metrics, model, sampling, split
from tidemark.plans import history_oracle, jobs, matrix
from tidemark.sources import aggregates, fixtures
from tidemark.sources.fixtures import ORACLE
from tidemark.sources.scratch import new_path, stored
from tidemark.sources.tables import META_COLUMNS, conform, feature_columns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(fixtures.raw_transactions(spark, sf_dir))


def near(c: str, digits: int = 4):
    """Rounded a hair up, so that halves fall alike in either engine; no negative zero."""
    x = F.round(F.col(c).cast("double") + 1e-7, digits)
    return F.when(x == 0, 0.0).otherwise(x).alias(c)


def sql_near(e: str, name: str, digits: int = 4) -> str:
    x = f"round(CAST({e} AS DOUBLE) + 1e-7, {digits})"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE {x} END AS {name}"


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- population statistics

_AXIS_SQL = {
    "mcc": ("CAST(mcc_key AS VARCHAR)", "''"),
    "channel": ("CASE WHEN ch_type IS NULL AND ch_sub IS NULL THEN '__MISSING__' ELSE coalesce(ch_type, '') END", "CASE WHEN ch_type IS NULL AND ch_sub IS NULL THEN '' ELSE coalesce(ch_sub, '') END"),
    "tz_currency": ("coalesce(tz, '__MISSING_TZ__')", "coalesce(ccy, '__MISSING_CCY__')"),
    "event_type_currency": ("coalesce(CAST(et AS VARCHAR), '__MISSING_ET__')", "coalesce(ccy, '__MISSING_CCY__')"),
    "event_descr": ("coalesce(descr, '__MISSING__')", "''"),
    "pos_cd": ("coalesce(pos, '__MISSING__')", "''"),
    "tz_alone": ("coalesce(tz, '__MISSING_TZ_ALONE__')", "''"),
}
_STAT_COLUMNS = ["mean", "std", "q25", "median", "q75", "q90", "q95", "q99", "cv", "label_rate", "woe", "log_frequency"]
_COUNTS = ["cnt", "label_count", "train_count", "cnt_clean"]


def _fit_sql(name: str, k1: str, k2: str) -> str:
    """CTEs f (fitted rows), a (statistics of each key and of the population)."""
    clean = "CASE WHEN NOT labelled THEN amt END"
    sums = f"""avg({clean}) AS mean, stddev_samp({clean}) AS std, {", ".join(f"quantile_cont({clean}, {q}) AS {n}" for n, q in axes.QUANTILES.items())},
  count(*) AS cnt, count(*) FILTER (phase = 'train') AS train_count, count(*) FILTER (labelled) AS label_count, count({clean}) AS cnt_clean"""
    log = "-ln((cnt + 1) / (total + 1))" if name == "event_type_currency" else "NULL"
    return f"""f AS (SELECT *, {k1} AS k1, {k2} AS k2 FROM tx WHERE phase IN ('pretrain', 'train')),
g AS (SELECT k1, k2, {sums} FROM f GROUP BY k1, k2 UNION ALL SELECT '__GLOBAL__' AS k1, '' AS k2, {sums} FROM f),
o AS (SELECT (label_count + 0.5) / (greatest(1, train_count) - label_count + 0.5) AS odds, cnt AS total FROM g WHERE k1 = '__GLOBAL__'),
a AS (SELECT g.*, CASE WHEN abs(mean) > 1e-9 THEN std / mean END AS cv, CASE WHEN train_count > 0 THEN label_count / train_count END AS label_rate,
  ln(((label_count + 0.5) / (greatest(1, train_count - label_count) + 0.5)) / odds) AS woe, {log} AS log_frequency FROM g, o)"""


def _axis_select() -> str:
    return "k1, k2, " + ", ".join(sql_near(n, n) for n in _STAT_COLUMNS) + ", " + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in _COUNTS)


def _axis_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = axes.axis_statistics(transactions(spark, sf_dir), {name: axes.axis_keys()[name]})
        return stats.select("k1", "k2", *map(near, _STAT_COLUMNS), *_COUNTS)

    return run


for _name, (_k1, _k2) in _AXIS_SQL.items():
    register(f"axis_{_name}", f"WITH {ORACLE}, {_fit_sql(_name, _k1, _k2)} SELECT {_axis_select()} FROM a")(_axis_query(_name))

_DOCUMENTS = "tx AS (SELECT 'train' AS phase, CAST(d.n_chars AS DOUBLE) AS amt, lang, source, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))"


@register("axis_documents", f"WITH {_DOCUMENTS}, {_fit_sql('lang', 'lang', 'source')} SELECT {_axis_select()} FROM a")
def axis_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics over documents, whose labels are a table of their own."""
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("amt")).join(marks, "doc_id", "left")
    rows = docs.withColumns({"phase": F.lit("train"), "labelled": F.coalesce("labelled", F.lit(False))})
    return axes.axis_statistics(rows, {"lang": (F.col("lang"), F.col("source"))}).select("k1", "k2", *map(near, _STAT_COLUMNS), *_COUNTS)


@register("population_meta", f"WITH {ORACLE} SELECT count(*) FILTER (phase = 'pretrain') AS total_pretrain_rows, count(*) FILTER (phase = 'train') AS total_train_rows, count(*) FILTER (labelled) AS total_train_rows_with_label FROM tx")
def population_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.population_totals(transactions(spark, sf_dir))


_FIT = f"WITH {ORACLE}, f AS (SELECT mcc_key, {_AXIS_SQL['channel'][0]} AS ch_type, {_AXIS_SQL['channel'][1]} AS ch_sub, coalesce(ccy, '__MISSING_CCY__') AS ccy, coalesce(tz, '__MISSING_TZ_ALONE__') AS tz FROM tx WHERE phase IN ('pretrain', 'train'))"


@register("mcc_totals", f"{_FIT} SELECT mcc_key, count(*) AS n_rows FROM f GROUP BY mcc_key")
def mcc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.mcc_totals(transactions(spark, sf_dir))


def _pair_query(*by: str):
    return lambda spark, sf_dir: axes.cooccurrence(transactions(spark, sf_dir), *by)


for _name, _by in {"mcc_channel_joint": ("ch_type", "ch_sub"), "mcc_currency_joint": ("ccy",), "mcc_tz_joint": ("tz",)}.items():
    register(_name, f"{_FIT} SELECT mcc_key, {', '.join(_by)}, count(*) AS cnt FROM f GROUP BY ALL")(_pair_query(*_by))

_TOP3 = """p AS (SELECT ch_type, ch_sub, mcc_key, count(*) AS cnt FROM f GROUP BY ALL),
  q AS (SELECT *, row_number() OVER (PARTITION BY ch_type, ch_sub ORDER BY cnt DESC, mcc_key) AS r FROM p),
  top AS (SELECT ch_type, ch_sub, """ + ", ".join(f"coalesce(max(mcc_key) FILTER (r = {i}), -2) AS top{i}_mcc" for i in (1, 2, 3)) + ", CAST(sum(cnt) AS BIGINT) AS ch_row_total FROM q GROUP BY ch_type, ch_sub)"


@register("channel_mcc_top3", f"{_FIT}, {_TOP3} SELECT * FROM top")
def channel_mcc_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axes.channel_top3(transactions(spark, sf_dir))


# ---- labels, cohorts


@register("label_join_weights", f"WITH {ORACLE} SELECT event_id, CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END AS target, CAST(CASE WHEN label = 1 THEN 5 WHEN label = 0 THEN 2 ELSE 1 END AS DOUBLE) AS sample_weight FROM tx WHERE phase = 'train'")
def label_join_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).where("phase = 'train'")
    marks = tx.where("label IS NOT NULL").select("event_id", "label")
    return labels.with_target(tx, marks).select("event_id", "target", "sample_weight")


_PRESENCE = {"n_labelled": "event_id % 41 <> 0 AND labelled", "n_unlabelled": "event_id % 41 <> 0 AND NOT labelled", "n_null_id": "event_id % 41 = 0"}


@register("label_presence_audit", f"WITH {ORACLE} SELECT count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _PRESENCE.items())}, {', '.join(sql_near(f'100.0 * count(*) FILTER ({c}) / count(*)', n.replace('n_', 'pct_', 1)) for n, c in _PRESENCE.items())} FROM tx WHERE phase = 'train'")
def label_presence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows have no id; they are counted apart."""
    raw = fixtures.raw_transactions(spark, sf_dir).where("phase = 'train'").withColumn("event_id", F.when(F.col("event_id") % 41 != 0, F.col("event_id")))
    found = labels.presence(conform(raw))
    return found.select("n", *_PRESENCE, *[near(n.replace("n_", "pct_", 1)) for n in _PRESENCE])


@register("label_semi_join", "SELECT count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def label_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("event_id"), "n_chars")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("event_id"))
    return labels.matched_rows(docs, marks).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))


@register("label_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def label_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("event_id"))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("event_id"))
    return labels.unmatched_labels(docs, marks).select(F.col("event_id").alias("doc_id"))


_COHORTS = "c AS (SELECT DISTINCT phase || '_' || CAST(CAST(customer_id AS BIGINT) % 3 AS VARCHAR) AS cohort, customer_id FROM tx WHERE phase <> 'test')"


@register("cohort_overlap", f'WITH {ORACLE}, {_COHORTS}, n AS (SELECT DISTINCT cohort FROM c) SELECT a.cohort AS "left", b.cohort AS "right", (SELECT count(*) FROM c x JOIN c y USING (customer_id) WHERE x.cohort = a.cohort AND y.cohort = b.cohort) AS n_shared FROM n a, n b WHERE a.cohort < b.cohort')
def cohort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    third = F.col("customer_id").cast("bigint") % 3
    return labels.cohort_overlap(tx, {f"{p}_{k}": (F.col("phase") == p) & (third == k) for p in ("pretrain", "train") for k in range(3)})


_SHARES = 'SELECT a.cohort AS "left", b.cohort AS "right", count(*) AS n_shared, list(a.customer_id ORDER BY a.customer_id)[:15] AS ids FROM c a JOIN c b USING (customer_id) WHERE a.cohort < b.cohort GROUP BY ALL'


@register("cohort_overlap_samples", f"""WITH {ORACLE}, c AS (SELECT DISTINCT phase || '_' || CAST(k AS VARCHAR) AS cohort, customer_id FROM tx, (SELECT unnest([2, 3]) AS k) WHERE phase <> 'test' AND CAST(customer_id AS BIGINT) % k = 0),
n AS (SELECT DISTINCT cohort FROM c), s AS ({_SHARES})
SELECT a.cohort AS "left", b.cohort AS "right", coalesce(s.n_shared, 0) AS n_shared, coalesce(array_to_string(s.ids, ','), '') AS sample_ids FROM n a JOIN n b ON a.cohort < b.cohort LEFT JOIN s ON s."left" = a.cohort AND s."right" = b.cohort""")
def cohort_overlap_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 least customers that each two overlapping cohorts share: a report of samples."""
    number = F.col("customer_id").cast("bigint")
    found = labels.cohort_overlap(transactions(spark, sf_dir), {f"{p}_{k}": (F.col("phase") == p) & (number % k == 0) for p in ("pretrain", "train") for k in (2, 3)}, samples=15)
    return found.select("left", "right", "n_shared", F.array_join("sample_ids", ",").alias("sample_ids"))


@register("customer_sets", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS n_both, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS n_only_first, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS n_only_second")
def customer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("customer_id"))
    return labels.id_sets(a, spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("customer_id")))


# ---- history features

_NAMES = list(history_oracle.SQL)
FAMILIES = {
    "hist_row": ["operation_amt", "phone_voip_call_state", "hour", "day_of_week", "is_night_transaction", "is_weekend", "timezone_missing", "battery_level", "developer_tools_flag", "accept_lang_browser_lang_mismatch"],
    "hist_amount": ["log_1_plus_transactions_seen", "amount_zscore", "trend_mean_last_3_to_10", "amount_percentile_rank", "amount_ratio_to_window_median", "amount_iqr_normalized", "amount_cv_in_window", "mean_amount_last_3_transactions"],
    "hist_time": ["transactions_last_24h", "sum_amount_last_1h", "max_amount_last_24h", "sum_amount_last_24h", "high_amount_ratio_last_24h", "transactions_last_1h", "amount_ratio_to_min_amount_24h", "web_rdp_count_last_24h", "voip_flag_count_last_24h", "distinct_hours_active_last_24h", "weekend_transaction_share_last_7d", "distinct_event_descr_count_last_24h_norm"],
    "hist_key_frequency": [n for n in _NAMES if "_freq_last_" in n] + ["mcc_event_descr_pair_new", "amount_relative_to_mcc_median_5_days", "mcc_amount_std_same_5d"],
    "hist_novelty": ["is_new_device", "is_new_mcc", "is_new_channel", "is_new_session_id", "is_device_switch", "is_mcc_switch", "amount_diff_prev", "amount_ratio_prev", "time_since_prev_transaction", "time_since_last_device_change", "time_since_last_mcc_change"],
    "hist_distinct": ["unique_mcc_count_suffix", "unique_device_key_count_suffix", "unique_channel_key_count_suffix", "unique_timezone_count_suffix", "device_freq", "channel_relative_freq", "timezone_relative_freq", "browser_language_relative_freq", "event_type_nm_share_in_suffix"],
    "hist_switches": [n for n in _NAMES if "switch_count" in n],
    "hist_deltas": ["std_time_deltas", "delta_1", "delta_2", "acceleration_delta_1_over_2", "std_delta_last_k", "mean_gap_seconds_last_5_intervals", "suffix_time_span_hours_log1p", "transactions_per_span_hour"],
    "hist_streaks": ["mcc_consecutive_streak_length", "amount_increase_streak_suffix", "amount_decrease_streak_suffix"],
    "hist_session": ["session_mean_amount", "seconds_since_session_start_in_window"],
}
FAMILIES["hist_same_mcc"] = [n for n in _NAMES if n not in {x for f in FAMILIES.values() for x in f}]


def _history_query(names: list[str], cap: int):
    return lambda spark, sf_dir: history.history_features(transactions(spark, sf_dir), names, cap=cap).select("event_id", *map(near, names))


for _name, _features in FAMILIES.items():
    register(_name, history_oracle.query(_features))(_history_query(_features, 512))
register("hist_cap16", history_oracle.query(_NAMES, 16))(_history_query(_NAMES, 16))


@register("hist_prefix_difference_24h", history_oracle.pairs() + f"\nSELECT event_id, CAST(coalesce(c24, 0) AS BIGINT) AS n_recent, {sql_near('coalesce(s24, 0)', 'sum_recent')} FROM z")
def hist_prefix_difference_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_by_prefix(transactions(spark, sf_dir)).select("event_id", "n_recent", near("sum_recent"))


_ORDERS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS t FROM orders)
SELECT r.o_orderkey AS event_id, count(h.rn) AS n_past, count(h.rn) FILTER (h.t >= r.t - 604800) AS n_week, round(coalesce(sum(h.o_totalprice) FILTER (h.t >= r.t - 604800), 0) + 1e-7, 2) AS sum_week
FROM r LEFT JOIN r AS h ON r.o_custkey = h.o_custkey AND h.rn < r.rn AND h.rn >= r.rn - 512 GROUP BY r.o_orderkey, r.rn, r.o_custkey"""


@register("orders_history", _ORDERS)
def orders_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History over orders, whose dates tie within a customer."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.lit(None).cast("string")
    tx = o.select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderkey").alias("event_id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("t"), F.col("o_totalprice").alias("amt"), F.lit("train").alias("phase"), *[none.alias(c) for c in ("mcc", "descr", "os", "ver", "ch_type", "ch_sub", "tz", "bl", "sess", "dev_tools")], F.lit(None).cast("double").alias("et"), F.lit(False).alias("rdp"), F.lit(False).alias("voip"))
    past = history.with_past(tx).withColumn("week", F.expr("filter(H, x -> x.t >= t - 604800)"))
    return past.select("event_id", F.expr("cast(size(H) AS bigint)").alias("n_past"), F.expr("cast(size(week) AS bigint)").alias("n_week"), F.round(F.expr(history.total(history.amounts("week"))) + 1e-7, 2).alias("sum_week"))


# ---- population features


def _block_sql(axis: str) -> list[tuple[str, str]]:
    """Name and SQL of an axis's features over amt and the statistics s_*."""
    z = lambda c: f"CASE WHEN s_std > 1e-9 THEN (amt - {c}) / s_std END"
    first = [("global_mean_amount", "mean"), ("global_std_amount", "std"), ("global_median_amount", "median"), ("global_q25", "q25"), ("global_q75", "q75"), ("global_q95", "q95"), ("global_cnt", "cnt"), ("global_cv", "cv"), ("fraud_rate", "label_rate"), ("fraud_count", "label_count"), ("train_total_count", "train_count"), ("woe", "woe")]
    rest = {
        "ratio": (f"amount_ratio_global_mean_{axis}", "CASE WHEN abs(s_mean) > 1e-9 THEN amt / s_mean END"), "z": (f"global_zscore_{axis}", z("s_mean")), "inv": (f"inv_global_cnt_{axis}", "1.0 / (s_cnt + 1)"),
        "clean": (f"global_cnt_clean_{axis}", "s_cnt_clean"), "q90": (f"global_q90_{axis}", "s_q90"), "q99": (f"global_q99_{axis}", "s_q99"),
        "robust": (f"global_zscore_median_iqr_{axis}", "CASE WHEN (s_q75 - s_q25) / 1.35 > 1e-9 THEN (amt - s_median) / ((s_q75 - s_q25) / 1.35) ELSE (amt - s_median) / 1e-9 END"),
        "position": (f"amount_percentile_in_{axis}", "CASE WHEN amt IS NOT NULL AND s_q25 IS NOT NULL THEN greatest(0, least(1, (amt - s_q25) / greatest(abs(s_q75 - s_q25), 1e-9))) END"),
        "median_z": (f"amount_z_vs_{lookups.MEDIAN_NAME.get(axis, axis)}_median", z("s_median")), "log_frequency": (f"global_type_frequency_log_{axis}", "s_log_frequency"),
    }
    return [(f"{n}_{axis}", f"s_{c}") for n, c in first] + [rest[k] for k in lookups.LAYOUT[axis]]


def _lookup_sql(axis: str) -> str:
    k1, k2 = _AXIS_SQL[axis]
    stats = ", ".join(f"coalesce(CASE WHEN own.k1 IS NOT NULL THEN own.{n} ELSE pop.{n} END, NULL) AS s_{n}" for n in [*axes.STATS, "log_frequency"])
    return f"""WITH {ORACLE}, {_fit_sql(axis, k1, k2)}, w AS (SELECT *, {k1} AS k1, {k2} AS k2 FROM tx),
  j AS (SELECT w.event_id, w.amt, {stats} FROM w LEFT JOIN a AS own ON w.k1 = own.k1 AND w.k2 = own.k2 CROSS JOIN (SELECT * FROM a WHERE k1 = '__GLOBAL__') AS pop)
SELECT event_id, {", ".join(sql_near(e, n) for n, e in _block_sql(axis))} FROM j"""


def _lookup_query(axis: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tx = transactions(spark, sf_dir)
        stats = stored(axes.axis_statistics(tx, {axis: axes.axis_keys()[axis]}))
        return lookups.with_axis(tx, stats, axis).select("event_id", *map(near, lookups.block_names(axis)))

    return run


for _name in lookups.LAYOUT:
    register(f"global_lookup_{_name}", _lookup_sql(_name))(_lookup_query(_name))

_NEGLOG = "-ln(({num} + 0.5) / ({den} + 0.5))"


@register(
    "global_joint_features",
    f"""{_FIT}, {_TOP3}, w AS (SELECT event_id, mcc_key, {_AXIS_SQL['channel'][0]} AS ch_type, {_AXIS_SQL['channel'][1]} AS ch_sub, coalesce(ccy, '__MISSING_CCY__') AS ccy, coalesce(tz, '__MISSING_TZ_ALONE__') AS tz FROM tx),
  mt AS (SELECT mcc_key, count(*) AS c FROM f GROUP BY ALL), mc AS (SELECT mcc_key, ccy, count(*) AS c FROM f GROUP BY ALL), mz AS (SELECT mcc_key, tz, count(*) AS c FROM f GROUP BY ALL),
  j AS (SELECT w.*, coalesce(mt.c, 0) AS total, coalesce(p.cnt, 0) AS n_ch, coalesce(mc.c, 0) AS n_ccy, coalesce(mz.c, 0) AS n_tz, top1_mcc, top2_mcc, top3_mcc, coalesce(ch_row_total, 0) AS ch_total
    FROM w LEFT JOIN mt USING (mcc_key) LEFT JOIN p USING (mcc_key, ch_type, ch_sub) LEFT JOIN mc USING (mcc_key, ccy) LEFT JOIN mz USING (mcc_key, tz) LEFT JOIN top USING (ch_type, ch_sub))
SELECT event_id, {sql_near(_NEGLOG.format(num='n_ch', den='total'), lookups.JOINT[0])}, {sql_near('CASE WHEN total > 0 THEN n_ccy / total END', lookups.JOINT[1])}, {sql_near('CASE WHEN total > 0 THEN n_tz / total END', lookups.JOINT[2])},
  {sql_near(_NEGLOG.format(num='n_ch', den='ch_total'), lookups.JOINT[3])}, {sql_near('CASE WHEN top1_mcc IS NOT NULL THEN CASE WHEN mcc_key IN (top1_mcc, top2_mcc, top3_mcc) THEN 0 ELSE 1 END END', lookups.JOINT[4])} FROM j""",
)
def global_joint_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return lookups.with_joint(tx, lookups.stored_counts(tx)).select("event_id", *map(near, lookups.JOINT))


_POPULATION = "SELECT * FROM " + " JOIN ".join(f"({ORACLES[q]})" + ("" if i == 0 else " USING (event_id)") for i, q in enumerate([*[f"global_lookup_{a}" for a in lookups.LAYOUT], "global_joint_features"]))


def _stored_aggregates(tx: DataFrame) -> aggregates.Aggregates:
    root = new_path(tx.sparkSession)
    aggregates.write(tx, root)
    return aggregates.read(tx.sparkSession, root)


@register("population_features", _POPULATION)
def population_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 146 features, from aggregate tables that are written, read back and checked."""
    tx = transactions(spark, sf_dir)
    return lookups.population_features(tx, _stored_aggregates(tx)).select("event_id", *map(near, lookups.feature_names()))


_ZERO_PARITY = "SELECT column_name, n AS n_compared, CAST(0 AS BIGINT) AS n_different FROM (SELECT unnest([{names}]) AS column_name), (SELECT count(*) AS n FROM tx)"


@register("population_parity", f"WITH {ORACLE} " + _ZERO_PARITY.format(names=", ".join(f"'{n}'" for n in lookups.feature_names())))
def population_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 146 features from stored tables against those from tables as they are computed, row by row: no difference is allowed."""
    tx = transactions(spark, sf_dir)
    return audits.parity(lookups.population_features(tx, _stored_aggregates(tx)), lookups.population_features(tx, lookups.stored_once(tx)), lookups.feature_names())


# ---- sampling, split, metrics, scalars

_CDF = "h AS (SELECT least(count(*), 512) AS length FROM tx WHERE phase <> 'test' AND CAST(customer_id AS BIGINT) % 3 = 0 GROUP BY customer_id), d AS (SELECT length, count(*) AS n FROM h GROUP BY length), cdf AS (SELECT length, n, sum(n) OVER (ORDER BY length) / sum(n) OVER () AS cdf FROM d)"


def _past_of_thirds(tx: DataFrame) -> DataFrame:
    return tx.where((F.col("phase") != "test") & (F.col("customer_id").cast("bigint") % 3 == 0))


@register("window_length_cdf", f"WITH {ORACLE}, {_CDF} SELECT CAST(length AS BIGINT) AS length, n, {sql_near('cdf', 'cdf', 6)} FROM cdf")
def window_length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.length_distribution(_past_of_thirds(transactions(spark, sf_dir))).select(F.col("length").cast("bigint").alias("length"), "n", near("cdf", 6))


def _mix_sql(z: str) -> str:
    """The 64-bit mixer over UHUGEINT, as a chain of let-like lambdas on one-element lists."""
    mask = "18446744073709551615::UHUGEINT"
    step = f"list_transform([({z} + 11400714819323198485::UHUGEINT) & {mask}], lambda a: (xor(a, a >> 30) * 13787848793156543929::UHUGEINT) & {mask})"
    step = f"list_transform({step}, lambda b: (xor(b, b >> 27) * 10723151780598845931::UHUGEINT) & {mask})"
    return f"list_transform({step}, lambda c: xor(c, c >> 31))[1]"


_DRAW = (
    f"e0 AS (SELECT event_id, customer_id, {_mix_sql('event_id::UHUGEINT')} AS h FROM tx),\n"
    + ",\n".join(f"e{i} AS (SELECT event_id, customer_id, CASE WHEN length(customer_id) >= {i} THEN " + _mix_sql(f"xor(h, (ascii(substr(customer_id, {i}, 1)) + 1099511628211)::UHUGEINT)") + f" ELSE h END AS h FROM e{i - 1})" for i in range(1, 9))
    + ",\nu AS (SELECT event_id, (" + _mix_sql(f"xor(h, {int(sampling._DRAW)}::UHUGEINT)") + " & 9007199254740991::UHUGEINT)::DOUBLE / 9007199254740991 AS u FROM e8)"
)


_LENGTH = "CAST(coalesce((SELECT min(length) FROM cdf WHERE cdf.cdf >= u.u), (SELECT max(length) FROM cdf)) AS BIGINT) AS length"


@register("window_length_sample", f"WITH {ORACLE}, {_CDF}, {_DRAW} SELECT event_id, round(u, 9) AS u, {_LENGTH} FROM u")
def window_length_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return sampling.sampled_lengths(tx, sampling.length_distribution(_past_of_thirds(tx))).select("event_id", F.round("u", 9).alias("u"), "length")


_CUT = "days AS (SELECT CAST(to_timestamp(t) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM tx WHERE t IS NOT NULL GROUP BY 1), run AS (SELECT day, sum(n) OVER (ORDER BY day DESC) AS covered, sum(n) OVER () AS n_total FROM days), cut AS (SELECT max(day) AS cutoff_day, CAST(min(covered) AS BIGINT) AS n_validation, CAST(max(n_total) AS BIGINT) AS n_total FROM run WHERE covered >= greatest(1, floor(n_total * 0.15)))"


@register("time_cutoff", f"WITH {ORACLE}, {_CUT} SELECT CAST(cutoff_day AS VARCHAR) AS cutoff_day, n_validation, n_total FROM cut")
def time_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.cutoff(transactions(spark, sf_dir)).withColumn("cutoff_day", F.col("cutoff_day").cast("string"))


@register("split_counts", f"WITH {ORACLE}, {_CUT} SELECT NOT (t < epoch(cutoff_day)) AS validation, count(*) AS n, round(sum(amt), 2) AS amount FROM tx, cut GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.with_split(transactions(spark, sf_dir)).groupBy("validation").agg(F.count("*").alias("n"), F.round(F.sum("amt"), 2).alias("amount"))


_AP_ROWS = "s AS (SELECT (event_id * 7919) % 1009 AS score, event_id % 11 = 0 AS hit, 1.0 + event_id % 3 AS w FROM tx)"


@register("average_precision_weighted", f"WITH {ORACLE}, {_AP_ROWS}, g AS (SELECT score, sum(CASE WHEN hit THEN w ELSE 0 END) AS p, sum(w) AS a, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, n, sum(p) OVER (ORDER BY score DESC) / sum(a) OVER (ORDER BY score DESC) AS precision, sum(p) OVER () AS all_p FROM g) SELECT round(sum(p / all_p * precision), 8) AS average_precision, CAST(sum(n) AS BIGINT) AS n, CAST(max(all_p) AS DOUBLE) AS positive_weight FROM c")
def average_precision_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir).select(((F.col("event_id") * 7919) % 1009).cast("double").alias("score"), (F.col("event_id") % 11 == 0).cast("int").alias("target"), (1.0 + F.col("event_id") % 3).alias("w"))
    return metrics.average_precision(tx, weight="w").select(F.round("average_precision", 8).alias("average_precision"), "n", "positive_weight")


@register("weight_remap", "SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 5 THEN 10 WHEN 2 THEN 5 ELSE l_linenumber END AS DOUBLE) AS w FROM lineitem")
def weight_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", S.remap_weight(F.col("l_linenumber").cast("double")).alias("w"))


@register("proba_to_logit", "SELECT l_orderkey, l_linenumber, round(ln(p / (1 - p)) + 1e-7, 4) AS predict FROM (SELECT l_orderkey, l_linenumber, greatest(1e-15, least(1 - 1e-15, l_discount * 10)) AS p FROM lineitem)")
def proba_to_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", S.logit(F.col("l_discount") * 10).alias("predict")).select("l_orderkey", "l_linenumber", near("predict"))


# ---- parsers and formulas on odd values

#: Odd spellings of each event's numbers and times, in SQL that either engine runs.
_ODD = """
SELECT event_id, user_id, value, {seconds} AS sec, 'l' || CAST(user_id % 3 AS STRING) AS bl, CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE ' l' || CAST(event_id % 3 AS STRING) || ' ' END AS al,
  CASE event_id % 9 WHEN 0 THEN ' ' || CAST(user_id AS STRING) WHEN 1 THEN CAST(user_id AS STRING) || 'abc' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN CAST(user_id AS STRING) || '.5e1'
    WHEN 5 THEN '-' || CAST(user_id AS STRING) || '.25 ' WHEN 6 THEN CAST(user_id AS STRING) || '.0' WHEN 7 THEN '-2' ELSE NULL END AS number,
  CASE event_id % 5 WHEN 0 THEN ' 2024-01-' || CAST(10 + event_id % 19 AS STRING) || ' 03:04:05.75' WHEN 1 THEN '2024-02-' || CAST(10 + event_id % 19 AS STRING) || ' 23:59:59' WHEN 2 THEN 'soon' WHEN 3 THEN '' ELSE NULL END AS moment,
  CASE event_id % 7 WHEN 0 THEN 0.6 WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 WHEN 3 THEN NULL ELSE CAST(event_id % 2 AS DOUBLE) END AS mark, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(5 AS DOUBLE) END AS weight
FROM {events}
"""
_NUMBER_SQL = r"try_cast(nullif(regexp_extract(trim(number, ' \t'), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'), '') AS DOUBLE)"
_WHOLE_MARK = "CASE WHEN mark IS NULL THEN 0 ELSE CAST(round_even(mark, 0) AS INT) END"


@register(
    "scalar_formulas",
    f"""WITH o AS ({_ODD.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)", events="events")}), n AS (SELECT *, {_NUMBER_SQL} AS x, {_WHOLE_MARK} AS whole FROM o)
SELECT event_id, {sql_near('x', 'number')}, CASE WHEN x IS NULL OR x <> round(x) OR x = -2 THEN -2 ELSE CAST(x AS BIGINT) END AS mcc_key,
  CAST(epoch(try_strptime(substr(trim(moment, ' \t'), 1, 19), '%Y-%m-%d %H:%M:%S')) AS BIGINT) AS seconds, CAST(sec % 86400 // 3600 AS INT) AS hour, CAST((sec // 86400 + 3) % 7 AS INT) AS weekday,
  CASE WHEN coalesce(trim(al), '') = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS has_language, CASE WHEN coalesce(trim(al), '') <> '' AND trim(al) <> bl THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mismatch,
  {sql_near('CASE WHEN abs(value - 50) <= 1e-9 THEN 1e-9 ELSE value - 50 END', 'denominator')},
  CASE WHEN whole = 1 AND weight = 2 THEN 0 ELSE whole END AS target, coalesce(weight, 1) AS weight FROM n""",
)
def scalar_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.sql(_ODD.format(seconds="unix_seconds(CAST(ts AS TIMESTAMP))", events="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    target, weight = S.finalise_target(F.col("mark"), F.col("weight"), demote=True)
    return o.select(
        "event_id", S.parse_double(F.col("number")).alias("number"), S.mcc_key(F.col("number")).alias("mcc_key"), S.parse_seconds(F.col("moment"), "string").alias("seconds"),
        S.hour_of(F.col("sec")).alias("hour"), S.weekday_of(F.col("sec")).alias("weekday"), S.non_empty_flag(F.col("al")).alias("has_language"), S.language_mismatch(F.col("al"), F.col("bl")).alias("mismatch"),
        S.safe_denominator(F.col("value") - 50).alias("denominator"), target.alias("target"), weight.alias("weight"),
    ).select("event_id", near("number"), "mcc_key", "seconds", "hour", "weekday", "has_language", "mismatch", near("denominator"), "target", "weight")


# ---- audits


_SEEN = "SELECT ln(1 + least(512, row_number() OVER (PARTITION BY customer_id ORDER BY CASE phase WHEN 'pretrain' THEN 0 WHEN 'train' THEN 1 ELSE 3 END, t, event_id) - 1)) AS v FROM tx"


@register("decile_profile", f"WITH {ORACLE} SELECT CAST(decile AS INT) AS decile, {sql_near('v', 'value')} FROM (SELECT unnest(range(11)) AS decile, unnest(quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS v FROM ({_SEEN}))")
def decile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the log history length."""
    rows = history.history_features(transactions(spark, sf_dir), ["log_1_plus_transactions_seen"])
    return audits.decile_profile(rows, "log_1_plus_transactions_seen").select("decile", near("value"))


def _profile_sql(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct, {e.format('min')} AS least, {e.format('max')} AS largest FROM orders" for c, e in columns.items())


_NUMBER, _TEXT, _TIME = "CAST({{}}({c}) AS DOUBLE)", "CAST({{}}(length({c})) AS DOUBLE)", "CAST(NULL AS DOUBLE)"


@register("quality_profile", _profile_sql({"o_orderkey": _NUMBER.format(c="o_orderkey"), "o_custkey": _NUMBER.format(c="o_custkey"), "o_orderstatus": _TEXT.format(c="o_orderstatus"), "o_totalprice": _NUMBER.format(c="o_totalprice"), "o_orderdate": _TIME, "o_orderpriority": _TEXT.format(c="o_orderpriority")}))
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.column_profile(spark.read.parquet(f"{sf_dir}/orders.parquet"))


@register("duplicate_ids", "SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_distinct, count(*) FILTER (c > 1) AS n_repeated FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicate_ids(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.struct("l_orderkey", "l_linenumber").alias("event_id")))


@register("sentinel_counts", f"WITH {ORACLE} SELECT 'mcc_key' AS column_name, count(*) FILTER (mcc_key = -2) AS n_reserved FROM tx")
def sentinel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.sentinels(transactions(spark, sf_dir), {"mcc_key": S.MCC_MISSING})


@register("schema_listing", "SELECT CAST(position AS INT) AS position, name, type, rows FROM (SELECT unnest([0, 1, 2, 3]) AS position, unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS name, unnest(['bigint', 'string', 'double', 'string']) AS type), (SELECT count(*) AS rows FROM customer)")
def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.schema_listing(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment"))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return matrix.training_matrix(tx, sampling.length_distribution(_past_of_thirds(tx)))


_FEATURES = [*history.FEATURES, *lookups.feature_names()]
_META = [c for c in META_COLUMNS if c not in ("customer_id", "event_id", "target", "sample_weight", "event_dttm")]
_MATRIX_SQL = (
    history_oracle.pairs("r.length", f" {_CDF}, {_DRAW}, lens AS (SELECT event_id, {_LENGTH} FROM u),", "(SELECT tx.*, lens.length FROM tx JOIN lens USING (event_id)) AS tx")
    + f""", past AS (SELECT event_id, {history_oracle.selected(list(history.FEATURES))}, {", ".join(f"{matrix.META[c]} AS {c}" for c in _META)}, customer_id,
  CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END AS target, CAST(CASE WHEN label = 1 THEN 5 WHEN label = 0 THEN 2 ELSE 1 END AS DOUBLE) AS sample_weight, t FROM z WHERE phase = 'train')
SELECT * FROM past JOIN ({_POPULATION}) AS population USING (event_id)"""
)


@register("training_matrix", _MATRIX_SQL)
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 244 features of every train row, each with its drawn history length, and the meta columns."""
    return _matrix(spark, sf_dir).select(*map(near, _FEATURES), *[c for c in META_COLUMNS if c != "event_dttm"], "t")


# ---- scoring

#: Rows of pretest without an id have one below all others here, so that pairs of rows can be told apart; test rows without one are left out.
_LATER = """ px0 AS (SELECT * REPLACE (CASE WHEN t < 1706486400 THEN 'pretest' ELSE 'test' END AS phase) FROM tx WHERE phase = 'test'),
px AS (SELECT * REPLACE (CASE WHEN event_id % 43 = 0 THEN -event_id ELSE event_id END AS event_id) FROM px0 WHERE phase = 'pretest' OR event_id % 43 <> 0),"""


def _scored_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture with its last phase cut into pretest and test; some rows of either have no id."""
    raw = fixtures.raw_transactions(spark, sf_dir)
    later = F.col("phase") == "test"
    raw = raw.withColumn("event_id", F.when(~later | (F.col("event_id") % 43 != 0), F.col("event_id")))
    return conform(raw.withColumn("phase", F.when(later & (F.unix_seconds(F.col("event_dttm")) < 1706486400), "pretest").otherwise(F.col("phase"))))


@register("scoring_features", history_oracle.pairs(10**9, _LATER, "px AS tx") + f"\nSELECT * FROM (SELECT event_id, {history_oracle.selected(list(history.FEATURES))} FROM z WHERE phase = 'test') JOIN ({_POPULATION}) AS population USING (event_id)")
def scoring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 244 features of the test rows: histories come from pretest and are unlimited, aggregates from stored tables."""
    tx = _scored_transactions(spark, sf_dir)
    return matrix.scoring_rows(tx, _stored_aggregates(tx)).select("event_id", *map(near, _FEATURES))


_SMOKE = ["amount_zscore", "delta_1", "trend_mean_last_3_to_10", "battery_level", "operation_amt", "sum_amount_last_24h", "hour"]
_SMOKE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, {sql_near(f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_share')}, count(*) FILTER (isinf({n})) AS n_infinite, count(*) FILTER (abs({n}) > 1e7) AS n_suspicious, "
    f"count(*) FILTER (isinf({n})) = 0 AND ({'true' if n == 'battery_level' else f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END) < 0.99'}) AS ok FROM f"
    for n in _SMOKE
)


@register("quality_smoke", history_oracle.pairs() + ", f AS (SELECT " + ", ".join(f"CAST({history_oracle.SQL[n]} AS DOUBLE) AS {n}" for n in _SMOKE) + f" FROM z) {_SMOKE_SQL}")
def quality_smoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.feature_health(history.history_features(transactions(spark, sf_dir), _SMOKE), _SMOKE)
    return found.select("column_name", near("missing_share"), "n_infinite", "n_suspicious", "ok")


@register("matrix_audit", f"WITH {ORACLE} SELECT 'training matrix' AS name, 0 AS n_missing_columns, count(*) AS n, {sql_near('avg(CASE WHEN t IS NULL THEN 1.0 ELSE 0.0 END)', 'null_time_share')}, count(*) - count(DISTINCT event_id) AS n_repeated_ids, true AS ok FROM tx WHERE phase = 'train'")
def matrix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.matrix_health(_matrix(spark, sf_dir).drop("t"), _FEATURES).select("name", "n_missing_columns", "n", near("null_time_share"), "n_repeated_ids", "ok")


@register("output_examples", f"WITH {ORACLE} SELECT event_id, customer_id, mcc AS mcc_code, amt AS operation_amt FROM tx WHERE phase = 'train' ORDER BY event_id LIMIT 3")
def output_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows: a report of examples."""
    tx = transactions(spark, sf_dir).where("phase = 'train'").withColumnsRenamed({"mcc": "mcc_code", "amt": "operation_amt"})
    return audits.examples(tx, ["event_id", "customer_id", "mcc_code", "operation_amt"])


@register("recipe_parity", f"WITH {ORACLE} " + _ZERO_PARITY.format(names="'transactions_last_24h', 'sum_amount_last_24h'"))
def recipe_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array frames against prefix differences, row by row: no difference is allowed."""
    tx = transactions(spark, sf_dir)
    arrays = history.history_features(tx, ["transactions_last_24h", "sum_amount_last_24h"])
    prefix = history.recent_by_prefix(tx).select("event_id", F.col("n_recent").alias("transactions_last_24h"), F.col("sum_recent").alias("sum_amount_last_24h"))
    return audits.parity(arrays, prefix, ["transactions_last_24h", "sum_amount_last_24h"])


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix with its split. The days are counted in the train rows themselves, else all histories would be computed for that too."""
    return stored(split.with_split(_matrix(spark, sf_dir), of=transactions(spark, sf_dir).where("phase = 'train'")))


@register("gbt_scores")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    fitted = model.train(rows, feature_columns(rows.drop("t", "validation")))
    return model.scored(fitted, rows.where("validation"), _FEATURES).select("event_id", "target", "sample_weight", "score", "predict")


@register("permutation_importance")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    fitted = model.train(rows, _FEATURES)
    return model.permutation_importance(fitted, sampling.within_budget(rows.where("validation"), len(_FEATURES)), _FEATURES, repeats=5)


@register("scoring")
def scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: aggregates, matrix and model are stored, read back, and the test rows scored."""
    found = jobs.run(spark, jobs.Paths(new_path(spark)), _scored_transactions(spark, sf_dir))
    return found.select("event_id", "predict")
