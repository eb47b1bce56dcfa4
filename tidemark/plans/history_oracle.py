"""DuckDB SQL for the history features, written over pairs of a row and each row of its past."""

from __future__ import annotations

from tidemark.sources.fixtures import ORACLE


def pairs(cap: int | str = 512, before: str = "", rows: str = "tx") -> str:
    """CTEs: r (rows in order), p (row and past row, h_*), agg (one row a row, with every feature). ``before`` has CTEs that ``rows`` needs; ``cap`` may be a column of r."""
    return f"""WITH {ORACLE},{before}
r AS (SELECT *, coalesce(os, '') || '|' || coalesce(ver, '') AS dev, os IS NOT NULL OR ver IS NOT NULL AS dev_known,
    coalesce(ch_type, '') || '|' || coalesce(ch_sub, '') AS ch, ch_type IS NOT NULL OR ch_sub IS NOT NULL AS ch_known,
    (t % 86400) // 3600 AS hr, (t // 86400 + 3) % 7 AS wd,
    row_number() OVER (PARTITION BY customer_id ORDER BY CASE phase WHEN 'pretrain' THEN 0 WHEN 'train' THEN 1 ELSE 3 END, t, event_id) AS rn FROM {rows}),
p0 AS (SELECT r.*, h.rn AS h_rn, h.t AS h_t, h.amt AS h_amt, h.mcc AS h_mcc, h.descr AS h_descr, h.et AS h_et, h.ch AS h_ch, h.ch_known AS h_chk,
    h.dev AS h_dev, h.dev_known AS h_devk, h.tz AS h_tz, h.bl AS h_bl, h.sess AS h_sess, h.rdp AS h_rdp, h.voip AS h_voip, h.hr AS h_hr, h.wd AS h_wd,
    r.rn - h.rn AS back, h.t >= r.t - 3600 AS w1, h.t >= r.t - 21600 AS w6, h.t >= r.t - 86400 AS w24, h.t >= r.t - 432000 AS w5, h.t >= r.t - 604800 AS w7,
    h.mcc = r.mcc AS m FROM r JOIN r AS h ON r.customer_id = h.customer_id AND h.rn < r.rn AND h.rn >= r.rn - {cap}),
p AS (SELECT *, lag(h_rn) OVER o AS l_rn, lag(h_mcc) OVER o AS l_mcc, lag(h_dev) OVER o AS l_dev, lag(h_ch) OVER o AS l_ch, lag(h_sess) OVER o AS l_sess,
    h_t - lag(h_t) OVER o AS d, row_number() OVER (PARTITION BY event_id, h_amt IS NULL ORDER BY h_rn DESC) AS ar,
    lag(h_amt) OVER (PARTITION BY event_id, h_amt IS NULL ORDER BY h_rn) AS l_amt,
    max(CASE WHEN m THEN 0 ELSE h_rn END) OVER (PARTITION BY event_id) AS last_other
  FROM p0 WINDOW o AS (PARTITION BY event_id ORDER BY h_rn)),
p2 AS (SELECT *, max(CASE WHEN h_amt IS NOT NULL AND NOT coalesce(h_amt > l_amt, false) THEN h_rn END) OVER (PARTITION BY event_id) AS no_up,
    max(CASE WHEN h_amt IS NOT NULL AND NOT coalesce(h_amt < l_amt, false) THEN h_rn END) OVER (PARTITION BY event_id) AS no_down,
    quantile_disc(h_amt, 0.0) OVER (PARTITION BY event_id) AS unused,
    (list_sort(list(h_amt) FILTER (h_amt IS NOT NULL) OVER (PARTITION BY event_id))) AS srt FROM p),
agg AS (SELECT event_id,
  count(*) AS n, avg(h_amt) AS mean_a, stddev_samp(h_amt) AS std_a, median(h_amt) AS med_a, count(h_amt) AS n_a, sum(h_amt) AS sum_a,
  count(h_amt) FILTER (w24) AS c24, count(h_amt) FILTER (w1) AS c1, coalesce(sum(h_amt) FILTER (w1), 0) AS s1, coalesce(sum(h_amt) FILTER (w24), 0) AS s24,
  max(h_amt) FILTER (w24) AS max24, min(h_amt) FILTER (w24) AS min24, count(*) FILTER (h_amt <= amt) AS n_le, any_value(srt) AS srt,
  count(*) FILTER (w24 AND h_amt > srt[CAST(floor(0.95 * (len(srt) - 1)) AS BIGINT) + 1]) AS n_high,
  avg(h_amt) FILTER (ar <= 3) AS mean3, avg(h_amt) FILTER (ar <= 10) AS mean10, max(h_t) FILTER (back = 1) AS prev_t, max(h_amt) FILTER (back = 1) AS prev_amt,
  max(h_mcc) FILTER (back = 1) AS prev_mcc, max(h_dev) FILTER (back = 1) AS prev_dev,
  stddev_samp(d) AS std_d, max(d) FILTER (back = 1) AS d1, max(d) FILTER (back = 2) AS d2, stddev_samp(d) FILTER (back <= 10) AS std_d10, avg(d) FILTER (back <= 5) AS gap5,
  max_by(h_t, h_rn) FILTER (h_dev <> dev) AS t_dev, max_by(h_t, h_rn) FILTER (h_mcc IS DISTINCT FROM mcc) AS t_mcc,
  count(*) FILTER (h_dev = dev) AS n_dev, count(*) FILTER (h_ch = ch) AS n_ch, count(*) FILTER (h_tz = tz) AS n_tz, count(*) FILTER (h_bl = bl) AS n_bl, count(*) FILTER (h_et = et) AS n_et,
  count(*) FILTER (h_sess = sess) AS n_sess, coalesce(sum(h_amt) FILTER (h_sess = sess), 0) AS s_sess, min(h_t) FILTER (h_sess = sess) AS t_sess,
  count(*) FILTER (w1 AND h_descr = descr) AS descr1, count(*) FILTER (w6 AND h_descr = descr) AS descr6, count(*) FILTER (w24 AND h_descr = descr) AS descr24,
  count(*) FILTER (w1 AND h_et = et) AS et1, count(*) FILTER (w6 AND h_et = et) AS et6, count(*) FILTER (w24 AND h_et = et) AS et24,
  count(*) FILTER (w6 AND m) AS mcc6, count(*) FILTER (w24 AND m) AS mcc24, count(*) FILTER (m AND h_descr = descr) AS n_pair,
  median(h_amt) FILTER (w5 AND m) AS med5, stddev_samp(h_amt) FILTER (w5 AND m) AS std5,
  count(DISTINCT h_mcc) AS u_mcc, count(DISTINCT h_dev) FILTER (h_devk) AS u_dev, count(DISTINCT h_ch) FILTER (h_chk) AS u_ch, count(DISTINCT h_tz) AS u_tz,
  count(*) FILTER (back < 20 AND l_rn IS NOT NULL AND h_mcc IS DISTINCT FROM l_mcc) AS sw_mcc, count(*) FILTER (back < 20 AND l_rn IS NOT NULL AND h_dev <> l_dev) AS sw_dev,
  count(*) FILTER (back < 20 AND l_rn IS NOT NULL AND h_ch <> l_ch) AS sw_ch, count(*) FILTER (back < 20 AND l_rn IS NOT NULL AND h_sess IS DISTINCT FROM l_sess) AS sw_sess,
  count(DISTINCT h_hr) FILTER (w24) AS u_hr, count(*) FILTER (w24 AND h_rdp) AS rdp24, count(*) FILTER (w24 AND h_voip) AS voip24,
  count(*) FILTER (h_rn > last_other) AS mcc_run, (max(h_t) - min(h_t)) / 3600.0 AS span_h, count(*) FILTER (w7) AS n7, count(*) FILTER (w7 AND h_wd >= 5) AS wk7,
  count(DISTINCT h_descr) FILTER (w24) AS u_descr24, count(*) FILTER (w24) AS n24,
  count(h_amt) FILTER (h_rn > no_up) AS up, count(h_amt) FILTER (h_rn > no_down) AS down,
  count(*) FILTER (m) AS n_m, coalesce(sum(h_amt) FILTER (m), 0) AS s_m, avg(h_amt) FILTER (m) AS mean_m, stddev_samp(h_amt) FILTER (m) AS std_m, min(h_amt) FILTER (m) AS min_m, max(h_amt) FILTER (m) AS max_m,
  max_by(h_t, h_rn) FILTER (m) AS t_m, count(*) FILTER (m AND h_ch = ch) AS n_mch, count(*) FILTER (m AND h_dev = dev) AS n_mdev, count(*) FILTER (m AND h_rdp) AS n_mrdp,
  avg(h_hr) FILTER (m) AS hr_mean, stddev_samp(h_hr) FILTER (m) AS hr_std
  FROM p2 GROUP BY event_id),
z AS (SELECT r.*, agg.* EXCLUDE (event_id, n), coalesce(agg.n, 0) AS n FROM r LEFT JOIN agg USING (event_id))"""


def _flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def _safe(d: str) -> str:
    return f"CASE WHEN abs({d}) > 1e-9 THEN {d} ELSE 1e-9 END"


def _c(x: str) -> str:
    return f"coalesce({x}, 0)"


#: The features over z, by name; those that are absent with an empty past fall to their default.
SQL: dict[str, str] = {
    "operation_amt": "amt", "log_1_plus_transactions_seen": "ln(1 + n)", "amount_zscore": "CASE WHEN std_a > 0 THEN (amt - mean_a) / std_a END",
    "transactions_last_24h": _c("c24"), "sum_amount_last_1h": _c("s1"), "max_amount_last_24h": _c("max24"), "is_new_device": _flag("dev_known AND coalesce(n_dev, 0) = 0"),
    "is_new_mcc": _flag("mcc IS NOT NULL AND coalesce(n_m, 0) = 0"), "is_new_channel": _flag("ch_known AND coalesce(n_ch, 0) = 0"), "phone_voip_call_state": _flag("voip"),
    "hour": "hr", "day_of_week": "wd", "is_night_transaction": _flag("hr >= 22 OR hr < 6"), "is_weekend": _flag("wd >= 5"), "sum_amount_last_24h": _c("s24"),
    "time_since_prev_transaction": "coalesce(t - prev_t, -1)", "timezone_missing": _flag("tz IS NULL"), "trend_mean_last_3_to_10": f"mean3 / {_safe('mean10')}",
    "amount_percentile_rank": "CASE WHEN amt IS NOT NULL AND n_a > 0 THEN n_le / n_a END", "std_time_deltas": "std_d", "is_device_switch": _flag("dev_known AND (n = 0 OR prev_dev <> dev)"),
    "is_mcc_switch": _flag("prev_mcc <> mcc"), "session_mean_amount": "CASE WHEN n_sess > 0 THEN s_sess / n_sess END", "device_freq": "CASE WHEN n > 0 THEN CASE WHEN dev_known THEN n_dev ELSE 0 END / n END",
    "delta_1": "d1", "delta_2": "d2", "acceleration_delta_1_over_2": f"CASE WHEN d2 IS NOT NULL THEN d1 / ({_safe('d2')}) END", "std_delta_last_k": "std_d10",
    "time_since_last_device_change": "CASE WHEN dev_known THEN t - t_dev END", "time_since_last_mcc_change": "CASE WHEN mcc IS NOT NULL THEN t - t_mcc END",
    "event_descr_freq_last_1h": _c("descr1"), "event_descr_freq_last_6h": _c("descr6"), "event_descr_freq_last_24h": _c("descr24"),
    "event_type_nm_freq_last_1h": _c("et1"), "event_type_nm_freq_last_6h": _c("et6"), "event_type_nm_freq_last_24h": _c("et24"), "mcc_freq_last_6h": _c("mcc6"), "mcc_freq_last_24h": _c("mcc24"),
    "mcc_event_descr_pair_new": _flag("mcc IS NOT NULL AND descr IS NOT NULL AND coalesce(n_pair, 0) = 0"), "high_amount_ratio_last_24h": "CASE WHEN c24 > 0 THEN n_high / c24 ELSE 0 END",
    "amount_relative_to_mcc_median_5_days": "CASE WHEN med5 <> 0 THEN amt / med5 END", "amount_ratio_to_window_median": "CASE WHEN med_a <> 0 THEN amt / med_a END",
    "amount_iqr_normalized": "CASE WHEN n_a > 1 THEN (amt - srt[(n_a - 1) // 4 + 1]) / (CASE WHEN abs(srt[(3 * (n_a - 1)) // 4 + 1] - srt[(n_a - 1) // 4 + 1]) < 1e-9 THEN 1e-9 ELSE srt[(3 * (n_a - 1)) // 4 + 1] - srt[(n_a - 1) // 4 + 1] END) END",
    "amount_cv_in_window": "CASE WHEN abs(mean_a) > 1e-9 THEN std_a / mean_a END", "transactions_last_1h": _c("c1"), "unique_mcc_count_suffix": _c("u_mcc"), "unique_device_key_count_suffix": _c("u_dev"),
    "unique_channel_key_count_suffix": _c("u_ch"), "unique_timezone_count_suffix": _c("u_tz"), "mcc_switch_count_last_20_tx": _c("sw_mcc"), "device_switch_count_last_20_tx": _c("sw_dev"),
    "channel_switch_count_last_20_tx": _c("sw_ch"), "distinct_hours_active_last_24h": "coalesce(u_hr, 0) / 24", "mean_amount_last_3_transactions": "mean3",
    "amount_ratio_to_min_amount_24h": "CASE WHEN min24 > 1e-9 THEN amt / min24 END", "web_rdp_count_last_24h": _c("rdp24"), "voip_flag_count_last_24h": _c("voip24"),
    "channel_relative_freq": "CASE WHEN n > 0 THEN CASE WHEN ch_known THEN n_ch ELSE 0 END / n END", "timezone_relative_freq": "CASE WHEN n > 0 THEN n_tz / n END", "browser_language_relative_freq": "CASE WHEN n > 0 THEN n_bl / n END",
    "event_type_nm_share_in_suffix": "CASE WHEN n > 0 THEN n_et / n ELSE 0 END", "mcc_consecutive_streak_length": "CASE WHEN mcc IS NULL THEN 0 ELSE coalesce(mcc_run, 0) END", "mean_gap_seconds_last_5_intervals": "gap5",
    "suffix_time_span_hours_log1p": "ln(1 + span_h)", "transactions_per_span_hour": "CASE WHEN n > 0 THEN n / greatest(span_h, 1e-9) END", "mcc_amount_std_same_5d": "std5",
    "weekend_transaction_share_last_7d": "CASE WHEN n7 > 0 THEN wk7 / n7 ELSE 0 END", "distinct_event_descr_count_last_24h_norm": "coalesce(u_descr24, 0) / greatest(1, coalesce(n24, 0))", "battery_level": "battery",
    "developer_tools_flag": _flag("dev_tools IN ('true', '1')"), "accept_lang_browser_lang_mismatch": _flag("al <> bl"), "amount_diff_prev": "amt - prev_amt", "amount_ratio_prev": f"CASE WHEN prev_amt IS NOT NULL THEN amt / ({_safe('prev_amt')}) END",
    "amount_increase_streak_suffix": _c("up"), "amount_decrease_streak_suffix": _c("down"), "is_new_session_id": _flag("sess IS NOT NULL AND coalesce(n_sess, 0) = 0"), "session_switch_count_last_20_tx": _c("sw_sess"),
    "seconds_since_session_start_in_window": "CASE WHEN sess IS NOT NULL THEN t - coalesce(t_sess, t) END", "mcc_same_count_suffix": _c("n_m"), "sum_amount_same_mcc_suffix": _c("s_m"), "mean_amount_same_mcc_suffix": "mean_m",
    "std_amount_same_mcc_suffix": "std_m", "min_amount_same_mcc_suffix": "min_m", "max_amount_same_mcc_suffix": "max_m", "share_mcc_cnt_suffix": "CASE WHEN mcc IS NOT NULL AND n > 0 THEN n_m / n END",
    "share_mcc_sum_suffix": "CASE WHEN mcc IS NOT NULL AND sum_a > 1e-9 THEN s_m / sum_a END", "amount_ratio_mean_same_mcc": "CASE WHEN abs(mean_m) > 1e-9 THEN amt / mean_m END", "amount_minus_mean_same_mcc": "amt - mean_m",
    "zscore_amount_same_mcc": "CASE WHEN std_m > 1e-9 THEN (amt - mean_m) / std_m END", "days_since_last_same_mcc": "(t - t_m) / 86400.0", "mcc_channel_same_count_suffix": "CASE WHEN ch_known THEN coalesce(n_mch, 0) ELSE 0 END",
    "is_new_mcc_channel_pair": _flag("mcc IS NOT NULL AND ch_known AND coalesce(n_mch, 0) = 0"), "mcc_device_same_count_suffix": "CASE WHEN dev_known THEN coalesce(n_mdev, 0) ELSE 0 END",
    "is_new_mcc_device_pair": _flag("mcc IS NOT NULL AND dev_known AND coalesce(n_mdev, 0) = 0"), "mcc_rdp_count_suffix": _c("n_mrdp"), "share_mcc_rdp_suffix": "CASE WHEN n_m > 0 THEN n_mrdp / n_m END",
    "hour_mean_same_mcc_suffix": "hr_mean", "hour_std_same_mcc_suffix": "hr_std",
}


def query(names: list[str], cap: int = 512) -> str:
    """event_id and the named features, rounded to 4 places (a hair up, so that halves fall alike)."""
    return pairs(cap) + f"\nSELECT event_id, {selected(names)} FROM z"


def selected(names: list[str]) -> str:
    return ", ".join(f"round(CAST({SQL[n]} AS DOUBLE) + 1e-7, 4) + 0.0 AS {n}" for n in names)
