"""Transactions and labels derived from the driver's tables; the mapping is plain SQL for either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SELECT = """
SELECT CAST(user_id AS STRING) AS customer_id, event_id, {seconds} AS sec,
  CASE WHEN event_id % 29 = 0 THEN NULL ELSE value END AS operaton_amt,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(5000 + k % 12 AS STRING) END AS mcc_code,
  CASE WHEN k % 17 = 0 THEN NULL ELSE 'ch' || CAST(k % 4 AS STRING) END AS channel_indicator_type,
  CASE WHEN k % 17 = 0 OR k % 5 = 0 THEN NULL ELSE 's' || CAST(k % 2 AS STRING) END AS channel_indicator_sub_type,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE 'tz' || CAST(k % 3 AS STRING) END AS timezone,
  CASE WHEN event_id % 23 = 0 THEN '' WHEN k % 10 = 0 THEN '840' ELSE '643' END AS currency_iso_cd,
  CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE NULL END AS DOUBLE) AS event_type_nm,
  CASE WHEN event_id % 37 = 0 THEN ' ' ELSE event_type END AS event_descr,
  CASE WHEN k % 13 = 0 THEN '' ELSE 'p' || CAST(k % 6 AS STRING) END AS pos_cd,
  CASE WHEN k % 19 = 0 THEN NULL ELSE 'os' || CAST(user_id % 2 AS STRING) END AS operating_system_type,
  CASE WHEN k % 19 = 0 THEN NULL ELSE 'v' || CAST(k % 5 AS STRING) END AS device_system_version,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) END AS session_id,
  'l' || CAST(k % 3 AS STRING) AS browser_language, 'l' || CAST(event_id % 3 AS STRING) AS accept_language,
  CASE WHEN k % 9 = 0 THEN NULL ELSE k / CAST(100 AS DOUBLE) END AS battery,
  CASE k % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE NULL END AS developer_tools,
  CASE WHEN event_id % 13 = 0 THEN '1' ELSE NULL END AS phone_voip_call_state,
  CASE WHEN event_id % 19 = 0 THEN '1' ELSE NULL END AS web_rdp_connection,
  CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 'pretrain' WHEN ts < TIMESTAMP '2024-01-26 00:00:00' THEN 'train' ELSE 'test' END AS phase,
  event_id % 17 = 0 AND ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-26 00:00:00' AS labelled,
  CAST(CASE WHEN event_id % 17 = 0 AND ts >= TIMESTAMP '2024-01-11 00:00:00' AND ts < TIMESTAMP '2024-01-26 00:00:00' THEN event_id % 2 ELSE NULL END AS INT) AS label
FROM (SELECT *, {k} AS k FROM {events}) AS e
"""

#: The canonical transactions as DuckDB sees them (columns as conform() gives them).
ORACLE = (
    "raw AS ("
    + _SELECT.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)", k="CAST(regexp_extract(props, '[0-9]+') AS INT)", events="events")
    + """),
tx AS (SELECT customer_id, event_id, sec AS t, operaton_amt AS amt, mcc_code AS mcc, coalesce(CAST(mcc_code AS BIGINT), -2) AS mcc_key,
  channel_indicator_type AS ch_type, channel_indicator_sub_type AS ch_sub, nullif(timezone, '') AS tz, nullif(currency_iso_cd, '') AS ccy,
  event_type_nm AS et, nullif(trim(event_descr), '') AS descr, nullif(pos_cd, '') AS pos, operating_system_type AS os, device_system_version AS ver,
  session_id AS sess, browser_language AS bl, accept_language AS al, CAST(NULL AS VARCHAR) AS screen, battery, developer_tools AS dev_tools,
  phone_voip_call_state IS NOT NULL AS voip, web_rdp_connection IS NOT NULL AS rdp, phase, labelled, label FROM raw)"""
)


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's input columns, from the events table."""
    sql = _SELECT.format(seconds="unix_seconds(CAST(ts AS TIMESTAMP))", k="CAST(get_json_object(props, '$.k') AS INT)", events="{events}")
    df = spark.sql(sql.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return df.withColumn("event_dttm", df["sec"].cast("timestamp")).drop("sec")
