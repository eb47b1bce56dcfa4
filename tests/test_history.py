"""History features on hand-made rows, and against DuckDB."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, history, lookups
from tidemark.operators import history_kernel as kernel
from tidemark.plans import matrix, queries
from tidemark.sources.tables import conform

RAW = "customer_id string, event_id long, event_dttm string, operaton_amt string, mcc_code string, channel_indicator_type string, event_desc string, session_id string, developer_tools string, phase string"


def features(spark, rows, **options):
    tx = conform(spark.createDataFrame(rows, RAW))
    return {r.event_id: r for r in history.history_features(tx, **options).collect()}


def row(i, time, amount, mcc="5411", **more):
    base = {"channel": "web", "descr": "pay", "sess": None, "dev": None, "phase": "train", "customer": "c"} | more
    return (base["customer"], i, time, amount, mcc, base["channel"], base["descr"], base["sess"], base["dev"], base["phase"])


def test_empty_and_single_past(spark):
    got = features(spark, [row(1, "2024-01-01 00:00:00", "10"), row(2, "2024-01-01 00:00:00.9", "30")])
    first, second = got[1], got[2]
    assert first.time_since_prev_transaction == -1 and first.device_freq is None and first.max_amount_last_24h == 0 and first.is_new_mcc == 1
    assert second.time_since_prev_transaction == 0 and second.transactions_per_span_hour == pytest.approx(1e9) and second.suffix_time_span_hours_log1p == 0
    assert second.amount_diff_prev == 20 and second.amount_ratio_prev == 3 and second.amount_zscore is None and second.is_new_mcc == 0


def test_bounds_ties_and_later_rows(spark):
    rows = [row(1, "2024-01-01 00:00:00", "1"), row(2, "2024-01-02 00:00:00", "2"), row(3, "2024-01-02 00:00:00", "4"), row(4, "2024-01-02 00:00:01", "8")]
    got = features(spark, rows)
    assert got[2].transactions_last_24h == 1  # exactly a day back is inside
    assert got[3].sum_amount_last_24h == 3 and got[4].transactions_last_24h == 2  # ties count, a second over a day doesn't
    assert got[4].amount_increase_streak_suffix == 2 and got[4].delta_1 == 0 and got[4].acceleration_delta_1_over_2 == 0


def test_odd_values(spark):
    rows = [row(1, "not a time", "abc", mcc=" 5411 "), row(2, "2024-01-01 10:00:00", "-5", dev="0.0"), row(3, "2024-01-01 11:00:00", "12abc", mcc="\t", dev="YES"), row(4, "2024-01-01 12:00:00", None, mcc="5411")]
    got = features(spark, rows)
    assert got[1].operation_amt is None and got[1].hour is None
    assert got[2].is_new_mcc == 0 and got[2].developer_tools_flag == 0 and got[2].amount_diff_prev is None
    assert got[3].operation_amt == 12 and got[3].developer_tools_flag == 1 and got[3].mcc_same_count_suffix == 0 and got[3].share_mcc_cnt_suffix is None
    assert got[4].mcc_same_count_suffix == 2 and got[4].sum_amount_same_mcc_suffix == -5 and got[4].hour_mean_same_mcc_suffix == 4.5 and got[4].share_mcc_sum_suffix == pytest.approx(-5 / 7)


def test_cap_suffix_and_warm_up(spark):
    rows = [row(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", str(i), phase="pretrain" if i < 300 else "train") for i in range(600)]
    got = features(spark, rows)
    assert got[599].log_1_plus_transactions_seen == pytest.approx(math.log1p(512)) and got[300].log_1_plus_transactions_seen == pytest.approx(math.log1p(300))
    tx = conform(spark.createDataFrame(rows, RAW))
    cut = history.history_features(tx.selectExpr("*", "cast(event_id % 4 AS bigint) AS length"), ["log_1_plus_transactions_seen", "mean_amount_last_3_transactions"], suffix="length")
    got = {r.event_id: r for r in cut.collect()}
    assert got[400].log_1_plus_transactions_seen == 0 and got[402].mean_amount_last_3_transactions == 400.5
    assert features(spark, rows, cap=None)[599].log_1_plus_transactions_seen == pytest.approx(math.log1p(599))


def test_one_shuffle_and_pruned_scan(spark, tables):
    plan = queries.QUERIES["hist_time"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    assert "Exchange" not in queries.QUERIES["hist_row"](spark, tables)._jdf.queryExecution().executedPlan().toString()


def odd_rows(seed: int, customers: int, most: int):
    """Transactions with gaps in every column, ties, and times that fall between and within phases."""
    r = random.Random(seed)
    some = lambda values, gap=0.15: None if r.random() < gap else r.choice(values)
    out, i = [], 0
    for c in range(customers):
        base = r.randint(0, 30) * 86_400
        for _ in range(r.choice([1, 2, 5, most])):
            i += 1
            phase = r.choice(["pretrain", "train", "pretest", "test"])
            t = None if r.random() < 0.1 else base + r.choice([0, 600, 3600, 86_400, 86_400 * 5]) * r.randint(0, 12) + r.randint(0, 2)
            amt = some([0.0, 1.0, 1.0, -3.5, 1e-12, 250.25, 1e9, round(r.random() * 100, 2)])
            out.append((
                f"c{c}" if c else None, None if r.random() < 0.05 else i, t, phase, amt, some(["1", "2", "3"]), some(["a", "b"]), some([1.0, 2.0]), some(["x", "y"], 0.5), some(["x", "y"], 0.5), some(["w", "m"], 0.5),
                some(["s"], 0.5), some(["z1", "z2"]), some(["en", "de"]), some(["s1", "s2", "s3"]), some(["1", "no"]), r.random() < 0.3, r.random() < 0.3, some([0.5]), some(["en", "de"]), i,
            ))
    return out


ODD = "customer_id string, event_id long, t long, phase string, amt double, mcc string, descr string, et double, os string, ver string, ch_type string, ch_sub string, tz string, bl string, sess string, dev_tools string, rdp boolean, voip boolean, battery double, al string, row_no long"


@pytest.mark.parametrize(("cap", "suffix", "range_rows"), [(512, None, 10**6), (7, None, 40), (None, None, 10**6), (30, "length", 10**6)])
def test_kernel_equals_array_expressions(spark, monkeypatch, cap, suffix, range_rows):
    monkeypatch.setattr(history, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(history, "CHUNK_ROWS", 100)
    tx = spark.createDataFrame(odd_rows(3, 18, 160), ODD).withColumn("length", F.pmod(F.xxhash64("row_no"), F.lit(40)) - 3)
    # rows without an id tie in order, so they get times of their own
    tx = tx.withColumn("event_id", F.when(F.col("event_id").isNull() & F.col("t").isNotNull(), F.lit(None)).otherwise(F.col("row_no")))
    tx = tx.withColumn("t", F.when(F.col("event_id").isNull(), F.col("t") * 1000 + F.col("row_no")).otherwise(F.col("t")))
    a, b = (f(tx, cap=cap, suffix=suffix, keep=["row_no"]) for f in (history.history_features, history.array_features))
    got = audits.parity(a, b, list(history.FEATURES), key="row_no", rtol=1e-9, atol=1e-9).collect()
    assert {r.n_compared for r in got} == {tx.count()} and [r.column_name for r in got if r.n_different] == []


def test_kernel_sets_no_rows_apart(spark):
    """Features of chosen rows only, empty tables, and all rows without a time."""
    tx = spark.createDataFrame(odd_rows(5, 6, 40), ODD)
    names = ["amount_zscore", "unique_mcc_count_suffix", "operation_amt"]
    whole = {r.row_no: tuple(r) for r in history.history_features(tx, names, keep=["row_no", "phase"]).collect()}
    some = {r.row_no: tuple(r) for r in history.history_features(tx, names, keep=["row_no", "phase"], rows="phase = 'test'").collect()}
    assert some == {n: r for n, r in whole.items() if r[2] == "test"} and 0 < len(some) < len(whole)
    assert history.history_features(tx.limit(0)).count() == 0
    timeless = history.history_features(tx.withColumn("t", F.lit(None).cast("long")), ["transactions_last_24h", "delta_1", "distinct_event_descr_count_last_24h_norm"]).distinct().collect()
    assert [tuple(r)[1:] for r in timeless][:1] == [(0.0, None, 0.0)]


def test_structures_against_loops():
    r = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 100):
        values, counts = r.integers(0, 9, n).astype(float), r.random(n) < 0.7
        a = r.integers(0, n + 1, 60)
        ranges = [(a, r.integers(0, n + 1, 60)), (np.minimum(a + 3, n), np.minimum(a + 5, n))]
        pieces = [[x for lo, hi in ranges for x in range(lo[i], hi[i])] for i in range(60)]
        ranks, k = kernel.Ranks(values), r.integers(0, 6, 60)
        kth, below, at_most = ranks.kth(ranges, k), ranks.below(ranges, values[a % n]), ranks.below(ranges, values[a % n], "right")
        moments = kernel.Moments(values, counts).over(ranges)
        for i, piece in enumerate(pieces):
            own = sorted(values[x] for x in piece)
            assert (kth[i] == own[k[i]]) if k[i] < len(own) else np.isnan(kth[i])
            assert below[i] == sum(v < values[a[i] % n] for v in own) and at_most[i] == sum(v <= values[a[i] % n] for v in own)
            known = [values[x] for x in piece if counts[x]]
            assert moments["n"][i] == len(known) and (not known or (moments["mean"][i] == pytest.approx(np.mean(known)) and moments["max"][i] == max(known)))
            assert len(known) < 2 or moments["std"][i] == pytest.approx(np.std(known, ddof=1), abs=1e-12)


def test_scoring_history_holds_pretest_rows_without_an_id(spark):
    rows = [row(None, f"2024-01-01 0{i}:00:00", str(10 + i), phase="pretest") for i in range(3)] + [row(1, "2024-01-01 04:00:00", "5", phase="pretest")]
    rows += [row(7, "2024-01-02 00:00:00", "9", phase="test"), row(None, "2024-01-02 01:00:00", "11", phase="test"), row(8, "2024-01-02 02:00:00", "13", phase="test"), row(99, "2024-01-01 00:00:00", "1", phase="train", customer="d")]
    tx = conform(spark.createDataFrame(rows, RAW)).withColumn("labelled", F.lit(False))
    got = {r.event_id: r for r in matrix.scoring_rows(tx, lookups.stored_once(tx)).collect()}
    assert set(got) == {7, 8}  # a test row without an id is neither scored nor history
    assert got[7].log_1_plus_transactions_seen == pytest.approx(math.log1p(4)) and got[7].sum_amount_last_24h == 38
    assert got[8].log_1_plus_transactions_seen == pytest.approx(math.log1p(5)) and got[8].delta_1 == 20 * 3600


def test_unlimited_history_of_a_large_customer(spark):
    """200,000 rows of one customer: no past is written out."""
    tx = spark.range(200_000).selectExpr(
        "'c' AS customer_id", "id AS event_id", "id * 7 AS t", "if(id < 100000, 'pretest', 'test') AS phase", "cast(pmod(xxhash64(id), 1000) AS double) AS amt", "cast(pmod(id, 50) AS string) AS mcc",
        *[f"cast(null AS string) AS {c}" for c in ("descr", "os", "ver", "ch_type", "ch_sub", "tz", "bl", "sess", "dev_tools")], "1D AS et", "false AS rdp", "false AS voip",
    )
    names = ["log_1_plus_transactions_seen", "amount_percentile_rank", "amount_ratio_to_window_median", "unique_mcc_count_suffix", "mcc_same_count_suffix", "sum_amount_last_24h"]
    got = history.history_features(tx, names, cap=None, rows="event_id = 199999").first()
    amounts = np.array([x.amt for x in tx.select("amt").collect()])
    own, past = amounts[-1], amounts[:-1]
    want = [math.log1p(199_999), np.mean(past <= own), own / np.median(past), 50, 3999, past[-(86_400 // 7) :].sum()]
    assert list(got)[1:] == pytest.approx(want)


def norm(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str)):
        return str(value)
    return round(float(value), 3) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("events", "documents", "labels", "orders", "customer", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = queries.QUERIES[name](spark, tables)
    answer = con.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(answer.columns)
    want = [dict(zip(answer.columns, r)) for r in answer.fetchall()]
    flat = lambda rows: sorted(repr([norm(r[c]) for c in order]) for r in rows)
    assert flat(df.collect()) == flat(want)
