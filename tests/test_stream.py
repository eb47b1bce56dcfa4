"""Streams against batches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_history import ODD, odd_rows
from tidemark.operators import audits, history
from tidemark.streaming import progress, stateful_history


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, stateful_history.PROVIDER)
    yield spark
    spark.conf.unset(key)


def drained(writer, spark, tmp_path, name):
    query = writer.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(90), query.stop()
    return spark.table(name)


def test_stream_equals_batch_for_all_features(rocks, tmp_path):
    rows = [r for r in odd_rows(11, 6, 40) if r[0] is not None]
    tx = rocks.createDataFrame(rows, ODD).withColumn("event_id", F.col("row_no"))
    # later batches have later times, as phase has no say in a stream
    tx = tx.withColumn("t", F.when(F.col("t").isNotNull(), F.col("row_no") * 900 + F.pmod("t", F.lit(700))))
    tx = tx.withColumn("phase", F.when(F.col("row_no") % 10 < 3, "pretest").otherwise("test")).withColumn("t", F.when(F.col("phase") == "test", F.coalesce("t", F.col("row_no")) + 10**6).otherwise(F.col("t")))
    tests = tx.where("phase = 'test'")
    for k in range(2):
        tests.where(F.when(F.col("t") < 10**6 + 900 * 60, 0).otherwise(1) == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
        time.sleep(1.1)  # files are taken in the order of their times
    source = rocks.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = drained(stateful_history.stream_history(source, cap=20, initial=tx.where("phase = 'pretest'")).writeStream, rocks, tmp_path, "all_features")
    want = history.history_features(tx, cap=20, rows="phase = 'test'")
    found = audits.parity(got, want, list(history.FEATURES), rtol=1e-9, atol=1e-9).collect()
    assert {r.n_compared for r in found} == {tests.count()} and [r.column_name for r in found if r.n_different] == []


def test_state_is_dropped_after_its_time(rocks, tmp_path):
    tx = rocks.createDataFrame([r for r in odd_rows(12, 3, 9) if r[0] is not None], ODD).limit(6).withColumns({"customer_id": F.lit("c"), "t": F.col("row_no"), "event_id": F.col("row_no")}).cache()
    names = ["log_1_plus_transactions_seen"]
    (tmp_path / "in").mkdir()
    source = rocks.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    query = stateful_history.stream_history(source, names, ttl_ms=5000).writeStream.format("memory").queryName("dropping").option("checkpointLocation", str(tmp_path / "ck")).start()

    def seen(part: str, rows: int) -> list[float]:
        tx.coalesce(1).write.parquet(str(tmp_path / "in" / part))
        for _ in range(120):
            got = rocks.table("dropping").collect()
            if len(got) >= rows:
                break
            time.sleep(0.5)
        return sorted(round(float(np.expm1(r[names[0]])), 6) for r in got)

    try:
        assert seen("part=0", 6) == [0, 1, 2, 3, 4, 5]
        time.sleep(7)
        assert seen("part=1", 12) == sorted([0, 1, 2, 3, 4, 5] * 2)  # the first rows are gone
    finally:
        query.stop()


def test_progress_rows(spark, tmp_path):
    listener = progress.ProgressRows()
    spark.streams.addListener(listener)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        drained(source.groupBy("id").count().writeStream.outputMode("complete"), spark, tmp_path, "counted")
        for _ in range(100):
            if any(r[1] == "ended" for r in listener.rows):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.table(spark).where("query = 'counted'").collect()
    assert [r.phase for r in rows][0] == "started" and rows[-1].phase == "ended"
    batches = [r for r in rows if r.phase == "batch"]
    assert sum(r.rows for r in batches) == 30 and batches[0].seconds > 0 and batches[-1].state_rows == 30
