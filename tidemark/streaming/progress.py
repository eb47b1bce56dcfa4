"""Progress of streams as rows of a table."""

from __future__ import annotations

import datetime
from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, phase string, batch long, rows long, seconds double, rows_a_second double, state_rows long, at timestamp"


class ProgressRows(StreamingQueryListener):
    """Keeps a row for each batch of each stream of the session, and for the start and end of each stream; the newest ``most`` of them."""

    def __init__(self, most: int = 100_000):
        self.rows: deque[tuple] = deque(maxlen=most)
        self.names: dict[str, str] = {}

    def _add(self, query: str, phase: str, batch: int | None = None, rows: int | None = None, seconds: float | None = None, state: int | None = None) -> None:
        rate = rows / seconds if rows is not None and seconds else None
        self.rows.append((query, phase, batch, rows, seconds, rate, state, datetime.datetime.now()))

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self._add(self.names[str(event.id)], "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        self._add(p.name or str(p.id), "batch", p.batchId, p.numInputRows, seconds, sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(self.names.get(str(event.id), str(event.id)), "failed" if event.exception else "ended")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SCHEMA)
