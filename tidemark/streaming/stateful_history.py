"""All history features of a stream of transactions: each customer's newest rows are keyed state.

State is a list of at most ``cap`` rows a customer, in RocksDB on the executors and in the stream's checkpoint. It begins with the
pretest rows, if given, and a row of it is dropped a set time after it was written. The features are those of
``history_features``, from the same structures, so stream and batch agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import history
from tidemark.operators import history_kernel as kernel

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KINDS = {"t": "double", "amt": "double", "et": "double"} | dict.fromkeys(history._FLAGS, "boolean")
STATE = ", ".join(f"{f} {_KINDS.get(f, 'string')}" for f in history._FIELDS)
_ARROW = pa.schema([(f"h_{f}", {"double": pa.float64(), "boolean": pa.bool_()}.get(_KINDS.get(f), pa.string())) for f in history._FIELDS])


class NewestRows(StatefulProcessor):
    """Answers a customer's new rows in the order of time and id, then keeps the newest ``cap`` rows."""

    def __init__(self, names: list[str], carried: list[str], cap: int, ttl_ms: int | None):
        self.names, self.carried, self.cap, self.ttl_ms = names, carried, cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", STATE, self.ttl_ms)

    def _table(self, rows: pd.DataFrame) -> pa.Table:
        return pa.table({f.name: pa.array(rows[f.name].tolist(), f.type, from_pandas=True) for f in _ARROW}, _ARROW)

    def _keep(self, table: pa.Table) -> None:
        newest = table.slice(max(0, table.num_rows - self.cap))
        self.rows.put(list(zip(*[c.to_pylist() for c in newest.columns])))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self._keep(self._table(initialState.sort_values(["h_t", "order_id"], na_position="first")))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:  # a customer with earlier rows only
            return
        new = pd.concat(parts).sort_values(["h_t", "order_id"], na_position="first")
        held = list(self.rows.get())
        past = pa.table([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], _ARROW) if held else _ARROW.empty_table()
        table = pa.concat_tables([past, self._table(new)])
        opens = np.zeros(table.num_rows, bool)
        opens[0] = True
        found = kernel.History(opens, history.columns_of(table, "h_"), self.cap)
        out = {c: new[c] for c in self.carried}
        for name in self.names:
            if name in kernel.FEATURES:
                values = np.asarray(kernel.FEATURES[name](found), float)[past.num_rows :]
                out[name] = [None if np.isnan(v) else v for v in values]
            else:
                out[name] = new[name]
        self._keep(table)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def _flat(tx: DataFrame, names: list[str], rows_only: bool = False) -> DataFrame:
    keyed = history._with_keys(tx)
    own = [] if rows_only else [F.expr(history.FEATURES[n]).cast("double").alias(n) for n in names if n not in kernel.FEATURES]
    fields = [F.col(f).cast(_KINDS.get(f, "string")).alias(f"h_{f}") for f in history._FIELDS]
    return keyed.select("customer_id", "event_id", F.coalesce("event_id", F.lit(0)).alias("order_id"), *fields, *own)


def stream_history(stream: DataFrame, names: list[str] | None = None, cap: int = history.CAP, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """customer_id, event_id and the named features (default: all) of each row of a stream of canonical transactions, over its customer's at
    most ``cap`` rows before it. ``initial`` has transactions that come before the stream. With ``ttl_ms`` a row of the state is
    dropped so many milliseconds after it was written; batches then go on without new rows, so such a stream never ends by itself. The session must keep state in RocksDB (``PROVIDER``).

    Rows of a batch are taken in the order of time and id, a missing id first; rows without a time come before all others of their batch.
    """
    names = list(names or history.FEATURES)
    carried = ["customer_id", "event_id"]
    schema = "customer_id string, event_id long, " + ", ".join(f"`{n}` double" for n in names)
    grouped = _flat(stream, names).groupBy("customer_id")
    first = _flat(initial, names, rows_only=True).groupBy("customer_id") if initial is not None else None
    return grouped.transformWithStateInPandas(NewestRows(names, carried, cap, ttl_ms), schema, "append", "none" if ttl_ms is None else "processingTime", first)
