"""Streaming twin of the history window: each customer's newest rows are state, scored before they are updated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["customer_id", "event_id", "n_seen", "n_recent", "sum_recent", "max_recent", "mean_seen", "since_previous"]
OUT = "customer_id string, event_id long, n_seen long, n_recent long, sum_recent double, max_recent double, mean_seen double, since_previous long"
STATE = "times array<long>, amounts array<double>"


def running_history(stream: DataFrame, seconds: int = 86_400, cap: int = 512, evict_after_ms: int | None = None) -> DataFrame:
    """For each row of a stream (customer_id, event_id, t, amt), over the customer's at most ``cap`` rows before it: n_seen, their
    mean amount and the seconds since the last one (-1: none); of those no older than ``seconds``, count, sum and largest of the amounts.

    Rows of a batch are taken in the order of time and id. A customer's state has ``cap`` rows at most; with
    ``evict_after_ms`` it is dropped once no row of theirs has come for that long; batches then go on without
    new rows, so such a stream is never idle (processAllAvailable does not return).
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old_times, old_amounts = state.get if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        times = np.concatenate([np.array(old_times, np.int64), rows["t"].to_numpy(np.int64)])
        amounts = np.concatenate([np.array(old_amounts, float), rows["amt"].to_numpy(float)])
        out = []
        for event_id, at in zip(rows["event_id"], range(len(old_times), len(times))):
            past, known = slice(max(0, at - cap), at), amounts[max(0, at - cap) : at]
            recent = known[(times[past] >= times[at] - seconds) & ~np.isnan(known)]
            known = known[~np.isnan(known)]
            since = int(times[at] - times[at - 1]) if at else -1
            out.append((key[0], int(event_id), past.stop - past.start, len(recent), float(recent.sum()), float(recent.max(initial=0.0)), float(known.mean()) if len(known) else None, since))
        state.update((times[-cap:].tolist(), amounts[-cap:].tolist()))
        if evict_after_ms is not None:
            state.setTimeoutDuration(evict_after_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    timeout = GroupStateTimeout.NoTimeout if evict_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.select("customer_id", "event_id", "t", "amt").groupBy("customer_id").applyInPandasWithState(advance, OUT, STATE, "append", timeout)
