"""Windows of a growing series in Structured Streaming.

Samples arrive in any order as (series_id, pos, value). State per window holds its samples until all are there; a
complete window goes out once; its samples leave the state, and a mark stays, so that copies which come late open no
window anew. With a timeout, marks and windows that stay incomplete are dropped after it; Spark then runs batches without
end to look for such windows, so a query that is to stop by itself (availableNow) takes none, and keeps what is incomplete
for its next start. Without one, a mark of a few bytes stays for each window of `size` samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "series_id string, window_id int, x array<double>"
#: The positions in the state of a window that went out.
DONE = [-1]


def stream_windows(samples: DataFrame, size: int, timeout_ms: int | None = None) -> DataFrame:
    """series_id, window_id (from 1) and x of each complete window; of samples with one position the first counts.

    Null values, null positions and negative ones don't count, so their window stays incomplete. Copies of samples that
    come after their window went out change nothing, within the timeout if there is one. An empty stream gives no window.
    Extra columns are not used.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, values = state.get if state.exists else ([], [])
        gone, got = list(at) == DONE, dict(zip(at, values))
        for b in batches:
            if not gone:
                for p, v in zip(b["pos"], b["value"]):
                    got.setdefault(int(p), float(v))
        full = not gone and len(got) == size
        state.update((DONE, []) if gone or full else (list(got), list(got.values())))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if full:
            yield pd.DataFrame({"series_id": [key[0]], "window_id": [int(key[1])], "x": [[got[p] for p in sorted(got)]]})

    keyed = samples.select("series_id", F.expr(f"int(pos div {size} + 1)").alias("window_id"), "pos", "value").where("value is not null and pos >= 0")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return keyed.groupBy("series_id", "window_id").applyInPandasWithState(update, OUT, "at array<bigint>, seen array<double>", "append", timeout)
