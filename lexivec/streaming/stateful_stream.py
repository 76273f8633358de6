"""Streaming form of admission and failure bursts (T3, T4, T5): ``applyInPandasWithState``.

State per key is a few numbers in the state store, recovered from the checkpoint after a restart. A
micro-batch's rows of a key are sorted by (time, id); an event older than the last one seen counts as
simultaneous with it. With an event-time timeout a key's state is dropped after the pause that makes it
a new key's, which bounds the store.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lexivec.streaming.keyed_state import FB_SCHEMA, TB_SCHEMA, FailureBurst, TokenBucket, admissions, bursts

TB_STATE = "last long, complete_at double"
FB_STATE = "last long, failures long, until double, began double"


def _stream(events: DataFrame, key, ts, id_col, extra, watermark, pause: float, step: Callable, out, state_kind: str) -> DataFrame:
    """``step(rows, times, state or None)`` gives the output columns and the new state."""

    def fn(k, pdfs, state):
        rows = pd.concat(list(pdfs), ignore_index=True)
        if state.hasTimedOut:
            state.remove()
            return
        rows = rows.sort_values(["us", "event_id"], kind="stable")
        last, old = (int(state.get[0]), tuple(state.get[1:])) if state.exists else (None, None)
        us = rows["us"].to_numpy()
        us = us if last is None else np.maximum(us, last)
        columns, new = step(rows, us, old)
        state.update((int(us[-1]), *new))
        state.setTimeoutTimestamp(int(us[-1] // 1000 + pause * 1000 + 1000))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "key": k[0], **columns})

    source = events.select(
        F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(id_col).alias("event_id"), *extra,
    ).withWatermark("ts", watermark)
    return source.groupBy("key").applyInPandasWithState(fn, out, state_kind, "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket_stream(events: DataFrame, p: TokenBucket, key="user_id", ts="ts", id_col="event_id", watermark="1 day") -> DataFrame:
    def step(rows, us, old):
        admitted, tokens, complete_at = admissions(us, p, old[0] if old else None)
        return {"admitted": admitted, "tokens": tokens}, (float(complete_at),)

    return _stream(events, key, ts, id_col, [], watermark, p.pause, step, TB_SCHEMA, TB_STATE)


def failure_bursts_stream(
    events: DataFrame, p: FailureBurst, key="user_id", ts="ts", id_col="event_id", type_col="event_type", watermark="1 day"
) -> DataFrame:
    def step(rows, us, old):
        outcome, count, (have, until, began) = bursts(us, rows["failed"].to_numpy(bool), p, (int(old[0]), old[1], old[2]) if old else None)
        return {"outcome": outcome, "failures": count}, (have, max(until, -1e18), began)

    failed = F.col(type_col).isin(list(p.failure_types)).alias("failed")
    return _stream(events, key, ts, id_col, [failed], watermark, p.pause, step, FB_SCHEMA, FB_STATE)
