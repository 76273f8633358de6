"""Admission and failure bursts per key over an event table or stream.

* Admission (``TokenBucket``): a key may spend ``burst`` tokens at once and earns ``rate`` a second. One
  instant is the whole state: when the key's tokens will be complete again. Admitting an event puts it
  off by the time one token takes; an event is admitted if it stays within ``burst`` tokens' time.
* Failure bursts (``FailureBurst``): ``max_failures`` failures without a success in between, inside a
  window of ``fail_window`` seconds that starts at the first event after the last one's end, open the
  breaker for ``open_seconds``; events meanwhile are blocked and count for nothing. Found by jumps: the
  events of a window are counted at once, and a search by time skips the blocked ones.

Batch plan: an event after a long enough pause finds its key as new, so a key's events are cut into
independent *episodes* at such pauses (``operators.segmented``: the time of the event before, then a
running count of the cuts; neither gives a heavy key to one task). Episodes are dealt out by (key,
episode), sorted within the task and streamed; an episode's events are an array of numbers. Stream plan:
the same two functions per key and micro-batch, state in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.operators.segmented import by_ranges, previous, running_sum


@dataclass(frozen=True)
class TokenBucket:
    burst: float = 2.0
    rate: float = 1.0 / 43200.0  # tokens per second
    enabled: bool = True

    @property
    def pause(self) -> float:
        """Seconds without an event after which the tokens are complete."""
        return self.burst / self.rate if self.rate > 0 else float("inf")


@dataclass(frozen=True)
class FailureBurst:
    max_failures: int = 3
    fail_window: float = 2 * 86400.0
    open_seconds: float = 86400.0
    failure_types: tuple[str, ...] = ("error",)

    @property
    def pause(self) -> float:
        """Seconds without an event after which any window and any opening is over."""
        return max(self.fail_window, self.open_seconds)


def admissions(us: np.ndarray, p: TokenBucket, complete_at: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Are the events at the times ``us`` (in order) admitted, tokens left after each, and when the
    tokens are complete (``complete_at``: the same from before; None for a new key)."""
    token = 1e6 / p.rate
    reach = p.burst * token
    admitted, debt = np.empty(len(us), bool), np.empty(len(us))
    at = float(us[0]) if complete_at is None else complete_at
    for n, now in enumerate(us.tolist()):
        late = max(at, now) + token
        admitted[n] = late - now <= reach
        if admitted[n]:
            at = late
        debt[n] = max(at - now, 0.0)
    return admitted, p.burst - debt / token, at


#: (failures so far, end of the opening, start of the window), times in microseconds.
Burst = tuple[int, float, float]


def bursts(us: np.ndarray, failed: np.ndarray, p: FailureBurst, state: Burst | None = None) -> tuple[np.ndarray, np.ndarray, Burst]:
    """Outcome and failure count of every event (times in order), and the state after them."""
    n = len(us)
    outcome, count = np.full(n, "blocked", object), np.zeros(n, np.int64)
    have, until, began = state or (0, -np.inf, float(us[0]))
    i = int(np.searchsorted(us, until)) if until > us[0] else 0
    count[:i] = have
    while i < n:
        if us[i] - began > p.fail_window * 1e6:
            have, began = 0, float(us[i])
        end = int(np.searchsorted(us, began + p.fail_window * 1e6, "right"))
        bad = failed[i:end]
        # failures since the last success, those from before until there is one
        total = np.cumsum(bad)
        at_success = np.maximum.accumulate(np.where(bad, -1, total))
        run = np.where(at_success < 0, total + have, total - at_success)
        full = np.flatnonzero(bad & (run >= p.max_failures))
        stop = i + int(full[0]) + 1 if len(full) else end
        outcome[i:stop] = np.where(bad[: stop - i], "failure", "ok")
        count[i:stop] = run[: stop - i]
        have = int(run[stop - i - 1])
        if len(full):
            outcome[stop - 1] = "opened"
            until = float(us[stop - 1]) + p.open_seconds * 1e6
            i = int(np.searchsorted(us, until))
            count[stop:i] = have
        else:
            i = stop
    return outcome, count, (have, until, began)


TB_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("admitted", T.BooleanType()),
        T.StructField("tokens", T.DoubleType()),
    ]
)
FB_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("failures", T.LongType()),
    ]
)


def episodes(events: DataFrame, pause: float, key: str, ts: str, id_col: str, extra: list) -> DataFrame:
    """``(key, episode, us, event_id, extra)``, an episode's rows together and in order."""
    cols = [F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(id_col).cast("long").alias("event_id"), *extra]
    order = ["us", "event_id"]
    ranged = previous(by_ranges(events.select(*cols), ["key"], order), ["key"], order, "us", "before")
    cut = F.coalesce(F.col("us") - F.col("before") > F.lit(pause * 1e6), F.lit(True))
    numbered = running_sum(ranged.withColumn("cut", cut.cast("long")), ["key"], order, "cut", "episode").drop("seg", "before", "cut")
    return numbered.repartition("key", "episode").sortWithinPartitions("key", "episode", *order)


def per_episode(make: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whole episodes out of sorted batches; the last one of a batch waits for the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            ends = np.flatnonzero(rows[["key", "episode"]].ne(rows[["key", "episode"]].shift(-1)).any(axis=1).to_numpy())
            cut = int(ends[-2]) + 1 if len(ends) > 1 else 0
            same = held and tuple(held[-1][["key", "episode"]].iloc[-1]) == tuple(rows[["key", "episode"]].iloc[0])
            if held and (cut or not same):
                whole = pd.concat([*held, rows.iloc[:cut]])
                yield from (make(e) for _, e in whole.groupby(["key", "episode"], sort=False, dropna=False))
                held = [rows.iloc[cut:]]
            elif cut:
                yield from (make(e) for _, e in rows.iloc[:cut].groupby(["key", "episode"], sort=False, dropna=False))
                held = [rows.iloc[cut:]]
            else:
                held.append(rows)
        if held:
            yield from (make(e) for _, e in pd.concat(held).groupby(["key", "episode"], sort=False, dropna=False))

    return run


def token_bucket(events: DataFrame, params: TokenBucket, key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """``(event_id, key, admitted, tokens)`` for every event; disabled or rate <= 0 admits all."""
    if not params.enabled or params.rate <= 0:
        return events.select(
            F.col(id_col).cast("long").alias("event_id"), F.col(key).cast("long").alias("key"),
            F.lit(True).alias("admitted"), F.lit(None).cast("double").alias("tokens"),
        )

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        admitted, tokens, _ = admissions(rows["us"].to_numpy(), params)
        return pd.DataFrame({"event_id": rows["event_id"], "key": rows["key"], "admitted": admitted, "tokens": tokens})

    return episodes(events, params.pause, key, ts, id_col, []).mapInPandas(per_episode(make), TB_SCHEMA)


def failure_bursts(
    events: DataFrame, params: FailureBurst, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", type_col: str = "event_type"
) -> DataFrame:
    """``(event_id, key, outcome, failures)``; outcome in ok / failure / opened / blocked."""
    failed = F.col(type_col).isin(list(params.failure_types)).alias("failed")

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        outcome, count, _ = bursts(rows["us"].to_numpy(), rows["failed"].to_numpy(bool), params)
        return pd.DataFrame({"event_id": rows["event_id"], "key": rows["key"], "outcome": outcome, "failures": count})

    return episodes(events, params.pause, key, ts, id_col, [failed]).mapInPandas(per_episode(make), FB_SCHEMA)
