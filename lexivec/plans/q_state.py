"""Keyed stateful operators on the events table (T3, T4): batch runs with recursive-CTE oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.plans.catalog import query
from lexivec.sources.tables import read_table
from lexivec.streaming.keyed_state import FailureBurst, TokenBucket, failure_bursts, token_bucket

# Parameters chosen for the data (30 days, 150 users, median gap ~7 h): burst 2, one token per
# 12 h; 3 failures in 2 days open the breaker for 1 day.
TB = TokenBucket(burst=2.0, rate=1.0 / 43200.0)
FB = FailureBurst(max_failures=3, fail_window=2 * 86400.0, open_seconds=86400.0)

_EV = """ev AS (SELECT user_id AS key, event_id, epoch_us(ts) AS us, event_type = 'error' AS failed,
                row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events)"""


def _tb_sql() -> str:
    b, r = f"{TB.burst!r}::DOUBLE", f"{TB.rate!r}::DOUBLE"
    t = f"least({b}, tb.tokens + greatest(0.0::DOUBLE, (e.us - tb.us)::DOUBLE / 1000000.0::DOUBLE) * {r})"
    return f"""
WITH RECURSIVE {_EV},
tb AS (
  SELECT key, rn, event_id, us,
         CASE WHEN {b} >= 1.0::DOUBLE THEN {b} - 1.0::DOUBLE ELSE {b} END AS tokens, {b} >= 1.0::DOUBLE AS admitted
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.event_id, e.us,
         CASE WHEN {t} >= 1.0::DOUBLE THEN {t} - 1.0::DOUBLE ELSE {t} END, {t} >= 1.0::DOUBLE
  FROM tb JOIN ev e ON e.key = tb.key AND e.rn = tb.rn + 1)
SELECT event_id, key, admitted, round(tokens, 6) AS tokens FROM tb
"""


def _fb_step(f: str, o: str, w: str) -> tuple[str, str, str, str]:
    """SQL of one breaker step from state (f, o, w) and event (e.now, e.failed)."""
    now, win, opn, mx = "e.now", f"{FB.fail_window!r}::DOUBLE", f"{FB.open_seconds!r}::DOUBLE", FB.max_failures
    blocked = f"({o} <> 0.0 AND ({now} - {o}) < {opn})"
    reset = f"(({now} - {w}) > {win})"
    f1 = f"(CASE WHEN {reset} THEN 0 ELSE {f} END)"
    w1 = f"(CASE WHEN {reset} THEN {now} ELSE {w} END)"
    nf = f"CASE WHEN {blocked} THEN {f} WHEN NOT e.failed THEN 0 ELSE {f1} + 1 END"
    no = (
        f"CASE WHEN {blocked} THEN {o} WHEN NOT e.failed THEN 0.0::DOUBLE "
        f"WHEN {f1} + 1 >= {mx} THEN {now} ELSE {o} END"
    )
    nw = f"CASE WHEN {blocked} THEN {w} ELSE {w1} END"
    out = (
        f"CASE WHEN {blocked} THEN 'blocked' WHEN NOT e.failed THEN 'ok' "
        f"WHEN {f1} + 1 >= {mx} THEN 'opened' ELSE 'failure' END"
    )
    return nf, no, nw, out


def _fb_sql() -> str:
    a = _fb_step("0", "0.0::DOUBLE", "e.now")
    r = _fb_step("fb.failures", "fb.opened_at", "fb.window_start")
    return f"""
WITH RECURSIVE {_EV},
evn AS (SELECT *, us::DOUBLE / 1000000.0::DOUBLE AS now FROM ev),
fb AS (
  SELECT e.key, e.rn, e.event_id, ({a[0]})::BIGINT AS failures, ({a[1]})::DOUBLE AS opened_at,
         ({a[2]})::DOUBLE AS window_start, {a[3]} AS outcome
  FROM evn e WHERE e.rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.event_id, {r[0]}, {r[1]}, {r[2]}, {r[3]}
  FROM fb JOIN evn e ON e.key = fb.key AND e.rn = fb.rn + 1)
SELECT event_id, key, outcome, failures FROM fb
"""


@query("token_bucket", sql=_tb_sql())
def token_bucket_q(spark, sf_dir):
    """Per-user token-bucket admission of every event (burst 2, one token per 12 h)."""
    ev = read_table(spark, sf_dir, "events")
    return token_bucket(ev, TB).select("event_id", "key", "admitted", F.round("tokens", 6).alias("tokens"))


@query("failure_bursts", sql=_fb_sql())
def failure_bursts_q(spark, sf_dir):
    """Per-user failure bursts: 'error' events are failures (3 in 2 days open the breaker for 1 day)."""
    return failure_bursts(read_table(spark, sf_dir, "events"), FB)
