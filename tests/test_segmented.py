"""Windows by ranges against plain windows: heavy keys, nulls, one key only, no key, empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexivec.operators.reports import inflight_peak
from lexivec.operators.segmented import by_ranges, previous, running_sum
from lexivec.streaming.keyed_state import FailureBurst, TokenBucket, admissions, bursts, failure_bursts, token_bucket

SCHEMA = "k long, t long, i long, v long"


def heavy(n, seed):
    """A third of all rows under one key, null keys, null values, equal times."""
    rng = random.Random(seed)
    return [(rng.choice([1, None, 2, *range(3, 9)]) if rng.random() < 0.67 else 1, rng.randint(0, n // 3), i, rng.choice([None, *range(-5, 9)])) for i in range(n)]


@pytest.mark.parametrize("rows", [heavy(3000, 1), [(7, i, i, i) for i in range(500)], [(None, 1, 1, None)], []])
def test_ranges_equal_plain_windows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["t", "i"]
    for keys in (["k"], []):
        ranged = by_ranges(df, keys, order, 13)
        got = previous(running_sum(ranged, keys, order, "v", "total"), keys, order, "v", "before").select("i", "total", "before")
        w = Window.partitionBy(*keys).orderBy(*order)
        want = df.select("i", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.lag("v").over(w).alias("before"))
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
        sizes = [r["count"] for r in ranged.groupBy("seg").count().collect()]
        assert not sizes or max(sizes) <= 3 * len(rows) / 13 + 5  # no range has more than its share


def test_peak_within_one_day(spark):
    rng = random.Random(3)
    spans = [(a := rng.randint(0, 80_000), a + rng.randint(0, 5000) if rng.random() < 0.9 else None) for _ in range(800)]
    at = lambda c: F.timestamp_seconds(F.col(c))
    df = spark.createDataFrame(spans, "a long, b long").select(at("a").alias("a"), at("b").alias("b"))
    level = {t: sum(a <= t and (b is None or t <= b) for a, b in spans) for t in {x for s in spans for x in s if x is not None}}
    top = max(level.values())
    row = inflight_peak(df, "a", "b", 11).first()
    first = min(t for t, n in level.items() if n == top)
    assert row.max_inflight == top and row.first_at == f"1970-01-01 {first // 3600:02d}:{first // 60 % 60:02d}:{first % 60:02d}"


def test_one_heavy_user_is_cut_into_episodes(spark):
    """Events in bouts with pauses between them: the whole history of a key in one pass gives the same."""
    rng = random.Random(5)
    now, rows = 0, []
    for i in range(1500):
        now += rng.choice([1, 60, 3600, 20_000, 50_000, 200_000])
        rows.append((i, now, 1 if i % 3 else 2, rng.choice(["error", "click"])))
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    tb, fb = TokenBucket(), FailureBurst()
    got_tb = {r.event_id: (r.admitted, round(r.tokens, 6)) for r in token_bucket(df, tb).collect()}
    got_fb = {r.event_id: (r.outcome, r.failures) for r in failure_bursts(df, fb).collect()}
    import numpy as np

    for key in (1, 2):
        own = [r for r in rows if r[2] == key]
        us = np.array([r[1] * 1_000_000 for r in own])
        ok, tokens, _ = admissions(us, tb)
        outcome, count, _ = bursts(us, np.array([r[3] == "error" for r in own]), fb)
        for n, r in enumerate(own):
            assert got_tb[r[0]] == (ok[n], round(tokens[n], 6)) and got_fb[r[0]] == (outcome[n], count[n])
    assert {o for o, _ in got_fb.values()} == {"ok", "failure", "opened", "blocked"}
