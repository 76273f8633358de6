"""Windows over keys of any size: running sums and previous values by ranges of (key, order).

A window partitioned by the key alone gives a heavy key to one task. Here rows are range-partitioned
by key *and* order, so a heavy key is spread over many ranges (``seg``). Each range is scanned by itself,
and what one range hands to the next (its sum, its last value) is a row per key and range, prefix-summed
over the ranges. Only a key that goes on from one range into the next needs a carried value, so there
are fewer carried rows than ranges, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.session import store_once


def by_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``seg``, its range's number in the order of (keys, order); stored, so that a task
    run again cannot change it."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store_once(df.repartitionByRange(n, *keys, *order).withColumn("seg", F.spark_partition_id()), "ranges")


def _carry(ranged: DataFrame, keys: list[str], per_range: Column, over_ranges) -> DataFrame:
    """``(keys, seg, carried)`` for the ranges into which a key goes on from the one before."""
    one = ranged.groupBy(*keys, "seg").agg(per_range.alias("x"))
    before = Window.partitionBy(*keys).orderBy("seg")
    return one.withColumn("carried", over_ranges(F.col("x"), before)).where("carried is not null").select(*keys, "seg", "carried")


def _join(ranged: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    other = carried.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "seg"]], "carried")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "seg"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return ranged.join(F.broadcast(other), on, "left").drop(*[f"_{k}" for k in [*keys, "seg"]])


def running_sum(ranged: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranged`` (``by_ranges``) with ``name``: the sum of ``value`` over the key's rows up to this
    one. ``order`` must tell a key's rows apart."""
    rows = Window.partitionBy(*keys, "seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _carry(ranged, keys, F.sum(value), lambda x, w: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = _join(ranged, carried, keys).withColumn("_own", F.sum(value).over(rows))
    total = F.when(F.col("_own").isNull() & F.col("carried").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("carried", F.lit(0)))
    return out.withColumn(name, total).drop("_own", "carried")


def previous(ranged: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``ranged`` with ``name``: ``value`` of the key's row before this one (null for the first)."""
    rows = Window.partitionBy(*keys, "seg").orderBy(*order)
    held = F.struct(F.col(value).alias("v"))  # a null value is still a row
    last = F.max_by(held, F.struct(*order))
    carried = _carry(ranged, keys, last, lambda x, w: F.lag(x).over(w))
    out = _join(ranged, carried, keys).withColumn("_own", F.lag(held).over(rows))
    return out.withColumn(name, F.coalesce("_own", "carried")["v"]).drop("_own", "carried")
