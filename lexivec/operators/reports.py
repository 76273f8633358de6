"""Reports re-aimed at log / event tables (A5-A9): histograms, counters, in-flight peak, health.

All are partial aggregates, the peak a segmented scan; nothing crosses rows with a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.operators.segmented import by_ranges, running_sum


def bound_label(b: float) -> str:
    return repr(float(b))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str]) -> DataFrame:
    """Cumulative bucket counts (``value <= le``) per group, plus ``+Inf``, sum and count.

    One aggregate with one conditional count per bound (map-side combined), then a local
    unpivot of the ~20 counters into rows.
    """
    aggs = [F.count_if(F.col(value) <= F.lit(float(b))).cast("long").alias(f"_b{i}") for i, b in enumerate(bounds)]
    a = df.groupBy(*by).agg(
        *aggs, F.count(F.lit(1)).cast("long").alias("_inf"), F.round(F.sum(value), 6).alias("value_sum"), F.count(value).cast("long").alias("value_count")
    )
    labels = [bound_label(b) for b in bounds] + ["+Inf"]
    cols = [f"_b{i}" for i in range(len(bounds))] + ["_inf"]
    stack = "stack({}, {}) AS (le, cum_count)".format(len(cols), ", ".join(f"'{lab}', {c}" for lab, c in zip(labels, cols)))
    return a.selectExpr(*by, stack, "value_sum", "value_count")


def counters(df: DataFrame, kind: str, ts: str, unit: str = "day") -> DataFrame:
    """Events per kind and time window."""
    return df.groupBy(F.col(kind).alias("kind"), F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("_w")).agg(
        F.count(F.lit(1)).cast("long").alias("n")
    ).select("kind", F.date_format("_w", "yyyy-MM-dd").alias("window_start"), "n")


def inflight_peak(intervals: DataFrame, start: str, end: str, ranges: int | None = None) -> DataFrame:
    """The highest number of open intervals ``[start, end]`` and the first instant it is reached.

    Starts and ends are counted per instant; the running level is a two-level prefix sum over ranges of
    instants (``segmented.running_sum``), so neither a day nor all time is one task.
    """
    ends = intervals.where(F.col(end).isNotNull())
    plus = intervals.where(F.col(start).isNotNull()).select(F.col(start).cast("timestamp").alias("t"), F.lit(1).alias("p"), F.lit(0).alias("m"))
    minus = ends.select(F.col(end).cast("timestamp").alias("t"), F.lit(0).alias("p"), F.lit(1).alias("m"))
    per_t = plus.unionByName(minus).groupBy("t").agg(F.sum("p").alias("p"), F.sum("m").alias("m"))
    ranged = by_ranges(per_t.withColumn("net", F.col("p") - F.col("m")), [], ["t"], ranges)
    # an interval that ends at an instant is still open at it
    lvl = running_sum(ranged, [], ["t"], "net", "after").select("t", (F.col("after") + F.col("m")).alias("peak"))
    top = lvl.agg(F.max(F.struct("peak", (-F.unix_micros("t")).alias("first"))).alias("x"))
    return top.select(
        F.col("x.peak").cast("long").alias("max_inflight"), F.date_format(F.timestamp_micros(-F.col("x.first")), "yyyy-MM-dd HH:mm:ss").alias("first_at")
    )


def index_health(index: DataFrame) -> DataFrame:
    """A5: size of the index (vectors, rows, tables), vector dimension and last indexing time."""
    return index.agg(
        F.count(F.lit(1)).cast("long").alias("vectors"),
        F.countDistinct("table", "pk").cast("long").alias("rows"),
        F.countDistinct("table").cast("long").alias("tables"),
        F.max(F.size("embedding")).cast("long").alias("dim"),
        F.max("indexed_at").cast("long").alias("last_indexed_at"),
    )
