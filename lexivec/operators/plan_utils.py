"""Physical-plan helpers: broadcasting only behind a proven or counted size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig


def bounded_broadcast(df: DataFrame, max_rows: int, row_bytes: int, cfg: RetrievalConfig) -> DataFrame:
    """``broadcast(df)`` when ``max_rows`` (an upper bound known from the plan, e.g. queries x k)
    times ``row_bytes`` fits the budget; otherwise the plain frame (shuffle join, AQE may still
    pick a broadcast at run time from real sizes)."""
    if max_rows * row_bytes <= cfg.broadcast_max_bytes:
        return F.broadcast(df)
    return df


def counted_broadcast(df: DataFrame, row_bytes: int, cfg: RetrievalConfig) -> DataFrame:
    """``broadcast(df)`` when its rows, counted, times ``row_bytes`` fit the budget; otherwise the
    plain frame (shuffle join). ``df`` is a stored table or a cheap projection of one."""
    return bounded_broadcast(df, df.count(), row_bytes, cfg)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rebalance before CPU-heavy per-row work (chunking, tokenising, embedding),
    but only when the input's size gives fewer file splits than the cluster can run at once, e.g. a
    small table stored as one row group. A 100 TB scan already has thousands of splits, so this
    adds no shuffle there. The size is the optimizer's own estimate; no job runs."""
    spark = df.sparkSession
    n = min_partitions or spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if size < n * split:
        return df.repartition(n)
    return df
