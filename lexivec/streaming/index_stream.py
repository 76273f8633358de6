"""Periodic incremental indexing as a Structured Streaming job.

A snapshot of a source table is a folder with any number of files. When it is complete, a manifest
(one JSON line: snapshot number, path) lands in the manifest folder, and that is what the stream reads.
So the unit of work is a whole snapshot, and "missing" rows are those that are in none of its files.
Every micro-batch

1. reads its snapshot and keeps the last version per key (T2); a snapshot older than one that was
   processed before is passed over, so a late manifest never overwrites newer rows,
2. turns the rows into row documents and runs ``incremental_update`` against the current
   index version (only new / changed rows are embedded),
3. writes the report, with the snapshot and the batch, to the snapshot's own folder of the run log
   (T6), and
4. writes the buckets of the rows that differ as a new index version when the report says something
   changed (U12).

``trigger(processingTime='60 seconds')`` is the original cadence; tests use ``availableNow``.
A batch that is replayed after a failure keeps the report it wrote before, and its update is a
no-op if the index was saved; a half written version never gets a commit marker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import Embedder
from lexivec.operators.incremental import incremental_update
from lexivec.operators.rowdocs import row_docs
from lexivec.sources.index_store import IndexStore
from lexivec.sources.tables import TableSpec


def last_version_per_key(batch: DataFrame, key: tuple[str, ...], version_col: str | None) -> DataFrame:
    """One row per key, the highest ``version_col`` (partitioned window, bounded by key). Rows are
    shuffled only if some key comes twice, which the keys alone tell."""
    if batch.groupBy(*key).count().where("count > 1").isEmpty():
        return batch
    if version_col is None:
        return batch.dropDuplicates(list(key))
    w = Window.partitionBy(*key).orderBy(F.col(version_col).desc())
    return batch.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


MANIFEST = "snapshot long, path string"


def _last_snapshot(spark: SparkSession, run_log: str) -> int | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(run_log)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(run_log).agg(F.max("snapshot")).first()[0]


def start_index_stream(
    spark: SparkSession,
    manifests: str,
    table: str,
    key: tuple[str, ...],
    store: IndexStore,
    run_log: str,
    checkpoint: str,
    cfg: RetrievalConfig,
    embedder: Embedder,
    clock: Callable[[int], int],
    version_col: str | None = None,
    available_now: bool = False,
    interval: str = "60 seconds",
):
    """Start the stream over a folder of manifests; returns the ``StreamingQuery``."""

    def one_snapshot(snapshot: int, path: str, batch_id: int) -> None:
        last = _last_snapshot(spark, run_log)
        if last is not None and snapshot < last:
            return
        now_ts = int(clock(batch_id))
        snap = last_version_per_key(spark.read.parquet(path), key, version_col)
        if version_col is not None:
            snap = snap.drop(version_col)
        current = row_docs(TableSpec(table, snap, key), cfg)
        res = incremental_update(store.load(), current, cfg, embedder, now_ts, [table])
        rep = res.report.collect()[0].asDict()  # one row of counters
        if snapshot != last:
            log = spark.createDataFrame([{**rep, "snapshot": int(snapshot), "batch_id": int(batch_id), "ts": now_ts}])
            log.write.mode("overwrite").parquet(f"{run_log}/run={int(snapshot)}")
        if rep["saved"]:
            store.save(res.index, res.touched)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        for m in batch.orderBy("snapshot").collect():  # one manifest file: one line a snapshot
            one_snapshot(m.snapshot, m.path, batch_id)

    reader = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(manifests)
    w = reader.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
