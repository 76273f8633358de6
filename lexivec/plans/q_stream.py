"""Streaming incremental indexing (T1, T2, T5, T6) driven by snapshots derived from documents."""

from __future__ import annotations

from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import HashingEmbedder
from lexivec.plans.catalog import query
from lexivec.plans.q_incremental import _BASE, _v1, _v2
from lexivec.session import scratch_path
from lexivec.sources.index_store import IndexStore
from lexivec.streaming.index_stream import MANIFEST, start_index_stream

CFG = RetrievalConfig()
T0 = 1_700_000_000


def land(spark, base: str, number: int, snap, files: int = 4) -> None:
    """A complete snapshot of several files, then its manifest."""
    path = f"{base}/landing/snapshot={number}"
    parts = snap.rdd.getNumPartitions()
    (snap if parts >= files else snap.repartition(files)).write.parquet(path)
    spark.createDataFrame([(number, path)], MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifests")


def drain(spark, base: str, store: IndexStore, cfg: RetrievalConfig) -> None:
    """Start the stream, process what has landed, and stop."""
    q = start_index_stream(
        spark, f"{base}/manifests", "documents", ("doc_id",), store, f"{base}/run_log", f"{base}/checkpoint",
        cfg, HashingEmbedder(cfg.embed_dim), clock=lambda b: T0 + 60 * b, available_now=True,
    )
    q.awaitTermination()


def run_stream_incremental(spark, sf_dir, cfg: RetrievalConfig = CFG):
    """Two snapshots (v1 then v2) land one after the other; the stream is started, drained and
    stopped after each, so the second run also exercises recovery from the checkpoint."""
    base = scratch_path(spark, "stream-incremental")
    store = IndexStore(spark, f"{base}/index")
    for i, snap in enumerate([_v1(spark, sf_dir).df, _v2(spark, sf_dir).df], start=1):
        land(spark, base, i, snap)
        drain(spark, base, store, cfg)
    return spark.read.parquet(f"{base}/run_log"), store, base


_REPORT = """SELECT {batch}::BIGINT AS batch_id, ({t0} + 60 * {batch})::BIGINT AS ts, 'documents' AS tables, {added} AS added_vectors, {rows} AS reembedded_rows,
       {skipped} AS skipped_rows, {deleted} AS deleted_vectors, {gone} AS deleted_rows, {total} AS total_meta, true AS saved"""


@query(
    "stream_incremental",
    sql=_BASE
    + _REPORT.format(
        batch=0, t0=T0, added="(SELECT count(*) FROM c1)::BIGINT", rows="(SELECT count(DISTINCT pk) FROM c1)::BIGINT", skipped="0::BIGINT",
        deleted="0::BIGINT", gone="0::BIGINT", total="(SELECT count(*) FROM c1)::BIGINT",
    )
    + "\nUNION ALL "
    + _REPORT.format(
        batch=1, t0=T0, added="(SELECT count(*) FROM added)::BIGINT", rows="(SELECT count(DISTINCT pk) FROM added)::BIGINT",
        skipped="(SELECT count(*) FROM cls WHERE change = 'unchanged')::BIGINT",
        deleted="""((SELECT coalesce(sum(n_existing), 0) FROM cls WHERE change IN ('changed', 'missing'))
        + (SELECT count(*) FROM c1 JOIN cls USING ("table", pk) WHERE change = 'unchanged') - (SELECT count(*) FROM kept))::BIGINT""",
        gone="(SELECT count(*) FROM cls WHERE change = 'missing')::BIGINT", total="((SELECT count(*) FROM kept) + (SELECT count(*) FROM added))::BIGINT",
    ),
)
def stream_incremental_q(spark, sf_dir):
    """Run log of the streaming index job over two snapshots of several files, deletes on: one
    report per snapshot."""
    log, _, _ = run_stream_incremental(spark, sf_dir, CFG.with_(delete_missing=True))
    return log.select(
        "batch_id", "ts", "tables", "added_vectors", "reembedded_rows", "skipped_rows", "deleted_vectors", "deleted_rows",
        "total_meta", "saved",
    )
