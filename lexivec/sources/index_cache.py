"""Build-once index tables for query-time jobs.

Retrieval reads a stored index (as the original read its vector service); it is rebuilt only when
its inputs change. The key covers the source files (path, size, modification time), the build
configuration and the embedder's model, so a stale index is never served. Storage is an ``IndexStore``
in the shared work folder (commit marker = complete).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import Embedder
from lexivec.operators.index_build import build_index
from lexivec.session import work_dir
from lexivec.sources.index_store import IndexStore
from lexivec.sources.tables import TableSpec


def _fingerprint_inputs(spark: SparkSession, paths: list[str]) -> list:
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for st in fs.listStatus(path):
            out.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(out)


def cached_index(
    spark: SparkSession,
    specs: list[TableSpec],
    source_paths: list[str],
    cfg: RetrievalConfig,
    embedder: Embedder,
    indexed_at: int,
) -> DataFrame:
    if not embedder.identity:
        raise ValueError("an index is only stored for an embedder that names its model")
    key = {
        "inputs": _fingerprint_inputs(spark, source_paths),
        "tables": [(s.name, s.pk, s.text_cols) for s in specs],
        "cfg": [cfg.chunk_chars, cfg.min_chunk_chars, cfg.combine_row_columns, cfg.include_column_names,
                list(cfg.always_include_patterns), list(cfg.fingerprint_include_patterns), cfg.index_row_limit],
        "embedder": embedder.identity,
        "indexed_at": indexed_at,
    }
    h = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:24]
    store = IndexStore(spark, f"{work_dir(spark)}/index-cache-buckets/{h}")
    if store.current_version() is None:
        store.save(build_index(specs, cfg, embedder, indexed_at))
    return store.load()
