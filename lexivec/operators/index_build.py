"""Index build (B1-B5): scan -> row documents -> chunks -> embed, one lazy plan, no driver collection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexivec.config import RetrievalConfig
from lexivec.functions.vectors import check_dim
from lexivec.operators.chunking import chunk_docs
from lexivec.operators.embedding import Embedder
from lexivec.operators.plan_utils import spread
from lexivec.operators.rowdocs import corpus_docs
from lexivec.sources.tables import TableSpec

INDEX_COLUMNS = [
    "id", "table", "pk", "column", "chunk_idx", "chunk", "doc_name", "columns", "temporal", "row_fp", "indexed_at", "embedding",
]


def build_chunks(specs: list[TableSpec], cfg: RetrievalConfig, indexed_at: int, column_specs: list[str] | None = None) -> DataFrame:
    spread_specs = [TableSpec(s.name, spread(s.df), s.pk, s.text_cols) for s in specs]
    return chunk_docs(corpus_docs(spread_specs, cfg, column_specs), cfg, indexed_at)


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Entries with vectors; a vector of another dimension than the embedder's fails the job."""
    e = embedder.embed_df(chunks, "chunk", "embedding")
    return e.withColumn("embedding", check_dim("embedding", embedder.dim)).select(*INDEX_COLUMNS)


def build_index(
    specs: list[TableSpec],
    cfg: RetrievalConfig,
    embedder: Embedder,
    indexed_at: int,
    column_specs: list[str] | None = None,
) -> DataFrame:
    return embed_chunks(build_chunks(specs, cfg, indexed_at, column_specs), embedder)
