"""Chunks and the index build.

``chunks`` schema:
    id, table, pk, column, chunk_idx INT, chunk, doc_name, columns, temporal, row_fp, indexed_at BIGINT

Chunking is a ``posexplode`` of a filtered slice array: a generator-shaped operator without a
UDTF, inside codegen. The chunk index counts kept chunks only (the filter runs before the
explode). ``indexed_at`` is a parameter, never the wall clock, so builds are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.config import ID_SEP, RetrievalConfig
from lexivec.functions.text import chunk_array

CHUNK_COLUMNS = ["id", "table", "pk", "column", "chunk_idx", "chunk", "doc_name", "columns", "temporal", "row_fp", "indexed_at"]


def chunk_id(table: Column, pk: Column, idx: Column, column: Column | None = None) -> Column:
    """``table::pk::idx``; single-column builds put the column in the ID (so the columns of
    one row do not overwrite each other)."""
    if column is None:
        return F.concat_ws(ID_SEP, table, pk, idx.cast("string"))
    return F.when(column == "*", F.concat_ws(ID_SEP, table, pk, idx.cast("string"))).otherwise(
        F.concat_ws(ID_SEP, table, pk, column, idx.cast("string"))
    )


def fallback_id(table: Column, pk: Column, chunk: Column) -> Column:
    """``table::pk::sha1(chunk)[:16]`` with defaults ``unknown`` and empty."""
    return F.concat_ws(
        ID_SEP, F.coalesce(table, F.lit("unknown")), F.coalesce(pk, F.lit("")), F.substring(F.sha1(F.coalesce(chunk, F.lit(""))), 1, 16)
    )


def doc_name(table: Column, pk: Column) -> Column:
    """P10."""
    return F.concat_ws(ID_SEP, table, pk)


def chunk_docs(docs: DataFrame, cfg: RetrievalConfig, indexed_at: int) -> DataFrame:
    """P6/P7 + metadata: one row per kept chunk of every row document."""
    exploded = docs.select(
        "*", F.posexplode(chunk_array(F.col("text"), cfg.chunk_chars, cfg.min_chunk_chars)).alias("chunk_idx", "chunk")
    )
    return exploded.select(
        chunk_id(F.col("table"), F.col("pk"), F.col("chunk_idx"), F.col("column")).alias("id"),
        "table",
        "pk",
        "column",
        F.col("chunk_idx").cast("int").alias("chunk_idx"),
        "chunk",
        doc_name(F.col("table"), F.col("pk")).alias("doc_name"),
        "columns",
        "temporal",
        "row_fp",
        F.lit(indexed_at).cast("long").alias("indexed_at"),
    )


def id_index(id_col: str = "id") -> Column:
    """Integer after the last ``::`` of an ID, 0 when it is not an integer (legacy order key)."""
    return F.coalesce(F.expr(f"try_cast(substring_index(`{id_col}`, '::', -1) AS INT)"), F.lit(0))


def legacy_fingerprint(entries: DataFrame) -> DataFrame:
    """Rebuild a row fingerprint from stored chunks ordered by the index in their ID.

    Grouped per row, so the collected list is bounded by the chunks of one row.
    """
    idx = id_index("id")
    return (
        entries.where(F.col("table").isNotNull() & F.col("pk").isNotNull())
        .groupBy("table", "pk")
        .agg(F.array_sort(F.collect_list(F.struct(idx.alias("i"), F.coalesce("chunk", F.lit("")).alias("c")))).alias("_cs"))
        .select(
            "table",
            "pk",
            F.substring(
                F.sha2(F.concat(F.array_join(F.transform("_cs", lambda s: s["c"]), ""), F.lit("\x00")), 256), 1, 32
            ).alias("legacy_fp"),
        )
    )


def assert_nonempty(chunks: DataFrame) -> DataFrame:
    """No text at all is an error (one cheap action on the first row)."""
    if chunks.limit(1).count() == 0:
        raise RuntimeError("No texts collected for indexing.")
    return chunks
