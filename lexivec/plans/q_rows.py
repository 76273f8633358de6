"""Row text, chunk, ID and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.operators.chunking import chunk_docs, fallback_id, legacy_fingerprint
from lexivec.operators.index_build import build_chunks
from lexivec.operators.rowdocs import column_docs, row_docs
from lexivec.plans import duck as D
from lexivec.plans.catalog import query
from lexivec.sources.tables import spec

CFG = RetrievalConfig()
INDEXED_AT = 1_700_000_000  # fixed build time of the test index


def _docs(spark, sf_dir, table, cfg=CFG):
    return row_docs(spec(spark, sf_dir, table), cfg)


def _doc_chunks(spark, sf_dir, cfg=CFG):
    return build_chunks([spec(spark, sf_dir, "documents")], cfg, INDEXED_AT)


_ROWTEXT_OUT = ["table", "pk", "text", "columns", "row_fp"]


def _rowtext_out(df):
    return df.select("table", "pk", "text", F.array_join("columns", ",").alias("columns"), "row_fp")


@query(
    "row_text",
    sql=f"""
{D.row_docs_cte('part', 'p_partkey', ['p_name', 'p_brand', 'p_type'])}
UNION ALL
{D.row_docs_cte('customer', 'c_custkey', ['c_name', 'c_mktsegment'])}
""",
)
def row_text_q(spark, sf_dir):
    return _rowtext_out(_docs(spark, sf_dir, "part")).unionByName(_rowtext_out(_docs(spark, sf_dir, "customer")))


@query("row_text_labelled", sql=D.row_docs_cte("part", "p_partkey", ["p_name", "p_brand", "p_type"], labelled=True))
def row_text_labelled_q(spark, sf_dir):
    return _rowtext_out(_docs(spark, sf_dir, "part", CFG.with_(include_column_names=True)))


@query(
    "single_column_docs",
    sql=f"""
SELECT 'documents' AS "table", doc_id::VARCHAR AS pk, 'text' AS "column", length(text)::BIGINT AS n_chars,
       {D.fp('text')} AS row_fp FROM documents WHERE text IS NOT NULL
UNION ALL
SELECT 'part', p_partkey::VARCHAR, 'p_type', length(p_type)::BIGINT, {D.fp('p_type')} FROM part WHERE p_type IS NOT NULL
""",
)
def single_column_docs_q(spark, sf_dir):
    a = column_docs(spec(spark, sf_dir, "documents"), "text", CFG)
    b = column_docs(spec(spark, sf_dir, "part"), "p_type", CFG)
    return a.unionByName(b).select("table", "pk", "column", F.length("text").cast("long").alias("n_chars"), "row_fp")


@query(
    "chunk_documents",
    sql=f"""
SELECT 'documents::' || pk || '::text::' || chunk_idx AS id, pk, chunk_idx, chunk
FROM ({D.chunks_of("(SELECT doc_id::VARCHAR AS pk, text FROM documents WHERE text IS NOT NULL)")})
""",
)
def chunk_documents_q(spark, sf_dir):
    """Single-column build of documents.text: every kept 1,200-char chunk with its ID."""
    docs = column_docs(spec(spark, sf_dir, "documents"), "text", CFG)
    return chunk_docs(docs, CFG, INDEXED_AT).select("id", "pk", "chunk_idx", "chunk")


_DOC_ROWS = D.row_docs_cte("documents", "doc_id", ["text", "lang", "source"])


@query(
    "chunk_ids",
    sql=f"""
SELECT 'documents::' || pk || '::' || chunk_idx AS id, 'documents::' || pk AS doc_name, chunk_idx,
       length(chunk)::BIGINT AS chunk_chars, row_fp, columns
FROM ({D.chunks_of(f"({_DOC_ROWS})")})
""",
)
def chunk_ids_q(spark, sf_dir):
    """Combined-row build of documents (text, lang, source): IDs, names, sizes, fingerprints."""
    return _doc_chunks(spark, sf_dir).select(
        "id", "doc_name", "chunk_idx", F.length("chunk").cast("long").alias("chunk_chars"), "row_fp",
        F.array_join("columns", ",").alias("columns"),
    )


@query(
    "chunk_hash_ids",
    sql=f"""
SELECT 'documents::' || pk || '::' || substr(sha1(chunk), 1, 16) AS fallback_id, pk, chunk_idx
FROM ({D.chunks_of(f"({_DOC_ROWS})")})
""",
)
def chunk_hash_ids_q(spark, sf_dir):
    c = _doc_chunks(spark, sf_dir)
    return c.select(fallback_id(F.col("table"), F.col("pk"), F.col("chunk")).alias("fallback_id"), "pk", "chunk_idx")


@query(
    "row_fingerprint",
    sql=f"""
SELECT "table", pk, row_fp FROM ({_DOC_ROWS})
UNION ALL
SELECT "table", pk, row_fp FROM ({D.row_docs_cte('orders', 'o_orderkey', ['o_orderstatus', 'o_orderpriority'])})
""",
)
def row_fingerprint_q(spark, sf_dir):
    a = _docs(spark, sf_dir, "documents").select("table", "pk", "row_fp")
    b = _docs(spark, sf_dir, "orders").select("table", "pk", "row_fp")
    return a.unionByName(b)


@query(
    "row_fingerprint_extras",
    sql=f"""
SELECT "table", pk, row_fp FROM (
{D.row_docs_cte('orders', 'o_orderkey', ['o_orderstatus', 'o_orderpriority'],
                extras=[D.ts_text('o_orderdate'), 'o_orderstatus'])})
""",
)
def row_fingerprint_extras_q(spark, sf_dir):
    """Fingerprint over the row text plus the raw values of columns matching 'date' or 'status'
    (sorted by lower-case name: o_orderdate, o_orderstatus)."""
    cfg = CFG.with_(fingerprint_include_patterns=("date", "status", "(bad"))
    return _docs(spark, sf_dir, "orders", cfg).select("table", "pk", "row_fp")


@query(
    "legacy_fingerprint",
    sql=f"""
WITH c AS ({D.chunks_of(f"({_DOC_ROWS})")})
SELECT "table", pk, legacy_fp, legacy_fp = row_fp AS same_as_row_fp FROM (
  SELECT "table", pk, any_value(row_fp) AS row_fp,
         substr(sha256(string_agg(chunk, '' ORDER BY chunk_idx) || chr(0)), 1, 32) AS legacy_fp
  FROM c GROUP BY "table", pk)
""",
)
def legacy_fingerprint_q(spark, sf_dir):
    """Index entries without a stored fingerprint: rebuild it from the chunks in ID order;
    it equals the row fingerprint unless a short tail chunk was dropped."""
    c = _doc_chunks(spark, sf_dir)
    lf = legacy_fingerprint(c.select("id", "table", "pk", "chunk"))
    cur = c.select("table", "pk", "row_fp").dropDuplicates(["table", "pk"])
    return lf.join(cur, ["table", "pk"]).select(
        "table", "pk", "legacy_fp", (F.col("legacy_fp") == F.col("row_fp")).alias("same_as_row_fp")
    )
