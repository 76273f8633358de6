"""Hybrid retrieval queries over documents (index) with benchmark passages as the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.operators.embedding import HashingEmbedder
from lexivec.operators.hybrid import hybrid_search
from lexivec.sources.index_cache import cached_index
from lexivec.plans import hybrid_sql as HS
from lexivec.plans.catalog import query
from lexivec.sources.tables import read_table, spec, table_path

CFG = RetrievalConfig()
INDEXED_AT = 1_700_000_000
NOW = "1999-01-01 00:00:00"


def stored_index(spark, sf_dir, cfg: RetrievalConfig = CFG):
    """The documents index: a stored table, built once per input version (see sources.index_cache)."""
    docs, emb = spec(spark, sf_dir, "documents"), HashingEmbedder(cfg.embed_dim, cfg.min_token_len)
    return cached_index(spark, [docs], [table_path(sf_dir, "documents")], cfg, emb, INDEXED_AT)


def run_hybrid(spark, sf_dir, cfg: RetrievalConfig = CFG):
    docs = spec(spark, sf_dir, "documents")
    emb = HashingEmbedder(cfg.embed_dim, cfg.min_token_len)
    index = stored_index(spark, sf_dir, cfg)
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return hybrid_search(index, [docs], queries, cfg, emb, F.to_timestamp(F.lit(NOW)))


@query("hybrid_merge", sql=HS.MERGE_SQL)
def hybrid_merge_q(spark, sf_dir):
    m = run_hybrid(spark, sf_dir)["merged"]
    return m.select(
        "query_id", "table", "pk", "snippet", F.round("score_ft", 6).alias("score_ft"),
        F.round("score_sem", 6).alias("score_sem"), "combined_text", "sem_only",
    )


@query("hybrid_rank", sql=HS.RANK_SQL)
def hybrid_rank_q(spark, sf_dir):
    r = run_hybrid(spark, sf_dir)["ranked"]
    return r.select(F.col("rnk").cast("long").alias("rnk"), "query_id", "table", "pk", "score", F.round("score_sem", 6).alias("score_sem"))


@query("hybrid_fulltext", sql=HS.FULLTEXT_RANK_SQL)
def hybrid_fulltext_q(spark, sf_dir):
    """Hybrid retrieval in full-text mode: whole passages follow the boolean grammar, their scores and
    the vector scores are blended."""
    r = run_hybrid(spark, sf_dir, CFG.with_(fulltext_required=True))["ranked"]
    return r.select(
        F.col("rnk").cast("long").alias("rnk"), "query_id", "table", "pk", F.round("score_ft", 6).alias("score_ft"),
        F.round("score_sem", 6).alias("score_sem"), "snippet", "sem_only",
    )


@query("hybrid_enriched", sql=HS.ENRICHED_SQL)
def hybrid_enriched_q(spark, sf_dir):
    e = run_hybrid(spark, sf_dir)["enriched"]
    return e.where(F.col("rnk") <= CFG.enrich_top).select(
        "query_id", F.col("rnk").cast("long").alias("rnk"), "pk", "snippet", "enriched"
    )


@query("hybrid_context", sql=HS.CONTEXT_SQL)
def hybrid_context_q(spark, sf_dir):
    return run_hybrid(spark, sf_dir)["lines"].select("query_id", F.col("rnk").cast("long").alias("rnk"), "line")


@query("hybrid_prompt", sql=HS.PROMPT_SQL)
def hybrid_prompt_q(spark, sf_dir):
    return run_hybrid(spark, sf_dir)["prompts"]


@query("like_search", sql=HS.LIKE_SQL)
def like_search_q(spark, sf_dir):
    return run_hybrid(spark, sf_dir)["lex"].select("query_id", "table", "pk", "snippet", F.col("lex_rank").cast("long").alias("lex_rank"))


@query("semantic_hits", sql=HS.SEM_SQL)
def semantic_hits_q(spark, sf_dir):
    s = run_hybrid(spark, sf_dir)["sem"]
    return s.select("query_id", "id", F.col("sem_rank").cast("long").alias("sem_rank"), "score_sem")
