"""Hybrid retrieval for a DataFrame of queries.

    queries ─┬─ lexical search (LIKE or BM25) ────────────────────────────┐
             └─ embed (distinct keys) ─ exact top-k over the index ─ fold ─┴─ full outer join
                 ─ rank (window per query) ─ enrich top rows (broadcast key lookup) ─ context ─ prompt

Every per-query collection is bounded: the fold by ``k_vec`` chunks per row, the prompt by
``context_snippets`` lines per query. Joins against the big tables (index metadata, source rows
for enrichment) broadcast the small, bounded side (queries x k) behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.config import CONTEXT_HEADER, SNIPPET_SEP, RetrievalConfig
from lexivec.functions.text import py_strip, value_text
from lexivec.functions.timeparse import status_of
from lexivec.operators.embedding import Embedder, embed_queries
from lexivec.operators.lexical import lexical_search
from lexivec.operators.plan_utils import bounded_broadcast
from lexivec.operators.vector_search import vector_topk
from lexivec.sources.tables import TableSpec


def semantic_hits(index: DataFrame, queries: DataFrame, cfg: RetrievalConfig, embedder: Embedder, now: Column, n_q: int) -> DataFrame:
    """``(query_id, id, table, pk, chunk, score_sem, sem_rank, status, indexed_at)``."""
    qv = embed_queries(queries.select("query_id", "text"), embedder)
    top = vector_topk(
        index.select("id", "embedding"),
        qv,
        cfg.k_vec,
        dim=embedder.dim,
        id_col="id",
        vec_col="embedding",
        max_broadcast_bytes=cfg.broadcast_max_bytes,
        query_batch_rows=cfg.query_batch_rows,
    )
    meta = index.select("id", "table", "pk", "chunk", "temporal", "indexed_at")
    hits = meta.join(bounded_broadcast(top, n_q * cfg.k_vec, 96, cfg), "id")
    return hits.select(
        "query_id",
        "id",
        "table",
        "pk",
        "chunk",
        F.col("score").alias("score_sem"),
        F.col("rnk").alias("sem_rank"),
        status_of(F.col("temporal"), now, cfg.status_timezone).alias("status"),
        "indexed_at",
    )


def merge_hits(lex: DataFrame, sem: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Outer join on (query, table, pk) and the ordered fold of a row's chunks."""
    n250, n500 = cfg.sem_snippet_chars, cfg.lex_snippet_chars
    sem_agg = sem.groupBy("query_id", "table", "pk").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("sem_rank").alias("r"),
                    F.col("score_sem").alias("s"),
                    F.col("chunk").alias("c"),
                    F.col("status").alias("st"),
                    F.col("indexed_at").alias("ia"),
                )
            )
        ).alias("chunks")
    )
    j = lex.join(sem_agg, ["query_id", "table", "pk"], "full_outer")
    has_lex = F.col("lex_rank").isNotNull()
    chunks = F.coalesce(F.col("chunks"), F.array().cast(sem_agg.schema["chunks"].dataType))
    first = F.try_element_at(chunks, F.lit(1))
    init = F.when(has_lex, F.coalesce(F.substring("snippet", 1, n500), F.lit(""))).otherwise(F.substring(first["c"], 1, n250))
    rest = F.when(has_lex, chunks).otherwise(F.slice(chunks, 2, cfg.k_vec + 1))

    def step(acc, c):
        ns = F.substring(F.coalesce(c["c"], F.lit("")), 1, n250)
        return F.when((ns != "") & ~F.contains(acc, ns), F.substring(F.concat(acc, F.lit(SNIPPET_SEP), ns), 1, n500)).otherwise(acc)

    scores = F.transform(chunks, lambda c: c["s"])
    score_sem = F.when(
        has_lex, F.greatest(F.lit(0.0), F.coalesce(F.array_max(scores), F.lit(0.0)))
    ).otherwise(F.array_max(scores))
    return j.select(
        "query_id",
        "table",
        "pk",
        F.lit("").alias("title"),
        F.aggregate(rest, init, step).alias("snippet"),
        F.coalesce(F.col("score_ft"), F.lit(0.0)).alias("score_ft"),
        score_sem.alias("score_sem"),
        F.try_element_at(F.filter(chunks, lambda c: c["c"] != ""), F.lit(1))["c"].alias("combined_text"),
        F.try_element_at(F.filter(chunks, lambda c: c["st"].isNotNull() & (c["st"] != "")), F.lit(1))["st"].alias("status"),
        F.try_element_at(F.filter(chunks, lambda c: c["ia"].isNotNull() & (c["ia"] != 0)), F.lit(1))["ia"].alias("indexed_at"),
        (~has_lex).alias("sem_only"),
        "lex_rank",
        first["r"].alias("first_sem_rank"),
    )


def rank_hits(merged: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Blended score, stable tie order (lexical hits in table then hit order, then
    semantic-only hits in rank order), cut at ``max(k_vec, 10)``."""
    score = F.lit(cfg.w_sem) * F.col("score_sem") + F.lit(cfg.w_ft) * F.col("score_ft")
    w = Window.partitionBy("query_id").orderBy(
        F.col("_sr").desc(), F.col("sem_only").asc(), F.col("_t").asc(), F.col("lex_rank").asc(), F.col("first_sem_rank").asc()
    )
    return (
        merged.withColumn("_sr", F.round(score, 6))
        .withColumn("_t", F.when(~F.col("sem_only"), F.col("table")))
        .withColumn("rnk", F.row_number().over(w))
        .where(F.col("rnk") <= cfg.final_k)
        .withColumn("score", F.col("_sr"))
        .drop("_sr", "_t")
    )


def enrichment(specs: list[TableSpec], keys: DataFrame, cfg: RetrievalConfig, n_keys_bound: int) -> DataFrame:
    """Full source row of each (table, pk) in ``keys`` as ``col: value`` text.

    One join per table: the source streams, the bounded key set is broadcast (inner join, so the
    small side may be broadcast). Returns ``(table, pk, enriched_head, terms_in)``.
    """
    out = None
    for s in specs:
        fields = s.fields()[: cfg.enrich_max_columns]
        parts = F.filter(
            F.array(
                *[
                    F.when(py_strip(value_text(F.col(f.name), f.dataType)) != "", F.concat(F.lit(f"{f.name}: "), py_strip(value_text(F.col(f.name), f.dataType))))
                    for f in fields
                ]
            ),
            lambda p: p.isNotNull(),
        )
        k = keys.where(F.col("table") == s.name).select("pk")
        # Late materialisation: select the few matching rows first (the key set is broadcast),
        # then build the row text only for them.
        matched = s.df.withColumn("_pk", s.pk_col()).join(
            bounded_broadcast(k.withColumnRenamed("pk", "_pk"), n_keys_bound, 64, cfg), "_pk", "left_semi"
        )
        full = F.array_join(parts, SNIPPET_SEP)
        # Only a bounded head of the row text leaves the scan, plus which essential terms the
        # whole text contains (the swap rule tests the uncut text).
        head = F.substring(full, 1, max(cfg.row_enrich_chars, cfg.lex_snippet_chars))
        terms = F.filter(F.array(*[F.lit(t) for t in cfg.essential_terms]), lambda t: F.contains(F.lower(full), t))
        e = matched.select(
            F.lit(s.name).alias("table"), F.col("_pk").alias("pk"), head.alias("enriched_head"), terms.alias("terms_in")
        )
        out = e if out is None else out.unionByName(e)
    return out


def enrich(ranked: DataFrame, specs: list[TableSpec], cfg: RetrievalConfig, n_q: int) -> DataFrame:
    """W5 + C4 + C5: enrich the first ``enrich_top`` rows; swap the snippet for the enriched
    text when it names an essential term the snippet lacks."""
    if not cfg.row_enrich:
        return ranked.withColumn("enriched", F.lit(None).cast("string"))
    top = ranked.where(F.col("rnk") <= cfg.enrich_top)
    bound = n_q * cfg.enrich_top
    keys = top.select("table", "pk").distinct()
    # An empty text is told apart after the joins: a filter here would be pushed below the key
    # join, and the text of every source row would be built for it.
    en = enrichment(specs, keys, cfg, bound)
    per_row = 64 + 4 * max(cfg.row_enrich_chars, cfg.lex_snippet_chars)
    j = ranked.join(bounded_broadcast(en, bound, per_row, cfg), ["table", "pk"], "left")
    is_top = (F.col("rnk") <= cfg.enrich_top) & (F.coalesce("enriched_head", F.lit("")) != "")
    low_s = F.lower(F.col("snippet"))
    swap = F.exists(F.col("terms_in"), lambda t: ~F.contains(low_s, t))
    return j.select(
        *[c for c in ranked.columns if c != "snippet"],
        F.when(is_top & swap, F.substring("enriched_head", 1, cfg.lex_snippet_chars)).otherwise(F.col("snippet")).alias("snippet"),
        F.when(is_top, F.substring("enriched_head", 1, cfg.row_enrich_chars)).alias("enriched"),
    )


def context_lines(results: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """One line per result among the first ``context_snippets``."""
    r = results.where(F.col("rnk") <= cfg.context_snippets)

    def nz(c):
        return F.when(F.col(c) != "", F.col(c))

    raw = py_strip(F.translate(F.coalesce(nz("enriched"), nz("combined_text"), nz("snippet"), F.lit("")), "\n", " "))
    r = r.withColumn("_raw", raw).where(F.col("_raw") != "")
    n = F.length("_raw")
    lim = cfg.context_chars

    def widen(m, t):
        idx = F.position(t, F.lower(F.col("_raw"))) - 1
        tl = F.length(t)
        return F.when(
            (idx >= 0) & (idx + tl > m), F.least(F.greatest(idx + tl + 40, m), F.least(n, F.lit(lim * 2)))
        ).otherwise(m)

    m = F.aggregate(F.array(*[F.lit(t) for t in cfg.essential_terms]), F.least(n, F.lit(lim)), widen)
    bits = F.filter(
        F.array(
            F.concat(F.lit("table="), F.col("table")),
            F.concat(F.lit("pk="), F.col("pk")),
            F.when(F.col("status").isNotNull() & (F.col("status") != ""), F.concat(F.lit("status="), F.col("status"))),
            F.when(F.col("indexed_at").isNotNull() & (F.col("indexed_at") != 0), F.concat(F.lit("indexed_at="), F.col("indexed_at").cast("string"))),
        ),
        lambda b: b.isNotNull(),
    )
    line = F.concat(F.lit("- "), F.substring(F.col("_raw"), F.lit(1), m), F.lit(" ["), F.array_join(bits, ", "), F.lit("]"))
    return r.select("query_id", "rnk", line.alias("line"))


def prompts(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """Query text, then the context block; a query without lines is the prompt alone."""
    agg = lines.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "line"))).alias("_ls"))
    body = F.array_join(F.transform("_ls", lambda s: s["line"]), "\n")
    j = queries.select("query_id", "text").join(agg, "query_id", "left")
    return j.select(
        "query_id",
        F.when(F.col("_ls").isNotNull(), F.concat(F.col("text"), F.lit("\n\n"), F.lit(CONTEXT_HEADER), body))
        .otherwise(F.col("text"))
        .alias("prompt"),
    )


def hybrid_search(
    index: DataFrame,
    specs: list[TableSpec],
    queries: DataFrame,
    cfg: RetrievalConfig,
    embedder: Embedder,
    now: Column,
) -> dict[str, DataFrame]:
    """All stages of one hybrid retrieval run, as lazily planned DataFrames."""
    n_q = queries.count()
    lex = lexical_search(specs, queries, cfg)
    sem = semantic_hits(index, queries, cfg, embedder, now, n_q)
    merged = merge_hits(lex, sem, cfg)
    ranked = rank_hits(merged, cfg)
    enriched = enrich(ranked, specs, cfg, n_q)
    lines = context_lines(enriched, cfg)
    return {
        "lex": lex,
        "sem": sem,
        "merged": merged,
        "ranked": ranked,
        "enriched": enriched,
        "lines": lines,
        "prompts": prompts(queries, lines),
    }
