"""Full-text search (J3): BM25 top-k of many queries.

Queries that fit the broadcast budget are answered in two passes over the texts
(``operators.fulltext_scan``). Others from the stored, impact-ordered index, by MaxScore as joins. A term
can add at most its idf times its highest impact to a score.

1. A query's weakest terms, ``WEAK`` of its whole bound together, are left for later; a row without
   any of the other, *essential* terms cannot score more than the weak ones' bound.
2. Blocks of postings are skipped that cannot reach the k-th score: of some term of the query, k
   rows have at least a known weight (from ``blocks`` alone).
3. Essential postings give partial sums. The best ``2 k`` rows of a query by partial sum are scored in
   full, and their k-th score is a bound for all: a row is scored in full only if its partial sum and
   the weak terms' bound reach it.
4. If the weak terms' bound itself reaches that score (few rows match), the query is answered from
   all its postings.

Every step is a join on term or (query, row), partial aggregation or a window per query whose local
top-k runs before the shuffle. The query side is broadcast when its counted rows fit the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.functions.text import tokens
from lexivec.operators.fulltext_scan import scan_scores
from lexivec.operators.plan_utils import counted_broadcast
from lexivec.session import store_once
from lexivec.sources.tables import TableSpec
from lexivec.sources.text_index import TextIndex, text_columns, text_index

WEAK = 0.05
#: Scores are compared after rounding to six digits; bounds leave room for that.
SLACK = 1e-5
PAIR = ["query_id", "did"]


def query_terms(queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """Distinct tokens of each query: ``(query_id, term)``."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), cfg.min_token_len))).alias("term")).distinct()


def word_clauses(qterms: DataFrame) -> DataFrame:
    """Distinct words of queries as optional clauses of the boolean grammar."""
    word = F.array("term")
    return qterms.select(
        "query_id", F.xxhash64("term").alias("term_no"), F.lit("").alias("op"), F.lit("word").alias("kind"), word.alias("toks"),
        word.alias("exact"), F.lit(None).cast("string").alias("prefix"),
    )


def plan_terms(index: TextIndex, qterms: DataFrame, k: int, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, term, idf, essential, rest, level)``: ``rest`` bounds the query's weak terms,
    ``level`` is the lowest block of the term that is needed (null: none)."""
    qt = index.terms.join(counted_broadcast(qterms, 64, cfg), "term").select("query_id", "term", "idf", (F.col("idf") * F.col("top")).alias("ub"))
    by_query = Window.partitionBy("query_id")
    upto = by_query.orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    qt = qt.withColumn("total", F.sum("ub").over(by_query)).withColumn("essential", F.sum("ub").over(upto) > WEAK * F.col("total"))
    qt = store_once(qt.withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("ub")).otherwise(0.0)).over(by_query)), "query-terms")
    blocks = index.blocks.join(counted_broadcast(qt, 96, cfg), "term")
    down = Window.partitionBy("query_id", "term").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("rows", F.sum("n").over(down))
    blocks = blocks.withColumn("reach", F.max(F.when(F.col("rows") >= k, F.col("idf") * F.col("low"))).over(by_query))
    needed = F.coalesce(F.col("idf") * F.col("top") + F.col("total") - F.col("ub") >= F.col("reach") - SLACK, F.lit(True))
    return blocks.groupBy("query_id", "term", "idf", "essential", "rest").agg(F.min(F.when(needed, F.col("level"))).alias("level"))


def weights(index: TextIndex, plan: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, did, w)`` of the planned terms' postings in needed blocks."""
    post = index.postings.select("term", "did", "imp", F.col("level").alias("own"))
    hit = post.join(counted_broadcast(plan.select("query_id", "term", "idf", "level"), 96, cfg), "term").where(F.col("own") >= F.col("level"))
    return hit.select("query_id", "did", (F.col("idf") * F.col("imp")).alias("w"))


def complete(index: TextIndex, pairs: DataFrame, weak: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """``(query_id, did, score)``: partial sums of ``pairs`` (stored) plus their weak terms."""
    every = weights(index, weak.withColumn("level", F.lit(0)), cfg)
    more = every.join(counted_broadcast(pairs.select(*PAIR), 24, cfg), PAIR).groupBy(*PAIR).agg(F.sum("w").alias("more"))
    return pairs.join(more, PAIR, "left").select(*PAIR, (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("score"))


def scored_pairs(index: TextIndex, qterms: DataFrame, k: int, cfg: RetrievalConfig, report: dict | None = None) -> DataFrame:
    """``(query_id, did, score)`` holding every query's best ``k`` rows, ties at the end included.
    ``report`` takes how many pairs were scored in full."""
    plan = store_once(plan_terms(index, qterms, k, cfg), "query-plan")
    essential, weak = plan.where("essential and level is not null"), plan.where("not essential")
    rest = plan.groupBy("query_id").agg(F.first("rest").alias("rest"))
    part = store_once(weights(index, essential, cfg).groupBy(*PAIR).agg(F.sum("w").alias("part")), "partial-sums")
    best = Window.partitionBy("query_id").orderBy(F.col("part").desc(), "did")
    seeds = store_once(part.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * k).drop("r"), "seeds")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = complete(index, seeds, weak, cfg).withColumn("r", F.row_number().over(by_score)).where(F.col("r") == k)
    bound = rest.join(kth.select("query_id", F.col("score").alias("kth")), "query_id", "left")
    # proven: no row without an essential term can be among the best
    bound = store_once(bound.withColumn("proven", F.coalesce(F.col("rest") < F.col("kth") - SLACK, F.col("rest") == 0.0)), "score-bounds")
    sides = counted_broadcast(bound, 32, cfg)
    likely = part.join(sides, "query_id").where(F.col("proven") & (F.col("part") + F.col("rest") >= F.coalesce("kth", F.lit(0.0)) - SLACK))
    likely = store_once(likely.select(*PAIR, "part"), "survivors")
    open_plan = plan.join(bound.where("not proven").select("query_id"), "query_id", "left_semi").withColumn("level", F.lit(0))
    whole = weights(index, open_plan, cfg).groupBy(*PAIR).agg(F.sum("w").alias("score"))
    if report is not None:
        report.update(partial=part.count(), seeds=seeds.count(), survivors=likely.count(), whole=whole.count(), queries=rest.count())
    return complete(index, likely, weak, cfg).unionByName(whole)


def with_keys(index: TextIndex, scores: DataFrame) -> DataFrame:
    return scores.join(index.docs, "did").drop("did")


def bm25_search(specs: list[TableSpec], queries: DataFrame, cfg: RetrievalConfig) -> DataFrame:
    """J3 + J2 (full-text snippet) + W2 ordered by score. Tables without text columns have no hits."""
    from lexivec.operators.lexical import lexical_hits, rank_per_table, with_snippets

    qterms = store_once(query_terms(queries, cfg), "query-words")
    clauses = store_once(word_clauses(qterms), "query-clauses")
    found = []
    for s in specs:
        cols = text_columns(s, cfg.fulltext_columns)
        if not cols:
            continue
        scores = scan_scores(s, clauses, cfg.k_ft, cfg)
        if scores is None:
            index = text_index(s, cfg)
            scores = with_keys(index, scored_pairs(index, qterms, cfg.k_ft, cfg)).withColumnRenamed("score", "score_ft")
        top = rank_per_table(scores.withColumn("table", F.lit(s.name)), cfg.k_ft, by_score=True)
        found.append(with_snippets(s, top, cols, cfg))
    return lexical_hits(found, queries)
