"""Blocks of vector search grow with the rows, and the scores of a pair of blocks are held in pieces."""

import numpy as np

from lexivec.operators import vector_search as V
from test_vector_blocks import DIM, brute, make


def shuffled(spark, monkeypatch, n):
    """How often a row is sent, and the answers."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 10)
    monkeypatch.setattr(V, "SCORES", 100)
    rows = [(i, np.float32(v).tolist() if v is not None else None) for i, v in make(n, 4, 1)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    report = {}
    found = V.block_topk(df, df.selectExpr("id as query_id", "v as qvec"), 4, DIM, "id", "v", "query_id", "qvec", True, True, report)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rnk)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == brute(rows, rows, 4, True)
    return report["met"] + report["skipped"]


def test_pairs_of_blocks_do_not_grow_with_the_square(spark, monkeypatch):
    small, large = shuffled(spark, monkeypatch, 400), shuffled(spark, monkeypatch, 1600)
    assert large < 2 * small  # 16 times as many before


def test_few_queries_hold_few_scores(spark, monkeypatch):
    rows = [(i, np.float32(v).tolist()) for i, v in make(300, 4, 2) if v is not None]
    df = spark.createDataFrame(rows, "id long, v array<float>").coalesce(1)
    wanted = brute(rows, rows, 4, True)
    local = V._local_topk

    def held(scores, k):
        if scores.size > 900:
            raise MemoryError(f"{scores.size} scores")
        return local(scores, k)

    monkeypatch.setattr(V, "SCORES", 900)
    monkeypatch.setattr(V, "_local_topk", held)
    got = {}
    for r in sorted(V.vector_topk(df, df.selectExpr("id as query_id", "v as qvec"), 4, DIM, "id", "v", normalise_corpus=True, exclude_self=True).collect(), key=lambda r: (r.query_id, r.rnk)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == wanted
