"""Block-by-block vector search against brute force: clusters, ties, zero and broken vectors."""

import numpy as np
import pytest

from lexivec.operators import vector_search as V

DIM = 6


def make(n, seed, clusters):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, DIM)) * 4
    v = middle[rng.integers(clusters, size=n)] + rng.normal(size=(n, DIM)) * 0.2
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(n + i, rows[i][1]) for i in range(5)]  # equal vectors
    rows += [(n + 10, [0.0] * DIM), (n + 11, [float("nan")] + [1.0] * (DIM - 1)), (n + 12, None), (n + 13, [float("inf")] * DIM)]
    return rows


def brute(corpus, queries, k, exclude_self):
    fine = [(i, np.array(v, float)) for i, v in corpus if v is not None and np.isfinite(v).all()]
    ids = np.array([i for i, _ in fine])
    unit = V._normalise_rows(np.array([v for _, v in fine]))
    out = {}
    for q, v in queries:
        if v is None or not np.isfinite(v).all():
            continue
        scores = unit @ V._normalise_rows(np.array([v], float))[0]
        ranked = sorted((-round(float(s), 6), i) for i, s in zip(ids.tolist(), scores, strict=True) if not (exclude_self and i == q))[:k]
        out[q] = [i for _, i in ranked]
    return out


@pytest.mark.parametrize("block_rows,cells", [(20, 1024), (7, 5), (10_000, 1024)])
def test_equals_brute_force(spark, monkeypatch, block_rows, cells):
    monkeypatch.setattr(V, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(V, "CELLS", cells)
    rows = make(300, 2, 8)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for exclude_self in (True, False):
        report = {}
        q = df.selectExpr("id as query_id", "v as qvec")
        found = V.block_topk(df, q, 4, DIM, "id", "v", "query_id", "qvec", True, exclude_self, report)
        got = {}
        for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rnk)):
            got.setdefault(r.query_id, []).append(r.id)
        assert got == brute(rows, rows, 4, exclude_self)
        if block_rows == 20:
            assert report["skipped"] > 2 * report["met"]


def test_empty_sides(spark):
    df = spark.createDataFrame(make(30, 3, 2), "id long, v array<double>")
    q = df.selectExpr("id as query_id", "v as qvec")
    nothing = df.where("id < 0")
    for corpus, queries in ((nothing, q), (df, q.where("query_id < 0")), (nothing, q.limit(0))):
        for rows in (0, 4096):
            assert V.vector_topk(corpus, queries, 3, DIM, "id", "v", normalise_corpus=True, query_batch_rows=rows).collect() == []
