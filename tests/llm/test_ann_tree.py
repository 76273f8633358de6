import numpy as np
import pytest
from pyspark.sql import functions as F

from lexivec.llm import ann_tree as A
from lexivec.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, vectors, queries, k):
    out = {}
    for q, v in queries:
        gaps = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gaps)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), gaps[i]) for i in order]
    return out


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, vectors, [(i, v) for i, v in zip(ids, vectors, strict=True) if i % 100 == 0], 10)
    got = {}
    for r in QUERIES["op8_ann_tree"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11))
        assert [(x[2], x[1]) for x in found] == sorted((x[2], x[1]) for x in found)
        own = vectors[ids == q][0]
        assert all(x[2] == pytest.approx(np.sqrt(((vectors[ids == x[1]][0] - own) ** 2).sum()), abs=1e-12) for x in found)
        hits += len({x[1] for x in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_widened_to_all_leaves_it_is_exact(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8)).astype(np.float32)
    vectors[200:500] = vectors[0]  # a third is one vector
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA)
    rows = A.neighbours(df, F.col("vec_id") % 10 == 0, k=10, target=1.0, sample=300).collect()
    want = brute(np.arange(900), vectors.astype(float), [(i, vectors[i].astype(float)) for i in range(0, 900, 10)], 10)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    same = sum([i for _, i in sorted(got[q])] == [i for i, _ in want[q]] for q in want)
    assert set(got) == set(want) and same >= 0.9 * len(want)
    assert [i for _, i in sorted(got[300])] == [0, *range(200, 209)]


def test_recall_over_many_leaves_and_partitions(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = A.neighbours(df, F.col("vec_id") % 20 == 0, k=10).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute(np.arange(3000), vectors.astype(float), [(i, vectors[i].astype(float)) for i in range(0, 3000, 20)], 10)
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q in want for i, _ in want[q]} for r in rows)
    assert len(rows) == 1500 and hits >= 0.9 * 1500


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "x") for i in range(400)], SCHEMA)
    run = lambda: sorted(map(tuple, A.neighbours(df, F.col("vec_id") % 4 == 0, k=3).collect()))
    whole = run()
    monkeypatch.setattr(A, "BLOCK_ROWS", 16)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 8)
    assert run() == whole


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    rows = np.repeat(rng.normal(size=(50, 5)), 3, axis=0)
    ids = rng.permutation(150)
    for q, (found, gaps) in zip(rows[:20], A.nearest(rows[:20], rows, ids, 7), strict=True):
        true = np.sqrt(((rows - q) ** 2).sum(axis=1))
        order = np.lexsort((ids, true))[:7]
        assert found.tolist() == ids[order].tolist() and np.array_equal(gaps, true[order])
    assert A.nearest(rows[:1], rows[:2], ids[:2], 7)[0][0].shape == (2,)


def test_best_bin_first_visits_every_leaf_once():
    tree = A.Tree(np.random.default_rng(4).normal(size=(500, 6)), 20)
    assert sorted(tree.visit(np.zeros(6))) == list(range(tree.leaves)) and tree.leaves > 10


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], "x"), (100, [1.0, 0.0], "x"), (1, [0.0, 1.0], None), (1, [0.0, 1.0], None), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [nan, 1.0], "x"),
            (5, [inf, 1.0], "x"), (6, [None, 1.0], "x"), (7, [1.0], "x"), (8, [], "x"), (None, [1.0, 1.0], "x"), (200, None, "x")]
    got = sorted(map(tuple, A.neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0, k=5).collect()))
    root = pytest.approx(2**0.5)
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, root), (100, 1, 0, 0.0), (100, 2, 1, root)]
    assert A.neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []
