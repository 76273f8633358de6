"""Exact cosine top-k of many queries against a vector corpus.

Two plans with the same rows:

* **Few queries** (one block of at most ``query_batch_rows``, within the broadcast budget): the block is
  broadcast and the corpus is neither shuffled nor collected. Each task multiplies its Arrow batch by the
  block, ``SCORES`` scores at a time, and keeps, per query, what can still be in the top k (its local k-th
  score less a rounding margin).
* **Many queries**: blocks meet blocks on the executors. Corpus and queries are put into at most
  ``CELLS`` cells around corpus rows; a cell of more rows than a block is several blocks. A block has
  ``BLOCK_ROWS`` rows, or a ``BLOCKS``-th of a larger corpus (``MOST_ROWS`` at most): a row is sent once
  for each block that it meets, so what is shuffled grows with the rows, not with their square. No score
  of two cells exceeds the cosine of what is left of the angle between their centres after both radii.
  Every cell of queries first meets the cells with the highest bounds, which gives each query a k-th
  score; then it meets those that can still reach the least of them, and skips the others. The driver
  sees centres and a row per cell, never the vectors.

Then ``row_number() <= k`` per query (planned as a partial and a final WindowGroupLimit). Ties: the final
order is ``round(score, 6) desc, id asc`` in both Spark and the SQL oracle. Rows with a component that is
not finite have no score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.vectors import EPS
from lexivec.session import store_once

MARGIN = 2e-6  # candidates within this of the local k-th score are kept (rounding-safe)
SCORES = 1 << 22  # scores held at a time in a task


def _normalise_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return m / (np.sqrt((m * m).sum(axis=1, keepdims=True)) + EPS)


def _stack(vs: pd.Series, dim: int) -> np.ndarray:
    if len(vs) == 0:
        return np.zeros((0, dim), dtype=np.float64)
    none = np.full(dim, np.nan)  # a null vector has no score
    return np.vstack([none if v is None else np.asarray(v, dtype=np.float64) for v in vs])


def _local_topk(scores: np.ndarray, k: int) -> np.ndarray:
    """Boolean mask (n x q) of rows that may be in the top-k of each column."""
    n = scores.shape[0]
    if n <= k:
        return np.ones_like(scores, dtype=bool)
    kth = np.partition(scores, n - k, axis=0)[n - k]
    return scores >= (kth - MARGIN)


def topk_candidates(
    corpus: DataFrame,
    id_col: str,
    vec_col: str,
    qids: np.ndarray,
    qmat: np.ndarray,
    k: int,
    normalise_corpus: bool,
    exclude_self: bool,
) -> DataFrame:
    """One broadcast pass: local top-k candidates ``(query_id, id, score)`` for a query block."""
    spark = corpus.sparkSession
    dim = qmat.shape[1]
    bq = spark.sparkContext.broadcast((qids, qmat.astype(np.float64)))
    id_type = corpus.schema[id_col].dataType
    qid_type = T.LongType() if np.issubdtype(qids.dtype, np.integer) else T.StringType()
    out_schema = T.StructType(
        [T.StructField("query_id", qid_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        q_ids, q = bq.value
        qt = q.T
        for pdf in batches:
            if pdf.empty:
                continue
            c = _stack(pdf[vec_col], dim)
            if c.shape[1] != dim:
                raise ValueError(f"Vector dimension mismatch: expected {dim} got {c.shape[1]}")
            if normalise_corpus:
                c = _normalise_rows(c)
            ids = pdf[id_col].to_numpy()
            fine = np.isfinite(c).all(axis=1)  # a NaN score would push real neighbours out
            c, ids = c[fine], ids[fine]
            step = max(1, SCORES // max(1, len(c)))
            for at in range(0, len(q_ids), step):
                s = c @ qt[:, at : at + step]
                if exclude_self:
                    s[ids[:, None] == q_ids[None, at : at + step]] = -np.inf
                r, j = np.nonzero(_local_topk(s, k) & np.isfinite(s))
                yield pd.DataFrame({"query_id": q_ids[j + at], id_col: ids[r], "score": s[r, j]})

    return corpus.select(id_col, vec_col).mapInPandas(run, out_schema)


def rank_topk(cands: DataFrame, id_col: str, k: int, score_col: str = "score") -> DataFrame:
    """Global top-k per query: ``row_number`` over ``round(score,6) desc, id`` (planned as
    a partial + final WindowGroupLimit, so only k rows per query leave each map task)."""
    w = Window.partitionBy("query_id").orderBy(F.col("_sr").desc(), F.col(id_col).asc())
    return (
        cands.withColumn("_sr", F.round(F.col(score_col), 6))
        .withColumn("rnk", F.row_number().over(w))
        .where(F.col("rnk") <= k)
        .withColumn(score_col, F.col("_sr"))
        .drop("_sr")
    )


CELLS = 1024
BLOCK_ROWS, MOST_ROWS = 4096, 65536
BLOCKS = 16


def _cells(df: DataFrame, id_col: str, vec_col: str, dim: int, centres, normalise: bool) -> DataFrame:
    """``(cell, id, vec, angle, norm)``: the nearest centre and the angle to it; rows without a direction
    have the cell behind the last centre. ``vec`` is the given vector, floats stay floats."""
    id_kind, number = df.schema[id_col].dataType, getattr(df.schema[vec_col].dataType, "elementType", None)
    single = isinstance(number, T.FloatType)
    out = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("id", id_kind),
        T.StructField("vec", T.ArrayType(T.FloatType() if single else T.DoubleType())),
        T.StructField("angle", T.DoubleType()), T.StructField("norm", T.DoubleType()),
    ])

    def run(batches):
        middle = centres.value
        for pdf in batches:
            v = _stack(pdf[vec_col], dim)
            if len(v) and v.shape[1] != dim:
                raise ValueError(f"Vector dimension mismatch: expected {dim} got {v.shape[1]}")
            fine = np.isfinite(v).all(axis=1)
            v, ids = v[fine], pdf[id_col].to_numpy()[fine]
            if len(v) == 0:
                continue
            unit = _normalise_rows(v)
            used = unit if normalise else v
            norm = np.sqrt((used * used).sum(axis=1))
            near = unit @ middle.T
            cell = np.where((unit * unit).sum(axis=1) < 0.5, len(middle), near.argmax(axis=1))
            angle = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pd.DataFrame({"cell": cell.astype(np.int32), "id": ids, "vec": list(v.astype(np.float32) if single else v), "angle": angle, "norm": norm})

    return df.select(id_col, vec_col).where(F.col(vec_col).isNotNull()).mapInPandas(run, out)


def _bounds(centres: np.ndarray, left: dict, right: dict) -> np.ndarray:
    """Highest possible score of every pair of cells (queries' x corpus's); -inf where one is empty."""
    n = len(centres)
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))
    out = np.full((n + 1, n + 1), -np.inf)
    for q, (_, q_radius, _, _) in left.items():
        for c, (_, c_radius, low, high) in right.items():
            best = 0.0 if n in (q, c) else float(np.cos(max(0.0, apart[q, c] - q_radius - c_radius - 1e-7)))
            out[q, c] = best * (high if best > 0 else low) + MARGIN
    return out


def _meet(corpus: DataFrame, queries: DataFrame, pairs: list[tuple[int, int]], parts: tuple[dict, dict], k: int, normalise: bool, exclude_self: bool) -> DataFrame:
    """Candidates ``(query_id, id, score)`` of the given pairs of cells, block by block."""
    spark = corpus.sparkSession
    # at most (CELLS + 1) ** 2 rows; the blocks of a cell are counted off on the executors
    met = F.broadcast(spark.createDataFrame([(q, c, parts[0][q], parts[1][c]) for q, c in pairs], "q_cell int, c_cell int, q_parts int, c_parts int"))
    pair = ["q_cell", "q_part", "c_cell", "c_part"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.withColumnsRenamed({"cell": "q_cell", "part": "q_part"}).join(met, "q_cell").withColumn("c_part", every("c_parts")).select(*pair, "id", "vec")
    right = corpus.withColumnsRenamed({"cell": "c_cell", "part": "c_part"}).join(met, "c_cell").withColumn("q_part", every("q_parts")).select(*pair, "id", "vec")
    out = T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", corpus.schema["id"].dataType), T.StructField("score", T.DoubleType()),
    ])

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": q["id"][:0], "id": c["id"][:0], "score": np.zeros(0)})
        unit = lambda df: np.vstack(df["vec"].to_numpy()).astype(np.float64)
        rows, qt = _normalise_rows(unit(c)) if normalise else unit(c), _normalise_rows(unit(q)).T
        ids, q_ids = c["id"].to_numpy(), q["id"].to_numpy()
        found, step = [], max(1, SCORES // len(c))
        for at in range(0, len(q), step):
            s = rows @ qt[:, at : at + step]
            if exclude_self:
                s[ids[:, None] == q_ids[None, at : at + step]] = -np.inf
            r, j = np.nonzero(_local_topk(s, k) & np.isfinite(s))
            found.append((j + at, r, s[r, j]))
        j, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": q_ids[j], "id": ids[r], "score": score})

    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(run, out)


def block_topk(corpus, queries, k, dim, id_col, vec_col, qid_col, qvec_col, normalise_corpus, exclude_self, report: dict | None = None) -> DataFrame:
    """The plan for many queries. ``report`` takes the numbers of block pairs met and skipped."""
    spark = corpus.sparkSession
    n_rows = corpus.count()
    block = max(BLOCK_ROWS, min(MOST_ROWS, -(-n_rows // BLOCKS)))
    n_cells = max(1, min(CELLS, -(-n_rows // block)))
    # centres: the corpus rows least by a hash of the id, CELLS at most
    some = corpus.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(vec_col).limit(n_cells).toArrow()
    centres = _normalise_rows(_stack(pd.Series(some[vec_col].to_pylist()), dim))
    centres = centres[np.isfinite(centres).all(axis=1) & ((centres * centres).sum(axis=1) > 0.5)]
    if len(centres) == 0:
        centres = np.eye(1, dim)
    shared = spark.sparkContext.broadcast(centres)
    sides, stats = [], []
    for df, i, v, normalise in ((queries, qid_col, qvec_col, True), (corpus, id_col, vec_col, normalise_corpus)):
        cells = store_once(_cells(df, i, v, dim, shared, normalise), "cells")
        own = cells.groupBy("cell").agg(F.count("*"), F.max("angle"), F.min("norm"), F.max("norm")).collect()
        stats.append({r[0]: tuple(r[1:]) for r in own})
        size = spark.createDataFrame([(c, -(-n // block)) for c, (n, *_) in stats[-1].items()], "cell int, parts int")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
        sides.append(cells.join(F.broadcast(size), "cell").select("cell", part, "id", "vec"))
    parts = tuple({c: -(-n // block) for c, (n, *_) in own.items()} for own in stats)
    bound = _bounds(centres, *stats)
    first, later = [], []
    for q in stats[0]:
        enough = 0
        for c in sorted(stats[1], key=lambda c: (-bound[q, c], c)):
            (first if enough < 4 * (k + 1) else later).append((q, c))
            enough += stats[1][c][0]
    meet = lambda pairs: _meet(sides[1], sides[0], pairs, parts, k, normalise_corpus, exclude_self)
    found = store_once(meet(first), "first-pairs")
    nth = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = found.withColumn("n", F.row_number().over(nth)).where(F.col("n") == k).select(F.col("query_id").alias("id"), "score")
    low = sides[0].join(kth, "id", "left").groupBy("cell").agg(F.min(F.coalesce("score", F.lit(-2.0 * 1e300))).alias("low")).collect()
    low = {r["cell"]: r["low"] for r in low}
    left = [(q, c) for q, c in later if bound[q, c] >= low[q] - MARGIN]
    if report is not None:
        blocks = lambda pairs: sum(parts[0][q] * parts[1][c] for q, c in pairs)
        report.update(met=blocks(first) + blocks(left), skipped=blocks(later) - blocks(left))
    cands = found.unionByName(meet(left)) if left else found
    return rank_topk(cands.withColumnRenamed("id", id_col), id_col, k)


def _one_block(queries: DataFrame, qid_col: str, qvec_col: str, dim: int, most_rows: int):
    """(ids, normalised matrix) of a query set of at most ``most_rows`` rows; None for a larger one."""
    rows = queries.select(F.col(qid_col).alias("_qid"), F.col(qvec_col).alias("_qv")).limit(most_rows + 1).toArrow()
    if rows.num_rows > most_rows:
        return None
    return rows["_qid"].to_numpy(), _normalise_rows(_stack(pd.Series(rows["_qv"].to_pylist(), dtype=object), dim))


def vector_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    qid_col: str = "query_id",
    qvec_col: str = "qvec",
    normalise_corpus: bool = False,
    exclude_self: bool = False,
    max_broadcast_bytes: int = 64 * 1024 * 1024,
    query_batch_rows: int = 4096,
) -> DataFrame:
    """``(query_id, <id_col>, score, rnk)`` for the top ``k`` corpus rows of every query.

    Queries are L2-normalised (like the original search); the corpus is normalised on the fly
    only if ``normalise_corpus`` (index vectors are stored normalised).
    """
    most = min(query_batch_rows, max_broadcast_bytes // (dim * 8 + 64))
    block = _one_block(queries, qid_col, qvec_col, dim, most)
    if block is None:
        return block_topk(corpus, queries, k, dim, id_col, vec_col, qid_col, qvec_col, normalise_corpus, exclude_self)
    if len(block[0]) == 0:
        spark: SparkSession = corpus.sparkSession
        schema = T.StructType(
            [
                T.StructField("query_id", T.LongType()),
                T.StructField(id_col, corpus.schema[id_col].dataType),
                T.StructField("score", T.DoubleType()),
                T.StructField("rnk", T.IntegerType()),
            ]
        )
        return spark.createDataFrame([], schema)
    return rank_topk(topk_candidates(corpus, id_col, vec_col, *block, k, normalise_corpus, exclude_self), id_col, k)
