"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample of the vectors (``SAMPLE``) and is broadcast; every vector
descends to its leaf. A query pops nodes from a priority queue by the distance to their centres and
so visits leaves nearest first. How many it visits is calibrated: for ``PROBES`` sample vectors the
true neighbours are found by brute force over all rows, and visits are widened until
``target`` of them lie in the visited leaves.

Equal vectors are one class. Of a class the index keeps the k + 1 smallest ids, since no answer
needs more, and queries with equal vectors are searched once, so a vector that a third of all rows
share costs as much as any other. Leaves are searched in blocks of (leaf, block of rows, block of
queries), both planned from counts, so a large leaf is spread over tasks. Within a block matrix
products choose the candidates, and their distances are then computed exactly in double precision.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite components take no part, neither as queries nor as candidates; equal distances go to
the smaller id; rows with one id and vector count once; null ids take no part; other columns are not
read; with fewer than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import batch, save

SAMPLE = 20_000
BRANCH = 8
#: Rows planned for a leaf, sample rows a leaf needs, and rows and queries of a search block.
LEAF_ROWS, LEAF_SAMPLE = 400, 8
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
PROBES = 64
TARGET = 0.96


class Tree:
    """Nodes as arrays: centres, children, and the leaf number of nodes without children."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 8):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, max(1, leaf_size), np.random.default_rng(seed))
        self.blocks = [np.array([self.centres[c] for c in kids]) for kids in self.children]

    def _grow(self, rows: np.ndarray, leaf_size: int, rng) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        parts = _kmeans(rows, min(BRANCH, max(2, -(-len(rows) // leaf_size))), rng) if len(rows) > leaf_size else [rows]
        if len(parts) < 2:
            self.leaf[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(p, leaf_size, rng) for p in parts]
        return node

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centre."""
        out = np.empty(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            near = _squared(rows[at], self.blocks[node]).argmin(axis=1)
            todo += [(kid, at[near == i]) for i, kid in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            gaps = ((self.blocks[node] - query) ** 2).sum(axis=1)
            for kid, gap in zip(self.children[node], gaps, strict=True):
                heapq.heappush(heap, (float(gap), kid))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _kmeans(rows: np.ndarray, k: int, rng, rounds: int = 8) -> list[np.ndarray]:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    near = np.zeros(len(rows), np.int64)
    for _ in range(rounds):
        near = _squared(rows, centres).argmin(axis=1)
        centres = np.array([rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
    return [rows[near == i] for i in range(k) if (near == i).any()]


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the k nearest rows: (ids, exact distances), by distance, then id. Products choose
    whatever may belong there, with room for their rounding."""
    rough = _squared(queries, rows)
    slack = 1e-9 * (1 + (queries * queries).sum(1) + (rows * rows).sum(1).max(initial=0))
    out = []
    for i, query in enumerate(queries):
        at = np.arange(len(rows))
        if len(rows) > k:
            at = np.flatnonzero(rough[i] <= np.partition(rough[i], k - 1)[k - 1] + slack[i])
        gaps = np.sqrt(((rows[at] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[at], gaps))[:k]
        out.append((ids[at][best], gaps[best]))
    return out


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (dims.d if dims else 0))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def build_index(rows: DataFrame, k: int, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Tree | None, np.ndarray]:
    """The stored index (leaf, vec_id, v), the tree, and the sample's first vectors."""
    copies = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.distinct().withColumn("rn", F.row_number().over(copies)).where(F.col("rn") <= k + 1).drop("rn")
    kept = save(kept, "ann-rows")
    total = kept.count()
    # only rows whose hash can be among the least are sorted: six deviations more than the sample's share
    place_of = F.xxhash64("vec_id", F.lit(8))
    share = (sample + 6 * sample**0.5) / max(total, 1)
    near = kept if share >= 1 else kept.where(place_of < int(share * 2**64) - 2**63)
    chosen = near.orderBy(place_of, "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(chosen):
        return kept.select(F.lit(0).cast("long").alias("leaf"), "vec_id", "v"), None, np.zeros((0, 1))
    taken = _vectors(chosen)
    tree = Tree(np.unique(taken, axis=0), max(LEAF_SAMPLE, int(len(taken) * leaf_rows / max(total, 1))))
    shared = rows.sparkSession.sparkContext.broadcast(tree)
    out = pa.schema([("leaf", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(out, shared.value.assign(_vectors(part.column(1))), part.column(0), part.column(1))

    return save(kept.mapInArrow(place, "leaf long, vec_id long, v array<double>"), "ann-index"), tree, taken


def true_leaves(index: DataFrame, probes: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(probe, leaf) of the k true nearest rows of each probe, by brute force over all rows."""
    shared = index.sparkSession.sparkContext.broadcast(probes)
    out = pa.schema([("probe", pa.int64()), ("gap", pa.float64()), ("vec_id", pa.int64()), ("leaf", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, ids = _vectors(part.column(2)), part.column(1).to_numpy()
            at = np.arange(len(ids))
            leaf = part.column(0).to_numpy()
            for probe, (hit, gaps) in enumerate(nearest(shared.value, rows, at, k)):
                yield batch(out, np.full(len(hit), probe), gaps, ids[hit], leaf[hit])

    order = Window.partitionBy("probe").orderBy("gap", "vec_id")
    found = index.select("leaf", "vec_id", "v").mapInArrow(scan, "probe long, gap double, vec_id long, leaf long")
    return [(r.probe, r.leaf) for r in found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("probe", "leaf").collect()]


def calibrate(index: DataFrame, tree: Tree, probes: np.ndarray, k: int, target: float) -> int:
    """Leaf visits that reach ``target`` of the probes' true neighbours."""
    ranks = [{leaf: i for i, leaf in enumerate(tree.visit(p))} for p in probes]
    needed = sorted(ranks[p][leaf] for p, leaf in true_leaves(index, probes, k))
    if not needed:
        return tree.leaves
    return min(tree.leaves, needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)] + 1)


def search(index: DataFrame, tree: Tree, queries: DataFrame, visits: int, k: int) -> DataFrame:
    """(qid, vec_id, score): the k nearest index rows found for each query (qid, v)."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    asked = pa.schema([("leaf", pa.int64()), ("qid", pa.int64())])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for qid, query in zip(part.column(0).to_pylist(), _vectors(part.column(1)), strict=True):
                leaves = [leaf for leaf, _ in zip(shared.value.visit(query), range(visits), strict=False)]
                yield batch(asked, leaves, [qid] * len(leaves))

    visits_of = save(queries.select("qid", "v").mapInArrow(visited, "leaf long, qid long"), "ann-visits")
    sizes = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(visits_of.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")), "leaf")
    plan = F.broadcast(sizes.select("leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("rs"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("qs")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = index.join(plan, "leaf").withColumn("r", F.pmod(F.xxhash64("vec_id"), F.col("rs")).cast("int")).withColumn("q", every("qs"))
    left = visits_of.join(plan, "leaf").withColumn("q", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int")).withColumn("r", every("rs")).join(queries.select("qid", "v"), "qid")
    cell = ["leaf", "r", "q"]  # of equal types on both sides: cogroup hashes them as they are
    kinds = "qid long, vec_id long, score double"

    def block(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"qid": [], "vec_id": [], "score": []})
        found = nearest(np.stack(asking.v.to_numpy()), np.stack(held.v.to_numpy()), held.vec_id.to_numpy(), k)
        return pd.DataFrame({"qid": np.repeat(asking.qid.to_numpy(), [len(i) for i, _ in found]), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([g for _, g in found])})

    near = left.select(*cell, "qid", "v").groupBy(cell).cogroup(right.select(*cell, "vec_id", "v").groupBy(cell)).applyInPandas(block, kinds)
    best = Window.partitionBy("qid").orderBy("score", "vec_id")
    return near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query``
    (a condition on vec_id), its own row left out."""
    rows = save(usable(vectors), "ann-vectors")
    index, tree, taken = build_index(rows, k, sample)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    visits = calibrate(index, tree, taken[:PROBES], k + 1, target)
    asked = rows.where(is_query).select("vec_id", "v").distinct()
    classes = save(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "ann-queries")
    found = save(search(index, tree, classes, visits, k + 1), "ann-found")
    members = asked.join(classes, "v").select(F.col("vec_id").alias("query_id"), "qid")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    own = members.join(found, "qid").where("vec_id != query_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
