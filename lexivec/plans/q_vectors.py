"""Vector queries: normalise, exact top-k (self k-NN over the whole table), label-centroid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.functions.vectors import l2_normalize, norm
from lexivec.operators.vector_search import vector_topk
from lexivec.plans.catalog import query
from lexivec.sources.tables import read_table

TOPK = 10

# DuckDB: unit vectors of the embeddings table in DOUBLE.
_UNIT = """
unit AS (
  SELECT vec_id, label,
         list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-12)) AS v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
)"""


@query(
    "l2_normalize",
    sql=f"""
WITH {_UNIT},
raw AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
f AS (SELECT vec_id, list_transform(v, lambda x: x::FLOAT) AS fv FROM unit)
SELECT raw.vec_id, round(raw.n, 6) AS norm_in,
       round(sqrt(list_sum(list_transform(fv, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_out,
       round(fv[1]::DOUBLE, 6) AS e0, len(fv)::BIGINT AS dim
FROM raw JOIN f USING (vec_id)
""",
)
def l2_normalize_q(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    u = e.select("vec_id", norm("embedding").alias("n"), l2_normalize("embedding").alias("fv"))
    return u.select(
        "vec_id",
        F.round("n", 6).alias("norm_in"),
        F.round(norm("fv"), 6).alias("norm_out"),
        F.round(F.col("fv")[0].cast("double"), 6).alias("e0"),
        F.size("fv").cast("long").alias("dim"),
    )


@query(
    "vector_topk_blocks",
    sql=f"""
WITH {_UNIT},
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_dot_product(q.v, c.v), 6) AS score
  FROM unit q JOIN unit c ON q.vec_id <> c.vec_id
)
SELECT * FROM (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk
  FROM s) WHERE rnk <= {TOPK}
""",
)
def vector_topk_blocks_q(spark, sf_dir):
    """The same by the plan for more queries than one broadcast block holds: blocks meet blocks."""
    e = read_table(spark, sf_dir, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    r = vector_topk(
        e.select("vec_id", "embedding"), queries, TOPK, dim=64, id_col="vec_id", vec_col="embedding", normalise_corpus=True, exclude_self=True,
        query_batch_rows=0,
    )
    return r.select("query_id", "vec_id", "score", F.col("rnk").cast("long").alias("rnk"))


@query(
    "vector_topk",
    sql=f"""
WITH {_UNIT},
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_dot_product(q.v, c.v), 6) AS score
  FROM unit q JOIN unit c ON q.vec_id <> c.vec_id
)
SELECT * FROM (
  SELECT query_id, vec_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk
  FROM s) WHERE rnk <= {TOPK}
""",
)
def vector_topk_q(spark, sf_dir):
    """Top-10 neighbours of every vector of the table (each vector is a query, itself excluded)."""
    e = read_table(spark, sf_dir, "embeddings")
    corpus = e.select("vec_id", "embedding")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    r = vector_topk(
        corpus, queries, TOPK, dim=64, id_col="vec_id", vec_col="embedding", normalise_corpus=True, exclude_self=True
    )
    return r.select("query_id", "vec_id", "score", F.col("rnk").cast("long").alias("rnk"))


@query(
    "vector_topk_centroids",
    sql=f"""
WITH {_UNIT},
c AS (
  SELECT label, list(x ORDER BY i) AS cv
  FROM (SELECT label, t.i, avg(v[t.i]) AS x FROM unit, range(1, 65) t(i) GROUP BY label, t.i)
  GROUP BY label
),
s AS (
  SELECT c.label AS query_id, u.vec_id, u.label,
         round(list_dot_product(list_transform(cv, lambda x: x / (sqrt(list_sum(list_transform(cv, lambda y: y * y))) + 1e-12)), u.v), 6) AS score
  FROM c JOIN unit u ON true
)
SELECT * FROM (
  SELECT query_id::BIGINT AS query_id, vec_id, label AS vec_label, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk
  FROM s) WHERE rnk <= {TOPK}
""",
)
def vector_topk_centroids_q(spark, sf_dir):
    """Queries derived from the data: the mean unit vector of every label, then top-10 vectors."""
    e = read_table(spark, sf_dir, "embeddings")
    unit = e.select("vec_id", "label", l2_normalize("embedding", as_float=False).alias("v"))
    # 64 partial averages per label: map-side combine, no explode of the vectors.
    cent = (
        unit.groupBy("label")
        .agg(*[F.avg(F.col("v")[i]).alias(f"x{i}") for i in range(64)])
        .select(F.col("label").cast("long").alias("query_id"), F.array(*[f"x{i}" for i in range(64)]).alias("qvec"))
    )
    r = vector_topk(unit, cent, TOPK, dim=64, id_col="vec_id", vec_col="v")
    labels = unit.select("vec_id", F.col("label").alias("vec_label"))
    return r.join(labels, "vec_id").select(
        "query_id", "vec_id", "vec_label", "score", F.col("rnk").cast("long").alias("rnk")
    )
