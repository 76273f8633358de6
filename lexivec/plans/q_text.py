"""Lexical and embedding queries: BM25, multi-table LIKE, feature-hashing embeddings, query embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.functions.text import tokens
from lexivec.functions.vectors import norm
from lexivec.operators.index_build import build_chunks
from lexivec.operators.embedding import HashingEmbedder, embed_queries
from lexivec.operators.fulltext import bm25_search
from lexivec.operators.lexical import like_search
from lexivec.plans import duck as D
from lexivec.plans.catalog import query
from lexivec.plans.hybrid_sql import SPLIT, _embed
from lexivec.sources.tables import read_table, spec

CFG = RetrievalConfig()
INDEXED_AT = 1_700_000_000


def _toks(x: str, least: int = 2) -> str:
    return f"coalesce(list_filter(regexp_split_to_array(lower({x}), {SPLIT}), lambda t: length(t) >= {least}), [])"


@query(
    "bm25_search",
    sql=f"""
WITH dt AS (SELECT doc_id::VARCHAR AS pk, {_toks('text')} || {_toks('lang')} || {_toks('source')} AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dt),
post AS (SELECT pk, t AS term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT pk, len(toks) AS dl, unnest(toks) AS t FROM dt) GROUP BY pk, t),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_toks('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY term),
sc AS (
  SELECT qt.query_id, post.pk,
         sum(ln(1 + (st.n_docs - df.df + 0.5) / (df.df + 0.5)) * post.tf * (1.2 + 1.0)
             / (post.tf + 1.2 * (1.0 - 0.75 + 0.75 * post.dl / st.avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term), st GROUP BY qt.query_id, post.pk)
SELECT * FROM (
  SELECT query_id, 'documents' AS "table", pk, round(score, 6) AS score_ft,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, pk) AS lex_rank FROM sc)
WHERE lex_rank <= 50
""",
)
def bm25_search_q(spark, sf_dir):
    """Full-text mode: BM25 of every benchmark passage (whole text) against documents."""
    docs = spec(spark, sf_dir, "documents")
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    r = bm25_search([docs], q, CFG.with_(fulltext_required=True))
    return r.select("query_id", "table", "pk", F.round("score_ft", 6).alias("score_ft"), F.col("lex_rank").cast("long").alias("lex_rank"))


# Extra query texts (common word, short fragment, essential term, blank,
# unescaped wildcards, and one longer than the 64-char LIKE cut).
EXTRA_QUERIES = [
    (-1, "the"),
    (-2, "ou"),
    (-3, "date"),
    (-4, " "),
    (-5, "e%t_n"),
    (-6, "Customer#00000001 and a long tail that runs past the sixty-four character cut"),
]


def _multi_queries(spark, sf_dir):
    words = (
        read_table(spark, sf_dir, "part")
        .select(F.explode(F.split(F.lower("p_name"), " ")).alias("text"))
        .where(F.col("text") != "")
        .distinct()
        .withColumn("query_id", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"))
    )
    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    extra = spark.createDataFrame(EXTRA_QUERIES, "query_id long, text string")
    return bench.unionByName(words.select("query_id", "text")).unionByName(extra)


_MQ = (
    "(SELECT item_id AS query_id, text FROM benchmark UNION ALL "
    "SELECT ('0x' || substr(md5(w), 1, 15))::BIGINT, w FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' "
    "UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in EXTRA_QUERIES) + ") v(query_id, text))"
)


def _like_table(t, pk, cols):
    snip = f"substr(array_to_string(list_filter([{', '.join('x.' + c + '::VARCHAR' for c in cols)}], lambda v: v IS NOT NULL AND v <> ''), ' | '), 1, 500)"
    return f"""
SELECT q.query_id, '{t}' AS "table", x.{pk}::VARCHAR AS pk, {snip} AS snippet
FROM {t} x JOIN mq q ON lower(x.{cols[0]}) LIKE '%' || lower(substr(coalesce(q.text, ''), 1, 64)) || '%'"""


@query(
    "like_search_multi_table",
    sql=f"""
WITH mq AS {_MQ},
h AS ({_like_table('documents', 'doc_id', ['text', 'lang', 'source'])}
      UNION ALL {_like_table('part', 'p_partkey', ['p_name', 'p_brand', 'p_type'])}
      UNION ALL {_like_table('customer', 'c_custkey', ['c_name', 'c_mktsegment'])})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, "table" ORDER BY pk) AS lex_rank FROM h)
WHERE lex_rank <= 50
""",
)
def like_search_multi_table_q(spark, sf_dir):
    """LIKE search of benchmark passages, part-name words and edge-case texts over three tables."""
    specs = [spec(spark, sf_dir, t) for t in ("documents", "part", "customer")]
    r = like_search(specs, _multi_queries(spark, sf_dir), CFG)
    return r.select("query_id", "table", "pk", "snippet", F.col("lex_rank").cast("long").alias("lex_rank"))


_DOC_CHUNKS = f"""
SELECT 'documents::' || pk || '::' || chunk_idx AS id, chunk
FROM ({D.chunks_of('(' + D.row_docs_cte('documents', 'doc_id', ['text', 'lang', 'source']) + ')')})"""


@query(
    "hash_embed",
    sql=f"""
WITH chunks AS ({_DOC_CHUNKS}), cv AS ({_embed('chunks', 'id', 'chunk')})
SELECT id, b::INTEGER AS bucket, round(v, 6) AS value FROM cv WHERE v <> 0
""",
)
def hash_embed_q(spark, sf_dir):
    """Feature-hashing embedding of every document chunk, as its non-zero coordinates."""
    chunks = build_chunks([spec(spark, sf_dir, "documents")], CFG, INDEXED_AT)
    emb = HashingEmbedder(CFG.embed_dim)
    e = emb.embed_df(chunks.select("id", "chunk"), "chunk")
    return (
        e.select("id", F.posexplode("embedding").alias("bucket", "value"))
        .where(F.col("value") != 0)
        .select("id", F.col("bucket").cast("int").alias("bucket"), F.round(F.col("value").cast("double"), 6).alias("value"))
    )


@query(
    "embed_distinct_queries",
    sql=f"""
WITH u AS (SELECT conv_id, turn, {D.strip('text')} AS k FROM conversations WHERE role = 'user'),
keys AS (SELECT DISTINCT k FROM u WHERE k <> ''),
kv AS ({_embed('keys', 'k', 'k')})
SELECT u.conv_id, u.turn, coalesce(e.nnz, 0)::BIGINT AS nnz, round(coalesce(e.n, 0.0), 6) AS norm
FROM u LEFT JOIN (SELECT k, count(*) FILTER (WHERE v <> 0) AS nnz, sqrt(sum(v * v)) AS n FROM kv GROUP BY k) e USING (k)
""",
)
def embed_distinct_queries_q(spark, sf_dir):
    """User turns as queries: stripped text is the key, each distinct key embedded once."""
    u = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    qv = embed_queries(u.select("conv_id", "turn", "text"), HashingEmbedder(CFG.embed_dim))
    return qv.select(
        "conv_id",
        "turn",
        F.size(F.filter("qvec", lambda x: x != 0)).cast("long").alias("nnz"),
        F.round(norm("qvec"), 6).alias("norm"),
    )


@query(
    "query_tokens",
    sql=f"""
SELECT item_id AS query_id, len(list_distinct({_toks('text')}))::BIGINT AS n_terms,
       len({_toks('text')})::BIGINT AS n_tokens FROM benchmark
""",
)
def query_tokens_q(spark, sf_dir):
    """Tokenizer shared by BM25, boolean search and the embedder, on every benchmark passage."""
    b = read_table(spark, sf_dir, "benchmark")
    t = tokens(F.col("text"))
    return b.select(
        F.col("item_id").alias("query_id"),
        F.size(F.array_distinct(t)).cast("long").alias("n_terms"),
        F.size(t).cast("long").alias("n_tokens"),
    )


def _boolean_queries(spark, sf_dir):
    """One boolean query per benchmark passage, by rule from all its tokens:
    ``+t1 t2 "t3 t4" p5* -t6 t7 t8 ...`` (p5 = first three characters of t5); parts that a short
    passage lacks are left out."""
    t = tokens(F.col("text"))

    def at(i):
        return F.try_element_at(t, F.lit(i))

    q = F.concat_ws(
        " ",
        F.concat(F.lit("+"), at(1)), at(2), F.concat(F.lit('"'), at(3), F.lit(" "), at(4), F.lit('"')),
        F.concat(F.substring(at(5), 1, 3), F.lit("*")), F.concat(F.lit("-"), at(6)),
        F.array_join(F.slice(t, 7, F.greatest(F.size(t) - 6, F.lit(0))), " "),
    )
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("text"))


@query(
    "boolean_search",
    sql=f"""
WITH dt AS (SELECT doc_id::VARCHAR AS pk, {_toks('text', 1)} || {_toks('lang', 1)} || {_toks('source', 1)} AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM dt),
bq AS (SELECT item_id AS query_id, {_toks('text')} AS t FROM benchmark),
q AS (SELECT query_id, t[1] AS t1, t[2] AS t2, t[3] AS t3, t[4] AS t4, substr(t[5], 1, 3) AS p5, t[6] AS t6, t[7:] AS more
      FROM bq),
post AS (SELECT pk, t AS term, count(*) AS tf, any_value(dl) AS dl
         FROM (SELECT pk, len(toks) AS dl, unnest(toks) AS t FROM dt) GROUP BY pk, t),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
wt AS (SELECT pk, term, ln(1 + (st.n_docs - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1.0)
                        / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / st.avgdl)) AS w
       FROM post JOIN dfs USING (term), st),
m AS (SELECT q.*, d.pk, d.toks FROM q JOIN dt d ON list_contains(d.toks, q.t1) AND NOT coalesce(list_contains(d.toks, q.t6), false)),
terms AS (
  SELECT query_id, pk, t1 AS term FROM m
  UNION SELECT query_id, pk, t2 FROM m WHERE list_contains(toks, t2)
  UNION SELECT query_id, pk, t3 FROM m WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || t3 || ' ' || t4 || ' ')
  UNION SELECT query_id, pk, t4 FROM m WHERE contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || t3 || ' ' || t4 || ' ')
  UNION SELECT query_id, pk, tok FROM (SELECT query_id, pk, p5, unnest(toks) AS tok FROM m) WHERE starts_with(tok, p5)
  UNION SELECT query_id, pk, tok FROM (SELECT query_id, pk, toks, unnest(more) AS tok FROM m) WHERE list_contains(toks, tok)),
sc AS (SELECT query_id, pk, sum(w) AS score FROM terms JOIN wt USING (pk, term) GROUP BY query_id, pk),
hits AS (SELECT m.query_id, m.pk, round(coalesce(sc.score, 0.0), 6) AS score_ft FROM m LEFT JOIN sc USING (query_id, pk))
SELECT * FROM (
  SELECT query_id, 'documents' AS "table", pk, score_ft,
         row_number() OVER (PARTITION BY query_id ORDER BY score_ft DESC, pk) AS lex_rank FROM hits)
WHERE lex_rank <= 50
""",
)
def boolean_search_q(spark, sf_dir):
    """Boolean full-text search (required, optional, phrase, prefix, excluded) over documents."""
    from lexivec.operators.boolean import boolean_search

    docs = spec(spark, sf_dir, "documents")
    r = boolean_search([docs], _boolean_queries(spark, sf_dir), CFG)
    return r.select("query_id", "table", "pk", F.round("score_ft", 6).alias("score_ft"), F.col("lex_rank").cast("long").alias("lex_rank"))
