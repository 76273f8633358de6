"""Reports (A5-A9) and the schema catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.config import JOB_BUCKETS, LATENCY_BUCKETS, RetrievalConfig
from lexivec.functions.vectors import norm
from lexivec.operators.embedding import HashingEmbedder, embed_queries
from lexivec.operators.reports import bound_label, counters, histogram, index_health, inflight_peak
from lexivec.operators.segmented import by_ranges, previous, running_sum
from lexivec.plans import hybrid_sql as HS
from lexivec.plans.catalog import query
from lexivec.plans.q_hybrid import INDEXED_AT, run_hybrid, stored_index
from lexivec.sources.tables import (
    ALL_TABLES, TABLE_KEYS, allowed, catalog_columns, column_values, key_report, read_table, resolve_index_columns, spec, text_columns_first_n,
)

CFG = RetrievalConfig()
#: What a result says about a row.
RESULT_KEYS = ("table", "pk", "title", "snippet", "score_ft", "score_sem", "status", "indexed_at")

_LABELS = [bound_label(b) for b in LATENCY_BUCKETS]
_HIST_VALUES = ", ".join(f"('{lab}', {b!r}::DOUBLE)" for lab, b in zip(_LABELS, LATENCY_BUCKETS)) + ", ('+Inf', 'inf'::DOUBLE)"


@query(
    "latency_histogram",
    sql=f"""
SELECT e.event_type, b.le, count(*) FILTER (WHERE e.value <= b.bound)::BIGINT AS cum_count,
       any_value(s.value_sum) AS value_sum, any_value(s.value_count) AS value_count
FROM events e JOIN (VALUES {_HIST_VALUES}) b(le, bound) ON true
JOIN (SELECT event_type, round(sum(value), 6) AS value_sum, count(value)::BIGINT AS value_count FROM events GROUP BY event_type) s
  ON s.event_type = e.event_type
GROUP BY e.event_type, b.le
""",
)
def latency_histogram_q(spark, sf_dir):
    """Cumulative latency buckets (request-latency bounds) of events.value per event type."""
    h = histogram(read_table(spark, sf_dir, "events"), "value", LATENCY_BUCKETS, ["event_type"])
    return h.select("event_type", "le", "cum_count", "value_sum", "value_count")


_JOB_VALUES = ", ".join(f"('{bound_label(b)}', {float(b)!r}::DOUBLE)" for b in JOB_BUCKETS) + ", ('+Inf', 'inf'::DOUBLE)"


@query(
    "job_histogram",
    sql=f"""
WITH g AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 3600000000.0 AS hours FROM events),
s AS (SELECT event_type, count(*) AS n, round(sum(hours), 6) AS value_sum, count(hours)::BIGINT AS value_count FROM g GROUP BY event_type)
SELECT g.event_type, b.le, CASE WHEN b.le = '+Inf' THEN any_value(s.n) ELSE count(*) FILTER (WHERE g.hours <= b.bound) END::BIGINT AS cum_count,
       any_value(s.value_sum) AS value_sum, any_value(s.value_count) AS value_count
FROM g JOIN (VALUES {_JOB_VALUES}) b(le, bound) ON true JOIN s ON s.event_type = g.event_type
GROUP BY g.event_type, b.le
""",
)
def job_histogram_q(spark, sf_dir):
    """The update job's bounds over the hours since a user's event before, per event type."""
    order = ["us", "event_id"]
    e = read_table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = previous(by_ranges(e, ["user_id"], order), ["user_id"], order, "us", "before")
    e = e.withColumn("hours", (F.col("us") - F.col("before")) / 3600000000.0)
    return histogram(e, "hours", tuple(JOB_BUCKETS), ["event_type"]).select("event_type", "le", "cum_count", "value_sum", "value_count")


@query(
    "event_counters",
    sql="""
SELECT event_type AS kind, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*)::BIGINT AS n
FROM events GROUP BY 1, 2
""",
)
def event_counters_q(spark, sf_dir):
    """Counters per kind and day (cache hits, errors, rejects ... are event kinds here)."""
    return counters(read_table(spark, sf_dir, "events"), "event_type", "ts")


@query(
    "inflight_max",
    sql="""
WITH e AS (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY l_orderkey),
iv AS (SELECT o_orderdate AS s, end_ts FROM orders LEFT JOIN e ON o_orderkey = l_orderkey),
d AS (SELECT s AS t, 1 AS p, 0 AS m FROM iv WHERE s IS NOT NULL UNION ALL SELECT end_ts, 0, 1 FROM iv WHERE end_ts IS NOT NULL),
pt AS (SELECT t, sum(p) AS p, sum(m) AS m FROM d GROUP BY t),
lv AS (SELECT t, coalesce(sum(p - m) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p AS peak FROM pt)
SELECT max(peak)::BIGINT AS max_inflight, strftime(min(t) FILTER (WHERE peak = (SELECT max(peak) FROM lv)), '%Y-%m-%d %H:%M:%S') AS first_at
FROM lv
""",
)
def inflight_max_q(spark, sf_dir):
    """Peak number of orders in flight (order date to last ship date, inclusive) and when first reached."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    last = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_ts"))
    iv = orders.join(last, orders.o_orderkey == last.l_orderkey, "left")
    return inflight_peak(iv, "o_orderdate", "end_ts")


@query(
    "index_health",
    sql=HS.base()
    + f"""
SELECT count(*)::BIGINT AS vectors, count(DISTINCT pk)::BIGINT AS "rows", count(DISTINCT "table")::BIGINT AS tables,
       64::BIGINT AS dim, {INDEXED_AT}::BIGINT AS last_indexed_at FROM chunks
""",
)
def index_health_q(spark, sf_dir):
    """Vector count, rows, tables, dimension and last indexing time of the stored documents index."""
    return index_health(stored_index(spark, sf_dir, CFG))


@query(
    "diagnostics",
    sql=HS.base(5, 5)
    + """,
nm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qf GROUP BY query_id),
rc AS (SELECT query_id, count(*)::BIGINT AS retrieval_count, max(CASE WHEN rnk = 1 THEN round(score_sem, 6) END) AS sample_score_sem
       FROM ranked GROUP BY query_id)
SELECT q.query_id, 64::BIGINT AS embed_dim, round(coalesce(nm.n, 0.0), 6) AS embed_norm,
       coalesce(rc.retrieval_count, 0)::BIGINT AS retrieval_count,
       CASE WHEN rc.retrieval_count > 0 THEN 'indexed_at,pk,score_ft,score_sem,snippet,status,table,title' END AS sample_keys, rc.sample_score_sem,
       (SELECT count(*) FROM chunks)::BIGINT AS stored_meta
FROM q LEFT JOIN nm USING (query_id) LEFT JOIN rc USING (query_id)
""",
)
def diagnostics_q(spark, sf_dir):
    """Pipeline diagnostics per benchmark query: query vector, result count (k_vec = k_ft = 5),
    first result's semantic score, index size."""
    cfg = CFG.with_(k_vec=5, k_ft=5)
    r = run_hybrid(spark, sf_dir, cfg)
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    emb = HashingEmbedder(cfg.embed_dim)
    qv = embed_queries(q, emb).select("query_id", F.round(norm("qvec"), 6).alias("embed_norm"))
    rc = r["ranked"].groupBy("query_id").agg(
        F.count(F.lit(1)).cast("long").alias("retrieval_count"),
        F.max(F.when(F.col("rnk") == 1, F.round("score_sem", 6))).alias("sample_score_sem"),
    )
    idx = stored_index(spark, sf_dir, cfg).agg(F.count(F.lit(1)).cast("long").alias("stored_meta"))
    keys = F.array_join(F.array(*[F.lit(c) for c in sorted(RESULT_KEYS)]), ",")  # of a query's first result, if it has one
    return (
        qv.join(rc, "query_id", "left")
        .crossJoin(F.broadcast(idx))  # attaches one scalar (a one-row aggregate)
        .select(
            "query_id", F.lit(emb.dim).cast("long").alias("embed_dim"), "embed_norm",
            F.coalesce("retrieval_count", F.lit(0)).cast("long").alias("retrieval_count"),
            F.when(F.col("retrieval_count") > 0, keys).alias("sample_keys"), "sample_score_sem", "stored_meta",
        )
    )


@query(
    "segmented_scan",
    sql="""
SELECT event_id, user_id, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running,
       round(value - lag(value) OVER w, 4) AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""",
)
def segmented_scan_q(spark, sf_dir):
    """Running sum and change of value per user over all events, heavy users spread over ranges."""
    order = ["ts", "event_id"]
    e = by_ranges(read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], order)
    e = previous(running_sum(e, ["user_id"], order, "value", "running"), ["user_id"], order, "value", "before")
    return e.select("event_id", "user_id", F.round("running", 2).alias("running"), F.round(F.col("value") - F.col("before"), 4).alias("change"))


_CAT_CLASS = """CASE WHEN data_type = 'VARCHAR' THEN 'text'
                     WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' OR data_type LIKE 'TIME%' THEN 'temporal'
                     ELSE 'other' END"""
_CAT_TABLES = ", ".join(f"'{t}'" for t in ALL_TABLES)


_VALUES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, n_values FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n_values)"
    for t in ALL_TABLES
)


@query(
    "catalog_columns",
    sql=f"""
SELECT table_name, ordinal_position::BIGINT AS ordinal, column_name, {_CAT_CLASS} AS type_class, n_values
FROM information_schema.columns JOIN ({_VALUES}) USING (table_name, column_name) WHERE table_name IN ({_CAT_TABLES})
""",
)
def catalog_columns_q(spark, sf_dir):
    """Schema catalog of every given table, with the non-null values that each column holds."""
    specs = [spec(spark, sf_dir, t) for t in ALL_TABLES]
    return catalog_columns(spark, specs).drop("spark_type").join(column_values(specs), ["table_name", "column_name"])


@query(
    "text_columns_first4",
    sql=f"""
SELECT table_name, ordinal, column_name, text_rank, n_values FROM (
  SELECT table_name, ordinal_position::BIGINT AS ordinal, column_name,
         row_number() OVER (PARTITION BY table_name ORDER BY ordinal_position) AS text_rank
  FROM information_schema.columns WHERE table_name IN ({_CAT_TABLES}) AND data_type = 'VARCHAR') JOIN ({_VALUES}) USING (table_name, column_name)
WHERE text_rank <= 4
""",
)
def text_columns_first4_q(spark, sf_dir):
    """First four text columns per table (the lexical-search column map) and the values they hold."""
    specs = [spec(spark, sf_dir, t) for t in ALL_TABLES]
    return text_columns_first_n(catalog_columns(spark, specs), 4).join(column_values(specs), ["table_name", "column_name"])


_ALLOWED = ("documents", "part", "orders")


@query(
    "resolved_columns",
    sql=f"""
SELECT spec, n_values FROM (VALUES ('documents.text', 'documents', 'text'), ('part.p_name', 'part', 'p_name')) s(spec, table_name, column_name)
JOIN ({_VALUES}) USING (table_name, column_name)
""",
)
def resolved_columns_q(spark, sf_dir):
    """Index columns from explicit names: tables off the allow-list and unknown columns drop out; with the
    values that the others hold."""
    specs = [spec(spark, sf_dir, t) for t in ALL_TABLES if allowed(t, _ALLOWED)]
    names = ["documents.text", "part.p_name", "part.nope", "supplier.s_name", "orders"]
    valid, _ = resolve_index_columns(spark, catalog_columns(spark, specs), names, _ALLOWED)
    return valid.join(column_values(specs), ["table_name", "column_name"]).select("spec", "n_values")


_KEYS = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{"|".join(k)}' AS key, count(*)::BIGINT AS n_rows, (count(*) FILTER (WHERE {" AND ".join(f"{c} IS NOT NULL" for c in k)}))::BIGINT AS n_keyed,
        (SELECT count(*) FROM (SELECT DISTINCT {", ".join(k)} FROM {t} WHERE {" AND ".join(f"{c} IS NOT NULL" for c in k)}))::BIGINT AS n_keys FROM {t}"""
    for t, k in TABLE_KEYS.items()
)


@query("key_report", sql=f"SELECT *, n_rows = n_keys AS is_key FROM ({_KEYS})")
def key_report_q(spark, sf_dir):
    """The declared key of every given table against its rows."""
    return key_report([spec(spark, sf_dir, t) for t in ALL_TABLES])
