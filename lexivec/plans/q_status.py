"""Event status (C1-C3) and metadata flattening."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexivec.config import RetrievalConfig
from lexivec.functions.text import iso_text
from lexivec.functions.timeparse import status_of
from lexivec.operators.chunking import chunk_docs
from lexivec.operators.metadata import flatten_metadata, metadata_entries
from lexivec.operators.plan_utils import spread
from lexivec.operators.rowdocs import row_docs
from lexivec.plans import duck as D
from lexivec.plans.catalog import query
from lexivec.sources.tables import read_table, spec

CFG = RetrievalConfig()
NOW = "1999-01-01 00:00:00"
INDEXED_AT = 1_700_000_000


@query(
    "event_status",
    sql=f"""
WITH e AS (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderkey, o_orderdate AS start_ts, end_ts FROM orders LEFT JOIN e ON o_orderkey = l_orderkey)
SELECT o_orderkey, {D.ts_iso('start_ts')} AS start_date, {D.ts_iso('end_ts')} AS end_date,
       CASE WHEN end_ts IS NOT NULL AND TIMESTAMP '{NOW}' > end_ts THEN 'completed'
            WHEN start_ts IS NOT NULL AND end_ts IS NOT NULL AND start_ts <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' <= end_ts THEN 'ongoing'
            WHEN start_ts IS NOT NULL AND TIMESTAMP '{NOW}' < start_ts THEN 'upcoming' END AS status
FROM o
""",
)
def event_status_q(spark, sf_dir):
    """Every order as an event from its order date to its last ship date, status at a fixed now.

    The period is carried as a temporal map of ISO strings (as index metadata carries it) and goes
    through the same parse / start-end pick / status rules as search results.
    """
    orders = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    last = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end_ts"))
    o = orders.join(last, orders.o_orderkey == last.l_orderkey, "left")
    dt = o.schema["o_orderdate"].dataType
    start_s, end_s = iso_text(F.col("o_orderdate"), dt), iso_text(F.col("end_ts"), dt)
    temporal = F.map_from_entries(
        F.filter(
            F.array(F.struct(F.lit("start_date").alias("k"), start_s.alias("v")), F.struct(F.lit("end_date").alias("k"), end_s.alias("v"))),
            lambda e: e["v"].isNotNull(),
        )
    )
    now = F.to_timestamp(F.lit(NOW))
    return o.select(
        "o_orderkey",
        start_s.alias("start_date"),
        end_s.alias("end_date"),
        status_of(temporal, now, CFG.status_timezone).alias("status"),
    )


def _flat(spark, sf_dir, table):
    c = chunk_docs(row_docs(spec(spark, sf_dir, table), CFG), CFG, INDEXED_AT)
    meta = c.select("table", "pk", "column", "chunk", "indexed_at", "doc_name", "columns", "id", "row_fp", "temporal")
    f = flatten_metadata(meta)
    return f.withColumn("columns", F.array_join("columns", ","))


@query(
    "metadata_flatten",
    sql=f"""
SELECT "table", pk, '*' AS "column", chunk, {INDEXED_AT}::BIGINT AS indexed_at, 'orders::' || pk AS doc_name, columns,
       'orders::' || pk || '::' || chunk_idx AS id, row_fp, {D.ts_iso('o_orderdate')} AS temporal_o_orderdate
FROM ({D.chunks_of('(' + D.row_docs_cte('orders', 'o_orderkey', ['o_orderstatus', 'o_orderpriority']).replace("AS columns", "AS columns, o_orderdate").replace('columns, ' + D.fp('text') + ' AS row_fp', 'columns, o_orderdate, ' + D.fp('text') + ' AS row_fp') + ')')})
""",
)
def metadata_flatten_q(spark, sf_dir):
    """Chunk metadata of orders flattened to top-level columns (temporal map -> temporal_<col>)."""
    return _flat(spark, sf_dir, "orders")


@query(
    "metadata_flatten_events",
    sql=f"""
SELECT "table", pk, '*' AS "column", chunk, {INDEXED_AT}::BIGINT AS indexed_at, 'events::' || pk AS doc_name, columns,
       'events::' || pk || '::' || chunk_idx AS id, row_fp, {D.ts_iso('ts')} AS temporal_ts
FROM ({D.chunks_of('(' + D.row_docs_cte('events', 'event_id', ['event_type', 'props']).replace("AS columns", "AS columns, ts").replace('columns, ' + D.fp('text') + ' AS row_fp', 'columns, ts, ' + D.fp('text') + ' AS row_fp') + ')')})
""",
)
def metadata_flatten_events_q(spark, sf_dir):
    """Same for events: microsecond timestamps keep their fraction in ISO form."""
    return _flat(spark, sf_dir, "events")


@query(
    "metadata_entries",
    sql=f"""
WITH e AS (SELECT event_id, event_type, user_id, ts, event_id % 200000 AS secs, props FROM events)
SELECT event_id, 'meta_at' AS key, {D.ts_iso('ts')} AS value FROM e
UNION ALL SELECT event_id, 'meta_took', printf('%02d:%02d:%02d', secs // 3600, (secs % 3600) // 60, secs % 60) FROM e
UNION ALL SELECT event_id, 'meta_tags', '["' || event_type || '","' || user_id || '"]' FROM e
UNION ALL SELECT event_id, 'meta_props_' || k, json_extract_string(props, '$."' || k || '"') FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM e)
UNION ALL SELECT event_id, 'by_' || event_type || '_id', user_id::VARCHAR FROM e
""",
)
def metadata_entries_q(spark, sf_dir):
    """Nested metadata of every event in long form: a struct with a time, a duration, an array and a map
    parsed from ``props``, and a map of structs whose keys are data."""
    e = read_table(spark, sf_dir, "events")
    took = F.make_dt_interval(secs=(F.col("event_id") % 200_000).cast("decimal(18,6)"))
    meta = F.struct(
        F.col("ts").alias("at"), took.alias("took"), F.array("event_type", F.col("user_id").cast("string")).alias("tags"),
        F.from_json("props", "map<string,string>").alias("props"),
    )
    by = F.create_map(F.col("event_type"), F.struct(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("none")))
    return metadata_entries(e.select("event_id", meta.alias("meta"), by.alias("by")), ["event_id"])
