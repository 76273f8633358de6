"""Guarded SQL suite (Q1-Q14) over the star tables, plus the random row sample.

Each query goes through the guard and runs as Spark SQL on temp views of the given tables; the
oracle is the same SQL text in DuckDB unless a function name differs between the dialects.
Every query reads whole tables and returns its whole result: the guard's row cap is for the
interactive tool and is off here.
"""

from __future__ import annotations

from lexivec.plans.catalog import query
from lexivec.plans.sql_guard import random_rows, run_guarded
from lexivec.sources.tables import named_tables, read_table, register_views

# (name, spark sql, duckdb sql or None = same text, params)
SUITE: list[tuple[str, str, str | None, dict | None]] = [
    (
        "sql_filter_project",
        """SELECT CASE WHEN l_discount >= 0.05 THEN 'high' ELSE 'low' END AS disc_class, l_returnflag,
                  count(*) AS n, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge
           FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02 00:00:00' AND l_quantity > 10
           GROUP BY 1, 2 ORDER BY 1, 2""",
        None,
        None,
    ),
    (
        "sql_join_inner",
        """SELECT n.n_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
           FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
           GROUP BY n.n_name ORDER BY n.n_name""",
        None,
        None,
    ),
    (
        "sql_join_left",
        """SELECT n_orders, count(*) AS n_customers FROM (
             SELECT c.c_custkey, count(o.o_orderkey) AS n_orders
             FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey) t
           GROUP BY n_orders ORDER BY n_orders""",
        None,
        None,
    ),
    (
        "sql_semi",
        """SELECT c_mktsegment, count(*) AS n FROM customer c
           WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
           GROUP BY c_mktsegment ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_anti",
        """SELECT c_mktsegment, count(*) AS n FROM customer c
           WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')
           GROUP BY c_mktsegment ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_in_subquery",
        """SELECT p_type, count(*) AS n FROM part
           WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
           GROUP BY p_type ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_range_join",
        # Band join written as two equi-joins on (user, hour bucket) so a heavy user is spread
        # over its hour buckets instead of one nested loop.
        """SELECT first_type, next_type, count(*) AS n FROM (
             SELECT a.event_type AS first_type, b.event_type AS next_type
             FROM (SELECT user_id, event_type, ts, date_trunc('hour', ts) AS h FROM events) a
             JOIN (SELECT user_id, event_type, ts, date_trunc('hour', ts) AS h FROM events) b
               ON a.user_id = b.user_id AND b.h = a.h
             WHERE b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR
             UNION ALL
             SELECT a.event_type, b.event_type
             FROM (SELECT user_id, event_type, ts, date_trunc('hour', ts) AS h FROM events) a
             JOIN (SELECT user_id, event_type, ts, date_trunc('hour', ts) AS h FROM events) b
               ON a.user_id = b.user_id AND b.h = a.h + INTERVAL 1 HOUR
             WHERE b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR) p
           GROUP BY 1, 2 ORDER BY 1, 2""",
        None,
        None,
    ),
    (
        "sql_agg",
        """SELECT l_returnflag, l_linestatus, count(*) AS count_order, round(sum(l_quantity), 2) AS sum_qty,
                  CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS sum_price_cents, round(max(l_discount), 2) AS max_disc
           FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10 ORDER BY 1, 2""",
        None,
        None,
    ),
    (
        "sql_count_distinct",
        """SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_suppkey) AS n_supp
           FROM lineitem GROUP BY l_returnflag ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_rollup",
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
           FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority) ORDER BY 1, 2""",
        None,
        None,
    ),
    (
        "sql_rank",
        """SELECT * FROM (
             SELECT o_orderpriority, o_orderkey, o_totalprice,
                    CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rk
             FROM orders) t WHERE rk <= 3 ORDER BY o_orderpriority, rk""",
        None,
        None,
    ),
    (
        "sql_lag",
        """SELECT event_type, count(*) AS n, CAST(round(sum(dv) * 100) AS BIGINT) AS sum_delta_cents FROM (
             SELECT event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dv FROM events) t
           WHERE dv IS NOT NULL GROUP BY event_type ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_running_sum",
        """SELECT user_id, count(*) AS n, round(max(rs), 2) AS max_running FROM (
             SELECT user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rs FROM events) t
           GROUP BY user_id ORDER BY user_id""",
        None,
        None,
    ),
    (
        "sql_topk",
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
        None,
        None,
    ),
    (
        "sql_union",
        "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY 1",
        None,
        None,
    ),
    (
        "sql_intersect",
        """SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000
           INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_except",
        """SELECT n_nationkey AS k FROM nation
           EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_scalar_subquery",
        "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
        None,
        None,
    ),
    (
        "sql_correlated",
        """SELECT c_mktsegment, count(*) AS n FROM customer c
           WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)
           GROUP BY c_mktsegment ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_string_fns",
        """SELECT upper(substr(p_name, 1, 3)) AS prefix, count(*) AS n, CAST(max(length(p_name)) AS BIGINT) AS max_len,
                  min(concat(lower(p_brand), '-', replace(p_type, 'A', 'a'))) AS first_bt, max(trim(p_name)) AS last_name
           FROM part GROUP BY 1 ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_date_fns",
        """SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n,
                  CAST(max(dayofmonth(o_orderdate)) AS BIGINT) AS last_day
           FROM orders GROUP BY 1, 2 ORDER BY 1, 2""",
        None,
        None,
    ),
    (
        "sql_math_fns",
        """SELECT p_type, round(avg(sqrt(p_retailprice)), 4) AS avg_sqrt, round(max(ln(p_retailprice)), 4) AS max_ln,
                  round(sum(abs(p_retailprice - 1000)), 2) AS dev, CAST(floor(min(p_retailprice)) AS BIGINT) AS fl,
                  CAST(max(p_size) % 7 AS BIGINT) AS size_mod
           FROM part GROUP BY p_type ORDER BY 1""",
        None,
        None,
    ),
    (
        "sql_json",
        """SELECT event_type, count(*) AS n, CAST(sum(CAST(get_json_object(props, '$.k') AS INT)) AS BIGINT) AS sum_k
           FROM events GROUP BY event_type ORDER BY 1""",
        """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k
           FROM events GROUP BY event_type ORDER BY 1""",
        None,
    ),
    (
        "sql_params",
        """SELECT o_orderpriority, count(*) AS n FROM orders
           WHERE o_totalprice > :min_price AND o_orderstatus = :status GROUP BY o_orderpriority ORDER BY 1""",
        """SELECT o_orderpriority, count(*) AS n FROM orders
           WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY 1""",
        {"min_price": 100000.0, "status": "F"},
    ),
]


def _make(sql: str, params):
    def run(spark, sf_dir):
        register_views(spark, sf_dir, named_tables(spark, sql))
        return run_guarded(spark, sql, params, limit_default=None)

    return run


for _name, _sql, _duck, _params in SUITE:
    query(_name, sql=_duck or _sql)(_make(_sql, _params))


@query(
    "random_rows",
    sql="SELECT * FROM part ORDER BY md5(p_partkey::VARCHAR || '42'), p_partkey LIMIT 5",
)
def random_rows_q(spark, sf_dir):
    """Five rows of part in a reproducible pseudo-random order (seed 42)."""
    return random_rows(spark, read_table(spark, sf_dir, "part"), "part", 5, "42")
