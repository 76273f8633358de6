"""Guarded read-only SQL (S14) and random row sample.

The guard keeps the original acceptance rule: strip, drop trailing ';', and the text must start
with ``SELECT `` (so ``WITH``, ``(SELECT`` and ``SELECT\\n`` are refused). FIX: the default cap is
added when the *outermost* query has no LIMIT; this is read from Spark's own parsed plan, not from
the text (a LIMIT inside a subquery or a string literal no longer disables the cap). Errors come
back as data. Spark itself refuses several statements in one call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.sources.tables import TABLE_KEYS, pk_expr


@dataclass
class SqlResult:
    df: DataFrame | None
    error: str | None = None
    limited: bool = False


def _root_is_limit(df: DataFrame) -> bool:
    """Does the outermost query bound its rows? An OFFSET alone does not."""
    plan = df._jdf.queryExecution().logical()
    name = plan.getClass().getSimpleName()
    while name == "Offset":
        plan = plan.child()
        name = plan.getClass().getSimpleName()
    return name in ("GlobalLimit", "Limit", "LocalLimit", "Tail")


def guarded_sql(spark: SparkSession, query: str, params=None, limit_default: int | None = 200) -> SqlResult:
    """``limit_default``: the interactive tool's row cap; None returns whole results."""
    q = query.strip().rstrip(";")
    if not q.upper().startswith("SELECT "):
        return SqlResult(None, "Only SELECT statements allowed")
    try:
        df = spark.sql(q, args=params) if params else spark.sql(q)
        if limit_default is None or _root_is_limit(df):
            return SqlResult(df)
        return SqlResult(df.limit(limit_default), limited=True)
    except Exception as e:  # errors are data, like the original
        return SqlResult(None, f"{type(e).__name__}: {str(e).splitlines()[0][:500]}")


def run_guarded(spark: SparkSession, query: str, params=None, limit_default: int | None = 200) -> DataFrame:
    r = guarded_sql(spark, query, params, limit_default)
    if r.error is not None:
        raise ValueError(r.error)
    return r.df


def random_rows(spark: SparkSession, df: DataFrame, table: str, limit: int = 5, seed: str = "0") -> DataFrame:
    """S13 with a reproducible order: rows ordered by md5(key || seed). Planned as
    TakeOrderedAndProject (a per-task top-n, then a final merge of n rows per task)."""
    if not table.strip():
        raise ValueError("table required")
    key = pk_expr(TABLE_KEYS.get(table, ("id",)))
    return df.orderBy(F.md5(F.concat(key, F.lit(seed))), key).limit(limit)
