"""Query catalogue: every registered query is ``fn(spark, sf_dir) -> DataFrame`` plus, where SQL
can express it, an equivalent DuckDB SQL text over the same parquet tables.

Modules register into ``REGISTRY`` with the ``query`` decorator; ``__spark_entry__`` exposes it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Import for side effects (registration), in catalogue order.
    from lexivec.plans import (  # noqa: F401
        q_vectors,
        q_rows,
        q_hybrid,
        q_text,
        q_status,
        q_incremental,
        q_sql,
        q_state,
        q_reports,
        q_stream,
    )

    return REGISTRY
