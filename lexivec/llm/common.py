"""Helpers shared by the corpus operators: table access, shared-folder tables, Arrow batches.

Tables that several jobs read again are written to the folder in ``spark.checkpoint.dir``
(``lexivec.session.work_dir``), so a lost executor costs a re-read, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lexivec.session import ensure_session_defaults, scratch_path

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

#: The white space of every contract here: space and the five ASCII controls 0x09-0x0D. Python's
#: ``bytes.split``/``bytes.strip`` use exactly this set.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def setup(spark: SparkSession) -> None:
    """Session defaults, the package on the executors, and bounded Arrow batches."""
    ensure_session_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Spark alone reads the path."""
    setup(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored rows (lineage ends here)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def in_pieces(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, rows.num_rows, size):
        yield rows.slice(start, size)


#: What a Python worker remembers between tasks, and how to drop it. Workers are used again by the
#: tasks of other operators, so one operator's memo is held at a time.
_MEMOS: dict[str, Callable[[], None]] = {}


def hold_memo(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called where a task starts: drops what other operators remembered in this worker."""
    for other in [o for o in _MEMOS if o != owner]:
        _MEMOS.pop(other)()
    _MEMOS[owner] = forget


def kept(docs: DataFrame, added: dict[str, str]) -> list[str]:
    """Columns that pass through an operator which adds (or replaces) ``added``."""
    return [c for c in docs.columns if c not in added]


def map_batches(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], added: dict[str, str]) -> DataFrame:
    """``docs`` mapped batch by batch: ``make`` runs once a task and gives the function from a
    batch of the kept columns, in order, to all output columns. Inside, columns have plain
    positional names, so any column name passes through."""
    names = kept(docs, added)
    plain = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*[f"c{i}" for i in range(len(names))])
    extra = StructType([StructField(f"a{i}", _parse_datatype_string(kind)) for i, kind in enumerate(added.values())])
    schema = StructType([*plain.schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for rows in batches:
            yield pa.RecordBatch.from_arrays(step(rows), names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*names, *added)
