"""Table registry and schema catalog.

A source table is a DataFrame plus its key columns. Parquet carries no key constraint, so
keys are declared in a ``TableSpec``; a composite key becomes one canonical string
(``a|b``), and every key is a STRING downstream so index keys compare exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Key columns of the driver tables (composite where one column is not unique).
TABLE_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "benchmark": ("item_id",),
    "labels": ("doc_id",),
    "conversations": ("conv_id", "turn"),
}
ALL_TABLES = tuple(TABLE_KEYS)
DEFAULT_PK = "id"


def type_class(dt: T.DataType) -> str:
    """Map a Spark type to the reference's column classes: text / temporal / other."""
    if isinstance(dt, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    return "other"


@dataclass(frozen=True)
class TableSpec:
    name: str
    df: DataFrame
    pk: tuple[str, ...] = (DEFAULT_PK,)
    text_cols: tuple[str, ...] | None = None  # None = discover by type

    def pk_col(self) -> Column:
        return pk_expr(self.pk)

    def fields(self) -> list[T.StructField]:
        return list(self.df.schema.fields)

    def discovered_text_cols(self, always_include_patterns: tuple[str, ...] = ()) -> list[str]:
        """Text-typed columns, plus columns whose name matches a pattern (regex search,
        case-insensitive; a bad pattern raises, like the original)."""
        if self.text_cols is not None:
            return list(self.text_cols)
        pats = [re.compile(p, re.IGNORECASE) for p in always_include_patterns]
        out = []
        for f in self.fields():
            if type_class(f.dataType) == "text" or any(p.search(f.name) for p in pats):
                out.append(f.name)
        return out

    def temporal_cols(self, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
        """Temporal-typed columns not already used as text, in schema order."""
        return [f.name for f in self.fields() if type_class(f.dataType) == "temporal" and f.name not in exclude]


def pk_expr(cols: tuple[str, ...] | list[str]) -> Column:
    """Canonical STRING key; composite keys joined by '|'."""
    if len(cols) == 1:
        return F.col(cols[0]).cast("string")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spec(spark: SparkSession, sf_dir: str, name: str, text_cols: tuple[str, ...] | None = None) -> TableSpec:
    return TableSpec(name, read_table(spark, sf_dir, name), TABLE_KEYS.get(name, (DEFAULT_PK,)), text_cols)


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ALL_TABLES) -> None:
    """Temp views for guarded SQL, always set to this folder (lazy: only footers are read)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def named_tables(spark: SparkSession, sql: str) -> tuple[str, ...]:
    """The given tables that a statement names, by Spark's parser; all of them if it cannot tell.
    A name that the statement itself defines may be among them, which does no harm."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString().lower()
    except Exception:  # the guard reports what is wrong with the statement
        return ALL_TABLES
    return tuple(t for t in ALL_TABLES if re.search(rf"\b{t}\b", plan))


def allowed(table: str, allow_list: tuple[str, ...] | None) -> bool:
    """An empty list or '*' allows every table."""
    if not allow_list:
        return True
    names = {t for t in allow_list if t != "*"}
    return not names or table in names


# ---------------------------------------------------------------------------
# Catalog DataFrames. Built from schema metadata (the footers), not data.
# ---------------------------------------------------------------------------
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("type_class", T.StringType()),
        T.StructField("spark_type", T.StringType()),
    ]
)


def catalog_columns(spark: SparkSession, specs: list[TableSpec], allow_list: tuple[str, ...] | None = None) -> DataFrame:
    rows = []
    for s in specs:
        if not allowed(s.name, allow_list):
            continue
        for i, f in enumerate(s.fields(), start=1):
            rows.append((s.name, i, f.name, type_class(f.dataType), f.dataType.simpleString()))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def column_values(specs: list[TableSpec]) -> DataFrame:
    """``(table_name, column_name, n_values)``: non-null values of every column, one pass a table."""
    out = None
    for s in specs:
        names = [f.name for f in s.fields()]
        counts = s.df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n_values")) for i, c in enumerate(names)])
        rows = counts.select(F.lit(s.name).alias("table_name"), F.explode(pairs).alias("x")).select("table_name", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def key_report(specs: list[TableSpec]) -> DataFrame:
    """``(table_name, key, n_rows, n_keyed, n_keys, is_key)``: does the declared key tell the rows
    of each table apart? Rows per key are counted first, so no set of keys is held in one place."""
    out = None
    for s in specs:
        null = F.lit(False)
        for c in s.pk:
            null = null | F.col(c).isNull()
        per_key = s.df.select(F.when(~null, s.pk_col()).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        row = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).alias("n_keyed"),
            F.count("k").alias("n_keys"),
        ).select(F.lit(s.name).alias("table_name"), F.lit("|".join(s.pk)).alias("key"), "*", (F.col("n_rows") == F.col("n_keys")).alias("is_key"))
        out = row if out is None else out.unionByName(row)
    return out


def text_columns_first_n(catalog: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` text columns by ordinal per table; tables without one drop out."""
    from pyspark.sql import Window

    w = Window.partitionBy("table_name").orderBy("ordinal")
    return (
        catalog.where(F.col("type_class") == "text")
        .withColumn("text_rank", F.row_number().over(w))
        .where(F.col("text_rank") <= n)
        .select("table_name", "ordinal", "column_name", F.col("text_rank").cast("long").alias("text_rank"))
    )


def resolve_index_columns(
    spark: SparkSession,
    catalog: DataFrame,
    column_specs: list[str],
    allow_list: tuple[str, ...] | None = None,
    auto_discover: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Validate explicit ``table.column`` specs against the catalog.

    Returns ``(valid, missing)``. When no spec is valid, falls back to every text column of the
    allowed tables (if ``auto_discover``), else to nothing.
    """
    raw = [s.strip() for s in column_specs if s.strip()]
    spec_schema = "spec string, table_name string, column_name string"
    explicit = bool(raw) and raw != ["*"]
    specs_df = spark.createDataFrame(
        [(s, s.split(".", 1)[0] if "." in s else None, s.split(".", 1)[1] if "." in s else None) for s in raw],
        spec_schema,
    )
    allowed_names = [t for t in (allow_list or ()) if t != "*"]
    cat = catalog.select("table_name", "column_name", "ordinal", "type_class")
    if allowed_names:
        specs_ok = specs_df.where(F.col("table_name").isin(allowed_names))
        cat = cat.where(F.col("table_name").isin(allowed_names))
    else:
        specs_ok = specs_df
    valid = specs_ok.join(cat, ["table_name", "column_name"], "left_semi") if explicit else specs_df.limit(0)
    missing = specs_df.join(valid, "spec", "left_anti") if explicit else specs_df.limit(0)
    auto = cat.where(F.col("type_class") == "text").select(
        F.concat_ws(".", "table_name", "column_name").alias("spec"), "table_name", "column_name"
    )
    if not auto_discover:
        auto = auto.limit(0)
    # The fallback is decided on the (tiny) count of valid specs.
    if explicit and valid.limit(1).count() > 0:
        return valid, missing
    return auto, missing
