"""Row documents.

A row document is one row of a source table turned into text:

    table, pk STRING, text, column ('*' or the column), columns ARRAY<STRING>,
    temporal MAP<STRING,STRING> (NULL when the row has none), row_fp

Everything is a projection of the scan, so Catalyst prunes the parquet read to the key, text
and temporal columns and the work pipelines inside one whole-stage-codegen stage.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.config import ROW_PART_SEP, RetrievalConfig
from lexivec.functions.text import fingerprint_parts, iso_text, py_strip, value_text
from lexivec.sources.tables import TableSpec, type_class

ROW_DOC_COLUMNS = ["table", "pk", "text", "column", "columns", "temporal", "row_fp"]


def _capped(spec: TableSpec, cfg: RetrievalConfig) -> DataFrame:
    """S1 row cap: opt-in, and a deterministic subset (lowest keys) when set."""
    df = spec.df
    if cfg.index_row_limit is not None:
        df = df.orderBy(*spec.pk).limit(cfg.index_row_limit)
    return df


def temporal_map(spec: TableSpec, names: list[str]) -> Column:
    """Temporal-typed columns among ``names`` (schema order) as ISO text; NULL entries
    dropped; NULL when nothing is left."""
    fields = {f.name: f for f in spec.fields()}
    tcols = [n for n in [f.name for f in spec.fields()] if n in names and type_class(fields[n].dataType) == "temporal"]
    if not tcols:
        return F.lit(None).cast("map<string,string>")
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), iso_text(F.col(c), fields[c].dataType).alias("v")) for c in tcols]),
        lambda e: e["v"].isNotNull(),
    )
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def fingerprint_extras(spec: TableSpec, raw_cols: list[str], patterns: tuple[str, ...]) -> list[Column]:
    """Raw values of columns whose name matches a pattern, sorted by lower-case name.
    Bad patterns are ignored; values are not stripped."""
    pats = []
    for p in patterns:
        try:
            pats.append(re.compile(p, re.IGNORECASE))
        except re.error:
            continue
    if not pats:
        return []
    fields = {f.name: f for f in spec.fields()}
    names = sorted(raw_cols, key=lambda s: s.lower())
    return [value_text(F.col(n), fields[n].dataType) for n in names if any(p.search(n) for p in pats)]


def row_docs(spec: TableSpec, cfg: RetrievalConfig) -> DataFrame:
    """S1 + P1-P5 + P11/P12 + B3: combined row text of every row of one table."""
    text_cols = spec.discovered_text_cols(cfg.always_include_patterns)
    schema = spec.df.schema
    if not text_cols:
        return spec.df.sparkSession.createDataFrame([], row_doc_schema())
    temporal_only = spec.temporal_cols(exclude=text_cols)
    raw_cols = text_cols + temporal_only
    parts = []
    for c in text_cols:
        v = py_strip(value_text(F.col(c), schema[c].dataType))
        part = F.concat(F.lit(f"{c}: "), v) if cfg.include_column_names else v
        parts.append(F.struct(F.lit(c).alias("name"), part.alias("part"), v.alias("raw")))
    kept = F.filter(F.array(*parts), lambda p: p["raw"].isNotNull() & (p["raw"] != ""))
    df = _capped(spec, cfg).select(
        F.lit(spec.name).alias("table"),
        spec.pk_col().alias("pk"),
        kept.alias("_parts"),
        temporal_map(spec, raw_cols).alias("temporal"),
        *[e.alias(f"_x{i}") for i, e in enumerate(fingerprint_extras(spec, raw_cols, cfg.fingerprint_include_patterns))],
    )
    extras = [c for c in df.columns if c.startswith("_x")]
    text = F.array_join(F.transform("_parts", lambda p: p["part"]), ROW_PART_SEP)
    return (
        df.where(F.size("_parts") > 0)
        .select(
            "table",
            "pk",
            text.alias("text"),
            F.lit("*").alias("column"),
            F.transform("_parts", lambda p: p["name"]).alias("columns"),
            "temporal",
            *extras,
        )
        .withColumn("row_fp", fingerprint_parts(F.array(F.col("text"), *[F.col(x) for x in extras])))
        .select(*ROW_DOC_COLUMNS)
    )


def column_docs(spec: TableSpec, column: str, cfg: RetrievalConfig) -> DataFrame:
    """S2 + B2: one document per non-NULL value of a single column; fingerprint over that text."""
    dt = spec.df.schema[column].dataType
    df = _capped(spec, cfg).where(F.col(column).isNotNull())
    text = value_text(F.col(column), dt)
    fields = [f.name for f in spec.fields()]
    return df.select(
        F.lit(spec.name).alias("table"),
        spec.pk_col().alias("pk"),
        text.alias("text"),
        F.lit(column).alias("column"),
        F.array(F.lit(column)).alias("columns"),
        temporal_map(spec, fields).alias("temporal"),
    ).withColumn("row_fp", fingerprint_parts(F.array("text")))


def row_doc_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("table", T.StringType()),
            T.StructField("pk", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("column", T.StringType()),
            T.StructField("columns", T.ArrayType(T.StringType())),
            T.StructField("temporal", T.MapType(T.StringType(), T.StringType())),
            T.StructField("row_fp", T.StringType()),
        ]
    )


def corpus_docs(specs: list[TableSpec], cfg: RetrievalConfig, column_specs: list[str] | None = None) -> DataFrame:
    """B1/B2 input: combined rows of every table once, or one document per ``table.column``."""
    out = None
    if cfg.combine_row_columns or not column_specs:
        parts = [row_docs(s, cfg) for s in specs]
    else:
        by_name = {s.name: s for s in specs}
        parts = []
        for sp in column_specs:
            t, c = sp.split(".", 1)
            if t in by_name:
                parts.append(column_docs(by_name[t], c, cfg))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
