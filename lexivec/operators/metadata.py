"""Metadata sanitise + flatten (P14, P15): nested values become flat ``prefix_key`` entries.

Two forms. *Long* (``metadata_entries``): rows of (key, value) per record; keys of maps are data and stay
data, so any number of them is fine. *Wide* (``flatten_metadata``): a column per key, for maps whose keys
are schema knowledge, given by the caller or discovered, ``MAX_MAP_KEYS`` of a map at most (else an error
that names the long form).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.text import iso_text


def sanitize(c: Column, dt: T.DataType) -> Column:
    """Temporal values as ISO text, durations as HH:MM:SS, everything else unchanged."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return iso_text(c, dt)
    if isinstance(dt, T.DayTimeIntervalType):
        total = (F.unix_micros(F.lit("1970-01-01").cast("timestamp") + c) / 1_000_000).cast("long")
        return F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60)
    return c


def _flatten(prefix: str, c: Column, dt: T.DataType, map_keys: dict[str, list[str]], out: list[Column]) -> None:
    if isinstance(dt, T.StructType):
        for f in dt.fields:
            _flatten(f"{prefix}_{f.name}" if prefix else f.name, c[f.name], f.dataType, map_keys, out)
    elif isinstance(dt, T.MapType):
        for k in map_keys.get(prefix, []):
            _flatten(f"{prefix}_{k}", c[k], dt.valueType, map_keys, out)
    elif isinstance(dt, T.ArrayType):
        out.append(F.transform(c, lambda e: sanitize(e, dt.elementType).cast("string")).alias(prefix))
    elif isinstance(dt, (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType)):
        out.append(c.alias(prefix))
    else:
        out.append(sanitize(c, dt).cast("string").alias(prefix))


MAX_MAP_KEYS = 1000


def discover_map_keys(df: DataFrame, col: str) -> list[str]:
    keys = [r[0] for r in df.select(F.explode(F.map_keys(col))).distinct().limit(MAX_MAP_KEYS + 1).collect()]
    if len(keys) > MAX_MAP_KEYS:
        raise ValueError(f"{col} has more than {MAX_MAP_KEYS} keys; use metadata_entries")
    return sorted(keys)


ENTRIES = "array<struct<key: string, value: string>>"


def _entries(key: Column, c: Column, dt: T.DataType) -> Column:
    """All entries below a value, by its type; nulls have none."""
    none = F.array().cast(ENTRIES)
    if isinstance(dt, T.StructType):
        parts = [_entries(F.concat(key, F.lit(f"_{f.name}")), c[f.name], f.dataType) for f in dt.fields]
        return F.concat(*parts) if parts else none
    if isinstance(dt, T.MapType):
        below = lambda e: _entries(F.concat(key, F.lit("_"), e["key"].cast("string")), e["value"], dt.valueType)
        return F.coalesce(F.flatten(F.transform(F.map_entries(c), below)), none)
    if isinstance(dt, T.ArrayType):
        value = F.to_json(c if isinstance(dt.elementType, (T.StructType, T.MapType, T.ArrayType)) else F.transform(c, lambda e: sanitize(e, dt.elementType).cast("string")))
    else:
        value = sanitize(c, dt).cast("string")
    return F.when(c.isNotNull(), F.array(F.struct(key.alias("key"), value.alias("value")))).otherwise(none)


def metadata_entries(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, key, value)``: a row for every value below the other columns, durations as HH:MM:SS, times
    in ISO form, arrays as JSON."""
    parts = [_entries(F.lit(f.name), F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if f.name not in keys]
    return df.select(*keys, F.explode(F.concat(*parts)).alias("e")).select(*keys, "e.key", "e.value")


def flatten_metadata(df: DataFrame, map_keys: dict[str, list[str]] | None = None) -> DataFrame:
    keys = dict(map_keys or {})
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType) and f.name not in keys:
            keys[f.name] = discover_map_keys(df, f.name)
    cols: list[Column] = []
    for f in df.schema.fields:
        _flatten(f.name, F.col(f.name), f.dataType, keys, cols)
    return df.select(*cols)
