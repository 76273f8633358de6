"""Text column expressions. All JVM-side (built-in functions and higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token split pattern (letters and digits are kept).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"
# Whitespace stripped from both ends of a value: every code point Python's str.isspace() accepts,
# built by rule (a plain linear trim in both engines, no regex).
WHITESPACE = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Whitespace strip on both ends (plain ``trim`` would only remove spaces)."""
    return F.trim(_c(c), F.lit(WHITESPACE))


def tokens(c: Column | str, min_len: int = 2) -> Column:
    """Lower-case split on runs of non letters/digits, tokens of at least ``min_len`` chars."""
    parts = F.split(F.lower(_c(c)), TOKEN_SPLIT)
    return F.filter(parts, lambda t: F.length(t) >= min_len)


def value_text(c: Column | str, dt: T.DataType) -> Column:
    """Explicit value-to-text rule, the same in the SQL oracle.

    Timestamps: ``yyyy-MM-dd HH:mm:ss`` plus ``.ffffff`` when there are sub-seconds; dates
    ``yyyy-MM-dd``; everything else the engine's cast to string.
    """
    col = _c(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        base = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        frac = F.date_format(col, "SSSSSS")
        return F.when(col.isNull(), None).when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))
    if isinstance(dt, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dt, T.StringType):
        return col
    return col.cast("string")


def iso_text(c: Column | str, dt: T.DataType) -> Column:
    """ISO-8601 text of a temporal value (``T`` separator), used in metadata."""
    col = _c(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        base = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        frac = F.date_format(col, "SSSSSS")
        return F.when(col.isNull(), None).when(frac == "000000", base).otherwise(F.concat(base, F.lit("."), frac))
    if isinstance(dt, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    return col.cast("string")


def fingerprint(*parts: Column) -> Column:
    """SHA-256 over every part followed by a zero byte; first 32 hex digits."""
    pieces = []
    for p in parts:
        pieces.extend([p, F.lit("\x00")])
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, 32)


def fingerprint_parts(parts: Column) -> Column:
    """Same as ``fingerprint`` over an ARRAY<STRING> of parts (NULL parts skipped); no lambda,
    so it stays in generated code."""
    joined = F.concat(F.array_join(parts, "\x00"), F.lit("\x00"))
    return F.substring(F.sha2(F.when(F.size(F.filter(parts, lambda p: p.isNotNull())) > 0, joined).otherwise(F.lit("")), 256), 1, 32)


def chunk_array(text: Column | str, size: int, min_chars: int) -> Column:
    """Fixed-size slices of ``size`` chars, slices shorter than ``min_chars`` dropped.

    Only the tail can be short (``min_chars <= size``), so the position in the kept array is
    the slice number. Empty or NULL text gives an empty array.
    """
    t = _c(text)
    n = F.length(t)
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")),
        lambda i: F.substring(t, i * size + 1, size),
    )
    kept = F.filter(slices, lambda x: F.length(x) >= min_chars)
    return F.when(n > 0, kept).otherwise(F.array().cast("array<string>"))
