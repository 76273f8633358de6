"""Vector column expressions (ARRAY<FLOAT> / ARRAY<DOUBLE>), JVM-side.

These higher-order-function forms are for per-row work (normalise, norm, checks). The
query-by-corpus product that dominates search cost runs as numpy blocks in
``operators.vector_search`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12  # fixed value: added to the norm before dividing


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sumsq(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))


def norm(v: Column | str) -> Column:
    return F.sqrt(sumsq(v))


def l2_normalize(v: Column | str, as_float: bool = True) -> Column:
    """``v / (|v| + 1e-12)`` computed in DOUBLE, stored as FLOAT (as the index stores vectors)."""
    col = _c(v)
    n = norm(col) + F.lit(EPS)
    out = F.transform(col, lambda x: x.cast("double") / n)
    return out.cast("array<float>") if as_float else out


def check_dim(v: Column | str, dim: int) -> Column:
    """Fail the job on a vector of the wrong dimension (returns the vector otherwise)."""
    col = _c(v)
    return F.when(
        F.size(col) == dim, col
    ).otherwise(F.raise_error(F.concat(F.lit(f"Vector dimension mismatch: expected {dim} got "), F.size(col).cast("string"))))


def hash_code(tok: Column) -> Column:
    """32-bit code of a token: the first 8 hex digits of its MD5."""
    return F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")


def hash_codes(toks: Column) -> Column:
    return F.transform(toks, hash_code)
