"""Embedders.

An embedder turns a text column into an ARRAY<FLOAT> column. Two implementations:

* ``HashingEmbedder``: deterministic feature hashing (Weinberger et al., 2009). Token codes are
  computed JVM-side (``md5``), the dense signed-count vector is built per Arrow batch with one
  ``numpy.bincount`` a block of rows (a scalar pandas UDF), then L2-normalised. Stands in for a hosted model.
* ``PandasEmbedder``: wraps any ``pd.Series[str] -> np.ndarray[n, dim]`` model function; it runs
  in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` = the service batch size) on
  every executor, so parallelism is the number of partitions.

Rows carry their keys, so batch order is irrelevant (the original re-assembled outputs by index).
"""

from __future__ import annotations

import hashlib
from itertools import chain
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.text import py_strip, tokens
from lexivec.functions.vectors import EPS, hash_codes


def _dense_from_codes(codes: list[list[int]], dim: int) -> np.ndarray:
    n = len(codes)
    lens = np.fromiter(map(len, codes), dtype=np.int64, count=n)
    total = int(lens.sum())
    flat = np.fromiter(chain.from_iterable(codes), dtype=np.int64, count=total)
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    sign = np.where((flat // dim) % 2 == 0, 1.0, -1.0)
    dense = np.bincount(rows * dim + flat % dim, weights=sign, minlength=n * dim).reshape(n, dim)
    norms = np.sqrt((dense * dense).sum(axis=1, keepdims=True)) + EPS
    return (dense / norms).astype(np.float32)


BLOCK = 512  # texts whose codes are held at a time
_SPLIT = _LATIN = None
_CODE_CACHE: dict[str, int] = {}
#: What a worker remembers of tokens: their number, and the longest that is worth it. A full cache
#: starts again, so a worker's memory does not grow with the vocabulary.
_CACHE_MAX, _CACHE_CHARS = 1 << 16, 32


def _words(text: str, empty: bool) -> list[str]:
    """Runs of letters and digits, lower-cased; with ``empty`` also the empty ones at both ends. A text of
    Latin-1 characters is cut by a table of their 256 bytes, filled by the regular expression that cuts all others."""
    global _SPLIT, _LATIN
    if _SPLIT is None:
        import regex

        _SPLIT = regex.compile(r"[^\p{L}\p{N}]+")
        _LATIN = bytes(ord(" ") if _SPLIT.fullmatch(chr(b)) else b for b in range(256))
    text = text.lower()
    if empty:
        return _SPLIT.split(text)
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _SPLIT.split(text)


def _token_codes(text: str | None, min_len: int) -> list[int]:
    """Same tokens as ``functions.text.tokens`` (lower-case, split on non letters/digits, length
    >= min_len); code = first 32 bits of the token's MD5. A bounded per-worker cache skips
    re-hashing frequent tokens."""
    if not text:
        return []
    cache = _CODE_CACHE
    toks = [t for t in _words(text, min_len < 1) if len(t) >= min_len]
    try:
        return list(map(cache.__getitem__, toks))
    except KeyError:
        pass
    out = []
    for t in toks:
        c = cache.get(t)
        if c is None:
            c = int.from_bytes(hashlib.md5(t.encode("utf-8")).digest()[:4], "big")
            if len(t) <= _CACHE_CHARS:
                if len(cache) >= _CACHE_MAX:
                    cache.clear()
                cache[t] = c
        out.append(c)
    return out


class Embedder:
    dim: int

    @property
    def identity(self) -> str | None:
        """Names the model behind the vectors, for stored indexes; None when it is unknown."""
        return None

    def embed(self, text: Column) -> Column:  # pragma: no cover - interface
        raise NotImplementedError

    def embed_df(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        return df.withColumn(out_col, self.embed(F.col(text_col)))


class HashingEmbedder(Embedder):
    """Feature hashing: signed counts of token codes in ``dim`` buckets, L2-normalised.

    Bucket = code mod dim, sign = + when (code div dim) is even. Runs per Arrow batch in a
    scalar pandas UDF (a model-inference step): tokens and codes in Python, one ``bincount``
    per block of rows for the dense vectors.
    """

    def __init__(self, dim: int = 64, min_token_len: int = 2):
        self.dim = dim
        self.min_token_len = min_token_len
        d, m = dim, min_token_len

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def _embed(texts: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(texts), BLOCK):
                out += list(_dense_from_codes([_token_codes(t, m) for t in texts[at : at + BLOCK]], d))
            return pd.Series(out, dtype=object)

        self._udf = _embed

    @property
    def identity(self) -> str:
        return f"hashing:{self.dim}:{self.min_token_len}"

    def codes(self, text: Column) -> Column:
        """JVM form of the token codes (used to cross-check the Python tokenizer)."""
        return hash_codes(tokens(text, self.min_token_len))

    def embed(self, text: Column) -> Column:
        return self._udf(text)


class PandasEmbedder(Embedder):
    """Any batch model: ``fn(texts: pd.Series) -> np.ndarray`` of shape (n, dim). Vectors are
    L2-normalised, since search reads scores as cosines. ``model``: the model's name and version."""

    def __init__(self, fn: Callable[[pd.Series], np.ndarray], dim: int, model: str | None = None):
        self.dim = dim
        self.model = model
        d = dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def _embed(texts: pd.Series) -> pd.Series:
            arr = np.asarray(fn(texts.fillna("")), dtype=np.float32)
            if arr.shape != (len(texts), d):
                raise RuntimeError("Embedding response size mismatch")
            wide = arr.astype(np.float64)
            norms = np.sqrt((wide * wide).sum(axis=1, keepdims=True)) + EPS
            return pd.Series(list((wide / norms).astype(np.float32)))

        self._udf = _embed

    @property
    def identity(self) -> str | None:
        return self.model and f"model:{self.model}:{self.dim}"

    def embed(self, text: Column) -> Column:
        return self._udf(text)


def embed_queries(queries: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "qvec") -> DataFrame:
    """The key is the stripped text; a blank key gets the zero vector; each distinct key is
    embedded once and joined back (the distinct set is shuffled by key, not collected)."""
    keyed = queries.withColumn("_qkey", py_strip(F.col(text_col)))
    distinct = keyed.select("_qkey").where(F.col("_qkey") != "").distinct()
    vecs = embedder.embed_df(distinct, "_qkey", out_col)
    zero = F.array_repeat(F.lit(0.0).cast("float"), embedder.dim)
    return (
        keyed.join(vecs, "_qkey", "left")
        .withColumn(out_col, F.when(F.col("_qkey") == "", zero).otherwise(F.col(out_col)))
        .drop("_qkey")
    )
