"""Token counts through a digest cache.

The cache is a stored table (tokenizer, digest, n_tokens): the SHA-256 of the tokenizer file with
the library's version and settings, the SHA-256 of the normalised content (null is empty, nothing
else changes), and the count. A call joins the documents' digests with the cache, encodes one row
of each distinct digest that is missing, appends the new counts, and joins all rows with the
cache. Another tokenizer, or another version, has another digest and never meets old counts.

Only the text of misses is encoded, where it is scanned: the shorter of two lists, of the rows to
encode or of those to skip, is broadcast when its checked size allows; else the rows to encode are
found by a shuffled join on the digest.

Defined results: null texts count as empty (0 tokens); texts are encoded whole; repeated rows get
the same count; null ids are kept; columns beside doc_id and text are not read; an empty table gives
no rows and appends nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivec.llm.bpe import ENTRY_BYTES, MEMO_BYTES, MEMO_CHARS, cut_specials, cuts_words
from lexivec.llm.common import batch, hold_memo, save, text_or_empty

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Rows of a list that is broadcast (some 60 bytes each).
BROADCAST_ROWS = 500_000


def tokenizer_digest(spec: str) -> str:
    import tokenizers

    return hashlib.sha256(f"{tokenizers.__version__}|plain|{spec}".encode()).hexdigest()


class PieceCounter:
    """Counts by the tokenizers library. A text is encoded in pieces cut before single spaces,
    where the byte-level pre-tokenizer always starts a word; pieces met before are looked up."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.forget()

    def forget(self) -> None:
        self.pieces: dict[str, int] = {}  # piece without the space before it -> tokens with it
        self.held = 0

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.held > MEMO_BYTES:
            self.forget()
        known = self.pieces.get
        total = [0] * len(texts)
        whole: list[tuple[int, str]] = []
        waiting: list[tuple[int, list[str]]] = []
        fresh: dict[str, None] = {}
        for n, text in enumerate(texts):
            for part in cut_specials(text, self.special):
                pieces = part.split(" ")
                inner = pieces[1:-1]
                new = {p for p in inner if p not in self.pieces}
                if part in self.special or len(pieces) == 1 or not cuts_words(pieces[0], new, pieces[-1]):
                    whole.append((n, part))
                    continue
                whole += [(n, p) for p in (pieces[0], " " + pieces[-1]) if p]
                fresh.update(dict.fromkeys(sorted(new)))
                waiting.append((n, inner))
        for size, (p, k) in zip(self._library([" " + p for p in fresh] + [p for _, p in whole]), [(p, None) for p in fresh] + whole, strict=True):
            if k is None:
                self.pieces[p] = size
            else:
                total[p] += size
        for n, inner in waiting:
            total[n] += sum(map(known, inner))
        for p in fresh:
            if len(p) > MEMO_CHARS:
                del self.pieces[p]
            else:
                self.held += ENTRY_BYTES + len(p)
        return total


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a cache that has no rows yet is an empty table there."""
    if not _exists(spark, path):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _texts_of(docs: DataFrame, keys: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Rows (digest, text) of ``docs`` that are in ``wanted`` (doc_id, digest)."""
    here = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    on = lambda other: here.doc_id.eqNullSafe(other.doc_id) & (here.digest == other.digest)
    skipped = keys.join(wanted, keys.doc_id.eqNullSafe(wanted.doc_id) & (keys.digest == wanted.digest), "left_anti").select("doc_id", "digest").distinct()
    n_wanted, n_skipped = wanted.count(), skipped.count()
    if n_skipped == 0:
        found = here
    elif n_skipped <= min(n_wanted, limit):
        found = here.join(F.broadcast(skipped), on(skipped), "left_anti")
    elif n_wanted <= limit:
        found = here.join(F.broadcast(wanted), on(wanted), "left_semi")
    else:
        found = here.join(wanted, on(wanted), "left_semi")
    return found.select("digest", "text")


def count_tokens(docs: DataFrame, spec: str, cache_path: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(spec)
    text = text_or_empty()
    keys = save(docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    cached = open_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer).select("digest")
    wanted = save(keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(cached, "digest", "left_anti").select("doc_id", "digest"), "token-misses")
    shared = spark.sparkContext.broadcast(spec)
    out = pa.schema([("tokenizer", pa.string()), ("digest", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(shared.value)
        for rows in batches:
            yield batch(out, [tokenizer] * rows.num_rows, rows.column(0), counter(rows.column(1).to_pylist()))

    counted = _texts_of(docs, keys, wanted, limit).mapInArrow(run, CACHE_SCHEMA).dropDuplicates(["digest"])
    counted.write.mode("append").option("compression", "zstd").parquet(cache_path)
    # A job that failed half-way and was run again may have appended a digest twice.
    stored = open_cache(spark, cache_path).where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    stored = save(stored, "token-counts")  # a plain side, so that AQE can split a hot digest's rows
    return keys.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens")


_COUNTERS: dict[str, PieceCounter] = {}


def counter_of(spec: str) -> PieceCounter:
    """One counter per Python worker and tokenizer; its pieces serve the worker's later tasks."""
    digest = hashlib.sha256(spec.encode()).hexdigest()
    if digest not in _COUNTERS:
        _COUNTERS[digest] = PieceCounter(spec)
    hold_memo("token counts", lambda: [c.forget() for c in _COUNTERS.values()])
    return _COUNTERS[digest]
