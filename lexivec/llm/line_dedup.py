"""Reversible line dedup: exact reference counts per line, and sharded cuckoo filters over them.

The state is a table ``(key, n)``: how many documents hold each line key (a 128-bit XXH3 digest of
the line, ASCII white space stripped, A-Z lower-cased). Inserting documents adds to the counts,
deleting them subtracts, so a deletion restores exactly what the insertion changed. The keys held
by ``min_docs`` documents or more are also kept in cuckoo filters, one per shard of the key space;
a key that crosses the threshold is inserted into its shard's filter or deleted from it, and a
full shard is rebuilt with twice the buckets from the exact table.

Reading: a line that misses its shard's filter stays, without any shuffle. Lines that hit are joined
with the exact table, so a false positive never drops a line. The filters are broadcast after their
size is checked; beyond the budget every line goes to the exact join (same rows).

Defined results: null and empty texts are one empty line; keys shorter than ``min_chars`` code
points are never dropped; a line repeated in one document counts once; repeated rows count as
documents of their own; null ids are joined null-safely; columns named like the results
(``n_lines``, ``n_dropped``) are replaced, all others pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, hold_memo, kept, map_batches, save, text_bytes

SLOTS = 4
LOAD = 0.9
KICKS = 500
#: Keys a shard is planned for, and the broadcast budget of all filters together.
SHARD_KEYS = 50_000
FILTER_BUDGET = 64 << 20


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """The 16-byte key of a line; None when it is too short to count."""
    line = line.strip().lower()
    if len(line) < min_chars or (min_chars > 1 and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line)


class CuckooShard:
    """A cuckoo filter: 16-bit fingerprints, two candidate buckets of four slots, deletions."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # buckets x SLOTS, 0 is free
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooShard:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, keys: list[bytes]):
        words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        mark = (words[:, 0] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (words[:, 1] & np.uint64(self.mask)).astype(np.int64)
        return mark, one, self.other(one, mark)

    def other(self, bucket, mark):
        return (bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) >> 7)) & self.mask

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        mark, one, two = self.places(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def _put(self, bucket: int, mark) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, keys: list[bytes]) -> bool:
        """False when the shard is too full; it must then be rebuilt."""
        if not keys:
            return True
        for mark, one, two in zip(*self.places(keys), strict=True):
            if self._put(one, mark) or self._put(two, mark):
                continue
            bucket = two
            for kick in range(KICKS):
                slot = kick % SLOTS
                mark, self.slots[bucket, slot] = self.slots[bucket, slot], mark
                bucket = int(self.other(np.int64(bucket), mark))
                if self._put(bucket, mark):
                    break
            else:
                return False
        return True

    def delete(self, keys: list[bytes]) -> None:
        """Only keys that were inserted; the exact table sees to that."""
        if not keys:
            return
        for mark, one, two in zip(*self.places(keys), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    @classmethod
    def holding(cls, keys: list[bytes]) -> CuckooShard:
        size = len(keys)
        while not (shard := cls.sized(size)).insert(keys):
            size = 2 * max(size, 1)
        return shard


# --- the exact table ---------------------------------------------------------------------------


def count_lines(docs: DataFrame, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(key, n): documents that hold each key; counted per batch before the shuffle."""
    out = pa.schema([("key", pa.binary()), ("n", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memo("lines")
        for rows in batches:
            found: Counter[bytes | None] = Counter()
            for body in text_bytes(rows.column(0)):
                found.update({line_key(x, min_chars) for x in body.split(b"\n")})
            found.pop(None, None)
            yield batch(out, list(found), list(found.values()))

    return docs.select(F.col(text).cast("string")).mapInArrow(keys, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def change_counts(counts: DataFrame | None, inserted: DataFrame | None, deleted: DataFrame | None, min_chars: int = 1) -> DataFrame:
    """The table after inserting and deleting documents: (key, n, was). Keys whose count falls to
    zero go. One shuffle of deltas and stored counts, pre-aggregated."""
    parts = []
    if counts is not None:
        parts.append(counts.select("key", F.col("n").alias("was"), F.lit(0).cast("long").alias("delta")))
    for docs, sign in ((inserted, 1), (deleted, -1)):
        if docs is not None:
            parts.append(count_lines(docs, min_chars).select("key", F.lit(0).cast("long").alias("was"), (F.col("n") * sign).alias("delta")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("key").agg(F.sum("was").alias("was"), F.sum("delta").alias("delta"))
    return merged.select("key", (F.col("was") + F.col("delta")).alias("n"), "was").where("n > 0 or was > 0")


# --- the filters -------------------------------------------------------------------------------


def change_filters(filters: DataFrame | None, changed: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """Filters (shard, slots) after a change of the exact table. ``changed``: (key, n, was). A
    group is one shard, planned for ``SHARD_KEYS`` keys."""
    now, before = F.col("n") >= min_docs, F.col("was") >= min_docs
    marked = changed.where(now | before).select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", F.when(now & before, 0).when(now, 1).otherwise(-1).alias("move")
    )
    out = "shard int, slots binary"
    old = filters if filters is not None else changed.sparkSession.createDataFrame([], out)

    def one(key, stored: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        pick = lambda *kinds: [bytes(k) for k in moves.key[moves.move.isin(kinds)]]
        if len(stored):
            shard = CuckooShard(np.frombuffer(bytes(stored.slots.iloc[0]), np.uint16).reshape(-1, SLOTS).copy())
            shard.delete(pick(-1))
            if not shard.insert(pick(1)):
                shard = CuckooShard.holding(pick(0, 1))
        else:
            shard = CuckooShard.holding(pick(0, 1))
        return pd.DataFrame({"shard": [key[0]], "slots": [shard.slots.tobytes()]})

    return old.groupBy("shard").cogroup(marked.groupBy("shard")).applyInPandas(one, out)


def plan_shards(counts: DataFrame, min_docs: int) -> int:
    return max(1, -(-counts.where(F.col("n") >= min_docs).count() // SHARD_KEYS))


def load_filters(filters: DataFrame, budget: int = FILTER_BUDGET) -> dict[int, np.ndarray] | None:
    """The filters for a broadcast, or None when their checked size is over the budget."""
    total = filters.agg(F.sum(F.length("slots").cast("long"))).first()[0] or 0
    if total > budget:
        return None
    return {r.shard: np.frombuffer(bytes(r.slots), np.uint16).reshape(-1, SLOTS) for r in filters.collect()}


# --- reading -----------------------------------------------------------------------------------


def _candidates(docs: DataFrame, filters: dict[int, np.ndarray] | None, shards: int, min_chars: int) -> DataFrame:
    """(__id, key): each document's distinct keys that hit their shard's filter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    out = pa.schema([("__id", pa.int64()), ("key", pa.binary())])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tables = {k: CuckooShard(v) for k, v in (known or {}).items()}
        for rows in batches:
            ids, keys = [], []
            for doc, body in zip(rows.column(0).to_pylist(), text_bytes(rows.column(1)), strict=True):
                own = {line_key(x, min_chars) for x in body.split(b"\n")} - {None}
                ids += [doc] * len(own)
                keys += own
            if known is not None and keys:
                hit = np.zeros(len(keys), bool)
                if shards == 1:
                    hit = tables[0].contains(keys) if 0 in tables else hit
                else:
                    of = np.fromiter((spark_shard(k, shards) for k in keys), np.int64, len(keys))
                    for s in np.unique(of):
                        at = np.flatnonzero(of == s)
                        if int(s) in tables:
                            hit[at] = tables[int(s)].contains([keys[i] for i in at])
                ids, keys = [ids[i] for i in np.flatnonzero(hit)], [keys[i] for i in np.flatnonzero(hit)]
            yield batch(out, ids, keys)

    return docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string")).mapInArrow(hits, "__id long, key binary")


def spark_shard(key: bytes, shards: int) -> int:
    """The shard that ``pmod(xxhash64(key), shards)`` gives (XXH64, seed 42, signed)."""
    h = xxhash.xxh64_intdigest(key, 42)
    return (h - (1 << 64) if h >> 63 else h) % shards


def drop_lines(docs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text's common lines dropped, ``n_lines``, ``n_dropped``."""
    added = {"n_lines": "long", "n_dropped": "long"}
    docs = docs.select(*[F.col(f"`{c}`") for c in kept(docs, added)]).withColumn("text", F.col("text").cast("string"))
    common = counts.where(F.col("n") >= min_docs).select("key")
    found = _candidates(docs, load_filters(filters), shards, min_chars).join(common, "key")
    drops = found.groupBy("__id").agg(F.collect_set("key").alias("__drop"))
    joined = docs.join(drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").drop("__id")
    at, drop_at = docs.columns.index("text"), len(docs.columns)

    def step(rows: pa.RecordBatch) -> list[pa.Array]:
        texts, totals, gone = [], [], []
        for body, drop in zip(text_bytes(rows.column(at)), rows.column(drop_at).to_pylist(), strict=True):
            lines = body.split(b"\n")
            stay = lines
            if drop:
                common_here = set(drop)
                stay = [x for x in lines if line_key(x, min_chars) not in common_here]
            texts.append(b"\n".join(stay))
            totals.append(len(lines))
            gone.append(len(lines) - len(stay))
        columns = list(rows.columns)
        columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
        return [*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]

    return map_batches(joined, lambda: step, added).drop("__drop")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Insert all documents into an empty state, then drop the lines of keys in ``min_docs`` or
    more of them. The state is stored in the shared folder between the steps."""
    counts = save(change_counts(None, docs, None, min_chars), "line-counts")
    shards = plan_shards(counts, min_docs)
    filters = save(change_filters(None, counts, min_docs, shards), "line-filters")
    return drop_lines(docs, counts, filters, shards, min_docs, min_chars)
