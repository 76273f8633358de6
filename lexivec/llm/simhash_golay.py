"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The binary Golay code decodes
a segment to the indices of its nearby codewords: one index when a codeword is within 2 bits,
else the six codewords at extended distance 4. Two segments that differ in at most 2 bits always
share an index. Fingerprints with at most 2 differing bits have, by the pigeonhole principle, one
segment without errors, so they share one of the keys (exact segment, Golay index of the next
segment): some 16 keys a fingerprint, each about 33 bits selective. Rows that share a key meet in
one bucket, and every link is verified by counting the differing bits.

Only distinct fingerprints are keyed, so groups of copies cost one row. A bucket gives a spanning
set of its links, not all pairs. Buckets of more than ``BUCKET`` fingerprints are linked exactly
in another way: two fingerprints differ in at most 2 bits just when some word is within 1 bit of
both, so each is dealt to its 65 words, and a word has at most 65 of them.

Defined results: texts without a word (null, empty, blank) have fingerprint 0 and link like any
other; repeated rows are linked, one result each; a null id never becomes a component id unless
its group has no other; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexivec.llm.common import batch, columns, hold_memo, save, text_bytes
from lexivec.llm.components import components

#: Segment widths; at most 23 each, 64 together.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the [23, 12] Golay code.
GENERATOR = 0xC75
#: Fingerprints that a bucket holds in memory and compares pairwise.
BUCKET = 2048
SEED = 42


# --- fingerprints ------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    joined = zip(*(words[i:] for i in range(size)), strict=False) if len(words) > size else [words]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, joined)), np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority bits over the text's word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    hashes = shingle_hashes(words, size)
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) >> 16)):
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, key: Column | None = None) -> DataFrame:
    """(doc_id, fp) for every row, and ``key`` if given; fp is the unsigned fingerprint in a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *([] if key is None else [key.alias("key")]))
    fields = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([fields[0], StructField("fp", LongType()), *fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memo("fingerprints")
        for rows in batches:
            fps = np.fromiter((fingerprint(t, size) for t in text_bytes(rows.column(1))), np.uint64, rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fps.view(np.int64)), *rows.columns[2:]], names=schema.names)

    return rows.mapInArrow(run, schema)


# --- Golay keys --------------------------------------------------------------------------------


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def _errors() -> np.ndarray:
    """Syndrome -> the error patterns that lead to nearby codewords (padded with -1): the
    leader of weight at most 3, and with one of weight 3 the five of weight 4 beside it."""
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    leader = np.full(2048, -1)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for s, e in zip(_syndrome(patterns), patterns, strict=True):
            if weight < 4:
                leader[s] = weight
            elif leader[s] != 3:
                continue
            table[s, used[s]] = e
            used[s] += 1
    return table


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Indices (0-4095) of the codewords near each 23-bit word: n x 6, -1 where there are fewer."""
    errors = _errors()[_syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the bucket keys of each unsigned 64-bit fingerprint."""
    segments, shift = [], 64
    for width in SEGMENTS:
        shift -= width
        segments.append((fps >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1))
    rows, keys = [], []
    for i, own in enumerate(segments):
        near = golay_indices(segments[(i + 1) % len(segments)])
        row, slot = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(np.int64(i << 60) | own[row] << 12 | near[row, slot])
    return np.concatenate(rows), np.concatenate(keys)


# --- links -------------------------------------------------------------------------------------


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words)


def spanning_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what differs in at most ``most`` bits: breadth-first, each
    fingerprint is reached once."""
    left = np.arange(len(fps))
    found = []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            near = _bits(fps[left] ^ fps[at]) <= most
            hit = left[near]
            found += [(int(at), int(x)) for x in hit]
            reached += hit.tolist()
            left = left[~near]
    return found


def _bucket_links(nodes: DataFrame, most: int, bucket: int) -> DataFrame:
    """(a, b): verified links; (a, null): fingerprints of buckets that are too large."""
    keyed = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = rows.column(0).to_numpy().view(np.uint64)
            row, key = golay_keys(fps)
            yield batch(keyed, key, fps[row].view(np.int64))

    def link(group: np.ndarray) -> tuple[list[int], list[int]]:
        pairs = spanning_links(group.view(np.uint64), most)
        return [int(group[i]) for i, _ in pairs], [int(group[j]) for _, j in pairs]

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: a bucket is a run, which may go on in the next batches."""
        open_key, held, large = None, np.zeros(0, np.int64), False
        for rows in batches:
            key, fp = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            if not len(key):
                continue
            a: list[int] = []
            b: list = []
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(starts)
            first_goes_on = key[0] == open_key
            for n in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                run = fp[starts[n] : starts[n + 1]]
                if n > 0 or not first_goes_on:
                    if len(held) > 1:
                        x, y = link(held)
                        a, b = a + x, b + y
                    open_key, held, large = key[starts[n]], np.zeros(0, np.int64), False
                if large or len(held) + len(run) > bucket:
                    a, b = a + held.tolist() + run.tolist(), b + [None] * (len(held) + len(run))
                    held, large = np.zeros(0, np.int64), True
                else:
                    held = np.concatenate([held, run])
            yield batch(out, a, b)
        if len(held) > 1:
            x, y = link(held)
            yield batch(out, x, y)

    return nodes.select("fp").mapInArrow(keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(buckets, "a long, b long")


def _ball_links(fps: DataFrame, most: int) -> DataFrame:
    """Exact links of any number of fingerprints: each meets the others at the words within 1 bit;
    a word gathers at most 65."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64 if most else 0)])
    dealt = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("word"))
    # Two that differ in 2 bits meet at a word between them; two that differ in 1, at each other.
    centre = F.min("fp") if most == 2 else F.min(F.when(F.col("fp") == F.col("word"), F.col("fp")))
    met = dealt.groupBy("word").agg(centre.alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select("a", F.explode("all").alias("b")).where("a != b")


def link_fingerprints(nodes: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes`` (fp) whose components are those of
    all pairs with at most ``most`` differing bits."""
    if not 0 <= most <= 2:
        raise ValueError("three Golay segments find fingerprints with at most 2 differing bits")
    found = save(_bucket_links(nodes, most, bucket), "golay-links")
    large = found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    return found.where(F.col("b").isNotNull()).unionByName(_ball_links(large, most))


def _grouped(prints: DataFrame, most: int, bucket: int, first: Column) -> DataFrame:
    """``prints`` (stored: doc_id, fp, ...) with component_id, and component_first: the least
    ``first`` of the component."""
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min(first).alias("first")), "fingerprint-nodes")
    roots = components(link_fingerprints(nodes, most, bucket))
    grouped = nodes.join(roots.withColumnRenamed("key", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("doc").alias("component_id"), F.min("first").alias("component_first"))
    named = save(grouped.select("fp", "root").join(least, "root").select("fp", "component_id", "component_first"), "fingerprint-groups")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, size: int = 3, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = save(fingerprints(docs, size), "fingerprints")
    return _grouped(prints, most, bucket, F.col("doc_id")).select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, size: int = 3, most: int = 2) -> DataFrame:
    """One row of each component: the one with the least id (null last), then the least digest of
    its text; of rows alike in both, the least as JSON text."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.md5(F.col("text").cast("string").cast("binary")).alias("digest"))
    prints = save(fingerprints(docs.select("doc_id", "text"), size, key), "fingerprints")
    found = save(_grouped(prints, most, BUCKET, F.col("key")).select("key", "component_first"), "near-duplicates")
    first = F.col("key").eqNullSafe(F.col("component_first"))
    gone = found.where(~first).select(F.col("key").alias("__key")).distinct()
    repeated = found.where(first).groupBy(F.col("key").alias("__key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    met = key.eqNullSafe(F.col("__key"))
    rest = docs.join(gone, met, "left_anti").select(*columns(docs))
    if repeated.isEmpty():
        return rest
    row = F.struct(*columns(docs))
    one = rest.join(repeated, met, "left_semi").groupBy(key.alias("__key")).agg(F.min_by(row, F.to_json(row)).alias("__row"))
    one = one.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
    return rest.join(repeated, met, "left_anti").select(*columns(docs)).unionByName(one)
