"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their length and then by successive bytes (in steps of growing width) until
a group is a single document or its texts have ended: texts that stay together to their last byte
are equal. No digest decides equality.

The recursion runs in two places by one rule. Across the cluster, groups that weigh more than a
task's planned bytes (or than ``1 / GROUPS`` of the table, if that is less) are split by their next
bytes with a sum per prefix, level by level. Of groups that are still too large only an eight-byte
name comes to the driver, at most ``NAMES`` a level: two groups of one name are split alike, which
changes where rows go and never what is equal. So the group that a task holds does not grow with the
table (up to ``NAMES * TASK_BYTES``, 32 TB; in proportion beyond: 100 MB at 100 TB).
What remains is dealt to tasks by its group, and each task goes on splitting in memory. Before
that shuffle every task collapses the equal texts it has scanned, so a text that a third of all rows
share travels once a task, and the rows it stands for follow by a join on the stand-in's row
number, which only a task's own rows can have.

Defined results: null texts count as empty; of equal texts the row with the largest doc_id stays,
null ids last; of repeated rows one stays (the others have ``kept`` false); a group without ids
has a null keep_id; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, save, text_bytes, text_or_empty

#: Prefix widths of the levels after the length; the last ones double on.
WIDTHS = [8, 32, 128, 512, 2048, 8192, 32768]
#: Groups over this share of the table are split further before the shuffle, however small it is.
GROUPS = 500
#: Names of large groups that a level may send to the driver (8 bytes each).
NAMES = 1_000_000
#: Bytes that a row weighs beside its text.
ROW_BYTES = 64
#: Text bytes a task holds before it collapses equal texts, and those planned for a task.
HELD_BYTES = 32 << 20
TASK_BYTES = 32 << 20


def width(level: int) -> int:
    """Bytes that are compared up to a level; level 0 compares lengths only."""
    return 0 if level == 0 else WIDTHS[level - 1] if level <= len(WIDTHS) else WIDTHS[-1] << (level - len(WIDTHS))


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Groups of equal texts (indices, in order): split by length, then by successive bytes until
    a group is a singleton or ended."""
    done, todo = [], [(list(range(len(texts))), -1)]
    while todo:
        group, level = todo.pop()
        if len(group) == 1 or (level >= 0 and width(level) >= len(texts[group[0]])):
            done.append(group)
            continue
        split: dict = {}
        if level < 0:
            for i in group:
                split.setdefault(len(texts[i]), []).append(i)
        else:
            start, end = width(level), width(level + 1)
            for i in group:
                split.setdefault(texts[i][start:end], []).append(i)
        todo += [(g, level + 1) for g in split.values()]
    return done


def group_name(size: int, prefix: bytes) -> int:
    """The name of a group of texts with that length and prefix, as Spark's ``xxhash64`` gives it."""
    name = xxhash.xxh64_intdigest(prefix, seed=xxhash.xxh64_intdigest(size.to_bytes(8, "little"), seed=42))
    return name - (1 << 64) if name >> 63 else name


def _large_groups(docs: DataFrame, groups: int, task_bytes: int = TASK_BYTES) -> tuple[list[np.ndarray], int, int]:
    """Per level, the sorted names of the groups that weigh too much; rows and bytes of the table."""
    rows = docs.select(text_or_empty().cast("binary").alias("text")).withColumn("size", F.octet_length("text"))
    lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    total, total_bytes = lengths.agg(F.sum("n"), F.sum(F.col("n") * F.col("size").cast("long"))).first()
    if not total:
        return [], 0, 0
    weight = total_bytes + ROW_BYTES * total
    most = max(min(task_bytes, weight // groups), weight // NAMES)
    name = lambda level: F.xxhash64(F.col("size").cast("long"), F.substring("text", 1, width(level)))
    levels: list[np.ndarray] = []
    open_ = rows
    while True:
        level = len(levels)
        summed = open_.groupBy(name(level).alias("name")).agg(F.sum(F.col("size") + F.lit(ROW_BYTES)).alias("weight"), F.max("size").alias("size"))
        found = summed.where(F.col("weight") > most).select("name", "size").toPandas()
        if found.empty:
            break
        levels.append(np.sort(found["name"].to_numpy(np.int64)))
        longer = found[found["size"] > width(level)]
        if longer.empty:
            break
        wanted = F.broadcast(docs.sparkSession.createDataFrame(longer[["name"]]))
        open_ = rows.where(F.col("size") > width(level)).withColumn("name", name(level)).join(wanted, "name", "left_semi").drop("name")
    return levels, total, total_bytes


def _holds(names: np.ndarray, name: int) -> bool:
    at = int(names.searchsorted(name))
    return at < len(names) and int(names[at]) == name


def route(text: bytes, levels: list[np.ndarray]) -> bytes:
    """The group that a text is dealt by: its length, and its bytes as far as its groups are large."""
    level, key = 0, b""
    while level < len(levels) and _holds(levels[level], group_name(len(text), key)) and width(level) < len(text):
        level += 1
        key = text[: width(level)]
    return len(text).to_bytes(8, "big") + key


class Collapse:
    """Equal texts of a stream of rows, holding one copy of each text."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.members: list[list[tuple]] = []  # per text: what the rows carry
        self.new: list[tuple[bytes, tuple]] = []
        self.held = 0

    def add(self, text: bytes, row: tuple) -> None:
        self.new.append((text, row))
        self.held += len(text)

    def settle(self) -> None:
        texts = self.texts + [t for t, _ in self.new]
        members = self.members + [[r] for _, r in self.new]
        groups = radix_groups(texts) if texts else []
        self.texts = [texts[g[0]] for g in groups]
        self.members = [[r for i in g for r in members[i]] for g in groups]
        self.new, self.held = [], 0


def _id_order(row: tuple) -> tuple:
    """Largest doc_id first choice, null ids last, then the larger row number."""
    doc, own = row[0], row[1]
    return (doc is not None, doc if doc is not None else 0, own)


def exact_groups(docs: DataFrame, groups: int = GROUPS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    levels, total, total_bytes = _large_groups(docs, groups, task_bytes)
    shared = spark.sparkContext.broadcast(levels)
    dealt = pa.schema([("route", pa.int64()), ("own", pa.int64()), ("doc_id", pa.int64()), ("stand_in", pa.int64()), ("n", pa.int64()), ("text", pa.large_binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collapse()

        def out() -> pa.RecordBatch:
            held.settle()
            rows = []
            for text, members in zip(held.texts, held.members, strict=True):
                best = max(members, key=_id_order)
                rows.append((xxhash.xxh64_intdigest(route(text, shared.value)) >> 1, best[1], best[0], best[1], len(members), text))
                rows += [(xxhash.xxh64_intdigest(own.to_bytes(8, "big")) >> 1, own, doc, best[1], None, None) for doc, own in members if own != best[1]]
            held.__init__()
            return batch(dealt, *(list(zip(*rows, strict=True)) or [[]] * 6))

        for rows in batches:
            for doc, own, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), text_bytes(rows.column(2)), strict=True):
                held.add(text, (doc, own))
                if held.held > HELD_BYTES:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("own"), text_or_empty().alias("text"))
    kinds = "route long, own long, doc_id long, stand_in long, n long, text binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // task_bytes))
    spread = rows.mapInArrow(scan, kinds).repartition(parts, "route")
    judged = pa.schema([("own", pa.int64()), ("doc_id", pa.int64()), ("stand_in", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Collapse()
        for rows in batches:
            own, doc, stand_in, n = (rows.column(i).to_pylist() for i in range(1, 5))
            follow = [i for i, k in enumerate(n) if k is None]
            none = [None] * len(follow)
            yield batch(judged, *([x[i] for i in follow] for x in (own, doc, stand_in)), none, none, none, none)
            for i, text in enumerate(rows.column(5).to_pylist()):
                if n[i] is not None:
                    held.add(text, (doc[i], own[i], n[i]))
                    if held.held > HELD_BYTES:
                        held.settle()
        held.settle()
        rows_out = []
        for text, members in zip(held.texts, held.members, strict=True):
            best, size, sha = max(members, key=_id_order), sum(m[2] for m in members), hashlib.sha256(text).hexdigest()
            rows_out += [(own, doc, own, best[1], best[0], size, sha) for doc, own, _ in members]
        for i in range(0, len(rows_out), 10_000):
            yield batch(judged, *zip(*rows_out[i : i + 10_000], strict=True))

    found = save(spread.mapInArrow(finish, "own long, doc_id long, stand_in long, keep_row long, keep_id long, group_size long, text_sha256 string"), "radix-groups")
    heads = found.where("group_size is not null")
    told = ["keep_row", "keep_id", "group_size", "text_sha256"]
    followers = found.where("group_size is null").select("own", "doc_id", "stand_in").join(heads.select("stand_in", *told), "stand_in")
    both = heads.select("own", "doc_id", *told).unionByName(followers.select("own", "doc_id", *told))
    return both.select("doc_id", "keep_id", "group_size", (F.col("own") == F.col("keep_row")).alias("kept"), "text_sha256")
