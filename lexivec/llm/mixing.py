"""Mixing overlapping sources to target weights by min-cost flow.

1. Targets: every source gets its weight's share of the mix; a target stops at ``most`` times the
   source's size and the excess is shared again by weight.
2. Documents are aggregated by membership pattern (the set of sources that hold them).
3. A min-cost flow routes the patterns' words to the sources' quotas. A pattern's first pass over
   its documents costs 0 a word, the second 1, the next 2, and so on: repetition is convex, so it
   is spread before it is deepened. The network has a node a pattern and a source; both lists are
   bounded (``MAX_PATTERNS``, checked) and do not grow with the documents.
4. Documents are selected in a seeded order, whole: every document of a pattern gets the full
   passes, then documents get one more in seeded order while the rest of the pattern's words last.
   The prefix is found from sums over 4,096 hash ranges and one window over the range where it
   ends; what is left over is filled by the largest documents that still fit (``FILL_ROUNDS``),
   and at last by one that is too large if it comes nearer.

Rows of one document id, text and pattern are one unit and alike, so reruns agree whatever the
partitioning; of a unit's rows any number may get one pass more. Defined results: null texts have
size 0; documents of size 0 take nothing; a null source is a source of its own, last in order; rows
with null ids have their places by their texts; extra columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import batch, columns, hold_memo, save, text_bytes

MAX_PATTERNS = 100_000
RANGES = 4096
FILL_ROUNDS = 4


# --- plan (bounded lists on the driver) ----------------------------------------------------------


def share_targets(sizes: dict[str, int], weights: dict[str, float], total: float, most: float) -> dict[str, float]:
    """Shares of ``total`` by weight, none above ``most`` times its source's size."""
    targets = dict.fromkeys(sizes, 0.0)
    open_, rest = sorted(sizes), float(total)
    while open_:
        unit = rest / sum(weights[s] for s in open_)
        full = [s for s in open_ if unit * weights[s] > most * sizes[s]]
        if not full:
            targets.update({s: unit * weights[s] for s in open_})
            break
        for s in full:
            targets[s] = float(most * sizes[s])
            rest -= targets[s]
        open_ = [s for s in open_ if s not in set(full)]
    return targets


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], passes: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Words that each pattern gives each of its sources: a min-cost flow by successive cheapest
    paths, for each set of patterns and sources that hang together on its own."""
    flow: dict[tuple[tuple[str, ...], str], int] = {}
    of_source = defaultdict(list)
    for p in patterns:
        for s in p:
            of_source[s].append(p)
    left = dict.fromkeys(sorted(patterns, key=str))
    while left:
        todo, group = [next(iter(left))], []
        del left[todo[0]]
        while todo:
            p = todo.pop()
            group.append(p)
            for q in (q for s in p for q in of_source[s] if q in left):
                todo.append(q)
                left.pop(q, None)
        flow |= _route_group(sorted(set(group), key=str), patterns, quotas, passes)
    return flow


def _route_group(group, patterns, quotas, passes):
    start, end = ("start",), ("end",)
    graph: dict[tuple, list[int]] = defaultdict(list)
    arcs: list[list] = []  # to, room, cost; the arc back is at index ^ 1

    def arc(a, b, room, cost):
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            graph[x].append(len(arcs))
            arcs.append([y, r, c])

    given = {}
    for p in group:
        for k in range(passes):
            arc(start, ("p", p), patterns[p], k)
        for s in p:
            given[p, s] = len(arcs)
            arc(("p", p), ("s", s), passes * patterns[p], 0)
    for s in sorted({s for p in group for s in p}):
        arc(("s", s), end, quotas[s], 0)
    while True:
        cost, via, queue, inside = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            inside.discard(a)
            for i in graph[a]:
                b, room, c = arcs[i]
                if room > 0 and cost[a] + c < cost.get(b, float("inf")):
                    cost[b], via[b] = cost[a] + c, i
                    if b not in inside:
                        queue.append(b)
                        inside.add(b)
        if end not in via:
            return {k: arcs[i ^ 1][1] for k, i in given.items() if arcs[i ^ 1][1]}
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        amount = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= amount
            arcs[i ^ 1][1] += amount


# --- documents -----------------------------------------------------------------------------------


def word_sizes(docs: DataFrame, sources: Column) -> DataFrame:
    """(doc_id, pattern, digest, size): pattern is the JSON text of the sorted distinct sources."""
    out = pa.schema([("doc_id", pa.int64()), ("pattern", pa.string()), ("digest", pa.int64()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memo("sizes")
        for rows in batches:
            yield batch(out, rows.column(0), rows.column(1), rows.column(2), [len(t.split()) for t in text_bytes(rows.column(3))])

    pattern = F.to_json(F.array_sort(F.array_distinct(sources)))
    rows = docs.select(F.col("doc_id").cast("long"), pattern.alias("pattern"), text_digest().alias("digest"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, pattern string, digest long, size long")


def text_digest() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def names(pattern: str) -> tuple[str, ...]:
    """Sources of a pattern as JSON texts, so that null is a name like any other."""
    return tuple(json.dumps(x, ensure_ascii=False) for x in json.loads(pattern))


def code_point_order(sources: list[str]) -> list[str]:
    return sorted(sources, key=lambda s: (s == "null", "" if s == "null" else json.loads(s)))


UNIT = ["doc_id", "pattern", "digest", "size"]


def _prefix(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units (``UNIT``, more: all their rows) of the seeded prefix of each pattern: the longest whose
    words stay within ``wanted`` (pattern, extra)."""
    ranges = units.groupBy("pattern", "range").agg(F.sum("words").alias("words"))
    order = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    below = ranges.withColumn("below", F.coalesce(F.sum("words").over(order), F.lit(0)))
    edge = below.join(F.broadcast(wanted), "pattern").withColumn("whole", F.col("below") + F.col("words") <= F.col("extra"))
    edge = edge.select("pattern", "range", "whole", (F.col("extra") - F.col("below")).alias("room")).where("room >= 0")
    near = units.join(edge, ["pattern", "range"])
    order = Window.partitionBy("pattern", "range").orderBy("place", "doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = near.where(~F.col("whole")).withColumn("sum", F.sum("words").over(order)).where("sum <= room")
    return near.where("whole").select(*UNIT, F.col("rows").alias("more")).unionByName(last.select(*UNIT, F.col("rows").alias("more")))


def select_documents(sizes: DataFrame, taken: dict[str, int], totals: dict[str, int], seed: int, rounds: int = FILL_ROUNDS) -> DataFrame:
    """(``UNIT``, rows, copies): ``rows`` of the unit's rows are taken ``copies`` times. ``taken`` and
    ``totals``: words to take and words there, by pattern."""
    spark = sizes.sparkSession
    place = F.xxhash64("doc_id", "digest", F.lit(seed))
    units = sizes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"words": F.col("size") * F.col("rows"), "place": place, "range": F.shiftrightunsigned(place, 52).cast("int")}
    )
    units = save(units, "mix-units")
    plan = [(p, taken[p] // totals[p] if totals[p] else 0, taken[p] % totals[p] if totals[p] else 0) for p in sorted(totals)]
    wanted = spark.createDataFrame(plan, "pattern string, passes long, extra long")
    extra = save(_prefix(units.where("size > 0"), wanted.where("extra > 0").select("pattern", "extra")), "mix-prefix")
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.pattern == b.pattern) & (a.digest == b.digest) & (a["size"] == b["size"])
    gaps = {p: e for p, _, e in plan if e}
    for words in extra.groupBy("pattern").agg(F.sum(F.col("size") * F.col("more")).alias("w")).collect():
        gaps[words[0]] -= words[1]
    for last in [False] * rounds + [True]:
        open_ = [(p, g) for p, g in gaps.items() if g > 0]
        if not open_:
            break
        gap = F.broadcast(spark.createDataFrame(open_, "pattern string, gap long"))
        # as many rows of one unit as fit; at the end one that is too large, if it comes nearer
        n = F.lit(1).cast("long") if last else F.least("rows", F.floor(F.col("gap") / F.col("size")).cast("long"))
        fits = units.where("size > 0").join(gap, "pattern").withColumn("more", n)
        off = F.abs(F.col("size") * F.col("more") - F.col("gap"))
        fits = fits.where(off < F.col("gap")).where("more > 0").join(extra, same(units, extra), "left_anti")
        best = fits.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "place", "doc_id", "digest", "size", "more")).alias("b")).select("pattern", "b.*").collect()
        for b in best:
            gaps[b.pattern] -= b["size"] * b.more
        if best:
            now = spark.createDataFrame([(b.doc_id, b.pattern, b.digest, b["size"], b.more) for b in best], extra.schema)
            extra = extra.unionByName(now)
    joined = units.join(extra, same(units, extra), "left").select(*[units[c] for c in UNIT], "rows", F.coalesce("more", F.lit(0)).alias("more"))
    joined = joined.join(F.broadcast(wanted.select("pattern", "passes")), "pattern")
    parts = F.array(
        F.struct(F.col("more").alias("rows"), (F.col("passes") + 1).alias("copies")),
        F.struct((F.col("rows") - F.col("more")).alias("rows"), F.col("passes").alias("copies")),
    )
    return joined.select(*UNIT, F.explode(F.filter(parts, lambda x: x.rows > 0)).alias("x")).select(*UNIT, "x.rows", "x.copies")


def mix(docs: DataFrame, sources: Column, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The selection (see ``select_documents``), the sources (source, source_size, target), and the
    routes (pattern, source, words). ``sources``: an array column, a document's sources; the
    weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    sizes = save(word_sizes(docs, sources), "mix-sizes")
    found = sizes.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    totals = {r.pattern: r["size"] for r in found}
    patterns = {names(p): n for p, n in totals.items()}
    held: dict[str, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            held[s] += n
    ordered = code_point_order(list(held))
    by_weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(ordered)}
    targets = share_targets(dict(held), by_weight, share * sum(patterns.values()), most)
    flow = route(patterns, {s: int(t + 0.5) for s, t in targets.items()}, most)
    taken = {p: sum(flow.get((names(p), s), 0) for s in names(p)) for p in totals}
    quotas = spark.createDataFrame([(json.loads(s), held[s], targets[s]) for s in ordered], "source string, source_size long, target double")
    routes = spark.createDataFrame([(list(map(json.loads, p)), json.loads(s), n) for (p, s), n in sorted(flow.items(), key=str)], "pattern array<string>, source string, words long")
    return select_documents(sizes, taken, totals, seed), quotas, routes


def mix_documents(docs: DataFrame, sources: Column, seed: int = 9, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    selection, _, _ = mix(docs, sources, seed=seed, **how)
    # a unit is taken evenly but for one copy; only a unit that is split needs its rows numbered
    unit = ["__id", "__digest", "__pattern"]
    many = selection.groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("pattern").alias("__pattern")).agg(
        F.min("copies").cast("int").alias("__copies"), F.max("copies").alias("__most"), F.max(F.struct("copies", "rows"))["rows"].alias("__rows")
    ).where("__most > 0")
    keys = {"__doc_id": F.col("doc_id").cast("long"), "__text": text_digest(), "__sources": F.to_json(F.array_sort(F.array_distinct(sources)))}
    same = F.col("__doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")) & (F.col("__sources") == F.col("__pattern"))
    joined = docs.withColumns(keys).join(many.hint("shuffle_hash"), same)
    even = joined.where(F.col("__most") == F.col("__copies"))
    split = joined.where(F.col("__most") > F.col("__copies"))
    nth = F.row_number().over(Window.partitionBy(*unit).orderBy(F.xxhash64(*columns(docs))))
    split = split.withColumn("__copies", F.when(nth <= F.col("__rows"), F.col("__copies") + 1).otherwise(F.col("__copies"))).where("__copies > 0")
    out = even.unionByName(split).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.drop(*unit, *keys, "__copies", "__most", "__rows", "__copy")
