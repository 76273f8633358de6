import random

import pytest
from corpus import awkward, empty
from pyspark.sql import functions as F

from lexivec.llm import mixing as M
from lexivec.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_targets_fill_up_to_the_limit():
    sizes = {"a": 10, "b": 1000, "c": 1000}
    got = M.share_targets(sizes, {"a": 5.0, "b": 2.0, "c": 1.0}, 1.5 * 2010, 2)
    assert got["a"] == 20 and got["b"] == pytest.approx(2995 * 2 / 3) and got["c"] == pytest.approx(2995 / 3)
    assert M.share_targets({}, {}, 0, 2) == {}
    assert M.share_targets({"a": 0}, {"a": 5.0}, 0, 2) == {"a": 0.0}


def least_cost(patterns, quotas, passes):
    """Brute force: the most words that fit, and for them the least repetition cost, over all
    integer flows of a tiny instance."""
    from itertools import product

    arcs = [(p, s) for p in sorted(patterns) for s in p]
    best = None
    for amounts in product(*[range(min(passes * patterns[p], quotas[s]) + 1) for p, s in arcs]):
        by_p = {p: sum(a for a, (q, _) in zip(amounts, arcs, strict=True) if q == p) for p in patterns}
        by_s = {s: sum(a for a, (_, t) in zip(amounts, arcs, strict=True) if t == s) for s in quotas}
        if any(n > passes * patterns[p] for p, n in by_p.items()) or any(n > quotas[s] for s, n in by_s.items()):
            continue
        cost = sum(max(0, n - patterns[p]) for p, n in by_p.items())
        key = (-sum(amounts), cost)
        best = key if best is None or key < best else best
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(4)
    for _ in range(25):
        patterns = {p: rng.randint(0, 3) for p in [("a",), ("a", "b"), ("b", "c")][: rng.randint(1, 3)]}
        quotas = {s: rng.randint(0, 4) for s in "abc"}
        flow = M.route(patterns, quotas, 2)
        by_p = {p: sum(n for (q, _), n in flow.items() if q == p) for p in patterns}
        assert all(n <= 2 * patterns[p] for p, n in by_p.items())
        assert all(sum(n for (_, t), n in flow.items() if t == s) <= quotas[s] for s in quotas)
        assert (-sum(flow.values()), sum(max(0, n - patterns[p]) for p, n in by_p.items())) == least_cost(patterns, {s: quotas[s] for p in patterns for s in p}, 2)


def test_query_meets_the_contract(spark):
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    per = {}
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len((d.text or "").encode().split()) and r.taken in (0, r["size"], 2 * r["size"])
        s = per.setdefault(d.source, [0, 0, r.target, r.source_size])
        s[0] += r["size"]
        s[1] += r.taken
    total = sum(s[0] for s in per.values())
    assert sum(s[2] for s in per.values()) == pytest.approx(1.5 * total)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per))}
    level = max(s[2] / weights[n] for n, s in per.items())
    for n, (size, taken, target, told) in per.items():
        assert told == size and target == pytest.approx(min(2 * size, level * weights[n]))
        assert abs(taken - target) <= 0.05 * target
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op9_mixing"](spark, SF).collect()))


def test_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 7), ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a", "a"]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    chosen, quotas, routes = M.mix(docs, F.col("held"), weights=(3, 1), share=1.0)
    copies = {r.doc_id: r.copies for r in chosen.collect()}
    words = {i: 5 + i % 7 for i in range(300)}
    target = {r.source: r.target for r in quotas.collect()}
    sent = {}
    for r in routes.collect():
        sent[r.source] = sent.get(r.source, 0) + r.words
    assert all(abs(sent[s] - target[s]) <= 1 for s in target)
    assert abs(sum(words[i] * n for i, n in copies.items()) - sum(sent.values())) <= 15
    assert max(copies.values()) <= 2


def test_awkward_documents(spark):
    docs = awkward(spark, ["pattern", "words", "a.b"]).withColumn("size", F.lit("y"))
    chosen, quotas, _ = M.mix(docs, F.array("source"))
    rows = chosen.collect()
    assert sum(r.rows for r in rows) == 10 and all(r.copies <= 2 for r in rows)
    assert {r.source for r in quotas.collect()} == {"a", "b", "c", None}
    mixed = M.mix_documents(docs, F.array("source"))
    assert mixed.columns == docs.columns
    n = {}
    for r in mixed.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n[5] % 2 == 0 and max(n[i] for i in n if i not in (5,)) <= 2
    assert M.mix(empty(spark), F.array("source"))[0].collect() == []
    assert M.mix_documents(empty(spark), F.array("source")).collect() == []


def test_null_ids_and_repeated_rows_come_near_their_targets(spark):
    schema = "doc_id long, text string, source string"
    rows = [(None, f"w{i} " + "x " * 9, "a") for i in range(200)] + [(7, "same " * 10, "b")] * 200 + [(i, "other " * 10, "c") for i in range(200)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    for weights in ((5, 2, 1), (1, 1, 3)):
        chosen, quotas, _ = M.mix(docs, F.array("source"), weights=weights)
        target = {r.source: r.target for r in quotas.collect()}
        taken = {r.pattern[2]: r.words for r in chosen.groupBy("pattern").agg(F.sum(F.col("size") * F.col("rows") * F.col("copies")).alias("words")).collect()}
        assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items()), (taken, target)
        mixed = [M.mix_documents(d, F.array("source"), weights=weights) for d in (docs, docs.repartition(3))]
        counts = [{r.source: r["count"] for r in m.groupBy("source").count().collect()} for m in mixed]
        assert counts[0] == {s: n // 10 for s, n in taken.items() if n}
        assert sorted(map(str, mixed[0].collect())) == sorted(map(str, mixed[1].collect()))
