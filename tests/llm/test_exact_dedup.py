import random

from corpus import awkward, documents, empty, sha

from lexivec.llm import exact_dedup as X


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def texts(n, seed):
    rng = random.Random(seed)
    head = "x" * 600
    pool = [head + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(40)] + ["", None, "é", "é", "a" * 70_000, "a" * 69_999 + "b"]
    return [rng.choice(pool) for _ in range(n)]


def test_equals_brute_force_with_large_groups(spark, monkeypatch):
    data = texts(400, 1)
    for groups, held in ((3, 32 << 20), (50, 32 << 20), (50, 1)):
        monkeypatch.setattr(X, "HELD_BYTES", held)
        docs = documents(spark, data).repartition(7)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in X.exact_groups(docs, groups, 1 << 20).collect()}
        assert got == brute(data)


def test_radix_groups_are_equal_texts():
    data = [(t or "").encode() for t in texts(300, 2)]
    groups = X.radix_groups(data)
    assert sorted(i for g in groups for i in g) == list(range(300))
    assert len(groups) == len(set(data)) and all(len({data[i] for i in g}) == 1 for g in groups)
    assert X.radix_groups([]) == []


def test_large_groups_are_split_to_their_end(spark):
    data = ["p" * 100 + f"{i:03d}" for i in range(50)] + ["p" * 103] * 50
    levels, total, size = X._large_groups(documents(spark, data), 4)
    assert total == 100 and size == 100 * 103 and len(levels) >= 4
    assert len({X.route(t.encode(), levels) for t in data}) == 51


def test_awkward_documents(spark):
    rows = X.exact_groups(awkward(spark, ["keep_id", "route"])).collect()
    assert len(rows) == 10
    ids = {(r.doc_id, r.kept): r for r in rows}
    assert ids[1, False].keep_id == 2 and ids[2, True].group_size == 2
    fives = [r for r in rows if r.doc_id == 5]  # a repeated row: one of them stays
    assert sorted(r.kept for r in fives) == [False, True] and all(r.group_size == 3 and r.keep_id == 5 for r in fives)
    assert ids[None, True].keep_id is None
    assert X.exact_groups(empty(spark)).collect() == []


def test_names_are_sparks_and_groups_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    data = ["", "a", "é" * 40, "x" * 5000]
    got = documents(spark, data).select("text", F.xxhash64(F.octet_length("text").cast("long"), F.col("text").cast("binary")).alias("h")).collect()
    assert all(r.h == X.group_name(len(r.text.encode()), r.text.encode()) for r in got)

    def largest(times):
        rows = [f"{i % 60:02d}" + "q" * 50 + f"{i:06d}" for i in range(300 * times)]
        levels, _, _ = X._large_groups(documents(spark, rows), 5, 4096)
        weights = {}
        for t in rows:
            key = X.route(t.encode(), levels)
            weights[key] = weights.get(key, 0) + len(t) + X.ROW_BYTES
        return max(weights.values())

    assert largest(1) <= 4096 and largest(4) <= 4096  # four times the rows: the group of a task stays
