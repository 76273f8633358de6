import random

from corpus import awkward, documents, empty

from lexivec.llm import line_dedup as D


def brute(texts, min_docs):
    key = lambda x: x.encode().strip().lower()
    held = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {b""}:
            held[k] = held.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held.get(key(x), 0) < min_docs]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    pool = [f" Line {i}{rng.choice(['', ' ', chr(13), chr(0x85)])}" for i in range(60)] + ["", "Ä", "ä"]
    return [rng.choice([None, ""]) if rng.random() < 0.05 else "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def counts_of(df):
    return sorted((bytes(r.key), r.n) for r in df.where("n > 0").collect())


def test_equals_brute_force(spark):
    data = texts(200, 1)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in D.dedup_lines(documents(spark, data), min_docs=10).collect()}
    assert [got[i] for i in range(len(data))] == brute(data, 10)


def test_without_filters_and_with_many_shards(spark, monkeypatch):
    data = texts(120, 2)
    docs = documents(spark, data)
    counts = D.save(D.change_counts(None, docs, None), "t")
    for shards in (1, 7):
        filters = D.save(D.change_filters(None, counts, 5, shards), "t")
        got = {r.doc_id: r.text for r in D.drop_lines(docs, counts, filters, shards, 5).collect()}
        assert [got[i] for i in range(len(data))] == [x[0] for x in brute(data, 5)]
    monkeypatch.setattr(D, "load_filters", lambda filters: None)  # over the budget: all lines are joined
    got = {r.doc_id: r.text for r in D.drop_lines(docs, counts, filters, 7, 5).collect()}
    assert [got[i] for i in range(len(data))] == [x[0] for x in brute(data, 5)]


def test_insertions_and_deletions_are_reversible(spark):
    a, b = documents(spark, texts(60, 3)), documents(spark, texts(60, 4))
    only_a = D.save(D.change_counts(None, a, None), "t")
    both = D.save(D.change_counts(only_a, b, None), "t")
    back = D.save(D.change_counts(both, None, b), "t")
    assert counts_of(back) == counts_of(only_a) and counts_of(both) != counts_of(only_a)
    filters = D.save(D.change_filters(None, only_a, 5, 3), "t")
    filters = D.save(D.change_filters(filters, both, 5, 3), "t")
    filters = D.load_filters(D.save(D.change_filters(filters, back, 5, 3), "t"))
    common = [bytes(r.key) for r in only_a.where("n >= 5").collect()]
    rare = [bytes(r.key) for r in both.where("n >= 5").join(only_a.where("n >= 5"), "key", "left_anti").collect()]
    shard = lambda k: D.CuckooShard(filters[D.spark_shard(k, 3)])
    assert all(shard(k).contains([k])[0] for k in common)
    assert rare and not any(shard(k).contains([k])[0] for k in rare)


def test_cuckoo_shard():
    keys = [random.Random(i).randbytes(16) for i in range(5000)]
    shard = D.CuckooShard.holding(keys)
    assert shard.contains(keys).all()
    others = [random.Random(10**6 + i).randbytes(16) for i in range(5000)]
    assert shard.contains(others).mean() < 0.01
    shard.delete(keys[:2500])
    assert shard.contains(keys[2500:]).all() and shard.contains(keys[:2500]).mean() < 0.01
    assert not D.CuckooShard.sized(4).insert(keys)  # full: the caller rebuilds it


def test_awkward_documents(spark):
    rows = D.dedup_lines(awkward(spark, ["n_lines", "key", "__x", "a.b"]), min_docs=4).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].text, by_id[1].n_lines, by_id[1].n_dropped) == ("", 1, 0)
    assert (by_id[3].n_lines, by_id[3].n_dropped) == (2, 0)  # blank lines are never common
    assert by_id[None].text == "without an id" and by_id[7].n_dropped == 1
    assert len(by_id[6].text) == 360_000 and by_id[6]["a.b"] == "x"
    assert D.dedup_lines(empty(spark)).collect() == []
