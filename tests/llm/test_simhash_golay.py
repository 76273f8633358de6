import random

import numpy as np
import xxhash
from corpus import awkward, documents, empty

from lexivec.llm import simhash_golay as S


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, most):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_words_within_two_bits_share_an_index():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    near = words.copy()
    for _ in range(2):
        near ^= 1 << rng.integers(0, 23, 3000)
    for a, b in zip(S.golay_indices(words), S.golay_indices(near), strict=True):
        assert set(a[a >= 0]) & set(b[b >= 0])
    assert set((S._errors() >= 0).sum(axis=1)) == {1, 6}


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(n // 20)]
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


def roots_by_spark(spark, fps, most, bucket):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    from lexivec.llm.components import components

    return {r.key: r.root for r in components(S.link_fingerprints(nodes, most, bucket)).collect()}, signed


def test_components_equal_all_pairs(spark):
    fps = clustered(600, 5)
    for most, bucket in ((2, 2048), (2, 2), (1, 2048), (1, 2), (0, 2)):
        found, signed = roots_by_spark(spark, fps, most, bucket)
        want = {}
        for fp, r in zip(fps, brute_components(fps, most), strict=True):
            want.setdefault(r, []).append(signed(fp))
        got = {}
        for fp in map(signed, fps):
            got.setdefault(found.get(fp, fp), []).append(fp)
        assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values())), (most, bucket)


def test_spanning_links_connect_a_bucket():
    fps = np.array(clustered(200, 6), np.uint64)
    links = S.spanning_links(fps, 2)
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 2 for a, b in links)
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = brute_components([int(x) for x in fps], 2)
    assert len({find(i) for i in range(len(fps))}) == len(set(want))


def test_documents_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + ["A b", "a  B", "a", None, ""]
    rows = {r.doc_id: r for r in S.near_duplicates(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [rows[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(fps, 2)


def test_awkward_documents(spark):
    rows = S.near_duplicates(awkward(spark, ["fp", "key"])).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1} and by_id[1].fp == 0
    assert by_id[5].component_id == 4
    kept = S.one_of_each_group(awkward(spark, ["a.b"])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 4), (False, 6), (False, 7), (False, 8), (True, 0)]
    assert S.near_duplicates(empty(spark)).collect() == [] and S.one_of_each_group(empty(spark)).collect() == []


def test_one_row_of_each_group_with_repeated_and_null_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey")
    rows = [(7, b, "x"), (7, a, "x"), (3, a, "x"), (None, c, "x"), (None, c, "x"), (9, c + " pink teal navy", "z"), (9, c + " pink teal navy", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    kept = sorted(((r.doc_id, r.text, r["a.b"]) for r in S.one_of_each_group(docs).collect()), key=str)
    assert kept == sorted([(3, a, "x"), (7, b, "x"), (None, c, "x"), (9, c + " pink teal navy", "y")], key=str)
