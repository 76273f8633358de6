import random

import numpy as np
import pytest
from corpus import awkward, empty, sha

from lexivec.llm import bpe as B
from lexivec.llm import token_counts as T
from lexivec.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"

POOLS = ["abcde fgh", "  \n\t\r\x0b\x0c\x1c\x85\xa0 a1'", "'s't'llab ", "ՙ͸࢏a 中文é ñ", "<|endoftext|> a<|", "aaaa", "  　 x1", "0123 .,!?-", "\U0001f600‍ é"]
EDGES = ["", " ", "<|endoftext|>", " <|endoftext|> a  <|endoftext|>", "a" * 5000, " " * 3000, "ab" * 4000 + " c\n\n d", "a b \n", "\n a b", "a \x1c b"]


@pytest.fixture(scope="module")
def bpe_spec():
    return B.read_spec(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder(bpe_spec):
    return B.BytePairs(bpe_spec)


def random_texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pool = rng.choice(POOLS) + rng.choice(POOLS)
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 30))))
    return out + EDGES


def test_ids_and_text_equal_the_library(encoder):
    texts = random_texts(4000, 1)
    for _ in range(2):  # the second time from the memo
        for text, ids, e in zip(texts, encoder.encode(texts), encoder.library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, text
    for e in encoder.library.encode_batch(texts[:500], add_special_tokens=False):
        assert encoder.decode(e.ids) == encoder.library.decode(e.ids, skip_special_tokens=False)


def test_decoding_parts_of_characters(encoder):
    ids = np.frombuffer(encoder.encode(["é\U0001f600ü"])[0], "<u4").tolist()
    for cut in range(len(ids)):
        assert encoder.decode(ids[cut:]) == encoder.library.decode(ids[cut:], skip_special_tokens=False)


def test_trie_walk_equals_word_by_word(encoder):
    words = sorted({w.encode() for t in random_texts(500, 2) for w in encoder.words_of(t)})
    assert encoder.encode_words(words) == [encoder.encode_words([w])[0] for w in words]


def test_unsuitable_files_are_refused(bpe_spec):
    import json

    other = json.loads(bpe_spec)
    other["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError, match="byte-level"):
        B.BytePairs(json.dumps(other))


def test_counter_equals_the_library(bpe_spec):
    counter = T.PieceCounter(bpe_spec)
    texts = random_texts(3000, 3)
    want = [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]
    assert counter(texts) == want and counter(texts) == want


def test_queries_equal_the_library(spark, encoder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: encoder.library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    for r in QUERIES["op7_bpe"](spark, SF).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(encoder.library.decode(ids, skip_special_tokens=False))
    rows = QUERIES["op6_token_counts"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len(docs[i].encode()), len(x), len(x) > 1024) for i, x in want.items()}


def test_cache_encodes_only_misses(spark, bpe_spec, monkeypatch):
    from lexivec.session import scratch_path

    path = scratch_path(spark, "cache")
    docs = awkward(spark, ["digest"])
    first = sorted(map(tuple, T.count_tokens(docs, bpe_spec, path).collect()), key=str)
    stored = T.open_cache(spark, path).count()
    assert len(first) == 10 and stored == docs.selectExpr("coalesce(text, '')").distinct().count()
    assert sorted(map(tuple, T.count_tokens(docs, bpe_spec, path).collect()), key=str) == first
    assert T.open_cache(spark, path).count() == stored  # all were hits
    T.count_tokens(docs.limit(4), bpe_spec.replace('"1.0"', '"1.0" ', 1), path).collect()
    assert T.open_cache(spark, path).count() > stored  # another tokenizer file meets no old counts
    for limit in (0, 1):  # lists over the broadcast limit
        assert sorted(map(tuple, T.count_tokens(docs, bpe_spec, scratch_path(spark, "cache"), limit).collect()), key=str) == first
    assert T.count_tokens(empty(spark), bpe_spec, scratch_path(spark, "cache")).collect() == []


def test_awkward_documents(spark, bpe_spec, encoder):
    encoded = B.encode_documents(awkward(spark, ["ids", "a.b"]), bpe_spec)
    rows = B.decode_documents(encoded, bpe_spec).collect()
    assert len(rows) == 10 and all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) and r["a.b"] == "x" for r in rows)
    assert B.encode_documents(empty(spark), bpe_spec).collect() == []
    assert len(B.round_trip_digests(awkward(spark), bpe_spec).collect()) == 10


def test_memos_are_bounded_in_bytes(monkeypatch):
    spec = B.read_spec(tokenizer_path("byte_bpe_50k.json"))
    long = ["a" + "xyz" * 4000 + str(i) for i in range(20)]
    texts = [f"one {w} two {w[:300]} three" for w in long]
    encoder, counter = B.BytePairs(spec), T.PieceCounter(spec)
    once = encoder.encode(texts)
    sizes = counter(texts)
    assert [len(x) // 4 for x in once] == sizes
    assert all(len(k) <= B.MEMO_CHARS + 1 for k in [*encoder.words, *encoder.pieces, *counter.pieces])
    assert encoder.held < 10_000 and counter.held < 10_000
    monkeypatch.setattr(B, "MEMO_BYTES", 0)
    monkeypatch.setattr(T, "MEMO_BYTES", 0)
    assert encoder.encode(texts) == once and counter(texts) == sizes
