import random

import numpy as np
import pytest
from corpus import awkward, documents, empty

from lexivec.llm import language_id as L
from lexivec.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
VOCAB = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return L.load_pieces(VOCAB)


@pytest.fixture(scope="module")
def random_model(pieces):
    model = L.new_model(["a", "b"], pieces)
    probs = np.random.default_rng(0).random(model.probs.shape)
    model.probs = probs / probs.sum(axis=0)
    return model


def brute_forward(model, pieces, word):
    """Sum over all segmentations, one end position at a time, with plain substrings."""
    index = {p: i for i, p in enumerate(pieces)}
    word = b" " + word
    sums = [np.ones(2)] + [np.zeros(2) for _ in word]
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in index:
                sums[end] = sums[end] + sums[start] * model.probs[index[word[start:end]]]
    return np.log(sums[-1])


def test_forward_sums_all_segmentations(random_model, pieces):
    words = [w.encode() for w in ("the", "größer", "naïve", "a", "zzzqq", "日本語", "internationalisation", "\x00x")]
    got = L.forward(random_model, words)
    assert np.allclose(got, [brute_forward(random_model, pieces, w) for w in words], atol=1e-9)


def test_long_words_neither_vanish_nor_overflow(random_model):
    one, two = L.forward(random_model, [b"abcdefgh" * 5_000, b"abcdefgh" * 10_000])
    assert np.isfinite([one, two]).all() and np.allclose(two / one, 2, rtol=0.01)


def test_expected_counts_cover_every_byte_once(random_model):
    weights = np.array([[2.0, 0.0], [0.0, 3.0]])
    counts = L.expected_counts(random_model, [b"there", b"on"], weights)
    assert np.allclose((counts * random_model.trie.lengths[:, None]).sum(axis=0), [2 * 6, 3 * 3])


def test_expected_counts_of_long_words(random_model, pieces):
    """Against sums over all cuts before and after each piece, without rescaling."""
    word = "internationalisierungsgrößenordnung日本語文字列".encode()
    index, spaced = {p: i for i, p in enumerate(pieces)}, b" " + word
    cuts = [(a, b, index[spaced[a:b]]) for a in range(len(spaced)) for b in range(a + 1, len(spaced) + 1) if spaced[a:b] in index]
    fore, back = np.zeros((len(spaced) + 1, 2)), np.zeros((len(spaced) + 1, 2))
    fore[0], back[-1] = 1, 1
    for a, b, i in cuts:
        fore[b] += fore[a] * random_model.probs[i]
    for a, b, i in reversed(cuts):
        back[a] += back[b] * random_model.probs[i]
    want = np.zeros_like(random_model.probs)
    for a, b, i in cuts:
        want[i] += fore[a] * random_model.probs[i] * back[b] / fore[-1]
    assert len(word) > 2 * L.RESCALE_EVERY
    got = L.expected_counts(random_model, [word, b"on"], np.array([[1.0, 1.0], [0.0, 0.0]]))
    assert np.allclose(got, want, atol=1e-9)
    long = "語ab".encode() * 3000
    assert b"".join(L.in_blocks(long)) == long and all(b.decode() for b in L.in_blocks(long))
    counts = L.count_uses(random_model, 1, [long, b"on"], [2, 1])
    assert np.isclose((counts * random_model.trie.lengths).sum(), 2 * (len(long) + len(L.in_blocks(long))) + 3)


def test_languages_written_without_spaces(spark):
    import random

    rng = random.Random(5)
    kana, thai = "あいうえおかきくけこさしすせそ", "กขคงจฉชซญดตถทธน"
    rows = [(i, "".join(rng.choices(thai if i % 2 else kana, k=60)), "th" if i % 2 else "ja") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.language_of_documents(docs, VOCAB).collect()}
    assert [i for i, _, lang in rows if got[i] != lang] == []


def test_every_language_is_learned(spark):
    rows = [(i, f"word{i} text", f"l{i:02}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, words = L.training_words(docs, 1, 20)
    assert langs == [f"l{i:02}" for i in range(30)] and words.select("lang").distinct().count() == 30


def test_held_out_accuracy_and_fold(spark):
    rows = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_documents(spark, pieces):
    model = L.new_model(["de", "en"], pieces)
    rows = L.identify(awkward(spark, ["score", "lang_pred", "a.b"]), model).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 8):  # null, empty, blank, no letter
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[4].lang_pred == "de" and by_id[4].score == 0.5  # a tie goes to the first
    assert by_id[6].lang_pred in ("de", "en") and by_id[4]["a.b"] == "x"


def test_without_labels_or_rows(spark):
    rows = L.language_of_documents(documents(spark, ["some text"]).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string")), VOCAB).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert L.language_of_documents(empty(spark), VOCAB).collect() == []


def test_texts_in_no_learned_language_go_and_clean_ones_stay(spark):
    import base64

    import corpus_pipeline as C

    rng = random.Random(8)
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = [
        " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(20)), base64.b64encode(rng.randbytes(900)).decode(),
        "Αυτό είναι ένα κείμενο στα ελληνικά που δεν έχει μάθει το μοντέλο " * 5, "这是一个没有空格的中文文本模型没有学过它" * 10, "a$#@%^&*()_+ {}[]|;:<>?/~` " * 20,
    ]
    planted = spark.createDataFrame([(10_000_000 + i, t, "en", "x", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in C.language_id(spark, docs.unionByName(planted), sf).select("doc_id").collect()}
    assert not any(i >= 10_000_000 for i in kept)
    assert kept == {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}


def test_unlabelled_tables_pass_whole(spark):
    import corpus_pipeline as C

    rows = [(i, t, None, "a", 1) for i, t in enumerate(["some text", "日本語", "123", None, "", "ein Text", "x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.language_id(spark, docs, "").collect()} == {0, 1, 5, 6}


def test_long_words_are_read_in_blocks(random_model):
    import time

    short = [b"there", b"on", "größer".encode()]
    assert np.allclose(L.word_logs(random_model, short), L.forward(random_model, short))
    word = b"abcdefgh" * 125_000
    start = time.time()
    got = L.word_logs(random_model, [b"ab", word])
    assert time.time() - start < 30 and np.isfinite(got).all()
    part = L.word_logs(random_model, [word[:40_000]])
    assert np.allclose(part, L.forward(random_model, [word[:40_000]]), rtol=1e-2)
    assert np.allclose(got[1], part * 25, rtol=1e-2)
