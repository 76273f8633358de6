"""LIKE search as one pass over the texts: the same rows as from the stored index, tests linear in the text,
nothing stored for patterns that fit the broadcast budget; the embedder's memory does not grow with the vocabulary."""

import os
import time

from lexivec.config import RetrievalConfig
from lexivec.operators import embedding as E
from lexivec.operators.lexical import RunFilter, like_search
from lexivec.session import work_dir
from lexivec.sources.tables import TableSpec

CFG = RetrievalConfig(like_chars=None)
TEXTS = ["", "a", "ab", "The tête-à-tête", "x😀y😀z", "100% sure", "c:\\dir", "line one\nline two", "ababab", None, "ab", "TEN tins"]
QUERIES = ["", " ", "a", "ab", "b%a", "t_n", "%", "_", "__", "😀y😀", "x😀_😀z", "tête", "0\\%", "e%", "one%two", "\\", "missing run", "e\nl", None]


def found(spark, texts, queries, cfg):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    rows = like_search([TableSpec("d", docs, ("doc_id",))], q, cfg).collect()
    return sorted((r.query_id, r.lex_rank, r.pk, r.snippet) for r in rows)


def test_scan_and_index_agree(spark):
    got = found(spark, TEXTS, QUERIES, CFG)
    assert got == found(spark, TEXTS, QUERIES, CFG.with_(broadcast_max_bytes=0))
    hit = {}
    for n, _, pk, _ in got:
        hit.setdefault(QUERIES[n], set()).add(int(pk))
    every = {i for i, t in enumerate(TEXTS) if t is not None}
    assert hit[""] == hit["%"] == hit[None] == every and hit["_"] == every - {0} and hit["__"] == every - {0, 1}
    assert hit["b%a"] == {8} and hit["t_n"] == {11} and hit["one%two"] == {7} and hit["tête"] == {3}
    assert hit["x😀_😀z"] == hit["😀y😀"] == {4} and hit["0\\%"] == {5} and "missing run" not in hit


def test_wildcards_are_linear_in_the_text(spark):
    start = time.time()
    assert found(spark, ["et" * 200_000, "et" * 200_000 + "ten"], ["e%t_n"], CFG) == [(0, 1, "1", ("et" * 250))]
    assert time.time() - start < 60  # trying every e with every t took hours


def test_no_postings_for_few_patterns(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    place = f"{work_dir(spark)}/gram-index"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    table = TableSpec("d", spark.read.parquet(f"{tmp_path}/d"), ("doc_id",))
    assert like_search([table], spark.createDataFrame([(1, "me te")], "query_id long, text string"), CFG).count() == 1
    assert before == (set(os.listdir(place)) if os.path.isdir(place) else set())


def test_filter_only_proposes():
    proposed = RunFilter([["abc", "cde"], ["b"], [], ["zzzz"]]).candidates(["abcde", "abc", "b", ""])
    assert [sorted(p) for p in proposed] == [[0, 1, 2], [1, 2], [1, 2], [2]]


def test_embedder_forgets_tokens(monkeypatch):
    monkeypatch.setattr(E, "_CACHE_MAX", 100)
    monkeypatch.setattr(E, "_CODE_CACHE", {})
    once = E._token_codes(" ".join(f"word{i}" for i in range(1000)) + " " + "x" * 5000, 2)
    assert len(once) == 1001 and len(E._CODE_CACHE) <= 100 and max(map(len, E._CODE_CACHE)) <= 32
    assert E._token_codes("word999 word0", 2) == [once[999], once[0]]
    blocks = E._dense_from_codes([[1, 65], [], [2]], 64)
    assert blocks.shape == (3, 64) and blocks[0, 1] == 0 and not blocks[1].any() and blocks[2, 2] == 1


def test_latin_texts_are_cut_by_a_table(spark, monkeypatch):
    texts = ["Ünïted_États 2½ x", "a b", "".join(map(chr, range(256))), "", "  ", "ǅ ﬁn", "ΑΣ δύο 一二 x²", "µm ª º", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for least in (1, 2):
        jvm = [r.c for r in df.orderBy("n").select(E.HashingEmbedder(64, least).codes("t").alias("c")).collect()]
        assert [E._token_codes(t, least) for t in texts] == [c or [] for c in jvm]
    assert len(E._token_codes(" a ", 0)) == 3  # with the empty ones at both ends
    monkeypatch.setattr(E, "_SPLIT", "not for these texts")
    assert len(E._token_codes("Où est-ce ? 12 km²", 2)) == 5
