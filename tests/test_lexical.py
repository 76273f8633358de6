"""LIKE search against brute force (the prefilter and literal paths must be exact) and the
boolean grammar parser."""

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lexivec.config import RetrievalConfig
from lexivec.operators.boolean import boolean_search, parse_boolean
from lexivec.operators.lexical import lexical_search, like_search
from lexivec.sources.tables import TableSpec, spec

CFG = RetrievalConfig()
EXTRA = [(-1, "the"), (-2, "ou"), (-3, "date"), (-4, " "), (-5, "e%t_n"), (-6, "x" * 70), (-7, "")]


def _like_regex(p):
    out = []
    for ch in p:
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
    return re.compile("".join(out), re.DOTALL)


def test_like_search_equals_brute_force(spark):
    docs = spec(spark, SF_SMALL, "documents")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    q = bench.select(F.col("item_id").alias("query_id"), "text").unionByName(spark.createDataFrame(EXTRA, "query_id long, text string"))
    got = {}
    for r in like_search([docs], q, CFG).collect():
        got.setdefault(r["query_id"], []).append((r["lex_rank"], r["pk"]))
    rows = [(str(r["doc_id"]), r["text"].lower()) for r in docs.df.select("doc_id", "text").collect()]
    for r in q.collect():
        p = (r["text"] or "")[:64].lower()
        if any(c in p for c in "%_"):
            rx = _like_regex(p)
            hit = [pk for pk, t in rows if rx.search(t)]
        else:
            hit = [pk for pk, t in rows if p in t]
        want = [(i + 1, pk) for i, pk in enumerate(sorted(hit)[:50])]
        assert sorted(got.get(r["query_id"], [])) == want, r["query_id"]
    assert any(len(v) == 50 for v in got.values())  # the per-table cut is exercised


def test_boolean_parser(spark):
    q = spark.createDataFrame([(1, '+Alpha beta "gamma delta" eps* -zeta "solo" a')], "query_id long, text string")
    rows = {r["term_no"]: r for r in parse_boolean(q, CFG).collect()}
    assert rows[0]["op"] == "+" and rows[0]["exact"] == ["alpha"] and rows[0]["kind"] == "word"
    assert rows[1]["op"] == "" and rows[1]["exact"] == ["beta"]
    assert rows[2]["kind"] == "phrase" and rows[2]["toks"] == ["gamma", "delta"]
    assert rows[3]["kind"] == "prefix" and rows[3]["prefix"] == "eps" and rows[3]["exact"] == []
    assert rows[4]["op"] == "-" and rows[4]["exact"] == ["zeta"]
    assert rows[5]["kind"] == "word" and rows[5]["exact"] == ["solo"]  # one-token phrase = word
    assert rows[6]["exact"] == ["a"]  # short words count like any other


def test_short_boolean_terms(spark):
    docs = spark.createDataFrame([(1, "c the cat", "tail end"), (2, "the tea", "x"), (3, "x the", "y")], "doc_id long, text string, more string")
    table = TableSpec("d", docs, ("doc_id",))
    texts = ["+c +the", "the -x", "+t*", "-x the c", '"the tail"', '"cat tail"', '"the cat"', "+z the"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {}
    for r in boolean_search([table], q, CFG).collect():
        got.setdefault(texts[r["query_id"]], set()).add(int(r["pk"]))
    assert got == {"+c +the": {1}, "the -x": {1}, "+t*": {1, 2, 3}, "-x the c": {1}, '"the cat"': {1}}
    hybrid = lexical_search([table], q, CFG.with_(fulltext_required=True)).where("query_id = 1").collect()
    assert [int(r["pk"]) for r in hybrid] == [1]


def test_backslashes_in_like_queries(spark):
    docs = spark.createDataFrame([(1, "c:dir x"), (2, "100% sure"), (3, "100 a"), (4, "ends c%"), (5, "c:\\dir")], "doc_id long, text string")
    texts = ["C:\\dir", "100\\%", "c\\", "c:\\\\dir", "\\", "sure"]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {}
    for r in like_search([TableSpec("d", docs, ("doc_id",))], q, CFG).collect():
        got.setdefault(r["query_id"], []).append(int(r["pk"]))
    # a backslash makes the next character literal, at the end the closing wildcard
    assert {k: sorted(v) for k, v in got.items()} == {0: [1], 1: [2], 2: [4], 3: [5], 4: [4], 5: [2]}
