"""Full-text and boolean search against brute force over every (query, row) pair."""

import math
import os
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_MID
from lexivec.config import RetrievalConfig
from lexivec.operators import fulltext as T
from lexivec.operators import fulltext_scan as S
from lexivec.operators.boolean import boolean_search
from lexivec.operators.lexical import LEX_COLUMNS, like_search, lexical_search
from lexivec.session import store_once, work_dir
from lexivec.sources.tables import TableSpec, read_table, spec
from lexivec.sources.text_index import text_index

CFG = RetrievalConfig()
WORDS = ["the", "then", "thea", "of", "ofe", "x", "xa", "cat", "cats", "dog", "do", "é", "éa"]


def words_of(text, least):
    return [t for t in re.split(r"[^\w]+|_", (text or "").lower()) if len(t) >= least]


def corpus(n, seed):
    """(id, two text columns): words with very different frequencies, null and empty texts."""
    rng = random.Random(seed)
    word = lambda: WORDS[min(int(rng.expovariate(0.25)), len(WORDS) - 1)]
    text = lambda k: " ".join(word() + rng.choice(["", "", ",", "-"]) for _ in range(rng.randint(0, k)))
    return [(i, rng.choice([None, "", *[text(40)] * 8]), text(4)) for i in range(n)]


def weights(rows, least):
    """BM25 weight of every (row, token), and the tokens with a break between the columns."""
    toks = {i: [words_of(a, least), words_of(b, least)] for i, a, b in rows}
    size = {i: sum(map(len, t)) for i, t in toks.items()}
    avg = sum(size.values()) / len(size)
    tf = {i: Counter(t[0] + t[1]) for i, t in toks.items()}
    df = Counter(w for c in tf.values() for w in c)
    n = len(rows)
    w = {
        (i, t): math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / avg))
        for i, c in tf.items() for t, f in c.items()
    }
    return w, toks


def top(scores, k):
    return sorted(((-round(s, 6), str(i)) for i, s in scores.items()))[:k]


def got(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((-round(r.score_ft, 6), r.pk))
    return {q: sorted(v) for q, v in out.items()}


def same(found, want):
    assert found.keys() == want.keys()
    for q, rows in want.items():
        assert [p for _, p in rows] == [p for _, p in found[q]], q
        assert all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(rows, found[q], strict=True))


def table(spark, rows):
    return TableSpec("t", spark.createDataFrame(rows, "id long, a string, b string"), ("id",))


def test_bm25_equals_brute_force(spark, monkeypatch):
    rows = corpus(120, 1)
    w, toks = weights(rows, 2)
    rng = random.Random(2)
    queries = {q: " ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for q in range(40)} | {90: "cat", 91: "the", 92: "", 93: "nowhere", 94: "cats dog éa"}
    want = {}
    for q, text in queries.items():
        scores = {i: sum(w.get((i, t), 0) for t in set(words_of(text, 2))) for i in toks}
        scores = {i: s for i, s in scores.items() if s > 0}
        if scores:
            want[q] = top(scores, 7)
    frame = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    for weak in (0.05, 0.4, 0.95):  # the last leaves most queries unproven
        monkeypatch.setattr(T, "WEAK", weak)
        same(got(T.bm25_search([table(spark, rows)], frame, CFG.with_(k_ft=7))), want)


def test_few_pairs_are_scored_and_the_index_is_kept(spark):
    docs = spec(spark, SF_MID, "documents")
    queries = read_table(spark, SF_MID, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = text_index(docs, CFG)
    assert text_index(spec(spark, SF_MID, "documents"), CFG).terms.inputFiles() == index.terms.inputFiles()
    assert text_index(TableSpec("documents", docs.df.where("doc_id > 5"), docs.pk), CFG).terms.inputFiles() != index.terms.inputFiles()
    report = {}
    T.scored_pairs(index, store_once(T.query_terms(queries, CFG), "words"), 5, CFG, report)
    assert report["seeds"] + report["survivors"] + report["whole"] < 0.1 * index.docs.count() * report["queries"]


def brute_boolean(rows, query, k):
    w, toks = weights(rows, 1)
    scores = {}
    for i, columns in toks.items():
        all_ = set(columns[0] + columns[1])
        met, adds, ok = 0, set(), True
        for op, body in re.findall(r'([+-]?)("[^"]*"|[^\s"]+)', query):
            phrase, prefix = body.startswith('"'), not body.startswith('"') and body.endswith("*")
            terms = words_of(body, 1)
            if not terms:
                continue
            if prefix:
                ends = {t for t in all_ if t.startswith(terms[-1])}
                hit, own = bool(ends) and all_ >= set(terms[:-1]), ends | set(terms[:-1])
            else:
                hit, own = all_ >= set(terms), set(terms)
                if phrase and len(terms) > 1:
                    hit = any(c[n : n + len(terms)] == terms for c in columns for n in range(len(c)))
            ok &= not (op == "+" and not hit) and not (op == "-" and hit)
            if hit and op != "-":
                met += 1
                adds |= own
        if ok and met:
            scores[i] = sum(w[i, t] for t in adds)
    return top(scores, k)


def test_boolean_equals_brute_force(spark):
    rows = corpus(90, 5)
    rng = random.Random(6)

    def term():
        some = lambda: rng.choice(WORDS)
        kind = rng.randrange(7)
        body = {0: some, 1: some, 2: lambda: some()[: rng.randint(1, 3)] + "*", 3: lambda: f'"{some()} {some()}"', 4: lambda: f"{some()}-{some()}",
                5: lambda: f"{some()}-{some()[:2]}*", 6: lambda: f'"{some()} {some()} {some()}"'}[kind]()
        return rng.choice(["", "", "", "+", "-"]) + body

    queries = {q: " ".join(term() for _ in range(rng.randint(1, 6))) for q in range(70)}
    queries |= {100: "+the +the the* th* cat cat", 101: "-the", 102: '"the the" the', 103: "+nowhere the", 104: "nowhere* the", 105: ", ;", 106: "the-the*"}
    want = {q: x for q, text in queries.items() if (x := brute_boolean(rows, text, 8))}
    frame = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    same(got(boolean_search([table(spark, rows)], frame, CFG.with_(k_ft=8))), want)


def test_tables_without_text_have_no_hits(spark):
    numbers = TableSpec("n", spark.range(3).withColumnRenamed("id", "k"), ("k",))
    nothing = spark.createDataFrame([], "id long, a string, b string")
    queries = spark.createDataFrame([(1, "the")], "query_id long, text string")
    for search in (T.bm25_search, boolean_search, like_search, lexical_search):
        for tables in ([numbers], [TableSpec("t", nothing, ("id",))], []):
            found = search(tables, queries, CFG)
            assert found.columns == LEX_COLUMNS and found.collect() == []
    assert got(T.bm25_search([numbers, table(spark, [(1, "the cat", "")])], queries, CFG)).keys() == {1}


def test_scan_and_index_agree(spark, monkeypatch):
    rows = [r for r in corpus(150, 11) if r[0] % 7]
    rows += [(1000 + i, f"dogma{i} dog{i % 3} the", None) for i in range(20)]
    texts = ["+the dog*", "cat* -of \"the then\"", "do-c* cats", "dog* do* dogm*", "-dog* the", "+nowhere dog*", "the-d* -x +of", "do-dog* dog* cat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    docs = table(spark, rows)
    monkeypatch.setattr(S, "ROWS", 16)
    cfg = CFG.with_(k_ft=9)
    want = {q: x for q, text in enumerate(texts) if (x := brute_boolean(rows, text, 9))}
    for most in (1 << 16, 3, 0):  # beginnings that go to the tasks
        monkeypatch.setattr(S, "MOST_TERMS", most)
        same(got(boolean_search([docs], frame, cfg)), want)
    same(got(boolean_search([docs], frame, cfg.with_(broadcast_max_bytes=0))), want)
    by_index = got(T.bm25_search([docs], frame, cfg.with_(broadcast_max_bytes=0)))
    same(got(T.bm25_search([docs], frame, cfg)), by_index)


def test_no_postings_for_few_queries(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, "more text")], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    place = f"{work_dir(spark)}/text-index"
    listed = lambda: set(os.listdir(place)) if os.path.isdir(place) else set()
    before = listed()
    docs = TableSpec("d", spark.read.parquet(f"{tmp_path}/d"), ("doc_id",))
    frame = spark.createDataFrame([(1, "more te*")], "query_id long, text string")
    assert T.bm25_search([docs], frame, CFG).count() == 1 and boolean_search([docs], frame, CFG).count() == 2
    assert before == listed()
