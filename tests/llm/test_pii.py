import random
import re
import time

from corpus import awkward, documents, empty, sha

from lexivec.llm import pii as P
from lexivec.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

#: The contract's patterns as they are written there.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda m, d: True,
                "ip": lambda m, d: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda m, d: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda m, d: 9 <= len(d) <= 15,
            }[kind](m, digits)
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def random_texts(n, seed):
    rng = random.Random(seed)
    pools = ["0123456789.", "01. -", "ab@.c-_%+", "+1 (23)-.4", "é\U0001f600a@b.c 12", "1234 5678-"]
    out = []
    for _ in range(n):
        pool = rng.choice(pools) + rng.choice(pools)
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 60))))
    for _ in range(n // 3):
        digits = "".join(rng.choices("0123456789", k=rng.randint(11, 19)))
        digits += next(x for x in "0123456789" if luhn(digits + x))
        out.append(rng.choice(["é", "", "a", "+"]) + "".join(d + rng.choice(["", "", " ", "-"]) for d in digits) + rng.choice(["z", ".", " 1"]))
    return out + ["0001.0255.3.256 00255.1.1.1", "a@b.c_d@e.f a@b.c.@d.e", "x.19@mail5.example.com", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8"]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = random_texts(3000, 1)
    rows = {r.doc_id: [tuple(x) for x in r.base] for r in P.spans_and_candidates(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert rows[i] == brute(t), t


def test_query_digests(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute(docs[r.doc_id])
        told = [f"{P.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == sha(",".join(told))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert set(told) <= set(r.spans.split(","))


def test_long_texts_take_linear_time(spark):
    texts = ["9" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+" * 100_000, "+1 (222) 333-4444 a@b.co 1.2.3.4 " * 3000]
    start = time.time()
    rows = {r.doc_id: r for r in P.find_personal_data(documents(spark, texts)).collect()}
    assert time.time() - start < 120
    assert len(rows[4].base) == 9000 and len(rows[2].base) == 25_000 and not rows[0].base


def test_labels_equal_all_pairs(spark):
    found = P.spans_and_candidates(documents(spark, random_texts(400, 2))).collect()
    df = P.spans_and_candidates(documents(spark, random_texts(400, 2)))
    got = {(r.doc_id, r.s, r.e, r.k): r.label for r in P.labelled(df).collect()}
    want = {}
    for r in found:
        base = [tuple(b) for b in r.base]
        for c in r.loose:
            touching = any(s < c.e and c.s < e for s, _, e in base)
            want[r.doc_id, c.s, c.e, c.k] = 1 if (c.s, c.k, c.e) in base else None if touching else 0
    assert got == want


def test_boosting_learns_a_rule_and_calibrates():
    rng = random.Random(0)
    cells = []
    for _ in range(400):
        v = tuple(rng.randint(0, 3) for _ in P.FEATURES)
        good = v[0] == 1 and v[3] != 2
        cells.append(P.Cell(2, v, 9.9 if good else 0.1, 10.0))
    trees = P.boost(cells)
    limits = P.thresholds(cells, trees, 0.98)
    for c in cells:
        assert (sum(P.tree_value(t, c.values) for t in trees) >= limits[2]) == (c.positives > 5)
    assert P.thresholds([P.Cell(0, v.values[1:], 0.0, 1.0) for v in cells], trees, 0.98) == {}


def test_scores_in_sql_equal_python(spark):
    cells = [P.Cell(k % 4, tuple((k * (i + 3)) % 5 for i in range(len(P.FEATURES))), float(k % 3), 4.0) for k in range(60)]
    trees = P.boost(cells, 8)
    names = ["k", *P.FEATURES]
    df = spark.createDataFrame([c.values for c in cells], names).selectExpr("k", f"struct({', '.join(P.FEATURES)}) f")
    got = [r[0] for r in df.selectExpr(P.score_sql(trees)).collect()]
    assert got == [sum(P.tree_value(t, c.values) for t in trees) for c in cells]


def test_loose_forms_are_added(spark):
    """Numbers like the labelled ones, but without their check digit, in the same context."""
    rng = random.Random(7)
    texts = []
    for i in range(400):
        d = "4" + "".join(rng.choices("0123456789", k=14))
        d += next(x for x in "0123456789" if luhn(d + x))
        texts.append(f"card {d} paid")
    spelled = "card 4111/1111/1111/1111 paid"
    rows = P.find_personal_data(documents(spark, [*texts, spelled, "nothing here 12"])).collect()
    by_id = {r.doc_id: r for r in rows}
    assert all(len(by_id[i].base) == 1 for i in range(400)) and not by_id[401].spans
    assert [tuple(x) for x in by_id[400].spans] in ([], [(5, 2, 24)])


def card(rng, sep):
    d = "4" + "".join(rng.choices("0123456789", k=14))
    d += next(x for x in "0123456789" if luhn(d + x))
    return sep.join(d[i : i + 4] for i in range(0, 16, 4))


def test_common_looser_forms_are_added_and_clean_numbers_are_not(spark):
    """Looser forms outnumber the base forms; numbers of the same shapes without meaning stay."""
    rng = random.Random(3)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    planted, clean = [], []
    for i in range(300):
        planted.append(("write to ", f"jo{i} [at] host{i % 7} [dot] com", " today", 0))
        planted.append(("phone ", f"0{rng.randint(150, 179)} {number(3)} {number(4)}", " today", 3))
        planted.append(("card ", card(rng, "/."[i % 2]), " paid", 2))
    for i in range(60):
        planted.append(("write to ", f"jo{i}@host{i % 7}.com", " today", 0))
        planted.append(("phone ", f"+49 {rng.randint(150, 179)} {number(3)} {number(4)}", " today", 3))
        planted.append(("card ", card(rng, " "), " paid", 2))
    for i in range(200):
        wrong = card(rng, "/")
        clean += [f"file {wrong[:-1]}{(int(wrong[-1]) + 5) % 10} closed", f"order no. {number(9)} sent", f"meet [at] noon {i}", f"on 2024-0{i % 9 + 1}-17 {number(2)}"]
    texts = [a + m + z for a, m, z, _ in planted] + clean
    rows = {r.doc_id: [tuple(x) for x in r.spans] for r in P.find_personal_data(documents(spark, texts)).collect()}
    missed = [texts[i] for i, (a, m, _, k) in enumerate(planted) if (len(a), k, len(a + m)) not in rows[i]]
    added = [texts[i] for i in range(len(planted), len(texts)) if rows[i]]
    assert (missed, added) == ([], [])


def test_redaction(spark):
    from pyspark.sql import functions as F

    df = documents(spark, ["é a@b.co, 1.2.3.4!", "none"])
    found = P.find_personal_data(df).join(df.select("doc_id", "text"), "doc_id")
    out = {r.doc_id: r.t for r in found.select("doc_id", P.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {0: "é [email], [ip]!", 1: "none"}


def test_native_plan_and_awkward_documents(spark):
    df = P.spans_and_candidates(awkward(spark, ["t", "base", "row"]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    rows = P.find_personal_data(awkward(spark, ["t", "base", "row"])).collect()
    assert len(rows) == 10 and all(r.base == [] for r in rows)
    assert P.find_personal_data(empty(spark)).collect() == []
