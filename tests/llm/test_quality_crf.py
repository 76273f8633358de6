import itertools
import math
import random

import numpy as np
from corpus import DOCS_SCHEMA, awkward, empty

from lexivec.llm import quality_crf as Q


def brute_marginals(log_odds, joint):
    """P(good) of each line and expected neighbour counts, over all labellings."""
    total, good, counts = 0.0, np.zeros(len(log_odds)), np.zeros((2, 2))
    for states in itertools.product((0, 1), repeat=len(log_odds)):
        w = math.exp(sum(x * s for x, s in zip(log_odds, states, strict=True)) + sum(joint[a, b] for a, b in itertools.pairwise(states)))
        total += w
        good += w * np.array(states)
        for a, b in itertools.pairwise(states):
            counts[a, b] += w
    return good / total, counts / total


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    joint = rng.normal(size=(2, 2))
    sizes = np.array([1, 4, 7, 2, 7])
    x = rng.normal(size=sizes.sum()) * 2
    found, counts = Q.marginals(Q.padded(x, sizes), joint)
    want_counts = np.zeros((2, 2))
    for n, own in enumerate(np.split(x, np.cumsum(sizes)[:-1])):
        good, c = brute_marginals(own, joint)
        want_counts += c
        assert np.allclose(found[: sizes[n], n], good) and np.isnan(found[sizes[n] :, n]).all()
        assert np.allclose(Q.chain_marginals(own.tolist(), joint), good)
    assert np.allclose(counts, want_counts)


def test_blocks_do_not_change_features():
    rng = random.Random(3)
    text = "\n".join("".join(rng.choice("ab C1.|é ") for _ in range(rng.randint(0, 60))) for _ in range(80)).encode()
    whole, cut = (np.concatenate(list(Q.blocks(text, most))) for most in (1 << 20, 200))
    assert whole.shape == (80, Q.FEATURES) and np.allclose(whole, cut, atol=1e-6)
    assert np.allclose(np.concatenate(list(Q.blocks(b"", 10))), Q.line_features([b""], True, True, []))
    long = b"ab. " * 1000
    a, b = Q.line_features([long], True, True, []), Q.long_line(long, True, True, [], 500)
    assert np.abs(a - b).max() < 0.05


def make(n, seed):
    """Clean prose, prose with bad lines among good ones, and junk."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 25))).capitalize() + "."
    bad = lambda: " | ".join(word().upper() + "$$" for _ in range(rng.randint(5, 25)))
    docs, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.8)
        lines = [good() if label or rng.random() < 0.4 else bad() for _ in range(rng.randint(1, 9))]
        if not label:
            lines[rng.randrange(len(lines))] = bad()
        docs.append((i, "\n".join(lines), "en", "a", 0))
        labels.append((i, label, 0))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_line_labels(spark):
    docs, labels = make(900, 5)
    truth = {i: q for i, q, _ in labels}
    df, lab = spark.createDataFrame(docs, DOCS_SCHEMA), spark.createDataFrame([(i, q if i % 3 else None, t) for i, q, t in labels], LABELS)
    model = Q.fit(df, lab)
    rows = Q.score_documents(df, model).collect()
    assert len(rows) == 900 and {r.held_out for r in rows} == {True, False}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    # the lines themselves: good lines of bad documents are told apart from bad ones
    marks = [(p > 0.5) != ("$$" in line) for _, text, *_ in docs[:200] for p, line in zip(model.line_quality(text.encode())[0], text.split("\n"), strict=True)]
    assert sum(marks) / len(marks) > 0.95
    again = Q.score_documents(df.repartition(5), Q.fit(df.repartition(3), lab)).collect()
    assert {r.doc_id: round(r.score, 6) for r in again} == {r.doc_id: round(r.score, 6) for r in rows}


def test_held_out_labels_are_never_used(spark):
    docs, labels = make(300, 6)
    df = spark.createDataFrame(docs, DOCS_SCHEMA)
    held = {r.doc_id for r in Q.score_documents(df, 0.5).where("held_out").collect()}
    flipped = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    a, b = (Q.fit(df, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert np.allclose(a.weights[1], b.weights[1]) and a.curve == b.curve


def test_awkward_rows_and_labels(spark):
    docs = awkward(spark, ["score", "quality"])
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in Q.quality_of_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 0, 0), (7, None, 0)], LABELS)
    assert len({r.score for r in Q.quality_of_documents(docs, one).collect()}) == 1
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(5, 0, 0), (5, 0, 0)], LABELS)
    rows = Q.quality_of_documents(docs, both).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert Q.quality_of_documents(empty(spark), both).collect() == []
