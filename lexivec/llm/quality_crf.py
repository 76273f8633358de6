"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's state depends on features of its own characters and words, on
the same features of the line before and the line after, and on the neighbouring states. Forward
and backward passes give each line's marginal probability of being good; a document's quality is
their mean weighted by line length, put on the labels' scale by a logistic curve.

Fit: labels are given for documents, not lines. All lines of a good document are good; of a bad
document first all lines are bad and each line is judged by itself; then, in ``ROUNDS`` rounds in all,
the lines that the model finds good are let go, the worst line always staying bad, and the whole
chain is fitted to what is left. The sample is bounded: ``TRAIN_DOCS`` labelled
documents of each label, the least by a hash of the id, with at most ``TRAIN_LINES`` lines each.
Their features alone reach the driver. Weights of the classes in the whole labelled table are
restored in the calibration.

Defined results: null and empty texts are one empty line and get a score; a line weighs its length
in bytes plus one; texts of any length are scored whole, in blocks of lines. Without labels every
score is 0.5; with one label only, (n1 + 1) / (n + 2). Contradicting labels of one id count by
majority, ties as 0. Repeated rows are scored each; null ids are not held out and never learned
from. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, save, text_bytes, text_or_empty
from lexivec.llm.language_id import held_out

TRAIN_DOCS = 1500
TRAIN_LINES = 120
ROUNDS = 3
#: Bytes of lines whose features are counted at once.
BLOCK = 1 << 18

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte kinds: lower, upper, digit, space, other control, non-ASCII first byte, continuation byte,
#: and each punctuation character by itself.
KINDS = 7 + len(PUNCTUATION)
#: Coarse kinds whose neighbourhoods are counted: letter, upper, digit, space, punctuation, other.
COARSE = 6


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, 4, np.int64)
    kind[0x61:0x7B], kind[0x41:0x5B], kind[0x30:0x3A] = 0, 1, 2
    kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
    kind[0x80:0xC0], kind[0xC0:] = 6, 5
    for n, c in enumerate(PUNCTUATION):
        kind[c] = 7 + n
    coarse = np.array([0, 1, 2, 3, 5, 0, 0] + [4] * len(PUNCTUATION))
    return kind, coarse[kind]


KIND, COARSE_KIND = _kinds()
EXTRA = 8
FEATURES = KINDS + COARSE * COARSE + EXTRA


def line_features(lines: list[bytes], first: bool, last: bool, before: list[bytes]) -> np.ndarray:
    """Features of consecutive lines of one document, one row each. ``first`` and ``last``: do they
    hold the document's first and last line? ``before``: the line before them, if any."""
    n = len(lines)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    data = np.frombuffer(b"".join(lines), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * KINDS + KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    coarse = COARSE_KIND[data]
    inside = owner[1:] == owner[:-1]
    pair = owner[1:] * COARSE * COARSE + coarse[:-1] * COARSE + coarse[1:]
    pairs = np.bincount(pair[inside], minlength=n * COARSE * COARSE).reshape(n, COARSE * COARSE)
    out = np.zeros((n, FEATURES), np.float32)
    room = np.maximum(sizes, 1)[:, None]
    out[:, :KINDS] = np.sqrt(kinds / room)
    out[:, KINDS : KINDS + COARSE * COARSE] = np.sqrt(pairs / room)
    extra = out[:, KINDS + COARSE * COARSE :]
    extra[:, 0] = np.log1p(sizes)
    extra[:, 1] = sizes == 0
    previous = before[0] if before else None
    for i, line in enumerate(lines):
        words = line.split()
        extra[i, 2] = len(set(words)) / len(words) if words else 1
        extra[i, 3] = len(line) / (len(words) + 1)
        extra[i, 4] = line[-1:] in (b".", b"!", b"?")
        extra[i, 5] = line == previous
        previous = line
    extra[:, 3] = np.log1p(extra[:, 3])
    if n:
        extra[0, 6], extra[-1, 7] = first, last
    return out


def blocks(text: bytes, most: int = BLOCK) -> Iterator[np.ndarray]:
    """Features of all lines of a text, in blocks of whole lines."""
    lines = text.split(b"\n")
    start = 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size + len(lines[end]) <= most) and end - start < 4096:
            size += len(lines[end])
            end += 1
        if end == start + 1 and size > most:
            yield long_line(lines[start], start == 0, end == len(lines), lines[start - 1 : start], most)
        else:
            yield line_features(lines[start:end], start == 0, end == len(lines), lines[start - 1 : start] if start else [])
        start = end


def long_line(line: bytes, first: bool, last: bool, before: list[bytes], most: int) -> np.ndarray:
    """The features of one long line: rates are means over its parts, weighted by length."""
    parts = [line[i : i + most] for i in range(0, len(line), most)]
    out = np.zeros((1, FEATURES), np.float64)
    for part in parts:
        out += np.square(line_features([part], first, last, [])) * (len(part) / len(line))
    out = np.sqrt(out)
    extra = out[:, KINDS + COARSE * COARSE :]
    words = line.split()
    extra[0, 0], extra[0, 1] = math.log1p(len(line)), 0
    extra[0, 2] = len(set(words)) / len(words) if words else 1
    extra[0, 3] = math.log1p(len(line) / (len(words) + 1))
    extra[0, 4], extra[0, 5] = line[-1:] in (b".", b"!", b"?"), bool(before) and before[0] == line
    extra[0, 6], extra[0, 7] = first, last
    return out.astype(np.float32)


# --- the chain -----------------------------------------------------------------------------------


def marginals(log_odds: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains. ``log_odds``: (lines, chains), the emission of good
    against bad, nan behind a chain's end. ``joint``: 2 x 2 log weights of neighbouring states (bad,
    good). Gives P(good) and, for the gradient, the expected counts of neighbouring states."""
    steps, chains = log_odds.shape
    here = ~np.isnan(log_odds)
    emit = np.stack([np.zeros_like(log_odds), np.where(here, log_odds, 0)], -1)
    top = emit.max(-1, keepdims=True)
    emit = np.exp(emit - top)
    move = np.exp(joint - joint.max())
    ahead, back = np.empty((steps, chains, 2)), np.ones((steps, chains, 2))
    ahead[0] = emit[0] / emit[0].sum(-1, keepdims=True)
    for t in range(1, steps):
        a = (ahead[t - 1] @ move) * emit[t]
        ahead[t] = np.where(here[t][:, None], a / a.sum(-1, keepdims=True), ahead[t - 1])
    for t in range(steps - 2, -1, -1):
        b = (emit[t + 1] * back[t + 1]) @ move.T
        back[t] = np.where(here[t + 1][:, None], b / b.sum(-1, keepdims=True), 1.0)
    both = ahead * back
    good = both[..., 1] / both.sum(-1)
    counts = np.zeros((2, 2))
    for t in range(1, steps):
        if not here[t].any():
            break
        x = ahead[t - 1][:, :, None] * move[None] * (emit[t] * back[t])[:, None, :]
        counts += (x / x.sum((1, 2), keepdims=True))[here[t]].sum(0)
    return np.where(here, good, np.nan), counts


def chain_marginals(log_odds: list[float], joint: np.ndarray) -> list[float]:
    """P(good) of the lines of one document: the same passes as odds of good against bad."""
    (bb, bg), (gb, gg) = np.exp(joint - joint.max()).tolist()
    emit = [math.exp(max(-50.0, min(50.0, x))) for x in log_odds]
    ahead, odds = [], None
    for e in emit:
        odds = e if odds is None else e * (odds * gg + bg) / (odds * gb + bb)
        ahead.append(odds)
    back, out = 1.0, [0.0] * len(emit)
    for t in range(len(emit) - 1, -1, -1):
        x = ahead[t] * back
        out[t] = x / (1 + x)
        x = emit[t] * back
        back = (gg * x + gb) / (bg * x + bb)
    return out


class Model:
    """Scales, emission weights (bias; own, previous, next line), transitions, calibration."""

    def __init__(self, center, scale, weights, joint, curve):
        self.center, self.scale, self.weights, self.joint, self.curve = center, scale, weights, joint, curve

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -5, 5)

    def log_odds(self, text: bytes) -> np.ndarray:
        """Emissions of all lines: three numbers a line are kept, so that blocks can go."""
        bias, own, prev, nxt = self.weights
        parts = []
        for x in blocks(text):
            parts.append(self.scaled(x) @ np.stack([own, prev, nxt], 1))
        s = np.concatenate(parts)
        out = s[:, 0] + bias
        out[1:] += s[:-1, 1]
        out[:-1] += s[1:, 2]
        return out

    def line_quality(self, text: bytes) -> tuple[list[float], list[int]]:
        """P(good) and weight of every line."""
        return chain_marginals(self.log_odds(text).tolist(), self.joint), [len(x) + 1 for x in text.split(b"\n")]

    def score(self, text: bytes) -> float:
        good, weight = self.line_quality(text)
        return calibrated(sum(map(lambda a, b: a * b, good, weight)) / sum(weight), self.curve)


def calibrated(quality: float, curve: tuple[float, float]) -> float:
    q = min(max(quality, 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, curve[0] * math.log(q / (1 - q)) + curve[1]))))


def padded(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One column a chain, nan behind its end."""
    out = np.full((len(sizes), sizes.max()), np.nan)
    out[np.arange(sizes.max()) < sizes[:, None]] = values
    return out.T


def neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own, previous and next line's features side by side; zeros beyond a document's ends."""
    ends = np.cumsum(sizes)
    prev, nxt = np.zeros_like(x), np.zeros_like(x)
    prev[1:], nxt[:-1] = x[:-1], x[1:]
    prev[ends - sizes], nxt[ends - 1] = 0, 0
    return np.concatenate([x, prev, nxt], 1)


def adam(gradient, start: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(features: np.ndarray, sizes: np.ndarray, weights: np.ndarray, labels: np.ndarray, totals: tuple[int, int], rounds: int = ROUNDS) -> Model:
    """``features`` of all lines, ``sizes`` lines a document, ``weights`` of the lines, document
    ``labels``, and how many labelled documents of each label there are in all."""
    center, scale = features.mean(0), features.std(0) + 1e-2
    model = Model(center, scale, None, None, None)
    x = neighbours(model.scaled(features).astype(np.float32), sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    inner = np.ones(len(doc), bool)
    inner[ends - sizes] = False
    states = labels[doc].astype(float)
    w = np.zeros(1 + x.shape[1] + 4)
    each = np.where(labels[doc] == 1, 1 / max(1, (labels[doc] == 1).sum()), 1 / max(1, (labels[doc] == 0).sum())) / 2

    def emissions(w):
        return x @ w[1:-4].astype(np.float32) + w[0]

    def good_lines(w):
        found, counts = marginals(padded(emissions(w), sizes), w[-4:].reshape(2, 2))
        return found.T[~np.isnan(found.T)], counts

    # first each line by itself: what good and bad documents share is found good
    free = np.concatenate([np.ones(1 + features.shape[1]), np.zeros(2 * features.shape[1] + 4)])
    for r in range(rounds):
        real = np.zeros((2, 2))
        np.add.at(real, (states[:-1][inner[1:]].astype(int), states[1:][inner[1:]].astype(int)), 1.0)

        def gradient(w, states=states, real=real, first=r == 0):
            good, counts = good_lines(w)
            miss = (good - states) * each
            own = np.concatenate([[miss.sum()], miss.astype(np.float32) @ x, (counts - real).ravel() / len(doc)])
            return (own + 1e-3 * w) * (free if first else 1)

        w = adam(gradient, w, 60 if r else 100)
        good, _ = good_lines(w)
        # bad documents let go of lines that look good; the worst line stays bad
        states = np.where(labels[doc] == 1, 1.0, (good > 0.5).astype(float))
        for n in np.flatnonzero(labels == 0):
            own = slice(ends[n] - sizes[n], ends[n])
            states[ends[n] - sizes[n] + int(np.argmin(good[own]))] = 0.0
    wide = features.shape[1]
    good, _ = good_lines(w)
    model.weights = (w[0], w[1 : 1 + wide], w[1 + wide : 1 + 2 * wide], w[1 + 2 * wide : 1 + 3 * wide])
    model.joint = w[-4:].reshape(2, 2)
    quality = np.bincount(doc, good * weights, len(sizes)) / np.bincount(doc, weights, len(sizes))
    q = np.clip(quality, 1e-6, 1 - 1e-6)
    odds = np.log(q / (1 - q))
    share = np.where(labels == 1, totals[1] / max(1, (labels == 1).sum()), totals[0] / max(1, (labels == 0).sum()))
    share = share / share.sum()

    def slope(c):
        miss = (1 / (1 + np.exp(-np.clip(c[0] * odds + c[1], -60, 60))) - labels) * share
        return np.array([(miss * odds).sum() + 1e-3 * (c[0] - 1), miss.sum() + 1e-4 * c[1]])

    model.curve = tuple(adam(slope, np.array([1.0, 0.0]), 400).tolist())
    return model


# --- Spark ---------------------------------------------------------------------------------------


def sample_features(docs: DataFrame, most_lines: int) -> DataFrame:
    """(doc_id, quality, lines, features, weights) of the sampled documents that are not too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("lines", pa.int64()), ("features", pa.binary()), ("weights", pa.binary())])
        for rows in batches:
            for doc_id, label, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), text_bytes(rows.column(2)), strict=True):
                n = text.count(b"\n") + 1
                if n <= most_lines:
                    x = np.concatenate(list(blocks(text)))
                    own = np.array([len(line) + 1 for line in text.split(b"\n")], np.float64)
                    yield batch(kind, [doc_id], [label], [n], [x.astype("<f4").tobytes()], [own.tobytes()])

    return docs.mapInArrow(run, "doc_id long, quality long, lines long, features binary, weights binary")


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model | float:
    """A model of the labelled rows outside the held-out fold, or the one score that is left to say."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("long").alias("quality"))
    # only ids that have a document
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = save(known.join(ids, "doc_id"), "crf-labels")
    totals = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return (n1 + 1) / (n0 + n1 + 2)
    rank = F.xxhash64(F.lit("crf"), "doc_id")
    chosen = [known.where(F.col("quality") == label).orderBy(rank, "doc_id").limit(per_label) for label in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_label rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(picked, "doc_id")
    # of repeated rows of one id one is learned from
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("by"), "quality", "text")).alias("x"))
    rows = sample_features(texts.select("doc_id", "x.quality", "x.text"), most_lines).toArrow().sort_by("doc_id")
    y = rows["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        return (n1 + 1) / (n0 + n1 + 2)
    x = np.concatenate([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in rows["features"].to_pylist()])
    own = np.concatenate([np.frombuffer(b, np.float64) for b in rows["weights"].to_pylist()])
    return train(x, rows["lines"].to_numpy(), own, y, (n0, n1))


def score_documents(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, n_bad) a row of ``docs``; ``n_bad``: lines
    that are rather bad than good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_lines", pa.int64()), ("n_bad", pa.int64())])
        model = shared.value
        for rows in batches:
            scores, lines, bad = [], [], []
            for text in text_bytes(rows.column(2)):
                if isinstance(model, float):
                    scores.append(model)
                    lines.append(text.count(b"\n") + 1)
                    bad.append(None)
                    continue
                good, weight = model.line_quality(text)
                scores.append(calibrated(sum(map(lambda a, b: a * b, good, weight)) / sum(weight), model.curve))
                lines.append(len(good))
                bad.append(sum(x < 0.5 for x in good))
            yield batch(kind, rows.column(0), rows.column(1), scores, lines, bad)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    out = plain.mapInArrow(run, "doc_id long, held_out boolean, score double, n_lines long, n_bad long")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, fit(docs, labels))
