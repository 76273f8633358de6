"""Language ID by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's
probability is the sum over *all* ways to cut it into pieces (forward algorithm); a text's is the
product over its words, since no piece crosses white space. Single bytes are pieces too, so every
word can be cut. The piece probabilities are fitted by expectation maximisation (forward-backward
counts) on a bounded sample of labelled rows.

Defined results: null texts and texts without a letter give ``und`` with score 0; equal scores go
to the language first in code-point order; repeated rows are scored each on its own; a table
without labelled rows gives ``und`` for all; a null ``doc_id`` counts as not held out. Other
columns are never read. Texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import batch, hold_memo, kept, map_batches, save

UND = "und"
#: Training bound: documents per language, and over all languages.
TRAIN_DOCS_PER_LANG = 1500
TRAIN_DOCS = 30_000
EM_ROUNDS = 3
#: Added to every expected count, so that no piece is impossible in a language.
SMOOTHING = 0.02
#: Distinct words whose scores a worker keeps before it starts anew.
WORD_CACHE = 200_000
WORD_CACHE_CHARS = 1 << 24
#: Words of one forward pass.
FORWARD_WORDS = 40_000
FORWARD_BYTES = 1 << 19
#: Bytes of one forward-backward pass, and of the blocks in which the fit counts longer words: every
#: byte is counted, only a piece across a block's border is not.
EM_BYTES = 1 << 18
EM_BLOCK = 4096
#: Scale per byte that keeps forward sums near 1, and how often they are rescaled exactly.
BYTE_SCALE = 12.0
RESCALE_EVERY = 24
END = 256  # code after a word's last byte; in no piece

SPACE = "▁"


class PieceTrie:
    """The vocabulary as a double-array trie over bytes: one numpy gather per step and word."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = i
        size = 4 * len(children) + 1024
        base, check, term = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        todo, low = [(0, 0)], 1
        while todo:
            node, slot = todo.pop()
            term[slot] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            while taken[low]:
                low += 1
            at = max(low - codes[0], 0)
            while any(taken[at + c] for c in codes):
                at += 1
            base[slot] = at
            for c in codes:
                taken[at + c] = 1
                check[at + c] = slot
                todo.append((children[node][c], at + c))
        top = taken.rfind(1) + 1 + 512
        self.base, self.check, self.term = base[:top], check[:top], term[:top]
        self.lengths = np.fromiter(map(len, pieces), np.float64, len(pieces))
        self.depth = int(self.lengths.max())


def load_pieces(path: str) -> list[bytes]:
    """Lower-case pieces of a sentencepiece model as bytes, the word mark as a space, and all
    256 single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and SPACE not in p[1:] and p == p.lower():
            found.add(p.replace(SPACE, " ").encode())
    return sorted(found)


@dataclass
class Unigrams:
    langs: list[str]
    trie: PieceTrie
    probs: np.ndarray  # pieces x languages


def _layout(words: list[bytes]):
    """Longest first: offsets into one code array; each word is a space, its bytes, and END."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    start = np.concatenate([[0], np.cumsum(lengths + 1)])
    codes = np.frombuffer(b"".join(b" " + words[i] + b"\0" for i in order), np.uint8).astype(np.int32)
    codes[start[1:] - 1] = END
    return order, lengths, start[:-1], codes


def _matches(trie: PieceTrie, codes: np.ndarray, pos: np.ndarray):
    """Pieces that start at each position: (row index, piece length, piece)."""
    alive = np.arange(len(pos))
    node = np.zeros(len(pos), np.int32)
    for d in range(trie.depth):
        nxt = trie.base[node] + codes[pos[alive] + d]
        ok = trie.check[nxt] == node
        ok &= nxt > 0
        alive, node = alive[ok], nxt[ok]
        if not len(alive):
            return
        piece = trie.term[node]
        hit = piece >= 0
        if hit.any():
            yield alive[hit], d + 1, piece[hit]


def forward(model: Unigrams, words: list[bytes], keep: list | None = None):
    """log P(word) for each word and language (words x languages).

    ``keep`` gets what the backward pass needs. Sums are scaled by ``BYTE_SCALE`` a byte and the
    open window is rescaled every ``RESCALE_EVERY`` bytes, so words of any length neither
    overflow nor vanish.
    """
    trie, n_langs = model.trie, model.probs.shape[1]
    if not words:
        return np.zeros((0, n_langs))
    order, lengths, start, codes = _layout(words)
    scaled = model.probs * BYTE_SCALE ** trie.lengths[:, None]
    alpha = np.zeros((len(codes), n_langs))
    alpha[start] = 1.0
    log_scale = np.zeros((len(words), n_langs))
    active = len(words)
    for s in range(int(lengths[0])):
        while active and lengths[active - 1] <= s:
            active -= 1
        pos = start[:active] + s
        if s and s % RESCALE_EVERY == 0:
            last = (start + lengths)[:active]
            top = np.max([alpha[np.minimum(pos + k, last)] for k in range(trie.depth + 1)], axis=0)
            top[top <= 0] = 1.0
            for k in range(trie.depth + 1):
                inside = pos + k <= last
                alpha[pos[inside] + k] /= top[inside]
            log_scale[:active] += np.log(top)
            if keep is not None:
                keep.append((pos, last, top))
        step = []
        for row, size, piece in _matches(trie, codes, pos):
            alpha[pos[row] + size] += alpha[pos[row]] * scaled[piece]
            if keep is not None:
                step.append((pos[row], size, piece))
        if keep is not None:
            keep.append(step)
    end = alpha[start + lengths]
    out = np.empty((len(words), n_langs))
    out[order] = np.log(np.maximum(end, 1e-300)) + log_scale - (lengths * np.log(BYTE_SCALE))[:, None]
    if keep is not None:
        keep.append((alpha, scaled, start, lengths, order))
    return out


def expected_counts(model: Unigrams, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces x languages) over all segmentations, by
    forward-backward; ``weights``: words x languages. Sums back are rescaled where the sums
    forward were, so words may have any length."""
    keep: list = []
    forward(model, words, keep)
    if not keep:
        return np.zeros_like(model.probs)
    alpha, scaled, start, lengths, order = keep.pop()
    beta = np.zeros_like(alpha)
    end = start + lengths
    total = alpha[end]
    beta[end] = np.where(total > 0, weights[order] / np.maximum(total, 1e-300), 0)
    pieces: list[np.ndarray] = []
    uses: list[np.ndarray] = []
    for step in reversed(keep):
        if isinstance(step, tuple):  # what lies before this place meets sums rescaled here
            pos, last, top = step
            for k in range(model.trie.depth + 1):
                inside = pos + k <= last
                beta[pos[inside] + k] /= top[inside]
            continue
        for pos, size, piece in step:
            back = scaled[piece] * beta[pos + size]
            pieces.append(piece)
            uses.append(alpha[pos] * back)
            beta[pos] += back
    counts = np.zeros_like(model.probs)
    if pieces:
        piece, used = np.concatenate(pieces), np.concatenate(uses)
        for lang in range(counts.shape[1]):
            counts[:, lang] = np.bincount(piece, used[:, lang], len(counts))
    return counts


def in_blocks(word: bytes) -> list[bytes]:
    """``word`` cut before the first whole character at each ``EM_BLOCK`` bytes."""
    cuts = [0]
    while len(word) - cuts[-1] > EM_BLOCK:
        at = cuts[-1] + EM_BLOCK
        while word[at] & 0xC0 == 0x80 and at > cuts[-1] + EM_BLOCK - 4:
            at -= 1
        cuts.append(at)
    return [word[x:y] for x, y in zip(cuts, [*cuts[1:], len(word)], strict=True)]


def word_logs(model: Unigrams, words: list[bytes]) -> np.ndarray:
    """log P of each word (words x languages), ``FORWARD_WORDS`` words and ``FORWARD_BYTES`` at a time. As in
    the fit, words of more than ``EM_BLOCK`` bytes are read in blocks, each like a word of its own, so
    that time and memory follow their bytes."""
    blocks = [(n, b) for n, w in enumerate(words) for b in in_blocks(w)]
    logs = np.zeros((len(words), model.probs.shape[1]))
    start = 0
    while start < len(blocks):
        end, size = start, 0
        while end < len(blocks) and end - start < FORWARD_WORDS and size < FORWARD_BYTES:
            size += len(blocks[end][1])
            end += 1
        part = blocks[start:end]
        np.add.at(logs, [n for n, _ in part], forward(model, [b for _, b in part]))
        start = end
    return logs


def count_uses(model: Unigrams, lang: int, words: list[bytes], weights: list[float]) -> np.ndarray:
    """Expected uses of each piece in weighted words of one language, ``EM_BYTES`` at a time."""
    one = Unigrams([model.langs[lang]], model.trie, model.probs[:, [lang]])
    blocks = sorted(((b, n) for w, n in zip(words, weights, strict=True) for b in in_blocks(w)), key=lambda x: len(x[0]))
    uses = np.zeros(len(model.probs))
    start = 0
    while start < len(blocks):
        end, size = start, 0
        while end < len(blocks) and size < EM_BYTES:
            size += len(blocks[end][0])
            end += 1
        part = blocks[start:end]
        uses += expected_counts(one, [b for b, _ in part], np.array([[n] for _, n in part], np.float64))[:, 0]
        start = end
    return uses


def held_out(doc_id: Column) -> Column:
    """The contract's fold: crc32 of the id's text, remainder 2 of 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_words(docs: DataFrame, per_lang: int, total: int) -> tuple[list[str], DataFrame]:
    """Words of a bounded, seeded sample of labelled rows: (lang, word, n), and the languages.

    Only ids and labels are read to choose the rows; at most ``per_lang`` ids of a language are
    broadcast, and ``total`` ids in all, but one of every language at least.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return [], docs.sparkSession.createDataFrame([], "lang string, word binary, n long")
    per_lang = max(1, min(per_lang, total // len(langs)))
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    ids = (
        labelled.select("doc_id", "lang").distinct()
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= per_lang)
        .select("doc_id", "lang")
    )
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")
    out = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                for word in (text or "").lower().split():
                    key = (lang, word.encode())
                    found[key] = found.get(key, 0) + 1
            yield batch(out, [k[0] for k in found], [k[1] for k in found], list(found.values()))

    counted = sample.mapInArrow(words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return langs, save(counted.sortWithinPartitions("lang"), "langid-words")


def new_model(langs: list[str], pieces: list[bytes]) -> Unigrams:
    """Start: every language alike, longer pieces a little likelier than their bytes."""
    trie = PieceTrie(pieces)
    start = np.where(trie.lengths > 1, 4.0, 1.0) / trie.lengths
    return Unigrams(langs, trie, np.repeat((start / start.sum())[:, None], max(1, len(langs)), axis=1))


def fit(docs: DataFrame, vocab_path: str, per_lang: int = TRAIN_DOCS_PER_LANG, total: int = TRAIN_DOCS, rounds: int = EM_ROUNDS) -> Unigrams:
    """Fit on the rows of ``docs`` (doc_id, text, lang). Each round adds up expected counts on the
    executors; the driver gets pieces x languages numbers."""
    spark = docs.sparkSession
    langs, words = training_words(docs, per_lang, total)
    model = new_model(langs, load_pieces(vocab_path))
    if not langs:
        return model
    out = pa.schema([("lang", pa.int32()), ("piece", pa.int32()), ("uses", pa.float64())])
    where = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            uses = np.zeros_like(now.probs)
            for rows in batches:
                of_lang: dict[str, list[int]] = {}
                for i, lang in enumerate(rows.column(0).to_pylist()):
                    of_lang.setdefault(lang, []).append(i)
                words_here, times = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                for lang, own in of_lang.items():
                    uses[:, where[lang]] += count_uses(now, where[lang], [words_here[i] for i in own], [times[i] for i in own])
            piece, lang = np.nonzero(uses)
            yield batch(out, lang.astype(np.int32), piece.astype(np.int32), uses[piece, lang])

        gathered = words.select("lang", "word", "n").mapInArrow(step, "lang int, piece int, uses double")
        gathered = gathered.groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        shared.unpersist()
        uses = np.full_like(model.probs, SMOOTHING)
        uses[gathered.column("piece").to_numpy(), gathered.column("lang").to_numpy()] += np.round(gathered.column("uses").to_numpy(), 6)
        model.probs = uses / uses.sum(axis=0)
    return model


def _posterior(logs: np.ndarray) -> np.ndarray:
    top = np.exp(logs - logs.max(axis=1, keepdims=True))
    return top / top.sum(axis=1, keepdims=True)


class Scorer:
    """Text -> (language, posterior), keeping the scores of the words seen so far."""

    def __init__(self, model: Unigrams):
        hold_memo("language")
        self.model = model
        self.reset()

    def reset(self) -> None:
        from collections import defaultdict

        self.ids: dict[str, int] = defaultdict(count().__next__)
        self.logs = np.zeros((0, len(self.model.langs)))
        self.chars = np.zeros(0)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        if len(self.ids) > WORD_CACHE or self.chars.sum() > WORD_CACHE_CHARS:
            self.reset()
        known = len(self.ids)
        split = [(t or "").lower().split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        ids = np.fromiter((i for words in split for i in map(self.ids.__getitem__, words)), np.int64, int(sizes.sum()))
        fresh = list(self.ids)[known:]
        if langs and fresh:
            self.logs = np.concatenate([self.logs, word_logs(self.model, [w.encode() for w in fresh])])
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, fresh), np.float64, len(fresh))])
        lettered = np.fromiter((any(map(str.isalpha, t)) if t else False for t in texts), bool, len(texts))
        told, score = [UND] * len(texts), np.zeros(len(texts))
        use = np.flatnonzero(lettered & (sizes > 0))
        self.last = (sizes, ids, np.full(len(texts), -1))
        if langs and len(use):
            starts = np.concatenate([[0], np.cumsum(sizes)])[use]
            sums = np.add.reduceat(self.logs[ids], starts, axis=0)
            post = _posterior(sums)
            best = post.argmax(axis=1)
            self.last[2][use] = best
            score[use] = post[np.arange(len(use)), best]
            for row, lang in zip(use, best, strict=True):
                told[row] = langs[lang]
        return told, score

    def word_fits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Per text the log probability a character of each of its words, in the text's language;
        no words for texts without a language."""
        self(texts)
        sizes, ids, best = self.last
        ends = np.cumsum(sizes)
        own = [ids[e - n : e] for n, e in zip(sizes, ends, strict=True)]
        return [self.logs[i, b] / self.chars[i] if b >= 0 else np.zeros(0) for i, b in zip(own, best, strict=True)]


#: A word is foreign to a language when a character of it costs so many times what one of a usual
#: word does; a text is rejected when less than this share of its words is not foreign.
FOREIGN = 3.0
LEAST_SHARE = 0.4


def usual_cost(labelled: DataFrame, model: Unigrams) -> float | None:
    """The median over labelled rows of each text's median word cost (log probability a character)."""
    added = {"usual": "double"}
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def step(rows: pa.RecordBatch) -> list[pa.Array]:
            fits = scorer.word_fits(rows.column(0).to_pylist())
            return [*rows.columns, pa.array([float(np.median(f)) if len(f) else None for f in fits], pa.float64())]

        return step

    found = map_batches(labelled.select(F.col("text").cast("string").alias("text")), make, added)
    return found.agg(F.percentile_approx("usual", 0.5)).first()[0]


def in_learned_languages(docs: DataFrame, model: Unigrams, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language: at least ``LEAST_SHARE`` of its words
    cost at most ``FOREIGN`` times the usual, which rows of ``labelled`` (left out of the fit) tell.
    Short texts, numbers and addresses among words do not matter that way. Where nothing could be
    learned, every text with a letter stays."""
    usual = usual_cost(labelled, model) if model.langs else None
    if usual is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    added = {"__share": "double"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        scorer = Scorer(shared.value)

        def step(rows: pa.RecordBatch) -> list[pa.Array]:
            fits = scorer.word_fits(rows.column(at).to_pylist())
            return [*rows.columns, pa.array([float((f >= FOREIGN * usual).mean()) if len(f) else 0.0 for f in fits], pa.float64())]

        return step

    return map_batches(docs, make, added).where(F.col("__share") >= LEAST_SHARE).drop("__share")


def identify(docs: DataFrame, model: Unigrams, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; the columns kept are passed through. Columns
    of those names in ``docs`` are replaced."""
    added = {"lang_pred": "string", "score": "double"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = kept(docs, added).index(text)

    def make():
        scorer = Scorer(shared.value)

        def step(rows: pa.RecordBatch) -> list[pa.Array]:
            told, points = scorer(rows.column(at).to_pylist())
            return [*rows.columns, pa.array(told, pa.string()), pa.array(points, pa.float64())]

        return step

    return map_batches(docs, make, added)


def language_of_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Train on the rows outside the held-out fold; predict every row from its text alone."""
    fold = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(fold.where(~F.col("held_out")), vocab_path)
    return identify(fold.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")), model).drop("text")
