"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another.

A text is tokenised by a byte-level BPE (A) and by a sentencepiece model with byte fallback (B).
The tokenizers library's character offsets and the spans of sentencepiece's proto give coarse cuts:
places where a token ends and the next one starts right there. Tokens that share a character
(multibyte characters split over tokens, byte-fallback pieces) have no such place between them;
there the decoded bytes of the tokens give the byte where each ends. Bytes where tokens of both
end cut the text into groups, and all A-B pairs of a group are linked.

Neither tokenizer has a token across the border between a character and a single space after it
(checked for B's vocabulary), so texts are aligned piece by piece between such borders, and a piece
seen before costs one look-up in a memo that is bounded in bytes.

Links are counted over the whole corpus (in how many documents an id pair is linked). The pairs
with the highest counts, ``HEAVY`` at most, go to every task; the others are joined by a shuffle,
at every size in the same way.

Defined results: null and empty texts have no tokens, nor has a text that the tokens do not spell
byte for byte (U+2581 inside): zeros and an empty digest. Texts of any length are aligned whole;
memory follows the longest run without spaces. Repeated rows are separate documents. Null ids stay
null. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.bpe import byte_letters
from lexivec.llm.common import hold_memo, save

#: Pairs whose counts every task holds (17 bytes each).
HEAVY = 500_000
#: Bytes of pieces that a worker remembers in each of two generations, and the longest such piece.
MEMO_BYTES = 150 << 20
MEMO_PIECE = 256

#: A space after a character that is no white space, with something behind it.
BORDER = re.compile(r"(?<=\S) (?=[\s\S])")
#: Where a plain cut at spaces would be wrong: white space before a space, a space at an end.
UNEVEN = re.compile(r"\s |\A | \Z")


#: The alignment of a piece: its groups as text, its links (``a * size of B + b`` a link, 8 bytes
#: each), its tokens of A. None: the tokens do not spell it.
Piece = tuple[str, bytes, int] | None


def byte_ends(spans: list[tuple[int, int]], token_bytes: list[bytes]) -> list[int] | None:
    """Byte where each token ends. ``spans`` are byte spans of the characters each token touches
    (empty for a byte-fallback piece that does not end its character); where the next token starts
    at this one's end, the span decides. Between such places the decoded bytes do. None when the
    two disagree."""
    ends, at = [], 0
    for n, ((start, end), own) in enumerate(zip(spans, token_bytes, strict=True)):
        at += len(own)
        clean = n + 1 == len(spans) or (start < end == spans[n + 1][0] < spans[n + 1][1])
        if clean and at != end:
            return None
        ends.append(at)
    return ends


class Aligner:
    """Both tokenizers and the memo of pieces."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import sentencepiece
        from tokenizers import Tokenizer

        letters = byte_letters()
        data = json.loads(spec)
        pre = data["pre_tokenizer"] or {}
        if data["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or data["normalizer"]:
            raise ValueError("A must be a byte-level BPE that cuts words by the library's pattern, without normaliser or prefix space")
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items()}
        if not {bytes([x]) for x in range(256)} <= set(self.bytes_a.values()):
            raise ValueError("A must have a token for every byte")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B must have no piece with a space after another character")
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        top = 1 + max(self.size, *self.bytes_a)
        self.next_group, self.next_side, self.next_id = (np.array([f"{c}{i}" for i in range(top)], object) for c in ";|,")
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, Piece] = {}
        self.old: dict[str, Piece] = {}
        self.held = 0

    def align(self, pieces: list[str]) -> Iterator[tuple[str, Piece]]:
        """The alignment of each piece, as if a space stood before it."""
        for start in range(0, len(pieces), 2000):
            part = pieces[start : start + 2000]
            of_a = self.a.encode_batch([" " + p for p in part], add_special_tokens=False)
            protos = self.b.encode(part, return_type="proto", num_threads=1)
            spelt, all_a, all_b = [], [], []
            for p, a, b in zip(part, of_a, protos, strict=True):
                of_b = list(b.pieces)
                ids_a, ids_b = a.ids, [x.id for x in of_b]
                ends = self._ends(" " + p, ids_a, a.offsets, ids_b, of_b)
                if ends is None:
                    yield p, None
                else:
                    spelt.append(p)
                    all_a.append((ids_a, ends[0]))
                    all_b.append((ids_b, ends[1]))
            yield from zip(spelt, self._groups(all_a, all_b), strict=True)

    def _ends(self, text: str, ids_a, offsets, ids_b, spans) -> tuple[list[int], list[int]] | None:
        """Bytes where the tokens of A and of B end; None when they do not spell the text."""
        whole = text.encode()
        own_b = [self.bytes_b[i] for i in ids_b]
        if b"".join(own_b) != whole:  # A has every byte and always spells
            return None
        # B's spans are of the text without the space that B adds in front
        if len(whole) == len(text):  # a character is a byte: the spans' ends are all there is
            return [e for _, e in offsets], [x.end + 1 for x in spans]
        own_a = [self.bytes_a[i] for i in ids_a]
        place = list(accumulate(map(len, map(str.encode, text)), initial=0))
        ends_a = byte_ends([(place[s], place[e]) for s, e in offsets], own_a)
        ends_b = byte_ends([(x.begin + 1 if n else 0, x.end + 1) for n, x in enumerate(spans)], own_b)
        return None if ends_a is None or ends_b is None else (ends_a, ends_b)

    def _groups(self, all_a: list[tuple[list[int], list[int]]], all_b: list[tuple[list[int], list[int]]]) -> Iterator[Piece]:
        """Groups and links of many pieces (ids and ends of A, of B) at once, laid end to end."""
        if not all_a:
            return
        n_a, n_b = (np.array([len(ids) for ids, _ in x]) for x in (all_a, all_b))
        base = np.concatenate([[0], np.cumsum([ends[-1] for _, ends in all_a])])[:-1]
        ids_a, ids_b = (np.fromiter(chain.from_iterable(ids for ids, _ in x), np.int64) for x in (all_a, all_b))
        at_a, at_b = (
            np.fromiter(chain.from_iterable(ends for _, ends in x), np.int64) + np.repeat(base, n) for x, n in ((all_a, n_a), (all_b, n_b))
        )
        cuts = np.intersect1d(at_a, at_b, assume_unique=True)
        in_a, in_b = np.searchsorted(cuts, at_a), np.searchsorted(cuts, at_b)  # a token's group
        start_a, start_b = (np.searchsorted(x, np.arange(len(cuts) + 1)) for x in (in_a, in_b))
        # links: every token of A with all tokens of B in its group
        mates = np.diff(start_b)[in_a]
        first = np.repeat(np.cumsum(mates) - mates, mates)
        with_b = np.repeat(start_b[in_a], mates) + np.arange(len(first)) - first
        links = (np.repeat(ids_a, mates) * self.size + ids_b[with_b]).tobytes()
        # ids in the order of the text: a group's A, then its B, each behind its separator
        words = np.empty(len(ids_a) + len(ids_b), object)
        opens_a, opens_b = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (in_a, in_b))
        words[np.arange(len(ids_a)) + start_b[in_a]] = np.where(opens_a, self.next_group[ids_a], self.next_id[ids_a])
        words[np.arange(len(ids_b)) + start_a[in_b + 1]] = np.where(opens_b, self.next_side[ids_b], self.next_id[ids_b])
        words = words.tolist()
        to_word = [0, *np.cumsum(n_a + n_b).tolist()]
        to_link = [0, *(8 * np.cumsum(mates)[np.cumsum(n_a) - 1]).tolist()]
        for n, own in enumerate(n_a.tolist()):
            yield "".join(words[to_word[n] : to_word[n + 1]])[1:], links[to_link[n] : to_link[n + 1]], own

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """Per text (n_a, n_b, n_groups, n_links, groups, distinct pairs, their times); None: no tokens."""
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        cut = [[] if not t else BORDER.split(t) if UNEVEN.search(t) else t.split(" ") for t in texts]
        fresh, long = [], []
        young, old = self.young, self.old
        for p in {p for pieces in cut for p in pieces}:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                    self.held += cost(p, old[p])
                else:
                    fresh.append(p)
        for p, piece in self.align(fresh):
            young[p] = piece
            if len(p) > MEMO_PIECE:
                long.append(p)
            else:
                self.held += cost(p, piece)
        out: list[tuple | None] = []
        for pieces in cut:
            found = list(map(young.__getitem__, pieces))
            if not found or None in found:
                out.append(None)
                continue
            groups, links, n_a = zip(*found, strict=True)
            spelt = ";".join(groups)
            own, times = np.unique(np.frombuffer(b"".join(links), np.int64), return_counts=True)
            n_groups, sum_a = spelt.count(";") + 1, sum(n_a)
            # a group's ids have a comma between them or the bar
            out.append((sum_a, spelt.count(",") + 2 * n_groups - sum_a, n_groups, int(times.sum()), spelt, own, times))
        for p in long:
            del young[p]
        return out


def cost(text: str, piece: Piece) -> int:
    """Bytes, about, that a remembered piece takes."""
    return 300 + 2 * len(text) + (0 if piece is None else len(piece[0]) + len(piece[1]))


_LOADED: dict[str, Aligner] = {}


def loaded(spec: str, model: bytes) -> Aligner:
    digest = hashlib.sha256(spec.encode() + model).hexdigest()
    if digest not in _LOADED:
        _LOADED[digest] = Aligner(spec, model)
    hold_memo("alignment", lambda: [x.forget() for x in _LOADED.values()])
    return _LOADED[digest]


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *values])))


def align_documents(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``, null
    without tokens), pairs (distinct linked pairs, ``a * size of B + b``) and times."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))
    kind = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(*shared.value)
        none = np.empty(0, np.int64)
        for rows in batches:
            for start in range(0, rows.num_rows, 256):
                part = rows.slice(start, 256)
                found = aligner.documents([t or "" for t in part.column(1).to_pylist()])
                plain = [x or (0, 0, 0, 0, None, none, none) for x in found]
                numbers = [pa.array([x[n] for x in plain], pa.int64()) for n in range(4)]
                groups = pa.array([x[4] for x in plain], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, groups, lists([x[5] for x in plain]), lists([x[6] for x in plain])], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """Per linked pair: in how many documents (``n``), and is that its A id's highest count?"""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = save(counts.withColumn("a", F.expr(f"pair div {size_b}")), "alignment-pairs")
    # one row an A id at most: the vocabulary bounds what is sent to the tasks
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def heavy_limit(counts: DataFrame, most: int) -> int:
    """The lowest count such that at most ``most`` pairs have it or a higher one."""
    # eight steps a doubling: some hundred rows
    step = F.floor(F.log2(F.col("n").cast("double")) * 8)
    rows = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("low")).collect()
    limit, room = 1 << 62, most
    for row in sorted(rows, key=lambda r: -r["step"]):
        room -= row["pairs"]
        if room < 0:
            break
        limit = row["low"]
    return limit


def score_links(aligned: DataFrame, size_b: int, most: int = HEAVY) -> DataFrame:
    """``aligned`` (stored) with n_best (links whose pair has its A id's highest count) and
    count_sum (counts summed over links). ``pairs`` and ``times`` go."""
    spark = aligned.sparkSession
    counts = save(pair_counts(aligned, size_b), "alignment-counts")
    limit = heavy_limit(counts, most)
    heavy = counts.where(F.col("n") >= limit).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(heavy[c].to_numpy() for c in ("pair", "n", "best")))
    others = [c for c in aligned.columns if c not in ("pairs", "times")]
    kind = aligned.select("row", "pairs", "times").withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = shared.value
        for rows in batches:
            flat, times = rows.column(1).flatten().to_numpy(zero_copy_only=False), rows.column(2).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(rows.column(1).offsets.to_numpy()).astype(np.int64)
            doc = np.repeat(np.arange(rows.num_rows), sizes)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            n_best, count_sum = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            if hit.any():
                np.add.at(n_best, doc[hit], times[hit] * best[at[hit]])
                np.add.at(count_sum, doc[hit], times[hit] * numbers[at[hit]])
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=rows.num_rows))]).astype(np.int32)
            rare = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *rare, pa.array(n_best), pa.array(count_sum)], names=kind.names)

    known = save(aligned.select("row", "pairs", "times").mapInArrow(run, kind), "alignment-known")
    rare = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = counts.where(F.col("n") < limit)
    rare = rare.join(rest, "pair").groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0).cast("long"))).alias(a)
    sums = known.select("row", "n_best", "count_sum").join(rare, "row", "left").select("row", plus("n_best", "more_best"), plus("count_sum", "more_sum"))
    return aligned.select(*others).join(sums, "row")


def digest(groups: str = "groups") -> Column:
    return F.when(F.col(groups).isNull(), F.lit("")).otherwise(F.sha2(F.col(groups), 256))


def alignment_of_documents(docs: DataFrame, spec: str, model: bytes, most: int = HEAVY) -> DataFrame:
    """Per row of ``docs``: the alignment's numbers, its links' corpus counts and the groups' SHA-256."""
    size_b = loaded(spec, model).size
    found = align_documents(docs, spec, model).withColumn("groups_sha256", digest()).drop("groups")
    # the row number is stored with the row, so that a task run again cannot change it
    aligned = save(found.withColumn("row", F.monotonically_increasing_id()), "alignment")
    return score_links(aligned, size_b, most).drop("row")
