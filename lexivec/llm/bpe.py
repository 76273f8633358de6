"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a word is fixed by the last token of each of its prefixes: a sequence of tokens is
the BPE encoding just when every token is what BPE makes of its own bytes and no two neighbours
would have merged across their border. So the last token of a prefix is the one token that ends it
and fits the last token of what is left before it. Distinct words are visited in the order of
their trie (sorted bytes, depth first): the stack holds one last token per byte of the current
path, and a prefix that many words share is computed once.

Texts are cut into words as the tokenizer's own byte-level pre-tokenizer does. Texts are first cut
at single spaces between other characters, where a word always starts, so that a piece seen before
costs one look-up. Texts with special strings are cut at those first. Characters that this Python
knows as unassigned are left to the tokenizers library, whose tables decide how they are classed.

Defined results: null texts count as empty and have no ids; texts of any length are encoded whole;
repeated rows are encoded each; columns named like the results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import batch, hold_memo, kept, map_batches

#: The byte-level pre-tokenizer's fixed pattern (contractions, letters, digits, others, spaces).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pairs that a worker keeps, and bytes of its pieces and words; beyond it starts anew.
MEMO = 700_000
MEMO_BYTES = 160 << 20
#: Longer pieces and words (in characters) are not kept; what an entry takes beside its characters and ids.
MEMO_CHARS = 256
ENTRY_BYTES = 200
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others take the letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file, and words -> ids by last tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]
        if (
            model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or data["normalizer"]
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            or any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            raise ValueError("a byte-level BPE file without normaliser, prefix space, dropout or stripped tokens is needed")
        letters = byte_letters()
        self.vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length = [len(b) for b in self.bytes_of]
        self.left, self.right, self.rank = list(range(size)), list(range(size)), [-1] * size
        self.pair_rank: dict[tuple[int, int], int] = {}
        plain = {token: i for token, i in model["vocab"].items()}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, made = plain[a], plain[b], plain[a + b]
            self.pair_rank[x, y] = rank
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        self.neighbours: dict[int, bool] = {}  # a * size + b
        self.size = size
        self.backward = self._backward_trie()
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        import regex

        self.words_of = regex.compile(PATTERN).findall
        self.rare = regex.compile("[\u0370-\U0010ffff]").findall  # all below is assigned
        self.pieces: dict[str, bytes] = {}  # piece without the space before it -> ids with it
        self.words: dict[str, bytes] = {}
        self.held = 0

    # -- which tokens can be neighbours ---------------------------------------------------------

    def _stay_apart(self, a: int, b: int, before: int) -> bool:
        """Do tokens a, b keep their border, looking at the merges made before rank ``before``?
        Undo the later of the two tokens' own merges, again and again: at each moment the two
        tokens at the border must have no merge that would have come first. Of equal merges the
        left one comes first."""
        rank, pair_rank = self.rank, self.pair_rank
        while True:
            if pair_rank.get((a, b), NEVER) < before:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                before, b = rank[b] + 1, self.left[b]

    def _fit(self, a: int, b: int) -> bool:
        if len(self.neighbours) > MEMO:
            self.neighbours.clear()
        ok = self.neighbours[a * self.size + b] = self._stay_apart(a, b, NEVER)
        return ok

    def _backward_trie(self) -> dict:
        """Tokens that BPE makes of their own bytes, by their bytes from the last to the first:
        byte -> [token or -1, children or None]."""
        own = [False] * len(self.rank)
        root: dict = {}
        for token, i in sorted(self.vocab.items(), key=lambda x: self.rank[x[1]]):
            a, b = self.left[i], self.right[i]
            own[i] = len(token) == 1 if self.rank[i] < 0 else own[a] and own[b] and self._stay_apart(a, b, self.rank[i])
            if own[i]:
                children = root
                for n, x in enumerate(reversed(token)):
                    entry = children.setdefault(x, [-1, None])
                    if n == len(token) - 1:
                        entry[0] = i
                    elif entry[1] is None:
                        entry[1] = {}
                    children = entry[1]
        return root

    # -- words ----------------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of the distinct, sorted ``words``: one depth-first walk of their trie."""
        out, last, path = [], [-1], b""
        root, length, known, fit, size = self.backward, self.length, self.neighbours, self._fit, self.size
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            path = word
            for end in range(shared, len(word)):
                ends, at, children = [], end, root
                while children is not None and at >= 0:
                    entry = children.get(word[at])
                    if entry is None:
                        break
                    if entry[0] >= 0:
                        ends.append((at, entry[0]))
                    children = entry[1]
                    at -= 1
                while ends:
                    at, token = ends.pop()
                    if at == 0:
                        break
                    ok = known.get(last[at] * size + token)
                    if fit(last[at], token) if ok is None else ok:
                        break
                last.append(token)
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= length[last[end]]
            out.append(ids[::-1])
        return out

    def _learn_words(self, words: set[str]) -> None:
        fresh = sorted(w.encode() for w in words if w not in self.words)
        for word, ids in zip(fresh, self.encode_words(fresh), strict=True):
            self.words[word.decode()] = np.array(ids, "<u4").tobytes()
            self.held += ENTRY_BYTES + len(word) + 4 * len(ids)

    def _drop_long(self, words: Iterable[str]) -> None:
        for w in words:
            if len(w) > MEMO_CHARS:
                self.held -= ENTRY_BYTES + len(w.encode()) + len(self.words.pop(w))

    def forget(self) -> None:
        """Drop what was remembered; the vocabulary stays."""
        self.pieces, self.words, self.held = {}, {}, 0
        self.neighbours.clear()

    # -- texts ----------------------------------------------------------------------------------

    def _unassigned(self, text: str) -> bool:
        return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in self.rare(text))

    def _library_ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, texts: set[str]) -> dict[str, bytes]:
        """Ids of whole texts (or pieces), as bytes; all their words in one trie walk."""
        cut = {t: None if self._unassigned(t) else self.words_of(t) for t in texts}
        needed = {w for words in cut.values() if words for w in words}
        self._learn_words(needed)
        get = self.words.__getitem__
        learnt = {t: self._library_ids(t) if words is None else b"".join(map(get, words)) for t, words in cut.items()}
        self._drop_long(needed)
        return learnt

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > MEMO_BYTES:
            self.pieces, self.words, self.held = {}, {}, 0
        parts = [(n, part) for n, text in enumerate(texts) for part in cut_specials(text, self.special)]
        found, fresh = [], set()
        for _, part in parts:
            if part in self.special:
                found.append([np.array([self.special[part]], "<u4").tobytes()])
                continue
            pieces = part.split(" ")
            inner = list(map(self.pieces.get, pieces[1:-1]))
            new = {p for p, ids in zip(pieces[1:-1], inner, strict=True) if ids is None} if None in inner else set()
            if len(pieces) == 1 or not cuts_words(pieces[0], new, pieces[-1]):
                found.append([part])
                fresh.add(part)
                continue
            fresh.update(" " + p for p in new)
            if None in inner:
                inner = [p if ids is None else ids for p, ids in zip(pieces[1:-1], inner, strict=True)]
            first, last = [pieces[0]] * bool(pieces[0]), " " + pieces[-1]
            fresh.update(first, [last])
            found.append([*first, inner, last])
        learnt = self.learn(fresh)
        out: list[list[bytes]] = [[] for _ in texts]
        for (n, _), plan in zip(parts, found, strict=True):
            for x in plan:
                if isinstance(x, list):
                    for p in x:
                        if isinstance(p, str) and len(p) <= MEMO_CHARS and p not in self.pieces:
                            ids = self.pieces[p] = learnt[" " + p]
                            self.held += ENTRY_BYTES + len(p) + len(ids)
                    out[n] += [learnt[" " + p] if isinstance(p, str) else p for p in x] if any(isinstance(p, str) for p in x) else x
                else:
                    out[n].append(learnt[x] if isinstance(x, str) else x)
        return [b"".join(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def cut_specials(text: str, special: dict[str, int]) -> list[str]:
    """The text cut at special strings, leftmost first, the longest at one place."""
    if not any(s in text for s in special):
        return [text] if text else []
    import re

    any_of = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    return [x for x in re.split(f"({any_of})", text) if x]


def cuts_words(first: str, inner: set[str], last: str) -> bool:
    """May a text be encoded piece by piece, cut before each single space? Not when a space
    touches other white space: then the pattern looks across the cut."""
    return (
        all(p and not p[0].isspace() and not p[-1].isspace() for p in inner)
        and not (first and first[-1].isspace()) and not (last and last[0].isspace())
    )


_LOADED: dict[str, BytePairs] = {}


def loaded(spec: str) -> BytePairs:
    """One encoder per Python worker and vocabulary; its memo serves the worker's later tasks."""
    digest = hashlib.sha256(spec.encode()).hexdigest()
    if digest not in _LOADED:
        _LOADED[digest] = BytePairs(spec)
    hold_memo("bpe", lambda: [b.forget() for b in _LOADED.values()])
    return _LOADED[digest]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec: str) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (array of int) of the column ``text``."""
    added = {"n_tokens": "long", "ids": "array<int>"}
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    at = kept(docs, added).index("text")

    def make():
        bpe = loaded(shared.value)

        def step(rows: pa.RecordBatch) -> list[pa.Array]:
            ids = bpe.encode([t or "" for t in rows.column(at).to_pylist()])
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return [*rows.columns, pa.array(sizes), pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4")))]

        return step

    return map_batches(docs, make, added)


def decode_documents(encoded: DataFrame, spec: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its column ``ids`` (null ids: empty)."""
    added = {"decoded": "string"}
    shared = encoded.sparkSession.sparkContext.broadcast(spec)
    at = kept(encoded, added).index("ids")

    def make():
        bpe = loaded(shared.value)
        return lambda rows: [*rows.columns, pa.array([bpe.decode(x or []) for x in rows.column(at).to_pylist()], pa.string())]

    return map_batches(encoded, make, added)


def round_trip_digests(docs: DataFrame, spec: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_tokens, and the SHA-256 of the ids and of the text
    decoded from them. Ids and texts stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for rows in batches:
            ids = bpe.encode([t or "" for t in rows.column(1).to_pylist()])
            texts = (bpe.decode(np.frombuffer(x, "<u4").tolist()).encode() for x in ids)
            yield batch(out, rows.column(0), [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x) for x in texts])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
