import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import awkward, documents, empty, sha

from lexivec.llm import tokenizer_alignment as T
from lexivec.llm.bpe import byte_letters, read_spec
from lexivec.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def files():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return read_spec(tokenizer_path("byte_bpe_50k.json")), f.read()


def tokens(files, texts):
    """(ids and bytes of A, of B) of every whole text, from the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letters = byte_letters()
    for t in texts:
        e = a.encode(" " + t, add_special_tokens=False)
        of_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in e.ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
        yield of_a, of_b


def brute(files, texts):
    """The contract by bytes: groups between common ends, all pairs of a group, counts over all."""
    per_text = []
    for t, (of_a, of_b) in zip(texts, tokens(files, [t or "" for t in texts]), strict=True):
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in of_a) != whole or b"".join(x for _, x in of_b) != whole:
            per_text.append(None)
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (of_a, of_b)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in common]
        for side in (0, 1):
            for (i, _), end in zip((of_a, of_b)[side], ends[side], strict=True):
                groups[next(n for n, c in enumerate(common) if end <= c)][side].append(i)
        per_text.append((len(of_a), len(of_b), groups))
    count = Counter()
    links = [[] if x is None else [(i, j) for a, b in x[2] for i in a for j in b] for x in per_text]
    for own in links:
        count.update(set(own))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for x, own in zip(per_text, links, strict=True):
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x[2])
        out.append((x[0], x[1], len(x[2]), len(own), sum(count[p] == most[p[0]] for p in own), sum(count[p] for p in own), sha(text)))
    return out


def texts(n, seed):
    rng = random.Random(seed)
    pieces = [
        "the", "The", "running", "ünïcödé", "日本語", "𝒳𝒴", "🙂👍🏽", "é", "a\nb", "\n\n", "\t", " ", "  ", "   ", "x  y", "don't", "<s>", "<|endoftext|>",
        "<0x41>", "0123456789", "$$$", "ﬁ", "Ω", " ", "　", "\x00", "\x1c", "\x85", ".", ",", "…", "ß|ß", "ab\r\ncd", "क्षि", "́",
    ]
    return ["".join(rng.choice(pieces) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


AWKWARD_TEXTS = [None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "a ▁b", "x▁y", "a" * 3000, "日" * 2000, "🙂" * 500, "=" * 999, " " * 77]


@pytest.mark.parametrize("most", [500_000, 40, 0])
def test_equals_alignment_by_bytes(spark, files, most):
    data = AWKWARD_TEXTS + texts(300, most)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in T.alignment_of_documents(documents(spark, data).repartition(5), *files, most).collect()}
    want = brute(files, data)
    assert [got[i] for i in range(len(data))] == want


def test_memo_changes_nothing(files, monkeypatch):
    monkeypatch.setattr(T, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(T, "MEMO_PIECE", 4)
    aligner = T.Aligner(*files)
    data = texts(200, 9)
    for _ in range(2):
        for start in range(0, len(data), 20):
            part = data[start : start + 20]
            for t, x in zip(part, aligner.documents(part), strict=True):
                (y,) = T.Aligner.documents(fresh := aligner, [t])
                assert fresh and x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()
    assert aligner.held < 3 * 20_000


def test_spans_only_cut_where_a_character_is_whole():
    # a character of four bytes over three tokens, then one of one byte
    assert T.byte_ends([(0, 4), (0, 4), (0, 4), (4, 5)], [b"12", b"3", b"4", b"x"]) == [2, 3, 4, 5]
    # byte-fallback pieces: empty spans until the last
    assert T.byte_ends([(0, 1), (1, 1), (1, 1), (1, 4)], [b" ", b"1", b"2", b"3"]) == [1, 2, 3, 4]
    assert T.byte_ends([(0, 2), (2, 3)], [b"abc", b""]) is None


def test_awkward_rows_and_other_tokenizers(spark, files):
    rows = T.alignment_of_documents(awkward(spark, ["row", "pairs", "n_a"]), *files).collect()
    assert len(rows) == 10 and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_a, by[1].groups_sha256, by[2].n_links) == (0, "", 0) and by[6].n_groups > 50_000
    assert T.alignment_of_documents(empty(spark), *files).collect() == []
    with pytest.raises(ValueError):
        T.Aligner(read_spec(tokenizer_path("word_bpe_49k.json")), files[1])
