"""Cross-tokenizer alignment against the libraries and a plain merge."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from revkit.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Tokens by the libraries; groups by sets of ends."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        to_byte = {c: b for b, c in enumerate(alignment.byte_chars())}
        self.bytes_a = lambda i: bytes(to_byte[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def groups(self, text):
        """[(ids of A, ids of B)] between the cuts."""
        if not text:
            return []
        want = (" " + text).encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        at_a, at_b = [self.bytes_a(i) for i in a], [self.bytes_b(i) for i in b]
        if b"".join(at_a) != want or b"".join(at_b) != want:
            return []
        ends = lambda parts: list(accumulate(map(len, parts)))
        ends_a, ends_b = ends(at_a), ends(at_b)
        out, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            out.append((a[i:p], b[j:q]))
            i, j = p, q
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def expected(plain, texts):
    groups = [plain.groups(t) for t in texts]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return out


def random_texts():
    rng = random.Random(11)
    letters = "abcdefghij klmnopqrstuvwxyz ABCÉß ñ'\"<|>.,!? ▁　\u0085日本😀\xa0 \n\t\r0123456789ﬁ①́\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    texts += [" ".join(rng.choice(["the", "quick", "internationalization", "tokenizers", "über", "naïve", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return texts + ["<|endoftext|> a <s> b </s> <unk>", "a" * 3000, " " * 2500 + "x", "\n", " ", "<0x41>", "x" * 999 + " " + "y" * 1000]


def test_query(spark, docs, none, plain):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(500 + k, t) for k, t in enumerate(random_texts())]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, alignment.digest_docs(frame, PATH_A, PATH_B).collect()))
    want = Counter((d, *x) for (d, _), x in zip(rows, expected(plain, [t for _, t in rows]), strict=True))
    assert got == want
    assert alignment.digest_docs(none, PATH_A, PATH_B).count() == 0


def test_many_blocks_and_only_empty_texts(spark, docs, plain, monkeypatch):
    one = sorted(map(repr, alignment.digest_docs(docs, PATH_A, PATH_B).collect()))
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 3)
    monkeypatch.setattr(alignment, "BATCH", 200)
    assert sorted(map(repr, alignment.digest_docs(docs, PATH_A, PATH_B).collect())) == one
    blank = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "a▁b", 3)], "doc_id long, text string, block long")
    assert {tuple(r) for r in alignment.digest_docs(blank, PATH_A, PATH_B).collect()} == {(d, 0, 0, 0, 0, 0, 0, "") for d in (1, None, 2)}


def test_align_docs(spark, plain):
    text = "Tokenizers: internationalization of 日本 naïveté"
    r = alignment.align_docs(spark.createDataFrame([(7, text, 0)], "doc_id int, text string, pairs int"), PATH_A, PATH_B).first()
    groups = plain.groups(text)
    assert r.a_ids == [i for a, _ in groups for i in a] and r.b_ids == [i for _, b in groups for i in b]
    assert [(r.a_ids[x], r.b_ids[y]) for x, y in zip(r.link_a, r.link_b, strict=True)] == [(a[-1], b[-1]) for a, b in groups]
    upto = [sum(len(plain.bytes_a(i)) for a, _ in groups[: k + 1] for i in a) for k in range(len(groups))]
    assert r.cuts == upto


def test_lockstep_lanes():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(1, 400, rng.integers(0, 200)))
        b = np.unique(rng.integers(1, 400, rng.integers(0, 200)))
        marks = np.unique(np.concatenate([[0, 400], rng.integers(0, 400, rng.integers(0, 30))]))
        x, y = alignment.lockstep(a, b, marks)
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_both_encoders_agree():
    """The plain form's encoder and the file's library, on every code point under U+3000."""
    side = alignment.ByteSide(alignment.read_spec(PATH_A))
    texts = [f"{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} {chr(c)}'s \n{chr(c)}" for c in range(0x3000)]
    assert side.fast is not None
    fast = side.ids(texts)
    side.fast = None
    assert side.ids(texts) == fast


def test_words_are_their_own(plain):
    """Ids of a text are those of its words, for spaces and white space of all kinds."""
    words = alignment.Words(alignment.ByteSide(alignment.read_spec(PATH_A)), alignment.PieceSide(alignment.read_model(PATH_B)))
    assert words.split
    assert alignment.words_of("a b\nc d") == ["a", "b\nc", "d"] and alignment.words_of("a  b \n c d\xa0 e") == ["a  b \n c", "d\xa0 e"]
    words.MEMORY = 300  # forgets between batches
    rng = random.Random(4)
    gaps = [" ", " ", " ", "  ", "   ", "\n", " \n ", "\t ", "\x1c", " \x1f ", "\x85 ", " \xa0 ", "\u3000", " \u2028 ", ""]
    some = ["don't", "I'll", "x", "12", "Zürich", "日本", "-", "...", "'s", "▁", "<s>", "é", "\u0301", "😀"]
    texts = ["".join(rng.choice(some) + rng.choice(gaps) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    for lo in range(0, len(texts), 400):
        part = texts[lo : lo + 400]
        (a, at_a), (b, at_b) = words.encode(part)
        for i, t in enumerate(part):
            assert a[at_a[i] : at_a[i + 1]].tolist() == plain.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
            assert b[at_b[i] : at_b[i + 1]].tolist() == plain.b.encode(t), repr(t)
