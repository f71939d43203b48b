"""BPE, packing, LM scores against the library, exact placement and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from revkit.llm import bpe, lm_scoring, packing


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_random_texts(tokenizer, library):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉÈéß ñ'\"<|>.,!?-_0123456789²½İΣς́ẞ日本😀\xa0\x85\x1c \n\t’ªſK"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("the aineo") for _ in range(rng.randint(1, 300))) for _ in range(500)]
    texts += ["a" * 5000, "ab" * 700 + "'" * 90, "don't I'M we'LL x'sam .'s '' ''s", None, "", " \n"]
    enc = bpe.Encoder(bpe.read_spec(tokenizer))
    enc.MEMORY = 500  # forgets words between batches
    got = [x for k in range(0, len(texts), 700) for x in enc.encode(texts[k : k + 700])]
    for t, x in zip(texts, got, strict=True):
        want = ids_of(library, t)
        assert x.tolist() == want, repr(t)
        assert enc.decode(x) == library.decode(want, skip_special_tokens=False)


def test_bpe_verdicts_are_exact(tokenizer):
    """A proposal whose adjacent pairs are all compatible is the merged result, any other is not."""
    enc = bpe.Encoder(bpe.read_spec(tokenizer))
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))).encode()
        data, one = np.frombuffer(word, np.uint8), np.array([0])
        _, guess = enc.propose(data, one, np.array([len(word)]))
        exact = enc.merge_long(word)
        assert enc.merge_exactly(data, one, np.array([len(word)]))[1].tolist() == exact
        assert enc.compatible(guess[:-1], guess[1:]).all() == (guess.tolist() == exact)


def test_bpe_query(docs, none, tokenizer, library):
    got = Counter(map(tuple, bpe.digest_docs(docs, tokenizer).collect()))
    want = Counter()
    for r in docs.collect():
        ids = ids_of(library, r.text)
        back = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digest_docs(none, tokenizer).count() == 0
    full = bpe.encode_docs(docs, tokenizer, decoded=True).where("doc_id = 18").first()
    assert full.ids == ids_of(library, docs.where("doc_id = 18").first().text) and "example</w>" in full.decoded


def test_packing(docs, none, tokenizer, library):
    cap = 256
    out = packing.pack_docs(docs, tokenizer, capacity=cap, open_bins=8).collect()
    want = Counter()
    total = 0
    for r in docs.collect():
        ids = np.array([*ids_of(library, r.text), 1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), cap)):
            part = ids[at : at + cap]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= cap
    assert len(places) <= math.ceil(total / cap) + 8
    assert packing.pack_docs(none, tokenizer).count() == 0


def test_open_bins_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(3) == (1, 7)  # fits both; the fuller one takes it
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # no place fits: sequence 2, the fullest, closes
    assert bins.place(2) == (0, 6)


def test_lm_scores(docs, none):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = [(r.doc_id, word.findall(r.text or "")) for r in docs.collect()]
    counts, total = Counter(), sum(len(w) for _, w in texts)
    for _, w in texts:
        for k in (1, 2, 3):
            counts.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    def score(w, i):
        back = 0.0
        for k in range(min(3, i + 1), 1, -1):
            g = tuple(w[i - k + 1 : i + 1])
            if counts[g] >= 2:
                return back + math.log(counts[g] / counts[g[:-1]])
            back += math.log(0.4)
        return back + math.log(counts[w[i],] / total)

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words), r.log_score, r.mean_log_score) for r in lm_scoring.score(docs).collect())
    want = sorted(((i is None, i or 0, len(w)), sum(score(w, k) for k in range(len(w)))) for i, w in texts)
    assert [g[0] for g in got] == [w[0] for w in want]
    for (key, log, mean), (_, expect) in zip(got, want, strict=True):
        assert log == pytest.approx(expect, rel=1e-9, abs=1e-9)
        assert mean is None if not key[2] else mean == pytest.approx(expect / key[2])
    assert lm_scoring.score(none).count() == 0


def test_lm_many_blocks_and_parts(docs, monkeypatch):
    one = sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm_scoring.score(docs).collect())))
    monkeypatch.setattr(lm_scoring, "PART_WORDS", 500)
    many = sorted(map(repr, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm_scoring.score(docs.repartition(5)).collect())))
    assert one == many
