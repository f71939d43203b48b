"""Best-fit decreasing: pieces against the library, places, padding, ties, cuts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from revkit.llm import decreasing


def check(out, texts, tokenizer, cap):
    """Every id of every document in one piece; sequences gapless, without padding."""
    library = Tokenizer.from_file(tokenizer)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = Counter((d, zlib.crc32(x.tobytes()), len(x)) for d, x in ((d, ids(t)) for d, t in texts))
    places, pieces = defaultdict(list), defaultdict(Counter)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    sizes = []
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= cap and (at == cap or at & (at - 1) == 0)
        sizes.append(at)
    assert sum(sizes) == sum(n * k for (_, _, n), k in want.items())
    for d in pieces:  # as many ids at every position as documents of that id have there
        rows = [ids(t) for e, t in texts if e == d]
        cover = Counter()
        for (start, length, crc, total), k in pieces[d].items():
            assert any(len(x) == total and zlib.crc32(x[start : start + length].tobytes()) == crc for x in rows)
            cover.update({(total, p): k for p in range(start, start + length)})
        expect = Counter()
        for x in rows:
            expect.update((len(x), p) for p in range(len(x)))
        assert cover == expect
    assert set(pieces) == {d for d, _ in texts}
    return sizes


@pytest.mark.parametrize("cap", [64, 4096])
def test_pack_docs(docs, none, tokenizer, cap):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    out = decreasing.pack_docs(docs, tokenizer, capacity=cap).collect()
    sizes = check(out, texts, tokenizer, cap)
    total = sum(sizes)
    assert sum(s == cap for s in sizes) == total // cap and len(sizes) == total // cap + bin(total % cap).count("1")
    assert decreasing.pack_docs(none, tokenizer).count() == 0


def test_several_tasks_and_no_broadcast(docs, tokenizer, monkeypatch):
    monkeypatch.setattr(decreasing, "BROADCAST_KEYS", 0)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = check(decreasing.pack_docs(docs, tokenizer, capacity=64, task_tokens=2000).collect(), texts, tokenizer, 64)
    assert len(sizes) > sum(sizes) // 64  # each task closes its own last window


def test_clashing_names_and_extra_columns(spark, tokenizer):
    rows = [(1, "a b c", 7, 8, 9, "x"), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, sequence_id long, offset long, length long, text_key string")
    out = decreasing.pack_docs(frame, tokenizer).collect()
    check(out, [(1, "a b c"), (None, None)], tokenizer, 4096)


def test_tightest_window():
    tree, rng = decreasing.CapacityTree(10), random.Random(3)
    have: list[tuple[int, int]] = []
    for k in range(3000):
        if rng.random() < 0.5:
            free = rng.randint(1, 10)
            tree.put(free, k)
            have.append((free, k))
        else:
            length = rng.randint(1, 10)
            best = min((f for f, _ in have if f >= length), default=None)
            got = tree.take(length)
            assert (got is None) == (best is None)
            if got:
                assert got[0] == best and got in have
                have.remove(got)


def test_rests_stay_whole_where_they_fit():
    got = list(decreasing.best_fit(iter([(0, 0, 7), (1, 0, 5), (2, 0, 5), (3, 0, 3), (4, 0, 2)]), 10))
    assert sorted(sorted(p[0] for p in s) for s in got) == [[0, 3], [1, 2], [4]]
    got = list(decreasing.best_fit(iter([(0, 0, 7), (1, 0, 7), (2, 0, 7)]), 10))  # nothing fits: one is cut for the others
    assert sorted(sum(p[2] for p in s) for s in got) == [1, 10, 10]
