"""Page scans are linear and equal to the patterns; overlaps of spans are exact; what is calibrated and drawn."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from revkit.llm import line_dedup, pii, quality_classifier


def by_patterns(html):
    text = re.sub(line_dedup.DROPPED, "", html, flags=re.I | re.A)
    lines = [re.sub(line_dedup.TAGS, "", x).strip(" \t\n\x0b\x0c\r") for x in re.split(line_dedup.BREAKS, text, flags=re.I | re.A)]
    return [x for x in lines if x]


def test_page_lines_equal_the_patterns():
    rng = random.Random(7)
    parts = ["<!--", "-->", "<script", "<SCRIPT a>", "</script>", "</Script >", "<style>", "</style>", "<p>", "</P>", "<br", ">", "<", "a", "b c", "\n", " ", "<b>", "</b>", "<td x='1'>", "<scripts>", "é", "<!-", "--", "</li"]
    for _ in range(4000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert line_dedup.lines_of(html) == by_patterns(html), html
    assert line_dedup.lines_of(None) == []


def test_unclosed_openings_are_linear():
    for opening in ("<!-- ", "<script>", "<style ", "<", "<p ", "<b"):
        begin = time.perf_counter()
        line_dedup.lines_of(opening * 100_000)
        assert time.perf_counter() - begin < 2


def test_spans_inside_a_long_span_are_not_free():
    text = "write " + "1.2.3.4_" * 14 + "00491234567x@mail.example.com"
    base = pii.base_spans(text)
    taken = pii._Taken(base)
    for lo, hi in [(lo, hi) for _, lo, hi in base]:
        assert not taken.free((0, lo, lo + 1)) and not taken.free((0, hi - 1, hi))
    assert not taken.free((0, 118, 129)) and taken.free((0, 0, 6)) and taken.free((0, len(text), len(text) + 1))
    spans, held = [], pii._Taken([])
    rng = random.Random(3)
    for _ in range(500):
        lo = rng.randrange(1000)
        span = (0, lo, lo + rng.randint(1, 40))
        free = all(span[2] <= a or b <= span[1] for _, a, b in spans)
        assert held.free(span) == free
        if free:
            held.add(span)
            spans.append(span)


def test_prose_without_digits_is_calibrated(spark, monkeypatch):
    """Proposals of texts without an address sign or digits count as negatives."""
    some = [(i, f"mail user{i}@example{i}.com or +49 30 12345{i % 10}7 now") for i in range(60)]
    prose = [(1000 + i, f"we met at dawn dot and then at noon dot by river{i} lane dot com") for i in range(200)]
    seen = {}
    real = pii._lowest
    monkeypatch.setattr(pii, "_lowest", lambda counts: seen.update({len(seen): int(counts[:, 0].sum())}) or real(counts))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    pii.train(docs(some))
    few = sum(seen.values())
    seen.clear()
    pii.train(docs(some + prose))
    assert any(pii.proposals(t) for _, t in prose) and sum(seen.values()) > few


def test_sample_does_not_follow_the_partitions(spark):
    rows = [(i, ("good plain words here " if i % 2 else "spam spam buy now ") * 5 + str(i)) for i in range(300)]
    docs = spark.createDataFrame(rows + [(7, "another text of seven")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    one = quality_classifier.train(docs.coalesce(1), labels, sample=100)
    two = quality_classifier.train(docs.repartition(7, F.xxhash64("text")), labels.repartition(5), sample=100)
    assert np.allclose(one, two) and np.abs(one).sum() > 0
