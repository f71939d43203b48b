"""What the personal-data detector is trained and calibrated on."""

import random

from revkit.llm import pii


def number(rng, ok=True):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    last = next(c for c in "0123456789" if pii.luhn(head + c))
    return head + (last if ok else str((int(last) + 3) % 10))


def test_calibration_reads_all_documents(spark, monkeypatch):
    """Neither the first rows nor one page of very many spans fill the sample."""
    rng = random.Random(11)
    page = (0, "\n".join(f"entry {number(rng)} ." for _ in range(600)))
    rest = [(1 + i, f"write to n{i}.x@host{i % 7}.example.com or {rng.randrange(10, 250)}.{rng.randrange(250)}.{rng.randrange(250)}.7 now") for i in range(1500)]
    docs = spark.createDataFrame([page, *rest], "doc_id long, text string").coalesce(1)
    detector = pii.train(docs, sample_spans=2000)
    assert detector.model is not None
    spans = detector.spans(["write to jane.doe [at] host2 [dot] example [dot] com now"])
    assert detector.thresholds[0] <= 1 and [s[0] for s in spans[0][1]] == [0]


def test_draw_does_not_depend_on_the_order(spark):
    rng = random.Random(12)
    rows = [(i, f"pay {number(rng)} or write a{i}@b{i % 5}.example.org, +49 30 {rng.randrange(10**6, 10**7)} x") for i in range(900)]
    both = [pii.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), sample_spans=1500) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert both[0].thresholds == both[1].thresholds and both[0].model.start == both[1].model.start
    assert all((a == b).all() for t, u in zip(both[0].model.trees, both[1].model.trees, strict=True) for a, b in zip(t, u, strict=True))


def test_hidden_personal_data_is_no_negative():
    """Only what cannot be personal data is a negative of its own."""
    hidden = [
        ("ask jane (at) host dot org now", 0, "jane (at) host dot org"), ("ask a.b [at] c.d [dot] com.", 0, "a.b [at] c.d [dot] com"), ("host 10-20-30-40 is up", 1, "10-20-30-40"),
        ("pay 4111.1111.1111.1111 now", 2, "4111.1111.1111.1111"), ("call 0049 30 12345 67 now", 3, "0049 30 12345 67"),
    ]
    for text, kind, body in hidden:
        assert any(k == kind and body in text[lo:hi] for k, lo, hi in pii.proposals(text)), text
        assert not any(x[0] == kind and x[1] >= len(body) for _, x in pii.examples(text, 1)), text
    for text in ("look at that. Then go", "pay 4111.1111.1111.1112 now", "on 2024-01-02 10 we", "runs 10-20-30-400 on", "at 10:20:30:40 we", "in 2001 11 12"):
        assert pii.proposals(text), text
        assert [y for y, _ in pii.examples(text, 1)].count(0) >= 1, text


def test_hidden_personal_data_does_not_switch_the_detector_off(spark):
    """Every third text has a dotted card of its own: the kind's threshold stays usable."""
    rng = random.Random(13)
    dotted = lambda n: ".".join(n[i : i + 4] for i in range(0, 16, 4))
    rows = [(i, f"some words {number(rng) if i % 3 else dotted(number(rng))} and then {number(rng, False)} there") for i in range(1500)]
    detector = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [a for _, a in detector.spans(["pay with 4111.1111.1111.1111 now", "pay with 4111.1111.1111.1112 now"])] == [[(2, 9, 28)], []]
