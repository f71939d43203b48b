"""Quality rules, classifier, personal data, line dedup, license scan on edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revkit.llm import license_scan, line_dedup, pii, quality_classifier, quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, docs):
    more = [(1, " lead"), (2, "a b c d e f g h a b c d e f g h"), (3, "x " * 9), (4, "\n\n a \n a \n"), (5, "#|<> \x1c é\x85")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    )
    got = both.select("text", quality_rules.metrics(F.col("text")).alias("m")).collect()
    for r in got:
        assert (r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words) == counts(r.text), repr(r.text)[:80]


def test_binomial_tail(spark):
    for n, k, p in ((50, 0, 0.02), (400, 7, 0.01), (3000, 12, 0.004)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first().x
        assert got == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_rules_certify_and_limit_false_rejection(spark):
    good = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(30)), "en", 1) for i in range(4000)]
    bad = [(5000 + i, " ".join(f"w{(i * 17 + k * 5) % 997}###" for k in range(30)), "en", 0) for i in range(200)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string, quality int").repartition(8)
    labels = df.select("doc_id", "quality")
    out = {r.doc_id: r for r in quality_rules.judge(df.drop("quality"), labels).collect()}
    assert not any(out[i].kept for i, *_ in bad)
    assert sum(not out[i].kept for i, *_ in good) <= quality_rules.ALPHA * len(good)


def test_rules_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.kept == (not r.base_failed) == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality_rules.judge(none, labels).count() == quality_rules.keep_good(none, labels.limit(0)).count() == 0


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50
    right = sum(r.predicted == r.quality for r in out) / len(out)
    assert right >= 0.95 > sum(r.quality for r in out) / len(out)


def test_classifier_reads_no_held_out_label(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality_classifier.train(docs, labels) == quality_classifier.train(docs, turned)).all()


def test_classifier_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 19)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    w = quality_classifier.train(docs, labels)
    out = quality_classifier.score(docs, w).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if r.doc_id in (7, 8, 9)}) == 1
    assert quality_classifier.score(none, w).count() == 0
    assert not quality_classifier.train(none, labels.limit(0)).any()


BASE = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s, d: 13 <= len(d) <= 19 and pii.luhn(d)),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 9 <= len(d) <= 15),
)


def brute_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


def test_pii_base_patterns():
    rng = random.Random(3)
    for _ in range(20000):
        parts = ["ab@.", "0123456789", "0123456789 -", "+0 (1.)2-3", "@a.b_c-", "1.2.3.45"]
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text), repr(text)


def test_pii_is_linear():
    for text in ("a" * 200000 + "@", "1." * 100000, "1" * 200000, "+1" + " " * 200000, "@" * 200000, "1 " * 100000):
        pii.base_spans(text)
        for s in pii.proposals(text)[:50]:
            pii.features(text, s)


def test_pii_query_and_redaction(spark, docs, none):
    more = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    detector = pii.train(more)
    for r in pii.detect(more, detector).join(more, "doc_id").collect():
        want = brute_spans(r.text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.shown(want).encode()).hexdigest()
        assert set(pii.shown(want).split(",")) <= set(r.spans.split(","))
    out = pii.redact(docs, detector)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 8").first().text is None
    assert out.where("doc_id = 18").first().text == "mail [EMAIL] or [IP], [PHONE] and [CARD]"
    assert pii.detect(none, pii.train(none)).count() == pii.redact(none, detector).count() == 0


def test_pii_model_adds_other_forms():
    """Trained on enough examples, the model takes forms that the base patterns miss."""
    import numpy as np

    from revkit.llm import boosting

    rng = random.Random(5)
    rows = []
    for i in range(1500):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        rows += pii.examples(f"some words here {card} and there, a.b{i}@mail{i % 9}.example.com then", i)
    x, y = np.array([r[1] for r in rows], float), np.array([r[0] for r in rows], float)
    half = np.arange(len(x)) % 2 == 0
    model = boosting.fit(x[half], y[half])
    score = model.score(x[~half])
    kind = x[~half][:, 0]
    limits = [pii._threshold(score[kind == k], y[~half][kind == k]) for k in range(4)]
    spans = pii.Detector(model, limits).spans(["pay with 4111.1111.1111.1111 now", "pay with 4111.1111.1111.1112 now", "plain 2024 text 12 34"])
    assert [a for _, a in spans] == [[(2, 9, 28)], [], []]


def test_line_dedup_edge_cases(spark):
    page = lambda *lines: "<html><script>var t='</p>';</script><nav>" + "".join(f"<p>{x}</p>" for x in lines) + "</nav></html>"
    rows = [(i, f"https://User@A.example:8080/{i}", page("menu", f"body {i}", "menu")) for i in range(6)]
    rows += [(10, "http://b.example/", page("menu", "x")), (11, None, page("menu")), (12, "no url", page("menu")), (13, "http://a.example", None), (None, "http://a.example/9", ""), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert (got[3].host, got[3].n_lines, got[3].n_dropped, got[3].text) == ("a.example", 3, 2, "body 3")
    assert got[10].text == "menu\nx" and got[11].host is None and got[11].text == got[12].text == "menu" and got[13].text == got[None].text == ""
    assert line_dedup.dedup_lines(df).count() == len(rows) and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_license_scan_edge_cases(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "r", "LICENSE", mit), (2, "r", "a/b/c.txt", "plain words"), (3, "r", "a/LICENSE.txt", f"intro\n{gpl}\nmore"), (4, "r", "x.txt", None), (5, "r", "a/b/d.txt", f"text\n {mit.upper()} \n"),
        (6, "s", "a/q.txt", "nothing"), (7, None, "LICENSE", mit), (8, None, "k.txt", ""), (9, "r", None, "words"), (2, "r", "a/b/c.txt", "plain words"), (10, "r", "b/LICENSE", "no such text"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, repo string, path string, text string")
    got = {r.doc_id: (r.license, r.how, r.from_dir) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", ""), 2: ("GPL-3.0", "inherited", "a"), 3: ("GPL-3.0", "own", "a"), 4: ("MIT", "inherited", ""), 5: ("MIT", "own", "a/b"),
        6: (None, None, None), 7: ("MIT", "own", ""), 8: ("MIT", "inherited", ""), 9: (None, None, None), 10: ("MIT", "inherited", ""),
    }
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0
