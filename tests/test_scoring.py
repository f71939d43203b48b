"""Comment scoring invariants and hand-computed values."""

import re
import time

from pyspark.sql import functions as F

from revkit.functions import scoring
from revkit.operators import reviews


def score(spark, msgs):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "review_id long, message string")
    return {r.review_id: r for r in reviews.score_comments(df).collect()}


def test_empty_comment(spark):
    r = score(spark, [""])[0]
    assert (r.thoroughness, r.clarity, r.actionability, r.overall) == (0.0, 0.0, 0.0, 0.0)
    assert r.recommendations == ["No review comment provided. Please add detailed comments about the code."]


def test_hand_computed(spark):
    # file refs: auth.js -> +10; code element 'function login' -> +5; terms: security -> +5
    r = score(spark, ["In auth.js the function login needs security"])[0]
    assert r.thoroughness == 50.0
    # paragraphs 1 -> 0.7; 'as' not present; readability 1.5 -> (0.7+1.5)/10*100
    assert abs(r.clarity - 22.0) < 1e-9
    # suggestion: none ('needs' is not 'need to'); all zero
    assert r.actionability == 0.0
    assert abs(r.overall - 36.0) < 1e-9


def test_bounds(spark):
    msgs = ["x", "TODO: fix\n- add tests\n- rename variable foo\n`a` ```b```" * 3, "word " * 40]
    for r in score(spark, msgs).values():
        assert 30 <= r.thoroughness <= 90
        assert 0 <= r.clarity <= 100 and 0 <= r.actionability <= 100
    assert score(spark, ["word " * 40])[0].overall == 30.0  # more than ten pieces -> floor 30


def test_aspect_list_untrimmed(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "consider this")], "review_id long, message string")
    out = reviews.score_comments(df, aspects=F.split(F.lit("Thoroughness, Actionability"), ",")).first()
    assert out.thoroughness == 30.0 and out.actionability == 0.0  # ' actionability' does not match


def test_long_names_and_sentences_are_read_once(spark):
    """a file mention is not sought from each character of a long name, and the
    words of a sentence are not collected; the counts are as before."""
    names = ["a.py.js", "/a.PY b\\c.jsx", ".py", "a..py", "x.pyy.js-a.go", "é.py _.ts", "K.ts ſ.GO", "a.javascript", "no"]
    words = ["w " * 25, "w " * 26, " w" * 26, "w\u00a0" * 25 + "w", "w\x0b\u3000" * 30, "\x1c" * 80, "é" * 60 + " é" * 25, "é" * 60 + " é" * 24, "a. b\n" * 30, "w " * 40 + "! " + "w " * 30]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(names + words)], "review_id long, message string")
    got = {r.review_id: r for r in reviews.comment_features(df).collect()}
    mention = re.compile(r"[/\\]?[A-Za-z0-9_\u017f\u212a-]+\.(py|js|go|java|cpp|ts|jsx|tsx)", re.I)
    for i, m in enumerate(names):
        assert got[i].file_refs == sum(1 for _ in mention.finditer(m)), m
    field = re.compile("[^\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    for i, m in enumerate(words, len(names)):
        assert got[i].long_sentences == sum(len(field.findall(s)) > 25 for s in re.split("[.!?]+[\t\n\f\r ]+|\n", m)), repr(m)
    feats = scoring.features(F.col("message"))
    plan = df.select(feats["long_sentences"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_count" not in plan
    started = time.time()
    long = spark.createDataFrame([("a" * 400_000 + ".py " + "é" * 400_000,)], "message string")
    assert long.select(feats["file_refs"].alias("f"), feats["long_sentences"].alias("s")).first() == (1, 0)
    long = spark.createDataFrame([("a" * 400_000,)], "message string")
    assert long.select(feats["file_refs"]).first()[0] == 0
    assert time.time() - started < 20
