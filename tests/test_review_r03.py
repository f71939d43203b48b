"""Fixes of the third review: cost of the rules and of the streams, same results."""

import re

import pytest
from helpers import files_df, run
from pyspark.sql import functions as F

from revkit import rx
from revkit.functions import text as T
from revkit.operators import java as J
from revkit.operators import php as G
from revkit.operators import python as H
from revkit.plans import extra_queries as X
from revkit.plans import stream_queries as S


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_micro_batch_holds_bytes_not_files(spark, monkeypatch):
    """F1, F2: the number of micro-batches does not follow the number of files."""
    started = []
    start = S.P.start
    monkeypatch.setattr(S.P, "start", lambda *a, **k: started.append(start(*a, **k)) or started[-1])
    derived = S.tables.source_files_raw
    monkeypatch.setattr(S.tables, "source_files_raw", lambda *a: derived(*a).limit(12).repartition(6))
    found = S._stream_findings(spark, "/root/testdata/sf0.001")
    assert found.count() > 0
    assert len([p for p in started[0].recentProgress if p.numInputRows]) == 1


@pytest.mark.parametrize("query", [S.q_stream_scores, S.q_stream_dedup])
def test_comment_streams_take_many_files_at_once(spark, monkeypatch, query):
    """As many micro-batches as the bytes need."""
    started = []
    start = S.P.start
    monkeypatch.setattr(S.P, "start", lambda *a, **k: started.append(start(*a, **k)) or started[-1])
    query(spark, "/root/testdata/sf0.001").count()
    assert len([p for p in started[0].recentProgress if p.numInputRows]) == 1


def test_history_append_scores_once(spark, monkeypatch):
    """the batches read scores that are there, not the scoring expressions."""
    plans = []
    append = X.L.HistoryTable.append
    monkeypatch.setattr(X.L.HistoryTable, "append", lambda self, rows, n: plans.append(_plan(rows)) or append(self, rows, n))
    X.q_history_append(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("regexp" in p.lower() or "parquet" in p.lower() for p in plans)


def test_php_issues_are_computed_once(spark):
    """no filter repeats the checks to test the size of their result."""
    files = files_df(spark, [("a.php", "<?php\nmd5($x);\n"), ("b.php", "plain")])
    rows = G.issue_rows(files)
    plan = _plan(rows)
    assert "size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)
    assert [(r.path, r.type, r.line) for r in rows.orderBy("path", "ord").collect()] == [("a.php", "PASSWORD_HASH", 2), ("a.php", "MISSING_NAMESPACE", 1)]


def test_boundary_before_a_word_is_one_look_behind():
    """And stays a full boundary where the next character may be another one."""
    assert rx.java(r"\b(eval|assert)\s*\(").startswith("(?d)(?<![A-Za-z0-9_])(eval")
    assert rx.java(r"\b[a-z_]+\b").startswith("(?d)(?<![A-Za-z0-9_])[a-z_]+")
    for pattern in (r"\bx?a", r"\b(a|)b", r"\ba|==", r"(?i)\bs", r"\b[^a]"):
        assert "(?<=" in rx.java(pattern)


def test_boundary_matches_like_before(spark):
    for pattern, text in ((r"\b\d+\b", "12a 3 b4 5_ _6 é7 8"), (r"\b(eval|assert)\s*\(", "eval( xeval( _assert( é(assert ( éeval("), (r"\b[a-z_]+\b", "a B cD é_x 1a z")):
        want = [m.group() for m in re.finditer(pattern, text, re.A)]
        got = spark.createDataFrame([(text,)], "s string").select(T.extract_all(F.col("s"), pattern)).first()[0]
        assert got == want


def test_spaces_of_go_are_trimmed_at_both_ends(spark):
    text = " \x85\xa0 \t x　y  \x0b"
    df = spark.createDataFrame([(text,), (" \t",), ("",)], "s string").select(H.trim_space(F.col("s")).alias("t"), T.indent_width(F.col("s")).alias("i"))
    assert [tuple(r) for r in df.collect()] == [("x　y", 0), ("", 2), ("", 0)]
    assert set(H._SPACES) == {chr(i) for i in range(0x3001) if chr(i).isspace() and i not in range(0x1C, 0x20)}


def test_long_methods_and_empty_blocks_behind_their_guards(spark):
    body = "  a();\n" * 51
    rules = [r for r in J.rules() if r.rule_id in ("F2", "F13")]
    rows = [("A.java", "class A {\n  public void big(int a)\n  {" + body + "}\n}\n"), ("B.java", "x void m() { if (a) { }\n}\n"), ("C.java", "x void m() { for (;;) y(); }\n")]
    got = [(p, r, ln) for p, r, ln, _ in run(spark, rules, rows)]
    assert ("B.java", "F2", 1) in got and not [g for g in got if g[0] == "C.java"]
    assert [g for g in got if g[1] == "F13"] == [("A.java", "F13", 2)]


def test_quotes_are_counted_once_a_line(spark):
    lines = ["a = 'x' + \"it's\" ", "\"'", "none", "''\"\"'"]
    got = spark.createDataFrame([(x,) for x in lines], "s string").select(H._quote_counts(F.col("s")).alias("c")).collect()
    assert [(r.c.s, r.c.d) for r in got] == [(2, 2), (0, 1), (0, 0), (3, 2)]
    plan = _plan(spark.createDataFrame([("x",)], "s string").select(H._quote_counts(F.col("s"))))
    assert plan.count("regexp_replace") <= 2
