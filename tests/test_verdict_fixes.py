"""Fixes of wrong answers: each case failed before its fix."""

from helpers import files_df, run
from pyspark.sql import functions as F

from revkit.functions.paths import path_escape
from revkit.operators import golang, metrics, php
from revkit.operators import requests as R
from revkit.operators.findings import prepare, regex_rule, run_rules


def test_php_anchor_on_a_later_line(spark):
    files = files_df(spark, [("a.php", "<html>\n<?php\n"), ("b.php", "<?php\n")])
    got = {(r.path, r.line) for r in php.issue_rows(files).where("type = 'MISSING_NAMESPACE'").collect()}
    assert got == {("a.php", 2), ("b.php", 1)}


def test_rules_that_share_an_id_stay_apart(spark):
    rows = [("a.py", "foo\nbar\n")]
    first = run(spark, [regex_rule("U1", "foo", "saw foo")], rows)
    second = run(spark, [regex_rule("U1", "bar", "saw bar")], rows)
    assert [x[3] for x in first] == ["a.py:1: saw foo"] and [x[3] for x in second] == ["a.py:2: saw bar"]


def test_settings(spark):
    schema = "channel_id string, message string, settings array<struct<label:string,type:string,description:string,`default`:string,value:string,required:boolean,options:array<string>>>"
    item = lambda label, default: (label, "t", "d", default, None, False, None)
    thr = "minimum_quality_threshold"
    rows = [
        ("a", "m", [item(thr, "85"), item(thr, "abc")]), ("b", "m", [item(thr, " 85 ")]), ("c", "m", [item(thr, "70d")]), ("d", "m", [item(thr, "1e2")]),
        ("e", "m", [item("include_recommendations", None), item("code_source", None)]), ("f", "m", []),
    ]
    got = {r.channel_id: r for r in R.resolve_settings(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k].threshold for k in "abcd"] == [85.0, 70.0, 70.0, 100.0]
    assert (got["e"].include_recommendations, got["e"].code_source) == (False, "")
    assert (got["f"].include_recommendations, got["f"].code_source) == (True, "github")


def test_path_escape(spark):
    out = spark.range(1).select(path_escape(F.lit("src/@scope/a+b~c d*.ts")).alias("x")).first().x
    assert out == "src%2F@scope%2Fa+b~c%20d%2A.ts"


def test_report_headers_follow_what_there_is(spark):
    schema = "repo string, path string, recommendations array<string>, error string"
    recs = spark.createDataFrame([("r1", "a.py", ["x", "y"], None), ("r1", "z.py", [], "boom"), ("r2", "b.py", [], "boom")], schema)
    repos = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo string")
    text = {r.repo: r.report for r in metrics.report_text(metrics.report_sections(recs, repos)).collect()}
    head = "## Code Analysis Results\n\n"
    assert text["r1"] == head + "### Analyzed Files:\n- a.py\n\n### Recommendations:\n## a.py\n\n- x\n- y\n## z.py\n- Error during analysis: boom\n"
    assert text["r2"] == head + "### Recommendations:\n## b.py\n- Error during analysis: boom\n"
    assert text["r3"] == head + "No issues found in the analyzed files.\n"


def test_go_signatures_over_lines_and_generic(spark):
    text = "// Package a docs\npackage a\n\nfunc Load(\n\ta int,\n\tb string,\n) (n int, err error) {\n\treturn\n}\n\nfunc Map[T any](x []T) {\n}\n"
    msgs = [x[3] for x in run(spark, golang.rules(), [("a.go", text)])]
    assert any("'Load' lacks documentation" in m for m in msgs) and any("'Map' lacks documentation" in m for m in msgs)
    assert any(":8: Naked return in function 'Load'" in m for m in msgs)


def test_go_checks_read_the_code_column_once(spark):
    files, ctx = prepare(files_df(spark, [("a.go", "package a\n")]), golang.rules())
    plan = files.select("go_checks")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(_lines#") == 1  # the code of the lines: a column, or inside the one expression that reads it
    assert run_rules(files_df(spark, [("a.go", "package a\n")]), golang.rules()).count() == 1


def test_rules_keep_their_own_prepared_columns(spark):
    from revkit.operators.findings import Rule, batch_rule, finding

    def rule(rule_id, word):
        hits = lambda c: F.filter(F.transform(c.lines, lambda l, i: F.when(F.contains(l, F.lit(word)), i + 1)), lambda x: x.isNotNull())
        last = lambda c: F.element_at(c.extra["hits"], -1)
        build = lambda c: F.array(finding(c.extra["last"], F.concat(F.lit(word), F.lit(" "), F.size(c.extra["hits"]).cast("string"))))
        return Rule(rule_id, build, prep=(("hits", hits), ("last", last)))

    rows = [("a.py", "foo\nbar\nfoo bar\nbar\n")]
    for pair in ([rule("U1", "foo"), rule("U2", "bar")], [rule("U2", "bar"), rule("U1", "foo")]):  # either may come first
        assert {(x[1], x[2], x[3]) for x in run(spark, pair, rows)} == {("U1", 3, "foo 2"), ("U2", 4, "bar 3")}

    def find(files):
        import pandas as pd

        return pd.DataFrame([(r.repo, r.path, r.lang, n, 0, "x") for r in files.itertuples() for n in (1, 2) if r.path == "a.py"], columns=["repo", "path", "lang", "line", "col", "msg"])

    found = batch_rule(files_df(spark, [*rows, ("b.py", "")]), "U3", find)
    own = run_rules(files_df(spark, rows), [rule("U1", "foo")])
    assert [(r.path, r.rule_id, r.occ, r.line) for r in own.unionByName(found).orderBy("rule_id", "occ").collect()] == [("a.py", "U1", 1, 3), ("a.py", "U3", 1, 1), ("a.py", "U3", 2, 2)]
