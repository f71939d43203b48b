"""Aspect bundles (D), sibling-test join (D3/M1) and PHP rendering."""

import json

from helpers import files_df

from revkit.operators import php as G
from revkit.operators.analyze import analyze


def test_sibling_test_file_suppresses_d3(spark):
    files = files_df(spark, [("src/a.py", "x = 1\n"), ("src/a_test.py", "x = 2\n"), ("src/b.py", "y = 1\n"), ("src/C.java", "int z;\n")])
    got = {r.path for r in analyze(files, langs=()).where("rule_id = 'D3'").collect()}
    assert got == {"src/b.py", "src/C.java"}  # a.py has a sibling; a_test.py contains 'test'


def test_php_render_groups_and_summarises(spark):
    content = "<?php\n" + "".join(f"md5($a{i});\n" for i in range(5)) + "echo $_GET['q'];\n"
    files = files_df(spark, [("x/Admin.php", content)])
    recs = [r.msg for r in analyze(files, langs=("php",), with_aspects=False).orderBy("occ").collect()]
    assert recs[0] == "--- CRITICAL Issues (1) ---"
    assert recs[1].startswith("XSS [L7:C1]: Potential XSS vulnerability. Sanitize user input before output\nCode context:\n")
    assert recs[2] == "--- HIGH Issues (5) ---"
    assert recs[3] == ("PASSWORD_HASH: Weak hashing algorithm. Use password_hash() for passwords "
                       "(Found at line 2, line 3, line 4 and 2 more locations)")
    assert recs[4] == "--- LOW Issues (1) ---"


def test_external_report_severity_and_merge(spark):
    files = files_df(spark, [("x/a.php", "<?php\n$x = 1;\n")])
    report = {"files": {"/tmp/a.php": {"messages": [
        {"message": "Possible SQL injection here", "line": 2, "column": 1},
        {"message": "Variable $y is unused", "line": 1, "column": 0}]}}}
    rep = spark.createDataFrame([("r", "x/a.php", json.dumps(report))], "repo string, path string, report string")
    ext = G.external_report_issues(rep, files)
    sev = {r.description: r.severity for r in ext.collect()}
    assert sev == {"Possible SQL injection here": "Critical", "Variable $y is unused": "Low"}
    recs = [r.recommendation for r in G.recommendations_with_report(files, ext).orderBy("occ").collect()]
    assert recs[0] == "--- CRITICAL Issues (1) ---"
    assert recs[1].startswith("PHPSTAN [L2:C1]: Possible SQL injection here\nCode context:\n    1: <?php\n--> 2: $x = 1;\n")
    assert "--- LOW Issues (2) ---" in recs


def test_user_regex_rule_and_keywords(spark):
    from revkit.operators.findings import regex_rule, run_rules
    from revkit.operators.metrics import ASPECT_KEYWORDS, file_metrics

    files = files_df(spark, [("a.go", "package a\n// HACK here\nx := 1 // HACK again\n")])
    found = run_rules(files, [regex_rule("U1", r"HACK", "Remove hack"), regex_rule("U2", r"^//", "Comment line", scope="line")])
    got = sorted((r.rule_id, r.msg) for r in found.collect())
    assert got == [("U1", "a.go:2: Remove hack"), ("U1", "a.go:3: Remove hack"), ("U2", "a.go:2: Comment line")]
    kw = dict(ASPECT_KEYWORDS, clarity=["hack"])
    m = file_metrics(found, keywords=kw).first()
    assert m.clarity == 2.0 and m.n_recs == 3
