"""Fixes of the fourth review: the same rows, at less cost."""

import glob
import os
import re
import tempfile

from helpers import files_df, run
from pyspark.sql import functions as F

from revkit.operators import aspects as D
from revkit.operators import common as E
from revkit.operators import findings
from revkit.operators import history as L
from revkit.operators import metrics as K
from revkit.operators import php as G
from revkit.operators import python as H
from revkit.operators.analyze import analyze
from revkit.plans import typed_queries as TQ


def _scored(spark, rows):
    frame = spark.createDataFrame(rows, "review_id long, channel_id string, ts string, overall double")
    zero = {c: F.lit(0.0) for c in ("thoroughness", "clarity", "actionability")}
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).withColumns(zero).withColumn("comment_length", F.lit(1).cast("long"))


def _scratch(name):
    return os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), name)


def test_history_files_do_not_follow_the_days(spark):
    """a batch over many days writes as many files as its rows need, and replaces its own."""
    rows = [(i, f"c{i % 2}", f"20{10 + i // 200}-{1 + i // 20 % 10:02d}-{1 + i % 20:02d} 12:00:00", float(i % 50)) for i in range(400)]
    late = [(1000 + i, c, d.replace("12:", "18:"), q) for i, c, d, q in rows]
    path = _scratch("history")
    table = L.HistoryTable(spark, path)
    for number, part in ((0, rows), (1, rows[:7]), (1, late)):
        table.append(_scored(spark, part), number)
    for name in ("records", "state"):
        assert {len(glob.glob(f"{path}/{name}/batch={b}/**/*.parquet", recursive=True)) <= 8 for b in (0, 1)} == {True}
    key = lambda df: sorted((r.channel_id, str(r.date), r.overall_quality, r.average, r.trend) for r in df.collect())
    assert key(table.records()) == key(L.history_records(L.with_history(_scored(spark, rows + late))))
    day = table.records().groupBy("period").count().orderBy("period").first()
    assert table.records().where(F.col("period") == day.period).count() == day["count"] == 2


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_computed_once_for_both_writes(spark, monkeypatch):
    """the batch is still written twice, from rows that are there."""
    plans = []
    write = TQ.T.write_findings
    monkeypatch.setattr(TQ.T, "write_findings", lambda found, path, batch: plans.append((_plan(found), batch)) or write(found, path, batch))
    rows = TQ.q_findings(spark, "/root/testdata/sf0.001")
    assert [batch for _, batch in plans] == [0, 0] and not any("regexp" in p.lower() or "rlike" in p.lower() for p, _ in plans)
    want = TQ.T.typed_findings(TQ.derived_files(spark, "/root/testdata/sf0.001")).select(*rows.columns)
    assert rows.count() == want.count() and rows.exceptAll(want).isEmpty()


def test_report_reads_recommendations_that_are_there(spark):
    """the headers count files without running the rules once more."""
    files = files_df(spark, [("a.py", "# TODO x\n"), ("b.go", "package b\n")])
    sections = K.report_sections(K.file_recommendations(analyze(files)))
    assert "rlike" not in _plan(sections).lower()
    rows = [(r.seq, r.path) for r in K.ordered_report(sections).collect()]
    assert rows == [(0, ""), (1, ""), (1, "a.py"), (1, "b.go"), (2, ""), (3, "a.py"), (3, "b.go")]


_PHP_LINES = [
    "$db->QUERY ( $x", "PDO::query($a", "ec" + "ho $_GET", "ſystem($x)", "SHELL_EXEC ( 'a' . $b", "proc_open($x", "eval (", "assert(", "İnclude ($x)", "requıre_once ($p)",
    "<FORM a method = 'POST' b>", "MD5 (", "ſha1(", "Header( 'Locatİon: $u", "split", "x mcrypt_ y", "@fopen(", "'PAſſWD' => 'abcde'", "'Key' => 'abcde'", "$_Fıles [",
    "seſsion_START (", "<?php", "const abc =", "a ?> b <?php", "print_r (", "=== null", "use A\\B;", "global $x", "die (", "exit(", "écho $_POST", "syste m($x)", "plain text, ſ İ K",
]


def test_php_checks_find_the_same_behind_their_words(spark, monkeypatch):
    """a check without any of its words would not have matched, in any case of letters."""
    rows = [("all.php", "\n".join(_PHP_LINES)), ("crlf.php", "a\r\nb\r\n")] + [(f"{k}.php", line) for k, line in enumerate(_PHP_LINES)]
    found = lambda: sorted(map(tuple, G.issue_rows(files_df(spark, rows)).collect()))
    got = found()
    monkeypatch.setattr(G, "_holds_one", lambda s, words: F.lit(True))
    monkeypatch.setattr(findings, "_BUILT", {})
    assert got == found()
    assert {r[2] for r in got} == {t for t, *_ in G.CHECKS} - {"INCONSISTENT_LINE_ENDINGS"}  # that one needs two lines
    assert set(G.NEEDS) == {t for t, *_ in G.CHECKS} and all(w == w.lower() for words in G.NEEDS.values() for w in words)


def test_words_are_looked_for_before_patterns(spark):
    """texts without them are spared the slow passes."""
    plan = _plan(G.issue_rows(files_df(spark, [("a.php", "x")])))
    assert plan.lower().count("contains(php_low") >= len(G.CHECKS)


def test_python_and_java_guards_keep_their_findings(spark):
    """lines at the edge of what the guards look for."""
    lines = ['execute("a %s" )', 'EXECUTE ( "a" +', "cursor.execute(f'%d' x)", 'exec("{a}")', 'os.system(f"{x}")', "eval('{}'", "a + b", "def f(a=[], b={}):", "deff(a=[])", "exec('x')"]
    got = run(spark, [r for r in H.rules() if r.rule_id in ("H13", "H19")], [("a.py", "\n".join(lines))])
    codes = sorted((ln, msg.split("] ")[1][:6]) for _, _, ln, msg in got)
    assert codes == [(1, "PYL601"), (2, "PYL601"), (2, "PYL602"), (3, "PYL601"), (4, "PYL602"), (5, "PYL602"), (6, "PYL602"), (7, "PYL602"), (8, "PYL301")]
    pairs = ["a == b", "a === b", "a >= b", "a >>b", "a =! b", "a!==b", "a <> b"]
    e6 = [ln for _, _, ln, _ in run(spark, [r for r in E.rules() if r.rule_id == "E6"], [("A.java", "\n".join(pairs))])]
    assert e6 == [k for k, text in enumerate(pairs, start=1) if re.search(E.COMPLEX_COMPARISON, text)]
    todo = ["// todo", "# TODO", "/* ToDo", "TODO"]
    d8 = [p for p, _, _, _ in run(spark, [r for r in D.bundle(("actionability",)) if r.rule_id == "D8"], [(f"{k}.go", t) for k, t in enumerate(todo)])]
    assert d8 == ["0.go", "1.go", "2.go"]
