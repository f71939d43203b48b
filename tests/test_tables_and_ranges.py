"""M3 range join over bins, L8 history in batches."""

import os
import tempfile

from helpers import files_df
from pyspark.sql import functions as F

from revkit.operators import context as M
from revkit.operators import history as L


def test_ranges_over_bins(spark):
    lines = [f"line {i}" for i in range(1, 201)]
    files = files_df(spark, [("a.py", "\n".join(lines)), ("b.py", "one"), ("unused.py", "x")])
    rows = [(1, 1, "r", "a.py", 60, 70), (2, 1, "r", "A.PY", 190, 500), (3, 1, "r", "b.py", 1, 9), (3, 2, "r", "a.py", 60, 70), (4, 1, "r", "gone.py", 1, 1), (5, 1, "r", "a.py", 900, 950)]
    refs = spark.createDataFrame(rows, "review_id long, ref_seq int, repo string, filename string, line_start int, line_end int")
    got = {(r.review_id, r.ref_seq): r for r in M.context_blocks(refs, files).collect()}

    def block(name, s, e):
        shown = [f"{'> ' if s <= n <= e else '  '}{n:4d}: {lines[n - 1]}\n" for n in range(max(0, s - 3) + 1, min(200, e + 3) + 1)]
        return f"Context for {name} (lines {s}-{e}):\n```\n{''.join(shown)}```\n\n"

    assert got[1, 1].block == block("a.py", 60, 70) == got[3, 2].block
    assert got[2, 1].block == block("A.PY", 190, 200) and got[5, 1].block == block("a.py", 1, 10)
    assert got[3, 1].block == "Context for b.py (lines 1-1):\n```\n>    1: one\n```\n\n"
    assert got[4, 1].block.startswith("Error retrieving gone.py")
    found = M.targeted_lines(M.resolve_files(refs, files), files).where("review_id IN (1, 2)").orderBy("review_id", "line_no").collect()
    assert [(r.review_id, r.line_no, r.line) for r in found] == [(1, n, f"line {n}") for n in range(60, 71)] + [(2, n, f"line {n}") for n in range(190, 201)]


def test_content_is_not_joined_to_references(spark):
    files = files_df(spark, [("a.py", "x\ny")])
    refs = spark.createDataFrame([(1, 1, "r", "a.py", 1, 2)], "review_id long, ref_seq int, repo string, filename string, line_start int, line_end int")
    bins = M.line_bins(M.resolve_files(refs, files), files)
    assert bins.columns == ["repo", "path", "total", "bin", "part"]
    assert "split(content" not in M.context_blocks(refs, files)._jdf.queryExecution().optimizedPlan().toString()


def _scored(spark, rows):
    frame = spark.createDataFrame(rows, "review_id long, channel_id string, ts string, overall double")
    zero = {c: F.lit(0.0) for c in ("thoroughness", "clarity", "actionability")}
    return frame.withColumn("ts", F.col("ts").cast("timestamp")).withColumns(zero).withColumn("comment_length", F.lit(1).cast("long"))


def test_history_in_batches(spark):
    rows = [(i, f"c{i % 2}", f"2024-01-0{1 + i // 30} {i % 30 // 2:02d}:{i % 2 * 30:02d}:00", float(i * 7 % 50)) for i in range(60)]
    key = lambda df: sorted((r.channel_id, str(r.date), r.overall_quality, round(r.average, 9), r.trend) for r in df.collect())
    want = key(L.history_records(L.with_history(_scored(spark, rows))))
    table = L.HistoryTable(spark, os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "history"))
    for number, part in ((0, rows[:11]), (1, rows[11:40]), (1, rows[11:40]), (2, rows[40:])):
        table.append(_scored(spark, part), number)
    assert key(table.records()) == want
    assert {(r.channel_id, r.period, r.n) for r in table.state(3).collect()} == {(c, p, 15) for c in ("c0", "c1") for p in (19723, 19724)}
    assert table.records().where("period = 19723").count() == 30
