"""A1/A2 directory scan, A7 reply, L8 history records."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from revkit.operators import history as L
from revkit.operators import requests as R
from revkit.operators import reviews
from revkit.sources.files import scan_directory


def _tree():
    root = tempfile.mkdtemp(prefix="revkit-scan-", dir="/tmp")
    files = {
        "a/Main.java": b"class A {}\r\n// x\n",
        "a/b/tool.PHP": b"<?php echo $_GET['x'];\n",
        "notes.txt": b"skip me",
        "c/bad.py": b"x = '\xff'\n",
        "web/app.tsx": b"let a = 1\n",
    }
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    return root


def test_scan_known_languages_and_exact_content(spark):
    root = _tree()
    rows = {r.path: (r.lang, r.content) for r in scan_directory(spark, root, repo="r").collect()}
    assert set(rows) == {"a/Main.java", "a/b/tool.PHP", "c/bad.py", "web/app.tsx"}
    assert rows["a/Main.java"] == ("java", "class A {}\r\n// x\n")  # CR kept, no line splitting
    assert rows["a/b/tool.PHP"][0] == "php"
    assert rows["web/app.tsx"][0] == "typescript"
    assert rows["c/bad.py"][1] == "x = '�'\n"  # invalid UTF-8 shown as U+FFFD


def test_scan_php_only(spark):
    root = _tree()
    got = [r.path for r in scan_directory(spark, root, glob="*.[pP][hH][pP]").collect()]
    assert got == ["a/b/tool.PHP"]


def test_reply_json_and_history_records(spark):
    df = spark.createDataFrame([(1, "c", "2024-01-01 00:00:00", "short <b> & co")], "review_id long, channel_id string, ts string, message string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    scored = L.with_history(reviews.score_comments(df))
    reply = json.loads(R.to_reply(scored, F.lit("hello")).first().reply)
    assert reply == {"event_name": "Code Review Analysis", "message": "hello", "status": "success", "username": "Code Review Analyzer"}
    rec = L.history_records(scored).first()
    assert rec.comment_length == len("short <b> & co".encode()) and rec.average == 0.0 and rec.trend == 0.0


def test_unreadable_files_reach_the_report(spark):
    from revkit.operators import metrics as K
    from revkit.operators.analyze import analyze
    from revkit.sources.files import scan_readable

    root = _tree()
    with open(os.path.join(root, "c/long.Go"), "wb") as fh:
        fh.write(b"package a\n" * 50)
    files = scan_readable(spark, root, "r", max_bytes=400)
    rows = {r.path: (r.content, r.error) for r in files.collect()}
    assert set(rows) == {"a/Main.java", "a/b/tool.PHP", "c/bad.py", "c/long.Go", "web/app.tsx"}
    assert rows["c/bad.py"] == ("", "error reading file c/bad.py: not valid UTF-8")
    assert rows["c/long.Go"] == ("", "error reading file c/long.Go: 500 bytes, more than 400")
    assert rows["a/Main.java"][1] is None
    report = K.report_text(K.report_sections(K.file_recommendations(analyze(files)))).first().report
    assert "## c/bad.py\n- Error during analysis: error reading file c/bad.py: not valid UTF-8\n" in report
    assert "- c/bad.py\n" not in report and "Create unit tests for c/bad.py" not in report and "## a/Main.java\n\n- " in report


def test_only_known_names_are_listed(spark):
    from revkit.sources.files import scan_readable

    plan = scan_readable(spark, _tree(), "r")._jdf.queryExecution().executedPlan().toString()
    assert "notes.txt" not in plan and scan_readable(spark, _tree(), "r").count() == 4


def test_directory_stream(spark):
    from revkit.streaming import comments as P
    from revkit.streaming.files import findings_stream, stream_directory

    root, out = _tree(), os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "out")
    found = findings_stream(stream_directory(spark, root, "r", max_files=1), langs=())
    P.start(found, "t_" + os.path.basename(root), out, trigger_once=True).awaitTermination()
    rows = spark.read.schema(found.schema).parquet(out).collect()
    assert [(r.path, r.msg) for r in rows if r.rule_id == "K9"] == [("c/bad.py", "error reading file c/bad.py: not valid UTF-8")]
    assert {r.path for r in rows} <= {"a/Main.java", "a/b/tool.PHP", "c/bad.py", "web/app.tsx"}
