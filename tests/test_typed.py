"""Typed findings under their own rule ids; the sink keeps one copy of a batch."""

import os
import tempfile

from helpers import files_df

from revkit.operators import typed as T
from revkit.streaming import comments as P
from revkit.streaming.files import FILE_SCHEMA

FILES = [
    ("a/A.java", "try { x(); } catch (E e) { }\nimport a.b.*;\nc.close();\nint n; // TODO\n" + 'String s = "a long literal, 1"; String t = "a long literal, 2"; String u = "a long literal, 3"; String v = "a long literal, 4";\n'),
    ("a/b.php", "<?php\nmd5($a);\n"),
    ("a/c.py", "from x import *\nexcept:\n"),
    ("a/d.go", "package d\nfunc Load() (n int, err error) {\n\tif err != nil {\n\t\tlog(err)\n\t}\n\treturn\n}\n"),
]


def test_each_rule_has_its_own_id(spark):
    rows = {(r.path, r.rule_id, r.code, r.severity, r.line, r.col): (r.message, r.snippet) for r in T.typed_findings(files_df(spark, FILES)).collect()}
    ids = lambda path: {k[1] for k in rows if k[0] == path}
    assert {"F2", "F6", "F9", "F11", "F16"} <= ids("a/A.java") and {"D3", "I1", "I4", "I5", "I7"} <= ids("a/d.go")
    assert rows["a/b.php", "G7", "PASSWORD_HASH", "High", 2, 1] == ("Weak hashing algorithm. Use password_hash() for passwords", "    1: <?php\n--> 2: md5($a);\n    3: \n")
    assert rows["a/c.py", "H7", "PYL201", "warning", 1, 8][0] == "Wildcard import from 'x'. Explicitly import only what you need"
    assert rows["a/c.py", "H4", "PYL101", "warning", 2, 1][0].startswith("Bare 'except:'")
    assert not any(k[1] in ("G25", "F5", "I3") for k in rows)


def _key(rows):
    return sorted(map(tuple, rows))


def test_sink_keeps_one_copy_of_a_batch(spark):
    found = T.typed_findings(files_df(spark, FILES)).cache()
    path = os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "findings")
    for batch in (0, 0, 1):
        T.write_findings(found.where("lang = 'php'") if batch else found, path, batch)
    got = T.read_findings(spark, path)
    assert _key(got.collect()) == _key(found.select(*T.KEYS, *T.TYPED).collect() + found.where("lang = 'php'").select(*T.KEYS, *T.TYPED).collect())
    assert "lang=php/severity=High" in " ".join(got.where("lang = 'php' AND severity = 'High'").inputFiles())


def test_stream_into_the_sink(spark):
    root = tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp")
    files_df(spark, FILES).select("repo", "path", "content").repartition(2).write.parquet(os.path.join(root, "in"))
    stream = spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "in"))
    write = T.sink(os.path.join(root, "out"))
    P.start_batches(stream, "t_" + os.path.basename(root), lambda df, n: write(T.typed_findings(df), n)).awaitTermination()
    want = [r for r in T.typed_findings(files_df(spark, FILES)).collect()]
    assert _key(T.read_findings(spark, os.path.join(root, "out")).collect()) == _key(want)
