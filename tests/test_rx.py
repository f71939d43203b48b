"""Translation probe: every rule pattern, translated for Java, finds the same
matches in Spark as the original RE2 pattern does in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from revkit import rx
from revkit.functions import scoring as S
from revkit.operators import aspects as D
from revkit.operators import common as E
from revkit.operators import context as M
from revkit.operators import golang as I
from revkit.operators import java as J
from revkit.operators import php as G
from revkit.operators import python as H

TEXTS = [
    "a\rb", "trailing  \r", "x\x0by", "mid\x85dle", "caféa b", "ſee Kelvin K", "line sep x",
    "TODO: fix\n// old\n\n   // code\nint x = 42; y=1.5", "if (a == null) { }\ncatch (Throwable t) {}\ntry {\n}\n",
    "def f(a, b=[]):\n    pass\nfrom os import *\n", "<?php echo $_GET['x']; md5($p); @fopen($f); ?> <?php",
    'func Load(a int) (n int, err error) {\n\tif err := f(); err != nil {\n\t\treturn\n\t}\n}', "  - Fix it.\n1) add test\n`x` ```y```",
    "src/a/b.py:10-20 and auth.js:5 été", "import a.b.*;\npublic int size = 3;\nnew FileInputStream(f).close()",
    "x" * 120, "password = 'abcd'\ncursor.execute(\"select %s\" % a)", "", "\n\n", "ééé tmp temp_x a _b",
]


def patterns():
    mods = [S, E, D, J, H, I, M]
    out = set()
    for m in mods:
        for k, v in vars(m).items():
            if k.isupper() and isinstance(v, str) and not k.startswith("_") and k not in ("DEFAULT_CODE_SOURCE", "EMPTY_RECOMMENDATION", "GO_SPACE", "STRING_OR_RAW"):
                out.add(v)
    out |= {p for _t, p, _d, _s in G.CHECKS}
    return sorted(out)


@pytest.mark.parametrize("pattern", patterns())
def test_pattern_matches_like_re2(spark, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: list(r.m) for r in df.select("i", F.regexp_extract_all("t", F.lit(rx.java(pattern)), 0).alias("m")).collect()}
    con = duckdb.connect()
    for i, t in enumerate(TEXTS):
        want = con.execute("SELECT regexp_extract_all(?, ?)", [t, pattern]).fetchone()[0]
        assert got[i] == want, (pattern, t)


def test_translation_rules():
    assert rx.java(r"[ \t]+$").endswith("\\z")
    assert rx.java(r"(?m)^\s*//.*").startswith("(?dm)")
    assert "\\{" in rx.java(r"func\s+(\w+)[^{]*?{")
    assert rx.java(r"(?i)a").startswith("(?diu)")
