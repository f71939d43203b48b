"""Building blocks: occurrence lines, byte columns, snippets, counts."""

import re

from pyspark.sql import functions as F

from revkit.functions import text as T


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first().x


def naive_lines(text, pattern):
    out, pos = [], 0
    for m in re.finditer(pattern, text):
        out.append(text[: m.start()].count("\n") + 1)
    return out


def test_match_lines_linear_equals_prefix_count(spark):
    text = "a1\n\nb22 c3\r\n// x\n  // y\n\n\n4"
    for pat in [r"\d+", r"//.*"]:
        assert _one(spark, lambda s: T.match_lines(s, pat), text) == naive_lines(text, pat)


def test_match_spanning_newlines_keeps_later_lines(spark):
    # (?m)^\s*//.* may start on a preceding blank line (reported there);
    # '// d' is not at a line start
    text = "int a;\n\n   // c\nx // d\n// e"
    assert _one(spark, lambda s: T.match_lines(s, r"(?m)^\s*//.*"), text) == [2, 5]


def test_marker_character_in_text_is_harmless(spark):
    text = "\x01a\x01 1 \x01 2"
    assert _one(spark, lambda s: T.match_lines(s, r"\d+"), text) == [1, 1]


def test_byte_offsets_multibyte(spark):
    assert _one(spark, lambda s: T.match_byte_offsets(s, r"md5\("), "é md5( md5(") == [3, 8]


def test_snippet_shapes(spark):
    df = spark.createDataFrame([("a\nb\nc",)], "s string").select(T.lines(F.col("s")).alias("l"))
    got = df.select(T.snippet(F.col("l"), F.lit(2)).alias("x"), T.snippet(F.col("l"), F.lit(1)).alias("y"),
                    T.snippet(F.col("l"), F.lit(9)).alias("z")).first()
    assert got.x == "    1: a\n--> 2: b\n    3: c\n"
    assert got.y == "--> 1: a\n    2: b\n"
    assert got.z == ""


def test_count_sub_non_overlapping(spark):
    assert _one(spark, lambda s: T.count_sub(s, "\n\n"), "a\n\n\nb") == 1
    assert _one(spark, lambda s: T.count_sub(s, "    "), "         x") == 2


def test_byte_prefix_cuts_bytes(spark):
    assert _one(spark, lambda s: T.byte_prefix(s, 3), "abcdef") == "abc"
    assert _one(spark, lambda s: T.byte_prefix(s, 2), "aé").startswith("a")
