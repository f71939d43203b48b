"""Line and occurrence building blocks (column expressions, no UDFs).

All positions follow the byte semantics of the rules: lengths and columns are
UTF-8 byte counts (``octet_length``), line numbers are 1-based.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit import rx

NL = "\n"
# Marker characters used to tag match starts. Content is first mapped so that
# MARK never occurs in it; ALT is a stand-in no rule pattern tells apart from MARK.
MARK = "\x01"
ALT = "\x02"


def lines(content: Column) -> Column:
    """Split on '\\n' keeping a trailing empty line and any '\\r'."""
    return F.split(content, NL, -1)


def count_sub(s: Column, sub: str) -> Column:
    """Non-overlapping count of a literal substring (strings.Count)."""
    gone = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(sub), F.lit("")))  # in bytes: no character is counted
    return F.floor(gone / F.lit(len(sub.encode()))).cast("int")


def indent_width(line: Column) -> Column:
    """Bytes of leading spaces and tabs."""
    return F.octet_length(line) - F.octet_length(F.ltrim(line, F.lit(" \t")))


def rcount(s: Column, go_pattern: str) -> Column:
    """Number of non-overlapping matches of an RE2 pattern."""
    return F.regexp_count(s, F.lit(rx.java(go_pattern)))


def rlike(s: Column, go_pattern: str) -> Column:
    return s.rlike(rx.java(go_pattern))


def extract_all(s: Column, go_pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(rx.java(go_pattern)), group)


def extract(s: Column, go_pattern: str, group: int = 0) -> Column:
    """First match (or group of it); '' when there is none."""
    return F.regexp_extract(s, rx.java(go_pattern), group)


def _marked(s: Column, go_pattern: str) -> Column:
    """Text with MARK inserted before every match of the pattern."""
    safe = F.replace(s, F.lit(MARK), F.lit(ALT))  # looks for the bytes; ``translate`` looks up every character
    return F.regexp_replace(safe, rx.java(go_pattern), MARK + "$0")


def match_lines(content: Column, go_pattern: str) -> Column:
    """C3+C4 (OCC): array with the 1-based line number of every match, in order.

    Linear in the text: matches are tagged in place, everything but newlines
    and tags is dropped, and each remaining line contributes its line number
    once per tag. Match text keeps its own newlines, so later lines stay right.
    """
    skeleton = F.regexp_replace(_marked(content, go_pattern), f"[^{NL}{MARK}]+", "")
    return F.flatten(F.transform(F.split(skeleton, NL, -1), lambda l, i: F.array_repeat(i + 1, F.length(l))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


_STEP = 256


def prefix_sums(sizes: Column) -> Column:
    """Running sums of an integer array, in blocks so that the work per element
    stays small for long arrays."""
    add = lambda a, x: a + x
    total = lambda arr, start, n: F.aggregate(F.slice(arr, start, n), F.lit(0), add)

    def sums(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _STEP).cast("int")), lambda b: total(v, b * _STEP + 1, F.lit(_STEP)))
        at = lambda k: F.floor(k / _STEP).cast("int")
        return let(blocks, lambda bs: F.transform(v, lambda _x, k: total(bs, F.lit(1), at(k)) + total(v, at(k) * _STEP + 1, k % _STEP + 1)))

    return let(sizes, sums)


def _offsets(s: Column, go_pattern: str, size: Callable[[Column], Column]) -> Column:
    """Offset of every match: running sums of the sizes of the pieces before the marks."""
    pieces = F.split(_marked(s, go_pattern), MARK, -1)
    return prefix_sums(let(pieces, lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), size)))


def match_byte_offsets(s: Column, go_pattern: str) -> Column:
    """0-based byte offset of every match in a text."""
    return _offsets(s, go_pattern, lambda x: F.octet_length(x))


def snippet(all_lines: Column, line_no: Column) -> Column:
    """Previous, marked and next line, each as '{mark}{n}: {text}\\n'; '' out of range."""
    total = F.size(all_lines)
    start = F.greatest(F.lit(0), line_no - 2)  # 0-based first line shown
    end = F.least(total, line_no + 1)  # 0-based exclusive
    shown = F.slice(all_lines, start + 1, F.greatest(end - start, F.lit(0)))
    body = F.array_join(
        F.transform(
            shown,
            lambda t, k: F.concat(
                F.when(start + k == line_no - 1, F.lit("--> ")).otherwise(F.lit("    ")),
                (start + k + 1).cast("string"),
                F.lit(": "),
                t,
                F.lit(NL),
            ),
        ),
        "",
    )
    return F.when((line_no <= 0) | (line_no > total), F.lit("")).otherwise(body)


def byte_prefix(s: Column, nbytes: int) -> Column:
    """First n bytes of a string, invalid UTF-8 tail shown as U+FFFD (Go's s[:n])."""
    return F.make_valid_utf8(F.substr(s.cast("binary"), F.lit(1), F.lit(nbytes)).cast("string"))


def match_char_offsets(s: Column, go_pattern: str) -> Column:
    """0-based character offset of every match (for ordering matches of
    different patterns within one text)."""
    offsets = _offsets(s, go_pattern, lambda x: F.length(x))
    return F.when(rlike(s, go_pattern), offsets).otherwise(F.array().cast("array<int>"))
