"""E: shared line/content rules (used by the Java analyzer) and the
targeted-range variants E8-E10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.operators.findings import Ctx, Rule, empty, per_line, per_match

# Common rule patterns (RE2 syntax).
TODO = r"(?i)TODO:|FIXME:|XXX:|BUG:|HACK:"
LONG_LINE = r".{100,}"
TRAILING_WS = r"[ \t]+$"
DEBUG_PRINT = r"(?i)(fmt\.Println|console\.log|print|debug|log\(.*\)|\.dump|\.inspect)"
COMMENTED_OUT = r"(?m)^\s*//.*"
COMPLEX_COMPARISON = r"(==|!=|>|<|>=|<=){2,}"
_TWO_SIGNS = r"[=!<>][=!<>]"  # no COMPLEX_COMPARISON without, and quicker to look for
MAGIC_NUMBER = r"\b\d+\b"


def loc(ctx: Ctx, line: Column, text: str | Column) -> Column:
    return F.concat(ctx.path, F.lit(":"), line.cast("string"), F.lit(": "), text if isinstance(text, Column) else F.lit(text))


def rules() -> list[Rule]:
    return [
        Rule("E1", lambda c: per_match(c.content, TODO, lambda ln, g: loc(c, ln, "Review TODO/FIXME"))),
        Rule(
            "E2",
            lambda c: per_line(
                c,
                lambda l, i: F.length(l) >= 100,  # LONG_LINE on a line
                lambda l, n: loc(c, n, F.concat(F.lit("Line too long ("), F.octet_length(l).cast("string"), F.lit(" chars)"))),
            ),
        ),
        Rule("E3", lambda c: per_line(c, lambda l, i: l.endswith(" ") | l.endswith("\t"), lambda l, n: loc(c, n, "Trailing whitespace"))),
        Rule("E4", lambda c: per_match(c.content, DEBUG_PRINT, lambda ln, g: loc(c, ln, "Remove debug print statement"))),
        Rule("E5", lambda c: per_match(c.content, COMMENTED_OUT, lambda ln, g: loc(c, ln, "Review commented-out code"))),
        Rule(
            "E6",
            lambda c: F.when(~(T.rlike(c.content, _TWO_SIGNS) & T.rlike(c.content, COMPLEX_COMPARISON)), empty()).otherwise(
                per_line(c, lambda l, i: T.rlike(l, COMPLEX_COMPARISON), lambda l, n: loc(c, n, "Simplify complex comparison"))
            ),
        ),
        Rule(
            "E7",
            lambda c: per_match(
                c.content,
                MAGIC_NUMBER,
                lambda ln, g: loc(c, ln, F.concat(F.lit("Use named constant instead of magic number '"), g[0], F.lit("'"))),
                groups=(0,),
            ),
        ),
    ]


# ------------------------------------------------------------ E8-E10 ranges

def targeted_findings(lines_in_range: DataFrame, aspects: list[str]) -> DataFrame:
    """E8-E10 over (file_path, line_no, line, ref_id) rows already cut to a
    clamped reference range (M3/M4); one row per hit, in aspect order."""
    checks: list[tuple[str, str, Column, str]] = []
    line = F.col("line")
    for a in aspects:
        low = a.lower()
        if low == "thoroughness":
            checks += [
                ("thoroughness", "E8a", F.contains(line, F.lit("err !=")), "Missing error handling."),
                ("thoroughness", "E8b", F.contains(line, F.lit("sync.WaitGroup")), "Review WaitGroup usage."),
            ]
        elif low == "clarity":
            checks += [
                ("clarity", "E9a", F.contains(line, F.lit("==")) | F.contains(line, F.lit("!=")), "Simplify complex comparisons."),
                ("clarity", "E9b", F.octet_length(line) > 80, "Line too long."),
                ("clarity", "E9c", F.contains(line, F.lit("interface{}")), "Avoid using empty interface."),
            ]
        elif low == "actionability":
            checks += [
                ("actionability", "E10a", F.contains(line, F.lit("TODO")) | F.contains(line, F.lit("//")), "Review TODOs/commented-out code."),
                ("actionability", "E10b", F.contains(line, F.lit("panic(")), "Avoid panics; use error handling."),
            ]
    # aspect k owns a block of check ids; within it the reference loops lines, then checks
    arr = F.array(
        *[
            F.when(
                pred,
                F.struct(
                    F.lit(k).alias("check_seq"),
                    F.lit(cid).alias("check_id"),
                    F.concat(F.col("file_path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": " + msg)).alias("recommendation"),
                ),
            )
            for k, (_a, cid, pred, msg) in enumerate(checks)
        ]
    )
    return lines_in_range.select("*", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("h")).select(
        *lines_in_range.columns, "h.check_seq", "h.check_id", "h.recommendation"
    )
