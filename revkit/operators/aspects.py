"""D: per-file aspect checks (thoroughness, clarity, actionability)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.operators.findings import Ctx, Rule, empty, finding, one_if

# Aspect check patterns (RE2 syntax).
PY_DOCSTRING = r'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''"
GO_COMMENT = r"//.*|/\*[\s\S]*?\*/"
PY_FUNC = r"def\s+(\w+)[^{]*?:"
GO_FUNC = r"func\s+(\w+)[^{]*?{"
NAME = r"\b[a-z_]+\b"
TODO_COMMENT = r"(?i)//\s*TODO|#\s*TODO|/\*\s*TODO"
ASPECTS = ("thoroughness", "clarity", "actionability")


def _msg(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def first_replace(s: Column, old: str, new: str) -> Column:
    """strings.Replace(s, old, new, 1)."""
    pos = F.instr(s, old)
    return F.when(pos > 0, F.concat(F.substr(s, F.lit(1), pos - 1), F.lit(new), F.substr(s, pos + len(old)))).otherwise(s)


def test_path(path: Column) -> Column:
    """D3 sibling test path: first '.py' -> '_test.py', then first '.go' -> '_test.go'."""
    return first_replace(first_replace(path, ".py", "_test.py"), ".go", "_test.go")


def documented(c: Ctx) -> Column:
    return (
        F.when(c.lang == "python", T.rlike(c.content, PY_DOCSTRING))
        .when(c.lang == "go", T.rlike(c.content, GO_COMMENT))
        .otherwise(F.lit(True))
    )


def handles_errors(c: Ctx) -> Column:
    return (
        F.when(c.lang == "python", F.contains(c.content, F.lit("try:")) & F.contains(c.content, F.lit("except")))
        .when(c.lang == "go", F.contains(c.content, F.lit("if err != nil")))
        .otherwise(F.lit(True))
    )


def complex_functions(c: Ctx) -> Column:
    def names(pattern: str, keep) -> Column:
        z = F.arrays_zip(T.extract_all(c.content, pattern, 0).alias("m"), T.extract_all(c.content, pattern, 1).alias("n"))
        return F.transform(F.filter(z, lambda x: keep(x["m"])), lambda x: x["n"])

    py = names(PY_FUNC, lambda m: T.count_sub(m, "    ") > 2)
    go = names(GO_FUNC, lambda m: (T.count_sub(m, "for") > 1) | (T.count_sub(m, "if") > 2))
    return F.when(c.lang == "python", py).when(c.lang == "go", go).otherwise(F.array().cast("array<string>"))


def poor_names(c: Ctx) -> Column:
    names = F.filter(
        T.extract_all(c.content, NAME, 0),
        lambda v: (F.length(v) == 1) | F.contains(v, F.lit("temp")) | F.contains(v, F.lit("tmp")),
    )
    return F.when(c.lang.isin("python", "go"), names).otherwise(F.array().cast("array<string>"))


def good_structure(c: Ctx) -> Column:
    return (
        F.when(c.lang == "python", ~F.contains(c.content, F.lit("\t")))
        .when(c.lang == "go", c.content.startswith("package ") & ~F.contains(c.content, F.lit("\t\t\t\t")))
        .otherwise(F.lit(True))
    )


def complex_expression(c: Ctx) -> Column:
    return F.exists(
        c.lines, lambda l: (F.octet_length(l) > 100) | (T.count_sub(l, "&&") > 2) | (T.count_sub(l, "||") > 2)
    )


def deprecated(c: Ctx) -> Column:
    py = F.contains(c.content, F.lit("print ")) | F.contains(c.content, F.lit("urllib2"))
    return (
        F.when((c.lang == "python") & py, F.lit("print statement (use print()), urllib2 (use requests)"))
        .when((c.lang == "go") & F.contains(c.content, F.lit("ioutil.")), F.lit("ioutil (use io/fs)"))
    )


def improvements(c: Ctx) -> Column:
    big = T.count_sub(c.content, "\n") > 300
    py = (c.lang == "python") & ~F.contains(c.content, F.lit("typing.")) & ~F.contains(c.content, F.lit("from typing import"))
    go = (c.lang == "go") & F.contains(c.content, F.lit("var ")) & ~F.contains(c.content, F.lit(":="))
    arr = F.array(
        F.when(big, finding(0, F.lit("Consider breaking this file into smaller modules"))),
        F.when(py, finding(0, F.lit("Consider adding type hints for better code maintainability"))),
        F.when(go, finding(0, F.lit("Consider using := for shorter variable declarations where appropriate"))),
    )
    return F.filter(arr, lambda x: x.isNotNull())


def _comment_mark(s: Column) -> Column:
    """What TODO_COMMENT cannot lack."""
    return F.contains(s, F.lit("//")) | F.contains(s, F.lit("#")) | F.contains(s, F.lit("/*"))


def thoroughness_rules() -> list[Rule]:
    """D11 = D1..D4 (D3 rows: ``sibling_test_findings``)."""
    return [
        Rule("D1", lambda c: one_if(~documented(c), 0, _msg("Add more documentation to ", c.path, " to improve code understanding"))),
        Rule("D2", lambda c: one_if(~handles_errors(c), 0, _msg("Improve error handling in ", c.path))),
        # D3 depends on the path only: its rows come from a key-only join
        # (sibling_test_findings), so the rule array holds nothing for it
        Rule("D3", lambda c: empty()),
        Rule(
            "D4",
            lambda c: one_if(
                F.size(c.extra["d_cx"]) > 0,
                0,
                _msg("Consider breaking down complex functions in ", c.path, ": ", F.array_join(c.extra["d_cx"], ", ")),
            ),
            prep=(("d_cx", complex_functions),),
        ),
    ]


def clarity_rules() -> list[Rule]:
    """D12 = D5..D7."""
    return [
        Rule(
            "D5",
            lambda c: one_if(
                F.size(c.extra["d_poor"]) > 0, 0, _msg("Improve naming clarity in ", c.path, " for: ", F.array_join(c.extra["d_poor"], ", "))
            ),
            prep=(("d_poor", poor_names),),
        ),
        Rule("D6", lambda c: one_if(~good_structure(c), 0, _msg("Improve code structure and organization in ", c.path))),
        Rule("D7", lambda c: one_if(complex_expression(c), 0, _msg("Simplify complex expressions in ", c.path))),
    ]


def actionability_rules() -> list[Rule]:
    """D13 = D8..D10."""
    return [
        Rule("D8", lambda c: one_if(_comment_mark(c.content) & T.rlike(c.content, TODO_COMMENT), 0, _msg("Address TODO comments in ", c.path))),
        Rule(
            "D9",
            lambda c: one_if(c.extra["d_depr"].isNotNull(), 0, _msg("Update deprecated features in ", c.path, ": ", c.extra["d_depr"])),
            prep=(("d_depr", deprecated),),
        ),
        Rule("D10", improvements),
    ]


def bundle(aspects) -> list[Rule]:
    """Bundles in the order of the aspect list (lower-cased, untrimmed;
    unknown entries add nothing, repeated entries repeat)."""
    out: list[Rule] = []
    for a in aspects:
        low = a.lower()
        if low == "thoroughness":
            out += thoroughness_rules()
        elif low == "clarity":
            out += clarity_rules()
        elif low == "actionability":
            out += actionability_rules()
    return out

