"""I: Go rules, re-aimed from a syntax tree to line and segment rules over
gofmt-style text (see README: results are heuristics).

Structure comes from the in-row lines array: string literals and line
comments are blanked first; a function runs from a ``func`` line to the
first later line that is exactly ``}``; a block runs from a line ending in
``{`` to the next line at the same indent starting with ``}``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit import rx
from revkit.functions import text as T
from revkit.operators.common import loc
from revkit.operators.findings import Ctx, Rule, empty, finding

# Go rule patterns (RE2 syntax).
PACKAGE = r"^package\s+\w+"
FUNC = r"^func\s+(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(([^)]*)\)(.*)$"
#: A signature whose parameters go on in the next lines.
FUNC_OPEN = r"^func\s+(\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(([^)]*)$"
BLANK_IMPORT = r"^\s*(import\s+)?_\s+\x60?\"[^\"]*\""
ERR_VAR = r"(err|\w*Err|\w*Error)"
ERR_CHECK = r"^\s*if\s+(.*;\s*)?" + ERR_VAR + r"\s*!=\s*nil\s*\{\s*$"
ASSIGN_CHECK = r"^\s*if\s+[^;]*?:?=\s*([^;]*);\s*" + ERR_VAR + r"\s*!=\s*nil\s*\{\s*$"
RETURN = r"^\s*return\b(.*)$"
CONTEXT_IMPORT = r"^\s*(import\s+)?\"context\"\s*$"


# string literals, written as an unrolled loop (same matches as
# "([^"\\]|\\.)*") so a long literal does not recurse in the Java engine
STRING_LITERAL = r'"[^"\\]*(?:\\.[^"\\]*)*"|`[^`]*`'
LINE_COMMENT = r"//.*$"


def _code(line: Column) -> Column:
    """Line with string literals and // comments blanked."""
    no_str = F.regexp_replace(line, rx.java(STRING_LITERAL), '""')
    return F.regexp_replace(no_str, rx.java(LINE_COMMENT), "")


def _strip(x: Column) -> Column:
    """Go's strings.TrimSpace (tabs included: gofmt indents with tabs)."""
    from revkit.operators.python import trim_space

    return trim_space(x)


def _comment_line(line: Column) -> Column:
    t = _strip(line)
    return t.startswith("//") | t.endswith("*/")


def _is_err_ident(x: Column) -> Column:
    return x.rlike(r"^(err|\w*Err|\w*Error)$")


def _prep(c: Ctx) -> Column:
    """Per line: the code text (strings and line comments blanked)."""
    return F.transform(c.lines, _code)


def _func_headers(c: Ctx) -> Column:
    """Array of struct(i, last, name, params, results) for every ``func`` line; a
    signature left open is read together with its lines up to the closing one
    (index ``last``)."""
    n = F.size(c.lines)

    def struct(text: Column, i: Column, last: Column) -> Column:
        return F.struct(
            i.alias("i"), last.alias("last"), T.extract(text, FUNC, 2).alias("name"), T.extract(text, FUNC, 3).alias("params"), T.extract(text, FUNC, 4).alias("rest")
        )

    def header(l: Column, i: Column) -> Column:
        closing = F.filter(F.sequence(i, n - 1), lambda j: F.contains(F.get(c.lines, j), F.lit(")")))
        last = F.coalesce(F.get(closing, 0), i)
        whole = F.array_join(F.slice(c.lines, i + 1, last - i + 1), " ")
        return F.when(T.rlike(l, FUNC), struct(l, i, i)).when(T.rlike(l, FUNC_OPEN) & T.rlike(whole, FUNC), struct(whole, i, last))

    return F.filter(
        F.transform(c.lines, header),
        lambda x: x.isNotNull(),
    )


def _ends(c: Ctx) -> Column:
    """0-based indexes of the lines that are exactly '}'."""
    at = F.transform(c.extra["go_code"], lambda x, j: F.when(F.regexp_replace(x, "[ \t\r]+\\z", "") == "}", j))
    return F.filter(at, lambda j: j.isNotNull())


def _with_ends(c: Ctx) -> Column:
    """struct(h, end) per function: the index of the first line after its
    signature that is exactly '}' (or of the last line). Signatures and such
    lines are sorted together and folded once, last first."""
    last = F.size(c.extra["go_code"]) - 1
    heads = F.transform(_func_headers(c), lambda h: F.struct(h["last"].alias("at"), F.lit(1).alias("kind"), h.alias("h")))
    none = F.when(F.lit(False), F.get(heads, 0)["h"])
    ends = F.transform(c.extra["go_ends"], lambda j: F.struct(j.alias("at"), F.lit(0).alias("kind"), none.alias("h")))
    init = F.struct(last.alias("end"), F.filter(F.transform(heads, lambda x: F.struct(x["h"].alias("h"), last.alias("end"))), lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        found = F.concat(F.array(F.struct(x["h"].alias("h"), acc["end"].alias("end"))), acc["out"])
        return F.when(x["kind"] == 1, F.struct(acc["end"].alias("end"), found.alias("out"))).otherwise(F.struct(x["at"].alias("end"), acc["out"].alias("out")))

    return F.aggregate(F.reverse(F.array_sort(F.concat(heads, ends))), init, step)["out"]


def _named_results(rest: Column) -> Column:
    """Results list '( a T, b U )' where an entry has a name and a type."""
    res = F.regexp_extract(rest, r"^\s*\(([^)]*)\)", 1)
    return F.exists(F.split(res, ",", -1), lambda e: _strip(e).rlike(r"^\w+\s+\S"))


def package_doc(c: Ctx) -> Column:
    """I1."""
    pos = F.array_position(F.transform(c.lines, lambda l: T.rlike(l, PACKAGE)), F.lit(True))
    prev = F.when(pos > 1, F.get(c.lines, pos - 2))
    documented = F.coalesce(_comment_line(prev), F.lit(False))
    return F.when((pos > 0) & ~documented, F.array(finding(1, F.concat(c.path, F.lit(":1: Package lacks documentation comment"))))).otherwise(empty())


def blank_imports(c: Ctx) -> Column:
    """Blank imports in an import block or single import line."""
    def on_line(l: Column, i: Column) -> Column:
        return F.when(T.rlike(l, BLANK_IMPORT), finding(i + 1, loc(c, i + 1, "Blank import found - ensure it's necessary")))

    return F.filter(F.transform(c.lines, on_line), lambda x: x.isNotNull())


def functions(c: Ctx) -> Column:
    """I3 length, I4 exported without doc, I5 naked returns, per function in order."""
    code = c.extra["go_code"]

    def per_func(x: Column) -> Column:
        h, start, end = x["h"], x["h"]["last"], x["end"]
        body = F.slice(code, start + 2, F.greatest(end - start - 1, F.lit(0)))
        stmts = F.size(F.filter(body, lambda x: (_strip(x) != "") & ~_strip(x).startswith("}"))) + F.size(
            F.filter(body, lambda x: _strip(x).endswith("{"))
        )
        line = h["i"] + 1
        prev = F.when(h["i"] > 0, F.get(c.lines, h["i"] - 1))
        exported = h["name"].rlike("^[A-Z]")
        naked = F.filter(
            F.transform(body, lambda x, k: F.when(_strip(x) == "return", start + 2 + k)),
            lambda x: x.isNotNull(),
        )
        return F.concat(
            F.when(stmts > 50, F.array(finding(line, loc(c, line, F.concat(
                F.lit("Function '"), h["name"], F.lit("' is too long ("), stmts.cast("string"),
                F.lit(" statements, consider refactoring)")))))).otherwise(empty()),
            F.when(exported & ~F.coalesce(_comment_line(prev), F.lit(False)), F.array(finding(line, loc(c, line, F.concat(
                F.lit("Exported function '"), h["name"], F.lit("' lacks documentation comment"))), key=F.lit("I4")))).otherwise(empty()),
            F.when(_named_results(h["rest"]), F.transform(naked, lambda n: finding(n, loc(c, n, F.concat(
                F.lit("Naked return in function '"), h["name"], F.lit("' reduces code readability"))), key=F.lit("I5")))).otherwise(empty()),
        )

    return F.flatten(F.transform(_with_ends(c), per_func))


def _checks(c: Ctx) -> Column:
    """Error checks in order: struct(i, single, handled) per ``if ... err != nil {``
    line.

    Only the lines that matter (checks, lines that begin with '}', returns of an
    error) are folded, once: a check is opened, a return handles all that are
    open, and a '}' closes those of its indent."""

    def event(x: Column, i: Column) -> Column:
        returns = T.rlike(x, RETURN) & F.exists(F.split(T.extract(x, RETURN, 1), ",", -1), lambda r: _is_err_ident(_strip(r)))
        rhs = T.extract(x, ASSIGN_CHECK, 1)
        single = T.rlike(x, ASSIGN_CHECK) & ~F.contains(F.regexp_replace(rhs, r"\([^()]*\)", ""), F.lit(","))
        one = lambda kind, single: F.struct(i.alias("i"), F.lit(kind).alias("kind"), T.indent_width(x).alias("ind"), single.alias("single"))
        return F.when(T.rlike(x, ERR_CHECK), one("check", single)).when(_strip(x).startswith("}"), one("close", F.lit(False))).when(returns, one("return", F.lit(False)))

    events = F.filter(F.transform(c.extra["go_code"], event), lambda e: e.isNotNull())
    kind = "array<struct<i:int,ind:int,single:boolean,handled:boolean>>"
    init = F.struct(F.array().cast(kind).alias("open"), F.array().cast(kind).alias("done"))

    def step(acc: Column, e: Column) -> Column:
        state = lambda open_, done: F.struct(open_.alias("open"), done.alias("done"))
        opened = F.array(F.struct(e["i"].alias("i"), e["ind"].alias("ind"), e["single"].alias("single"), F.lit(False).alias("handled")))
        closed = F.filter(acc["open"], lambda o: o["ind"] == e["ind"])
        still = F.filter(acc["open"], lambda o: o["ind"] != e["ind"])
        handled = F.transform(acc["open"], lambda o: F.struct(o["i"].alias("i"), o["ind"].alias("ind"), o["single"].alias("single"), F.lit(True).alias("handled")))
        return (
            F.when(e["kind"] == "check", state(F.concat(acc["open"], opened), acc["done"]))
            .when(F.size(acc["open"]) == 0, acc)
            .when(e["kind"] == "return", state(handled, acc["done"]))
            .otherwise(state(still, F.concat(acc["done"], closed)))
        )

    return F.aggregate(events, init, step, lambda acc: F.array_sort(F.concat(acc["done"], acc["open"])))


def error_handling(c: Ctx) -> Column:
    """I6 + I7 per check in order, then I8 for the file."""
    checks = c.extra["go_checks"]
    per = F.flatten(
        F.transform(
            checks,
            lambda k: F.concat(
                F.when(k["single"], F.array(finding(k["i"] + 1, loc(c, k["i"] + 1,
                    "Consider separating error assignment and checking for better readability")))).otherwise(empty()),
                F.when(~k["handled"], F.array(finding(k["i"] + 1, loc(c, k["i"] + 1,
                    "Error check doesn't properly return or handle the error"), key=F.lit("I7")))).otherwise(empty()),
            ),
        )
    )
    total = F.size(checks)
    ok = F.size(F.filter(checks, lambda k: k["handled"]))
    many = F.when((total > 0) & (ok < F.floor(total / 2)), F.array(finding(1, F.concat(
        c.path, F.lit(":1: Many error checks don't properly return or handle the error")), key=F.lit("I8")))).otherwise(empty())
    return F.concat(per, many)


def context_usage(c: Ctx) -> Column:
    """I10."""
    imported = F.exists(c.lines, lambda l: T.rlike(l, CONTEXT_IMPORT))
    passed = F.exists(_func_headers(c), lambda h: F.contains(h["params"], F.lit("context.Context")))
    return F.when(imported & ~passed, F.array(finding(1, F.concat(
        c.path, F.lit(":1: Using context package but not passing context through functions"))))).otherwise(empty())


def _parses(c: Ctx) -> Column:
    """Stand-in for a successful parse: a package clause exists."""
    return F.exists(c.lines, lambda l: T.rlike(l, PACKAGE))


PREP = (("go_code", _prep), ("go_ends", _ends), ("go_checks", _checks))


def _guard(fn):
    return lambda c: F.when(_parses(c), fn(c)).otherwise(empty())


def rules() -> list[Rule]:
    g = ("go",)
    return [
        Rule("I1", _guard(package_doc), g, PREP),
        Rule("I2", _guard(blank_imports), g, PREP),
        Rule("I3", _guard(functions), g, PREP),
        Rule("I6", _guard(error_handling), g, PREP),
        Rule("I10", _guard(context_usage), g, PREP),
    ]
