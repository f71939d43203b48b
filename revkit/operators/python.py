"""H: Python rules. Line rules index into the in-row lines array (lead/lag
without a shuffle); the order-dependent checks (delimiter stack, indent
stack, function length) are folds with ``aggregate`` over that array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.functions.paths import basename
from revkit.operators.findings import Ctx, Rule, empty, finding

# Python rule patterns (RE2 syntax) and import groups.
EXCEPT_BARE = r"except\s*:"
EXCEPT_EXCEPTION = r"except\s+Exception\s*:"
IMPORT_STAR = r"from\s+(\w+)\s+import\s+\*"
MUTABLE_DEFAULT = r"def\s+\w+\([^)]*?(\w+)\s*=\s*(\[\]|\{\}|\(\))"
FUNC_NAME = r"def\s+(\w+)\s*\("
ASSIGN = r"^\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*="
CONSTANT = r"^[A-Z][A-Z0-9_]*$"
CAMEL = r"^[a-z][a-zA-Z0-9]*$"
SNAKE = r"^[a-z][a-z0-9_]*$"
SQL_INJECTION = r"""(?i)(execute|executemany|cursor\.execute)\s*\(\s*[f"'].*?\%.*?['"]\s*.*?\)|execute\s*\(\s*["'].*?\s*\+"""
SHELL_INJECTION = r"""(?i)(os\.system|subprocess\.call|subprocess\.Popen|exec|eval)\s*\(\s*[f"'].*?\{.*?\}.*?['"]|.*?\+"""
# Its second alternative '.*?\+' matches exactly the lines holding '+'; testing
# that with contains() and the first alternative alone gives the same answer
# without the backtracking scan from every start position of a long line.
SHELL_CALL = SHELL_INJECTION[: -len("|.*?\\+")]
PASSWORD = r"""(?i)password\s*[=:]\s*['"][^'"]+['"]"""
DEF_OR_CLASS = r"^\s*(def|class)\s+(\w+)"
GROUPS = ["standard", "third-party", "local"]

# Go's unicode.IsSpace set (strings.TrimSpace / strings.Fields), as a Java class.
GO_SPACE = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


#: The characters of GO_SPACE.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_space(s: Column) -> Column:
    return F.trim(s, F.lit(_SPACES))


def fields(s: Column) -> Column:
    return F.filter(F.split(s, f"{GO_SPACE}+", -1), lambda x: x != "")


def byte_index(s: Column, sub: str | Column) -> Column:
    """strings.Index in bytes; -1 when absent."""
    pos = F.position(sub if isinstance(sub, Column) else F.lit(sub), s)
    return F.when(pos > 0, F.octet_length(F.substr(s, F.lit(1), pos - 1))).otherwise(F.lit(-1))


def skip(trimmed: Column) -> Column:
    return (trimmed == "") | trimmed.startswith("#")


#: Issue code -> rule and severity.
CODES = {
    "PYL001": ("H1", "error"), "PYL002": ("H2", "error"), "PYL003": ("H3", "error"),
    "PYL101": ("H4", "warning"), "PYL102": ("H5", "warning"), "PYL103": ("H6", "warning"),
    "PYL201": ("H7", "warning"), "PYL202": ("H10", "info"), "PYL203": ("H11", "info"),
    "PYL301": ("H13", "warning"), "PYL302": ("H14", "warning"), "PYL401": ("H15", "info"), "PYL402": ("H16", "info"),
    "PYL501": ("H17", "info"), "PYL502": ("H18", "info"), "PYL601": ("H19", "error"), "PYL602": ("H20", "error"), "PYL603": ("H21", "error"),
    "PYL701": ("H22", "warning"), "PYL702": ("H23", "warning"), "PYL801": ("H24", "info"),
}


def issue(c: Ctx, line: Column, col: Column | int, sev: str, code: str, msg: Column | str) -> Column:
    colc = col if isinstance(col, Column) else F.lit(col)
    where = F.concat(c.extra["py_base"], F.lit(":"), line.cast("string"),
                     F.when(colc > 0, F.concat(F.lit(":"), colc.cast("string"))).otherwise(F.lit("")))
    text = F.concat(where, F.lit(f" [{sev}] {code}: "), msg if isinstance(msg, Column) else F.lit(msg))
    return finding(line, text, colc, key=F.lit(code))


def _nn(*xs: Column) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def _per_line(c: Ctx, fn) -> Column:
    return F.flatten(F.transform(c.lines, fn))


# ----------------------------------------------------------------- H1 syntax

DELIMITER = r"[()\[\]{}]"


def unbalanced(c: Ctx) -> Column:
    """H1: per line, a closer that does not match the top of a fresh stack."""
    def on_line(l: Column, i: Column) -> Column:
        init = F.struct(F.lit("").alias("st"), F.array().cast("array<int>").alias("bad"))

        def step(acc, x):
            ch, k = x["c"], x["k"]
            opener = F.when(ch == "(", ")").when(ch == "[", "]").when(ch == "{", "}")
            is_close = ch.isin(")", "]", "}")
            top = F.substr(acc["st"], F.length(acc["st"]), F.lit(1))
            bad = is_close & ((F.length(acc["st"]) == 0) | (top != ch))
            st = (
                F.when(opener.isNotNull(), F.concat(acc["st"], opener))
                .when(is_close & ~bad, F.substr(acc["st"], F.lit(1), F.length(acc["st"]) - 1))
                .otherwise(acc["st"])
            )
            return F.struct(st.alias("st"), F.when(bad, F.concat(acc["bad"], F.array(k))).otherwise(acc["bad"]).alias("bad"))

        # the delimiters alone, and the bytes before each of them
        marks = F.regexp_extract_all(l, F.lit(DELIMITER), F.lit(0))
        folded = F.aggregate(F.transform(marks, lambda ch, k: F.struct(ch.alias("c"), k.alias("k"))), init, step)

        def hits(v: Column) -> Column:
            col = lambda k: F.get(v["at"], k) + 1
            return F.transform(
                v["bad"],
                lambda k: issue(c, i + 1, col(k), "error", "PYL001", F.concat(F.lit("Unbalanced delimiter: '"), F.get(v["marks"], k), F.lit("'"))),
            )

        found = F.struct(folded["bad"].alias("bad"), marks.alias("marks"), T.match_byte_offsets(l, DELIMITER).alias("at"))
        return F.when(l.rlike("[)\\]}]"), T.let(found, hits)).otherwise(empty())

    return _per_line(c, on_line)


def indentation(c: Ctx) -> Column:
    """H2 + H3 interleaved per line: mixed tabs/spaces, then the indent-stack check."""
    init = F.struct(F.array(F.lit(0)).alias("stack"), empty().alias("hits"))

    def step(acc, x):
        l, i = x["l"], x["i"]
        trimmed = x["t"]
        cur = x["ind"]
        stack = acc["stack"]
        top = F.element_at(stack, -1)
        last_le = F.size(stack) - F.array_position(F.reverse(F.transform(stack, lambda v: v <= cur)), F.lit(True)) + 1
        new_stack = (
            F.when(trimmed.endswith(":"), F.concat(stack, F.array(cur + 4)))
            .when(cur < top, F.slice(stack, 1, last_le))
            .otherwise(stack)
        )
        new_top = F.element_at(new_stack, -1)
        mixed = F.contains(l, F.lit("\t")) & F.contains(l, F.lit("    "))
        bad = (cur > 0) & (cur != new_top)
        found = _nn(
            F.when(mixed, issue(c, i + 1, 1, "error", "PYL002", "Mixed tab and space indentation")),
            F.when(bad, issue(c, i + 1, 1, "error", "PYL003", F.concat(
                F.lit("Indentation error: expected "), new_top.cast("string"), F.lit(" spaces, got "), cur.cast("string")))),
        )
        return F.when(
            skip(trimmed), acc
        ).otherwise(
            F.struct(new_stack.alias("stack"), F.when(F.size(found) > 0, F.concat(acc["hits"], found)).otherwise(acc["hits"]).alias("hits"))
        )

    return F.aggregate(_indexed(c), init, step)["hits"]


# ------------------------------------------------------------ H4-H6 except

def exceptions(c: Ctx) -> Column:
    n = F.size(c.lines)

    def on_line(l: Column, i: Column) -> Column:
        col = byte_index(l, "except") + 1
        nxt = F.get(c.lines, i + 1)
        return _nn(
            F.when(T.rlike(l, EXCEPT_BARE), issue(c, i + 1, col, "warning", "PYL101", "Bare 'except:' clause used. Always catch specific exceptions")),
            F.when(T.rlike(l, EXCEPT_EXCEPTION), issue(c, i + 1, col, "warning", "PYL102", "'except Exception:' used. Catch specific exceptions instead")),
            F.when(
                F.contains(l, F.lit("except")) & (i + 1 < n) & (F.get(c.extra["py_trim"], i + 1) == "pass"),
                issue(c, i + 2, 1, "warning", "PYL103",
                      "Empty except block with 'pass'. Either handle the exception or add a comment explaining why it is ignored"),
            ),
        )

    return _per_line(c, on_line)


# ------------------------------------------------------------- H7-H12 imports

def import_group(trimmed: Column) -> Column:
    """H8."""
    return (
        F.when(F.contains(trimmed, F.lit("my_local_module")), F.lit("local"))
        .when(F.contains(trimmed, F.lit("requests")) | F.contains(trimmed, F.lit("numpy")), F.lit("third-party"))
        .otherwise(F.lit("standard"))
    )


def import_name(line: Column) -> Column:
    """H9: second whitespace field when the first is import/from, else the line."""
    fs = fields(line)
    return F.when((F.size(fs) > 1) & F.get(fs, 0).isin("import", "from"), F.get(fs, 1)).otherwise(line)


def imports(c: Ctx) -> Column:
    wildcard = _per_line(
        c,
        lambda l, i: _nn(
            F.when(
                T.rlike(l, IMPORT_STAR),
                issue(c, i + 1, byte_index(l, "import *") + 1, "warning", "PYL201",
                      F.concat(F.lit("Wildcard import from '"), T.extract(l, IMPORT_STAR, 1), F.lit("'. Explicitly import only what you need"))),
            )
        ),
    )
    groups = c.extra["py_imports"]
    per_group = {g: groups[_field(g)] for g in GROUPS}
    order = []
    for g in GROUPS:
        es = per_group[g]
        pairs = F.transform(
            F.slice(es, 2, F.greatest(F.size(es) - 1, F.lit(0))),
            _pair_check(c, es, g),
        )
        order.append(F.filter(pairs, lambda x: x.isNotNull()))
    # K-th present group (k >= 1) is checked against the (k-1)-th group of the fixed order
    present = [F.size(per_group[g]) > 0 for g in GROUPS]
    group_checks = []
    for gi, g in enumerate(GROUPS):
        k = sum((p.cast("int") for p in present[:gi]), F.lit(0))  # present groups before g
        prev_checks = []
        for pj, pg in enumerate(GROUPS[:-1]):
            prev = per_group[pg]
            cur = per_group[g]
            prev_checks.append(
                F.when(
                    (k == pj + 1) & present[pj] & (F.element_at(prev, -1)["n"] > F.get(cur, 0)["n"]),
                    issue(c, F.get(cur, 0)["n"], 1, "info", "PYL203",
                          "Imports are not grouped in the correct order (standard, third-party, local)"),
                )
            )
        group_checks.append(F.when(present[gi], F.coalesce(*prev_checks)))
    return F.concat(wildcard, *order, _nn(*group_checks))


def _field(g: str) -> str:
    return g.replace("-", "_")


def import_groups(c: Ctx) -> Column:
    """H7-H9: import lines (n, group, name) split by group, one struct per file."""
    def entry(l: Column, i: Column) -> Column:
        t = F.get(c.extra["py_trim"], i)
        return F.when(
            t.startswith("import ") | t.startswith("from "),
            F.struct((i + 1).alias("n"), import_group(t).alias("g"), import_name(l).alias("name")),
        )

    entries = F.filter(F.transform(c.lines, entry), lambda e: e.isNotNull())
    return F.struct(*[F.filter(entries, _group_is(g)).alias(_field(g)) for g in GROUPS])


def _group_is(g: str):
    return lambda e: e["g"] == g


def _pair_check(c: Ctx, es: Column, g: str):
    def fn(e: Column, k: Column) -> Column:
        prev = F.get(es, k)  # es[k] precedes es[k+1] == e
        return F.when(prev["name"] > e["name"], issue(c, e["n"], 1, "info", "PYL202", f"Imports in group '{g}' are not in alphabetical order"))

    return fn


# ------------------------------------------------------- H13/H14 functions

def functions(c: Ctx) -> Column:
    """H13 per line, H14 function length, interleaved exactly as the
    reference's single pass: a function's length issue is emitted on the line
    that ends it (after that line's mutable-default check) or at the end."""
    init = F.struct(
        F.lit(False).alias("inf"), F.lit("").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("cnt"),
        F.lit(0).alias("ind"), empty().alias("hits"),
    )

    def too_long(acc) -> Column:
        return issue(c, acc["start"] + 1, 1, "warning", "PYL302", F.concat(
            F.lit("Function '"), acc["name"], F.lit("' is too long ("), acc["cnt"].cast("string"), F.lit(" lines). Consider refactoring")))

    def step(acc, x):
        l, i = x["l"], x["i"]
        trimmed = x["t"]
        ind = x["ind"]
        mutable = F.when(
            F.contains(l, F.lit("def")) & T.rlike(l, MUTABLE_DEFAULT),
            issue(c, i + 1, byte_index(l, T.extract(l, MUTABLE_DEFAULT, 2)) + 1, "warning", "PYL301",
                  F.concat(F.lit("Mutable default argument '"), T.extract(l, MUTABLE_DEFAULT, 1), F.lit("="),
                           T.extract(l, MUTABLE_DEFAULT, 2), F.lit("' can cause unexpected behavior"))),
        )
        is_def = trimmed.startswith("def ")
        named = is_def & T.rlike(trimmed, FUNC_NAME)
        ends = ~is_def & acc["inf"] & (ind <= acc["ind"])
        emit_prev = (named | ends) & acc["inf"] & (acc["cnt"] > 50)
        found = _nn(mutable, F.when(emit_prev, too_long(acc)))
        hits = F.when(F.size(found) > 0, F.concat(acc["hits"], found)).otherwise(acc["hits"])
        new = F.struct(
            F.when(named, F.lit(True)).when(ends, F.lit(False)).otherwise(acc["inf"]).alias("inf"),
            F.when(named, T.extract(trimmed, FUNC_NAME, 1)).otherwise(acc["name"]).alias("name"),
            F.when(named, i).otherwise(acc["start"]).alias("start"),
            F.when(named, F.lit(1)).when(~is_def & acc["inf"] & ~ends, acc["cnt"] + 1).otherwise(acc["cnt"]).alias("cnt"),
            F.when(named, ind).otherwise(acc["ind"]).alias("ind"),
            hits.alias("hits"),
        )
        return F.when(skip(trimmed), acc).otherwise(new)

    return F.aggregate(
        _indexed(c), init, step,
        lambda acc: F.when(acc["inf"] & (acc["cnt"] > 50), F.concat(acc["hits"], F.array(too_long(acc)))).otherwise(acc["hits"]),
    )


# ------------------------------------------------------- H15/H16 naming

def naming(c: Ctx) -> Column:
    def on_line(l: Column, i: Column) -> Column:
        name = T.extract(l, ASSIGN, 1)
        has = T.rlike(l, ASSIGN) & ~(name.startswith("__") & name.endswith("__"))
        const = T.rlike(name, CONSTANT)
        col = byte_index(l, name) + 1
        return _nn(
            F.when(has & (F.upper(name) == name) & ~const, issue(c, i + 1, col, "info", "PYL401", F.concat(
                F.lit("Variable '"), name, F.lit("' appears to be a constant but doesn't follow UPPER_CASE naming")))),
            F.when(has & ~const & ~T.rlike(name, SNAKE) & T.rlike(name, CAMEL), issue(c, i + 1, col, "info", "PYL402", F.concat(
                F.lit("Variable '"), name, F.lit("' uses camelCase but Python convention is snake_case")))),
        )

    return _per_line(c, on_line)


# ------------------------------------------------------- H17/H18 style

QUOTE_TOKEN = "'\"*'?|\"'*\"?"


def _quote_counts(l: Column) -> Column:
    """(single, double) quote counts of one line, quotes inside the other kind
    ignored, state reset per line. On the line's quote characters the toggle
    automaton is a tokenizer: an opening quote, quotes of the other kind
    (ignored), an optional closing quote; each token counts 1 or 2."""
    toks = F.regexp_extract_all(F.regexp_replace(l, "[^'\"]+", ""), F.lit(QUOTE_TOKEN), 0)

    def count(toks: Column, q: str) -> Column:
        ends = lambda t: 1 + ((F.length(t) >= 2) & t.endswith(q)).cast("int")
        return F.aggregate(toks, F.lit(0), lambda n, t: n + F.when(t.startswith(q), ends(t)).otherwise(0))

    zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("d"))
    found = T.let(toks, lambda v: F.struct(count(v, "'").alias("s"), count(v, '"').alias("d")))
    return F.when(F.contains(l, F.lit("'")) | F.contains(l, F.lit('"')), found).otherwise(zero)


def style(c: Ctx) -> Column:
    long_lines = _per_line(
        c,
        lambda l, i: _nn(F.when(F.octet_length(l) > 100, issue(c, i + 1, 100, "info", "PYL501", F.concat(
            F.lit("Line too long ("), F.octet_length(l).cast("string"), F.lit(" characters, max suggested 100)"))))),
    )
    counts = F.aggregate(
        F.transform(c.lines, _quote_counts),
        F.struct(F.lit(0).alias("s"), F.lit(0).alias("d")),
        lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["d"] + x["d"]).alias("d")),
    )
    s, d = counts["s"], counts["d"]
    quotes = _nn(F.when((s > 0) & (d > 0) & ((s > d * 3) | (d > s * 3)), issue(
        c, F.lit(1), 1, "info", "PYL502", "Inconsistent quote style. Consider using consistent string quotes")))
    return F.concat(long_lines, quotes)


# ------------------------------------------------------- H19-H21 security

def security(c: Ctx) -> Column:
    def on_line(l: Column, i: Column) -> Column:
        low = F.lower(l)
        pw = F.contains(l, F.lit("password")) & (F.contains(l, F.lit("=")) | F.contains(l, F.lit(":"))) & T.rlike(l, PASSWORD)
        # what a match cannot lack is looked for first: the patterns are slow on long lines
        sql = F.contains(l, F.lit("(")) & (F.contains(l, F.lit("%")) | F.contains(l, F.lit("+"))) & T.rlike(l, SQL_INJECTION)
        shell = F.contains(l, F.lit("{")) & T.rlike(l, SHELL_CALL)
        return _nn(
            F.when(sql, issue(c, i + 1, 1, "error", "PYL601", "Potential SQL injection vulnerability. Use parameterized queries instead")),
            # the pattern's second alternative '.*?\+' matches exactly the lines holding '+'
            F.when(F.contains(l, F.lit("+")) | shell, issue(c, i + 1, 1, "error", "PYL602",
                                                      "Potential shell injection vulnerability. Sanitize user input before using in shell commands")),
            F.when(pw, issue(c, i + 1, byte_index(low, "password"), "error", "PYL603",
                             "Hard-coded password detected. Use environment variables or a secure configuration system")),
        )

    return _per_line(c, on_line)


# ------------------------------------------------------- H22/H23 performance

def performance(c: Ctx) -> Column:
    n = F.size(c.lines)

    def on_line(l: Column, i: Column) -> Column:
        loop = F.contains(F.get(c.extra["py_trim"], i), F.lit("for "))
        n1, n2 = F.get(c.lines, i + 1), F.get(c.lines, i + 2)
        both = F.concat(n1, n2)
        return _nn(
            F.when(loop & (i + 1 < n) & F.contains(n1, F.lit(" += [")), issue(
                c, i + 2, 1, "warning", "PYL701",
                "List concatenation in loop is inefficient. Consider using list.append() or a list comprehension")),
            F.when(loop & (i + 2 < n) & (F.contains(both, F.lit(' += "')) | F.contains(both, F.lit(" += '"))), issue(
                c, i + 1, 1, "warning", "PYL702", "String concatenation in loop is inefficient. Use ''.join() or string formatting instead")),
        )

    return _per_line(c, on_line)


# ------------------------------------------------------- H24 docstrings

def docstrings(c: Ctx) -> Column:
    n = F.size(c.lines)

    def on_line(l: Column, i: Column) -> Column:
        kind = T.extract(l, DEF_OR_CLASS, 1)
        name = T.extract(l, DEF_OR_CLASS, 2)
        private = name.startswith("_") & ~name.startswith("__") & ~name.endswith("__")
        t1 = F.get(c.extra["py_trim"], i + 1)
        t2 = F.get(c.extra["py_trim"], i + 2)
        doc1 = (i + 1 < n) & (t1.startswith('"""') | t1.startswith("'''"))
        stop1 = (t1 != "") & ~t1.startswith("#") & (t1 != "pass")
        doc2 = (i + 2 < n) & (t2.startswith('"""') | t2.startswith("'''"))
        has_doc = doc1 | ((i + 1 < n) & ~stop1 & doc2)
        return _nn(F.when(T.rlike(l, DEF_OR_CLASS) & ~private & ~has_doc, issue(
            c, i + 1, byte_index(l, kind), "info", "PYL801",
            F.concat(F.lit("Missing docstring for "), kind, F.lit(" '"), name, F.lit("'")))))

    return _per_line(c, on_line)


PREP = (
    ("py_base", lambda c: basename(c.path)),
    ("py_trim", lambda c: F.transform(c.lines, trim_space)),
    ("py_indent", lambda c: F.transform(c.lines, T.indent_width)),
    ("py_imports", import_groups),
)


def _indexed(c: Ctx) -> Column:
    """Per line: text, 0-based index, trimmed text, indent width."""
    return F.transform(
        c.lines,
        lambda l, i: F.struct(l.alias("l"), i.alias("i"), F.get(c.extra["py_trim"], i).alias("t"), F.get(c.extra["py_indent"], i).alias("ind")),
    )


def rules() -> list[Rule]:
    p = ("python",)
    return [
        Rule("H1", unbalanced, p, PREP),
        Rule("H2", indentation, p, PREP),
        Rule("H4", exceptions, p, PREP),
        Rule("H7", imports, p, PREP),
        Rule("H13", functions, p, PREP),
        Rule("H15", naming, p, PREP),
        Rule("H17", style, p, PREP),
        Rule("H19", security, p, PREP),
        Rule("H22", performance, p, PREP),
        Rule("H24", docstrings, p, PREP),
    ]
