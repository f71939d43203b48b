"""F: Java rules, run after the common rules E1-E7 on every Java file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.operators.common import loc
from revkit.operators.findings import Ctx, Rule, empty, finding, one_if, per_match

# Java rule patterns (RE2 syntax).
CATCH_THROWABLE = r"catch\s*\(\s*Throwable\s+(\w+)\s*\)"
EMPTY_BLOCK = r"(?m)(if|for|while|try|catch|else|synchronized).*?\{\s*\}"
# EMPTY_BLOCK, or the rest of the line where the first keyword finds no empty
# block: later keywords of that line find none either, so each line is read once
EMPTY_BLOCK_OR_REST = r"(?m)(if|for|while|try|catch|else|synchronized)(?:.*?\{\s*\}|.*)"
_EMPTY = r"\{\s*\}"
NULL_CHECK = r"if\s*\(\s*(\w+)\s*==\s*null\s*\)|\(\s*(\w+)\s*!=\s*null\s*\)"
PUBLIC_FIELD = r"(?m)^\s*public\s+([a-zA-Z0-9_<>]+)\s+([a-zA-Z0-9_]+)\s*[=;]"
NON_FIELD = r"(?m)^\s*public\s+(class|interface|enum|record|static\s+final)"
TRY = r"try\s*\{"
CATCH = r"catch\s*\("
FINALLY = r"finally\s*\{"
EMPTY_CATCH = r"catch\s*\([^)]+\)\s*\{\s*\}"
GENERIC_CATCH = r"catch\s*\(\s*Exception\s+(\w+)\s*\)"
STRING_LITERAL = r'"([^"]{15,})"'
IMPORT = r"(?m)^import\s+([a-zA-Z0-9_.]+);"
WILDCARD_IMPORT = r"import\s+[a-zA-Z0-9_.]+\.\*;"
SERIALIZABLE_CLASS = r"class\s+([A-Za-z0-9_]+).*?implements.*?Serializable"
METHOD = r"(?ms)(public|private|protected)?\s+\w+(\s+\w+)?\([^)]*\)\s*(\{[^}]*\})"
# METHOD for Java's engine: what a run of spaces or word characters has taken is
# not given back, as what follows it never begins with one of them
_LONG_BLOCK = r"\{(?:[^}\n]*+\n){51}"  # a method of more than 50 lines has one
_METHOD = r"(?ms)(public|private|protected)?\s++\w++(\s++\w++)?+\([^)]*+\)\s*+(\{[^}]*+\})"
METHOD_NAME = r"\s+(\w+)\s*\("
COMPLEX_CONDITION = r"if\s*\(\s*[^()]*&&.*\|\|.*[^()]*\)"
RESOURCE = r"new\s+(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter|Connection|Statement|ResultSet)\s*\("
TRY_WITH_RESOURCES = r"try\s*\(\s*\w+"


def _s(x) -> Column:
    return x.cast("string")


def _first_line(ctx: Ctx, pattern: str) -> Column:
    return F.get(T.match_lines(ctx.content, pattern), 0)


def null_checks(c: Ctx) -> Column:
    n = T.rcount(c.content, NULL_CHECK)
    g1 = T.extract(c.content, NULL_CHECK, 1)
    var = F.when(g1 != "", g1).otherwise(T.extract(c.content, NULL_CHECK, 2))
    msg = loc(c, _first_line(c, NULL_CHECK), F.concat(F.lit("Found "), _s(n), F.lit(" null checks (e.g., '"), var,
                                                       F.lit("'). Consider using Objects.isNull() and Objects.nonNull()")))
    return F.when(~F.contains(c.content, F.lit("null")), empty()).otherwise(one_if(n > 5, _first_line(c, NULL_CHECK), msg))


def public_fields(c: Ctx) -> Column:
    return per_match(
        c.content,
        PUBLIC_FIELD,
        lambda ln, g: loc(c, ln, F.concat(F.lit("Public field '"), g[1], F.lit(" "), g[2],
                                          F.lit("'. Consider using private fields with getter/setter methods"))),
        groups=(0, 1, 2),
        keep=lambda ln, g: ~T.rlike(F.substring_index(g[0], "\n", 1), NON_FIELD),
    )


def try_offsets(c: Ctx) -> Column:
    """Per file, once: try offsets and lines, last catch/finally offset, empty-catch offsets and lines."""
    return F.struct(
        T.match_char_offsets(c.content, TRY).alias("tries"),
        T.match_lines(c.content, TRY).alias("try_lines"),
        F.greatest(
            F.coalesce(F.array_max(T.match_char_offsets(c.content, CATCH)), F.lit(-1)),
            F.coalesce(F.array_max(T.match_char_offsets(c.content, FINALLY)), F.lit(-1)),
        ).alias("last_handler"),
        T.match_char_offsets(c.content, EMPTY_CATCH).alias("ec_off"),
        T.match_lines(c.content, EMPTY_CATCH).alias("ec_lines"),
    )


def try_blocks(c: Ctx) -> Column:
    """F5 + F6, interleaved per try: missing catch/finally, then the first
    empty catch at or after the try (one per try, duplicates kept)."""
    t = c.extra["java_try"]
    try_lines, last_handler, ec_off, ec_lines = t["try_lines"], t["last_handler"], t["ec_off"], t["ec_lines"]
    chars = F.length(c.content)

    def per_try(off: Column, k: Column) -> Column:
        line = F.get(try_lines, k)
        # more than the four bytes of "try{" are left; a shorter rest is just those
        no_handler = ~((chars - off > 4) & (last_handler >= off))
        first_ec = F.array_position(F.transform(ec_off, lambda o: o >= off), F.lit(True))
        return F.filter(
            F.array(
                F.when(no_handler, finding(line, loc(c, line, "Try block without catch or finally. Ensure proper exception handling"))),
                F.when(
                    first_ec > 0,
                    finding(
                        F.get(ec_lines, first_ec - 1),
                        loc(c, F.get(ec_lines, first_ec - 1), "Empty catch block suppresses exceptions. At minimum, add a comment or log"),
                        key=F.lit("F6"),
                    ),
                ),
            ),
            lambda x: x.isNotNull(),
        )

    return F.flatten(F.transform(t["tries"], per_try))


def hardcoded_strings(c: Ctx) -> Column:
    lits = T.extract_all(c.content, STRING_LITERAL, 1)
    lines = T.match_lines(c.content, STRING_LITERAL)
    n = F.size(lits)
    first3 = F.transform(
        F.slice(F.arrays_zip(lines.alias("ln"), lits.alias("s")), 1, 3),
        lambda z: finding(
            z["ln"],
            loc(c, z["ln"], F.concat(
                F.lit('Long string literal "'),
                F.when(F.octet_length(z["s"]) > 20, F.concat(T.byte_prefix(z["s"], 17), F.lit("..."))).otherwise(z["s"]),
                F.lit('". Consider using string constants or resource bundles'),
            )),
        ),
    )
    summary = F.array(finding(0, F.concat(c.path, F.lit(": Found "), _s(n - 3),
                                          F.lit(" more long string literals. Consider using string constants or resource bundles")), key=F.lit("F9")))
    return F.when(n > 3, F.concat(first3, summary)).otherwise(empty())


def imports(c: Ctx) -> Column:
    names = T.extract_all(c.content, IMPORT, 1)
    n = F.size(names)
    line = _first_line(c, IMPORT)
    msg = loc(c, line, F.concat(F.lit("Found "), _s(n), F.lit(" imports (e.g., "), F.array_join(F.slice(names, 1, 3), ", "),
                                F.lit("). Consider refactoring to reduce dependencies")))
    many = one_if(n > 30, line, msg)
    wline = _first_line(c, WILDCARD_IMPORT)
    wild = one_if(
        T.rlike(c.content, WILDCARD_IMPORT),
        wline,
        loc(c, wline, F.concat(F.lit("Wildcard import '"), F.trim(T.extract(c.content, WILDCARD_IMPORT, 0)),
                               F.lit("'. Import specific classes instead"))),
        key=F.lit("F11"),
    )
    return F.when(~F.contains(c.content, F.lit("import")), empty()).otherwise(F.concat(many, wild))


def serial_version(c: Ctx) -> Column:
    guard = F.contains(c.content, F.lit("implements Serializable")) | F.contains(c.content, F.lit("extends.*Serializable"))
    line = _first_line(c, SERIALIZABLE_CLASS)
    cond = guard & T.rlike(c.content, SERIALIZABLE_CLASS) & ~F.contains(c.content, F.lit("serialVersionUID"))
    return one_if(cond, line, loc(c, line, F.concat(F.lit("Class '"), T.extract(c.content, SERIALIZABLE_CLASS, 1),
                                                    F.lit("' implements Serializable but doesn't define serialVersionUID"))))


def long_methods(c: Ctx) -> Column:
    def name(decl: Column) -> Column:
        n = T.extract(decl, METHOD_NAME, 1)
        return F.when(T.rlike(decl, METHOD_NAME), n).otherwise(F.lit("unknown"))

    found = per_match(
        c.content,
        _METHOD,
        lambda ln, g: loc(c, ln, F.concat(F.lit("Method '"), name(g[0]), F.lit("' is too long ("), _s(T.count_sub(g[1], "\n")),
                                          F.lit(" lines). Consider refactoring"))),
        groups=(0, 3),
        keep=lambda ln, g: T.count_sub(g[1], "\n") > 50,
    )
    return F.when(~T.rlike(c.content, _LONG_BLOCK), empty()).otherwise(found)


def complex_conditions(c: Ctx) -> Column:
    def ops(m: Column) -> Column:
        return T.count_sub(m, "&&") + T.count_sub(m, "||")

    return per_match(
        c.content,
        COMPLEX_CONDITION,
        lambda ln, g: loc(c, ln, F.concat(F.lit("Complex condition with "), _s(ops(g[0])),
                                          F.lit(" logical operators. Consider extracting into a separate method"))),
        groups=(0,),
        keep=lambda ln, g: ops(g[0]) >= 3,
    )


def resources(c: Ctx) -> Column:
    line = _first_line(c, RESOURCE)
    res = one_if(
        T.rlike(c.content, RESOURCE) & ~T.rlike(c.content, TRY_WITH_RESOURCES),
        line,
        loc(c, line, F.concat(F.lit("Using '"), T.extract(c.content, RESOURCE, 1),
                              F.lit("' without try-with-resources. Use 'try (Resource res = new Resource())' for automatic resource management"))),
    )
    pos = F.instr(c.content, ".close()")
    prefix = F.substr(c.content, F.lit(1), pos - 1)
    obj = T.extract(prefix, r"(\w+)$", 1)
    cline = T.count_sub(prefix, "\n") + 1
    close = one_if(
        (pos > 0) & ~F.contains(c.content, F.lit("finally")),
        cline,
        loc(c, cline, F.concat(F.lit("Manual closing of "), F.when(obj != "", obj).otherwise(F.lit("resource")),
                               F.lit(" without finally block. Use try-with-resources or ensure close() in finally"))),
        key=F.lit("F16"),
    )
    return F.concat(res, close)


def rules() -> list[Rule]:
    j = ("java",)
    return [
        Rule("F1", lambda c: per_match(c.content, CATCH_THROWABLE, lambda ln, g: loc(c, ln, F.concat(
            F.lit("Catching Throwable '"), g[0], F.lit("' is too broad. Catch more specific exceptions"))), groups=(1,)), j),
        Rule("F2", lambda c: F.when(~T.rlike(c.content, _EMPTY), empty()).otherwise(per_match(c.content, EMPTY_BLOCK_OR_REST, lambda ln, g: loc(c, ln, F.concat(
            F.lit("Empty "), g[0], F.lit(" block. Add comments explaining why or implement properly"))), groups=(1, 0),
            keep=lambda ln, g: T.rlike(g[1], r"\{\s*\}$"))), j),
        Rule("F3", null_checks, j),
        Rule("F4", public_fields, j),
        Rule("F5", try_blocks, j, prep=(("java_try", try_offsets),)),
        Rule("F7", lambda c: per_match(c.content, GENERIC_CATCH, lambda ln, g: loc(c, ln, F.concat(
            F.lit("Catching generic Exception '"), g[0], F.lit("'. Catch more specific exceptions"))), groups=(1,)), j),
        Rule("F8", hardcoded_strings, j),
        Rule("F10", imports, j),
        Rule("F12", serial_version, j),
        Rule("F13", long_methods, j),
        Rule("F14", complex_conditions, j),
        Rule("F15", resources, j),
    ]
