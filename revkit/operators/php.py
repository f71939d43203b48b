"""G: PHP rules. Every pattern is matched per line (all matches, byte
column + 1); issues are rendered grouped by severity and type (G25)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions import text as T
from revkit.operators.findings import Ctx, Rule, empty, finding

# PHP checks as (type, pattern in RE2 syntax, description, severity), in check order.
CHECKS = [
    ("SQL_INJECTION", r"(?i)(mysqli_query|->query|->exec|PDO::query)\s*\(\s*.*\$", "Potential SQL injection vulnerability. Use prepared statements with parameters", "Critical"),
    ("XSS", r"(?i)echo\s+\$_(GET|POST|REQUEST|COOKIE)", "Potential XSS vulnerability. Sanitize user input before output", "Critical"),
    ("COMMAND_INJECTION", r"(?i)(system|exec|shell_exec|passthru|proc_open)\s*\(\s*.*\$", "Potential command injection vulnerability. Validate and sanitize inputs", "Critical"),
    ("EVAL_USAGE", r"\b(eval|assert)\s*\(", "Use of eval() or assert() with dynamic content is dangerous and should be avoided", "Critical"),
    ("FILE_INCLUSION", r"(?i)(include|require|include_once|require_once)\s*\(\s*.*\$", "Potential file inclusion vulnerability. Validate file paths", "High"),
    ("CSRF_MISSING", r"""(?i)<form[^>]*method\s*=\s*["']post["'][^>]*>""", "Form without CSRF protection. Implement CSRF tokens", "High"),
    ("PASSWORD_HASH", r"(?i)(md5|sha1)\s*\(", "Weak hashing algorithm. Use password_hash() for passwords", "High"),
    ("OPEN_REDIRECT", r"""(?i)header\s*\(\s*["']Location:\s*\$""", "Potential open redirect vulnerability. Validate redirect URLs", "Medium"),
    ("DEPRECATED_FUNCTION", r"\b(mysql_|ereg_|split|create_function|mcrypt_|session_unregister|define_syslog_variables)\b", "Deprecated PHP function found. Update to modern alternatives", "Medium"),
    ("ERROR_SUPPRESSION", r"@[a-zA-Z0-9_]+\(", "Error suppression operator (@) used. Handle errors properly instead", "Medium"),
    ("HARDCODED_CREDENTIALS", r"""(?i)["'](password|passwd|pwd|secret|key)["']\s*=>\s*["'][^"']{4,}["']""", "Potential hardcoded credentials. Use environment variables or secure configuration", "High"),
    ("FILE_UPLOAD", r"(?i)\$_FILES\s*\[", "File upload detected. Ensure proper validation of file types and content", "Medium"),
    ("SESSION_SECURITY", r"(?i)session_start\s*\(", "Session management detected. Ensure proper session security", "Info"),
    ("MISSING_NAMESPACE", r"^<\?php", "No namespace defined. Modern PHP code should use namespaces", "Low"),
    ("LOWERCASE_CONSTANTS", r"const\s+([a-z][a-zA-Z0-9_]*)\s*=", "Constants should use uppercase names (CONST_NAME)", "Low"),
    ("MIXED_HTML_PHP", r"\?>.*<\?php", "Mixed PHP and HTML detected. Consider using a template engine", "Low"),
    ("VAR_DUMP_PRINT_R", r"\b(var_dump|print_r)\s*\(", "Debugging functions found. Remove before production", "Medium"),
    ("ISSET_EMPTY_COMPARISON", r"(?:==\s*null|!=\s*null|===\s*null|!==\s*null)", "Use isset() or empty() for null checks instead of comparison", "Low"),
    ("UNUSED_USE_STATEMENT", r"use\s+([^;]+);", "Potentially unused use statement. Verify usage", "Info"),
    ("GLOBAL_USAGE", r"global\s+\$", "Use of global variables. Consider dependency injection instead", "Medium"),
    ("EXIT_DIE_USAGE", r"\b(exit|die)\s*\(", "Use of exit() or die(). Consider structured exception handling instead", "Low"),
    ("INCONSISTENT_LINE_ENDINGS", r"\r\n.*\n", "Inconsistent line endings (mixed CRLF and LF)", "Info"),
]
#: What a text must hold for a check to match at all, in lower case: one of these. Looking for
#: them is much cheaper than trying a pattern at every character.
NEEDS = {
    "SQL_INJECTION": ("query", "->exec"), "XSS": ("$_",), "COMMAND_INJECTION": ("system", "exec", "passthru", "proc_open"),
    "EVAL_USAGE": ("eval", "assert"), "FILE_INCLUSION": ("include", "require"), "CSRF_MISSING": ("<form",), "PASSWORD_HASH": ("md5", "sha1"),
    "OPEN_REDIRECT": ("location:",), "ERROR_SUPPRESSION": ("@",), "HARDCODED_CREDENTIALS": ("=>",), "FILE_UPLOAD": ("$_files",),
    "DEPRECATED_FUNCTION": ("mysql_", "ereg_", "split", "create_function", "mcrypt_", "session_unregister", "define_syslog_variables"),
    "SESSION_SECURITY": ("session_start",), "MISSING_NAMESPACE": ("<?php",), "LOWERCASE_CONSTANTS": ("const",), "MIXED_HTML_PHP": ("?>",),
    "VAR_DUMP_PRINT_R": ("var_dump", "print_r"), "ISSET_EMPTY_COMPARISON": ("null",), "UNUSED_USE_STATEMENT": ("use",), "GLOBAL_USAGE": ("global",),
    "EXIT_DIE_USAGE": ("exit", "die"), "INCONSISTENT_LINE_ENDINGS": ("\r\n",),
}
HEADERS_TYPE = "MISSING_SECURITY_HEADERS"
HEADERS_DESC = "Missing security headers. Consider setting X-Frame-Options, X-XSS-Protection, etc."
EXTERNAL_TYPE = "PHPSTAN"
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]

SEV_RANK = {s: k for k, s in enumerate(SEVERITIES, start=1)}
TYPES = [t for t, _p, _d, _s in CHECKS] + [HEADERS_TYPE, EXTERNAL_TYPE]
EXTERNAL_SEQ = len(TYPES)
N_SLOTS = len(TYPES) * len(SEVERITIES)


def _hit(seq: int, line: Column, col: Column) -> Column:
    return F.struct(F.lit(seq).alias("type_seq"), line.cast("int").alias("line"), col.cast("int").alias("col"))


def _holds_one(s: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(s, F.lit(word)) for word in words))


def _line_hits(ctx: Ctx, pattern: str, seq: int, words: tuple[str, ...]) -> Column:
    def on_line(l: Column, i: Column) -> Column:
        # one matching pass rejects the (many) lines without a hit before the
        # tagging passes that locate byte columns
        hits = F.transform(T.match_byte_offsets(l, pattern), lambda o: _hit(seq, i + 1, o + 1))
        return F.when(_holds_one(F.get(ctx.extra["php_low_lines"], i), words) & T.rlike(l, pattern), hits).otherwise(F.array().cast(HIT))

    return F.flatten(F.transform(ctx.lines, on_line))


HIT = "array<struct<type_seq:int,line:int,col:int>>"


def folded(ctx: Ctx) -> Column:
    """The text in lower case; letters that "(?i)" takes for an ASCII one are that one."""
    s = ctx.content
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i"), ("\u212a", "k")):
        s = F.replace(s, F.lit(letter), F.lit(plain))
    return F.lower(s)


def hits(ctx: Ctx) -> Column:
    """(type_seq, line, byte col) of every issue, in check, line, column order."""
    parts = []
    for seq, (type_, pattern, _desc, _sev) in enumerate(CHECKS, start=1):
        # cheap guard: skip the per-line pass, and the pattern on a line, without any of the check's words
        found = _line_hits(ctx, pattern, seq, NEEDS[type_])
        parts.append(F.when(_holds_one(ctx.extra["php_low"], NEEDS[type_]), found).otherwise(F.array().cast(HIT)))
    controller = F.contains(ctx.path, F.lit("controller")) | F.contains(ctx.path, F.lit("Controller"))
    no_headers = ~F.contains(ctx.content, F.lit("X-Frame-Options")) & ~F.contains(ctx.content, F.lit("X-XSS-Protection"))
    parts.append(F.when(controller & no_headers, F.array(_hit(len(CHECKS) + 1, F.lit(1), F.lit(0)))).otherwise(F.array().cast(HIT)))
    return F.concat(*parts)


def _lookup(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx)


def decorate(h: Column, lines: Column) -> Column:
    """Issue structs with type, severity, description and snippet."""
    descs = [d for _t, _p, d, _s in CHECKS] + [HEADERS_DESC, ""]
    sevs = [s for _t, _p, _d, s in CHECKS] + ["Medium", "Medium"]
    return F.transform(
        h,
        lambda x, k: F.struct(
            _lookup(TYPES, x["type_seq"]).alias("type"),
            x["type_seq"].alias("type_seq"),
            _lookup(sevs, x["type_seq"]).alias("severity"),
            x["line"].alias("line"),
            x["col"].alias("col"),
            _lookup(descs, x["type_seq"]).alias("description"),
            F.when(x["type_seq"] <= len(CHECKS), T.snippet(lines, x["line"])).otherwise(F.lit("")).alias("snippet"),
            k.alias("ord"),
        ),
    )


def issues(ctx: Ctx) -> Column:
    return decorate(hits(ctx), ctx.lines)


def _rank(sev: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), sev).cast("int")


def sort_issues(iss: Column) -> Column:
    """Issues as struct(r = severity rank, v = issue), ordered by (rank, type order, arrival)."""
    keyed = F.transform(iss, lambda x: F.struct(_rank(x["severity"]).alias("r"), x["type_seq"].alias("t"), x["ord"].alias("o"), x.alias("v")))
    return F.transform(F.array_sort(keyed), lambda y: F.struct(y["r"].alias("r"), y["v"].alias("v")))


def _slot(y: Column) -> Column:
    return (y["v"]["type_seq"] - 1) * len(SEVERITIES) + y["r"]


def issue_counts(srt: Column) -> Column:
    """struct(per (type, severity) slot counts, per severity counts)."""
    return F.struct(
        F.transform(F.sequence(F.lit(1), F.lit(N_SLOTS)), lambda k: F.size(F.filter(srt, lambda y: _slot(y) == k))).alias("types"),
        F.transform(F.sequence(F.lit(1), F.lit(len(SEVERITIES))), lambda k: F.size(F.filter(srt, lambda y: y["r"] == k))).alias("sevs"),
    )


def render(srt: Column, counts: Column) -> Column:
    """Recommendation strings for one file's sorted issues.

    One pass over issues ordered by (severity rank, type order, arrival)
    emits a count header at each new severity and, per type, one summary
    line (more than 3 issues, first 3 line numbers) or one line per issue.
    ``srt`` and ``counts`` must be materialized columns (see ``rules``)."""
    slot = _slot
    return F.flatten(F.transform(srt, lambda y, i: _render_one(y, i, srt, counts["types"], counts["sevs"], slot)))


def _render_one(y: Column, i: Column, srt: Column, type_counts: Column, sev_counts: Column, slot) -> Column:
    x = y["v"]
    prev = F.get(srt, i - 1)
    first_sev = (i == 0) | (prev["r"] != y["r"])
    first_type = first_sev | (prev["v"]["type_seq"] != x["type_seq"])
    n_type = F.element_at(type_counts, slot(y))
    n_sev = F.element_at(sev_counts, y["r"])
    header = F.when(first_sev, F.array(finding(0, F.concat(F.lit("--- "), F.upper(x["severity"]), F.lit(" Issues ("),
                                                           n_sev.cast("string"), F.lit(") ---")))))
    first3 = F.array_join(F.transform(F.slice(srt, i + 1, 3), lambda z: F.concat(F.lit("line "), z["v"]["line"].cast("string"))), ", ")
    summary = F.when(first_type & (n_type > 3), F.array(finding(0, F.concat(
        x["type"], F.lit(": "), x["description"], F.lit(" (Found at "), first3, F.lit(" and "), (n_type - 3).cast("string"),
        F.lit(" more locations)")))))
    one = F.when(n_type <= 3, F.array(finding(x["line"], F.concat(
        x["type"], F.lit(" [L"), x["line"].cast("string"), F.lit(":C"), x["col"].cast("string"), F.lit("]: "), x["description"],
        F.when(x["snippet"] != "", F.concat(F.lit("\nCode context:\n"), x["snippet"])).otherwise(F.lit(""))), x["col"])))
    return F.concat(F.coalesce(header, empty()), F.coalesce(summary, empty()), F.coalesce(one, empty()))


PREP = (
    ("php_low", folded),
    ("php_low_lines", lambda c: T.lines(c.extra["php_low"])),
    ("php_issues", issues),
    ("php_sorted", lambda c: sort_issues(c.extra["php_issues"])),
    ("php_counts", lambda c: issue_counts(c.extra["php_sorted"])),
)


def rules() -> list[Rule]:
    return [Rule("G25", lambda c: render(c.extra["php_sorted"], c.extra["php_counts"]), ("php",), prep=PREP)]


def issue_rows(files: DataFrame) -> DataFrame:
    """G1-G23 as rows: (repo, path, type, severity, line, col, description, snippet)."""
    from revkit.operators.findings import prepare

    prepped, ctx = prepare(files, rules())
    # a bare column would give Spark a filter on its size, which it evaluates by all checks once more
    found = F.coalesce("php_issues", F.array().cast(prepped.schema["php_issues"].dataType))
    return prepped.select("repo", "path", F.explode(found).alias("i")).select("repo", "path", "i.*")


def external_report_issues(report_json: DataFrame, files: DataFrame) -> DataFrame:
    """A5 + G24: an external analyzer's JSON report per file -> issue rows.

    ``report_json`` has (repo, path, report STRING) in the PHPStan JSON
    shape (files -> messages). Severity comes from the message text.
    Snippets come from the file's lines by an equi join on (repo, path)."""
    schema = "files MAP<STRING, STRUCT<messages: ARRAY<STRUCT<message: STRING, line: INT, `column`: INT>>>>"
    parsed = report_json.select("repo", "path", F.from_json("report", schema).alias("r"))
    msgs = F.flatten(F.transform(F.map_values(F.col("r.files")), lambda f: f["messages"]))
    rows = parsed.select("repo", "path", F.posexplode(msgs).alias("ord", "m")).select(
        "repo", "path", "ord", F.col("m.message").alias("description"), F.col("m.line").alias("line"), F.col("m.column").alias("col")
    )
    d = F.col("description")
    sev = (
        F.when(F.contains(d, F.lit("security")) | F.contains(d, F.lit("injection")) | F.contains(d, F.lit("XSS")), F.lit("Critical"))
        .when(F.contains(d, F.lit("deprecated")), F.lit("Medium"))
        .when(F.contains(d, F.lit("unused")), F.lit("Low"))
        .otherwise(F.lit("Medium"))
    )
    lines = files.select("repo", "path", T.lines(F.col("content")).alias("all_lines"), F.col("content"))
    joined = rows.join(lines, ["repo", "path"], "left")
    snip = F.when(F.coalesce(F.col("content"), F.lit("")) != "", T.snippet(F.col("all_lines"), F.col("line"))).otherwise(F.lit(""))
    return joined.select(
        "repo", "path", F.lit(EXTERNAL_TYPE).alias("type"), F.lit(EXTERNAL_SEQ).alias("type_seq"), sev.alias("severity"),
        F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "description", snip.alias("snippet"),
        F.col("ord").cast("int").alias("ord"),
    )


def recommendations_with_report(files: DataFrame, external: DataFrame) -> DataFrame:
    """G25 over static issues plus external-report issues, per PHP file.

    External issues are grouped per file (bounded by one report) and joined
    to the file rows on (repo, path); they follow the static ones."""
    from revkit.operators.findings import prepare

    prepped, ctx = prepare(files, rules())
    ext = external.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.struct("type", "type_seq", "severity", "line", "col", "description",
                                                                 "snippet", "ord").alias("i")))).alias("ext")
    )
    both = prepped.join(ext, ["repo", "path"], "left")
    static = F.col("php_issues")
    extra = F.transform(F.coalesce(F.col("ext"), F.array()), lambda e: e["i"].withField("ord", e["i"]["ord"] + F.size(static)))
    staged = both.select("repo", "path", sort_issues(F.concat(static, extra)).alias("srt"))
    staged = staged.select("repo", "path", "srt", issue_counts(F.col("srt")).alias("cnt"))
    return staged.select("repo", "path", F.posexplode(render(F.col("srt"), F.col("cnt"))).alias("occ", "f")).select(
        "repo", "path", (F.col("occ") + 1).alias("occ"), F.col("f.msg").alias("recommendation")
    )
