"""Registered file-rule queries (D, E) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import aspects as D
from revkit.operators import common as E
from revkit.operators.analyze import analyze
from revkit.operators.findings import run_rules
from revkit.plans.queries import register
from revkit.plans.sqlkit import FILES_CTE, count_sub, has, match_lines_sql, nl_count, q, rl
from revkit.sources.files import derived_files

OUT = ["repo", "path", "rule_id", "occ", "line", "recommendation"]


def shape(found: DataFrame) -> DataFrame:
    return found.select(
        "repo", "path", "rule_id", F.col("occ").cast("bigint").alias("occ"), F.col("line").cast("bigint").alias("line"),
        F.col("msg").alias("recommendation"),
    )


# ------------------------------------------------------------------ D aspects

def _names_sql(pattern: str, cond: str) -> str:
    """Group-1 names of matches whose full text satisfies cond(m)."""
    ms = f"regexp_extract_all(content, {q(pattern)}, 0)"
    ns = f"regexp_extract_all(content, {q(pattern)}, 1)"
    return (
        f"list_filter(list_transform(generate_series(1, len({ms})), lambda i: CASE WHEN {cond.format(m=f'{ms}[i]')} THEN {ns}[i] END), "
        f"lambda x: x IS NOT NULL)"
    )


_PY_CX = _names_sql(D.PY_FUNC, count_sub("{m}", "    ") + " > 2")
_GO_CX = _names_sql(D.GO_FUNC, "(" + count_sub("{m}", "for") + " > 1 OR " + count_sub("{m}", "if") + " > 2)")
_POOR = f"list_filter(regexp_extract_all(content, {q(D.NAME)}), lambda v: length(v) = 1 OR contains(v, 'temp') OR contains(v, 'tmp'))"


def _first_replace(s: str, old: str, new: str) -> str:
    return f"(CASE WHEN strpos({s}, {q(old)}) > 0 THEN substr({s}, 1, strpos({s}, {q(old)}) - 1) || {q(new)} || substr({s}, strpos({s}, {q(old)}) + {len(old)}) ELSE {s} END)"


_TP = _first_replace(_first_replace("path", ".py", "_test.py"), ".go", "_test.go")

ASPECTS_SQL = f"""WITH {FILES_CTE},
k AS (SELECT * FROM files WHERE lang <> 'unknown'),
d AS (
  SELECT repo, path, lang, content, {_TP} AS tp,
    CASE lang WHEN 'python' THEN {rl('content', D.PY_DOCSTRING)} WHEN 'go' THEN {rl('content', D.GO_COMMENT)} ELSE true END AS documented,
    CASE lang WHEN 'python' THEN {has('content', 'try:')} AND {has('content', 'except')} WHEN 'go' THEN {has('content', 'if err != nil')} ELSE true END AS handles,
    CASE lang WHEN 'python' THEN {_PY_CX} WHEN 'go' THEN {_GO_CX} ELSE []::VARCHAR[] END AS cx,
    CASE WHEN lang IN ('python', 'go') THEN {_POOR} ELSE []::VARCHAR[] END AS poor,
    CASE lang WHEN 'python' THEN NOT contains(content, chr(9)) WHEN 'go' THEN starts_with(content, 'package ') AND NOT contains(content, repeat(chr(9), 4)) ELSE true END AS structured,
    len(list_filter(string_split(content, chr(10)), lambda l: strlen(l) > 100 OR {count_sub('l', '&&')} > 2 OR {count_sub('l', '||')} > 2)) > 0 AS cexpr,
    {rl('content', D.TODO_COMMENT)} AS todo,
    CASE WHEN lang = 'python' AND ({has('content', 'print ')} OR {has('content', 'urllib2')}) THEN 'print statement (use print()), urllib2 (use requests)'
         WHEN lang = 'go' AND {has('content', 'ioutil.')} THEN 'ioutil (use io/fs)' END AS depr,
    {nl_count('content')} > 300 AS big,
    lang = 'python' AND NOT {has('content', 'typing.')} AND NOT {has('content', 'from typing import')} AS nohints,
    lang = 'go' AND {has('content', 'var ')} AND NOT {has('content', ':=')} AS shortvar
  FROM k
)
SELECT repo, path, 'D1' AS rule_id, 1::BIGINT AS occ, 0::BIGINT AS line, 'Add more documentation to ' || path || ' to improve code understanding' AS recommendation FROM d WHERE NOT documented
UNION ALL SELECT repo, path, 'D2', 1, 0, 'Improve error handling in ' || path FROM d WHERE NOT handles
UNION ALL SELECT repo, path, 'D3', 1, 0, 'Create unit tests for ' || path FROM d
  WHERE NOT contains(lower(path), 'test') AND NOT (tp <> path AND EXISTS (SELECT 1 FROM k k2 WHERE k2.repo = d.repo AND k2.path = d.tp))
UNION ALL SELECT repo, path, 'D4', 1, 0, 'Consider breaking down complex functions in ' || path || ': ' || array_to_string(cx, ', ') FROM d WHERE len(cx) > 0
UNION ALL SELECT repo, path, 'D5', 1, 0, 'Improve naming clarity in ' || path || ' for: ' || array_to_string(poor, ', ') FROM d WHERE len(poor) > 0
UNION ALL SELECT repo, path, 'D6', 1, 0, 'Improve code structure and organization in ' || path FROM d WHERE NOT structured
UNION ALL SELECT repo, path, 'D7', 1, 0, 'Simplify complex expressions in ' || path FROM d WHERE cexpr
UNION ALL SELECT repo, path, 'D8', 1, 0, 'Address TODO comments in ' || path FROM d WHERE todo
UNION ALL SELECT repo, path, 'D9', 1, 0, 'Update deprecated features in ' || path || ': ' || depr FROM d WHERE depr IS NOT NULL
UNION ALL SELECT repo, path, 'D10', 1, 0, 'Consider breaking this file into smaller modules' FROM d WHERE big
UNION ALL SELECT repo, path, 'D10', 1 + big::BIGINT, 0, 'Consider adding type hints for better code maintainability' FROM d WHERE nohints
UNION ALL SELECT repo, path, 'D10', 1 + big::BIGINT, 0, 'Consider using := for shorter variable declarations where appropriate' FROM d WHERE shortvar"""


@register("aspect_findings", ASPECTS_SQL)
def q_aspect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D14 with the default aspect list, every known-language file."""
    return shape(analyze(derived_files(spark, sf_dir), langs=()))


# ------------------------------------------------------------------ E common

def _occ_sql(rule_id: str, pattern: str, msg: str, where: str = "lang = 'java'") -> str:
    ms = f"regexp_extract_all(content, {q(pattern)})"
    return f"""SELECT repo, path, {q(rule_id)} AS rule_id, generate_subscripts({ms}, 1)::BIGINT AS occ,
    unnest({match_lines_sql('content', pattern)})::BIGINT AS line, unnest({ms}) AS m FROM files WHERE {where}"""


def _line_sql(rule_id: str, cond: str, where: str = "lang = 'java'") -> str:
    return f"""SELECT repo, path, {q(rule_id)} AS rule_id, n AS line, l FROM (
      SELECT repo, path, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS n
      FROM files WHERE {where}) WHERE {cond}"""


def _lines_numbered(sub: str, msg: str) -> str:
    return f"""SELECT repo, path, rule_id, row_number() OVER (PARTITION BY repo, path ORDER BY line)::BIGINT AS occ, line,
    path || ':' || CAST(line AS VARCHAR) || ': ' || {msg} AS recommendation FROM ({sub})"""


def _occ_out(sub: str, msg: str) -> str:
    return f"SELECT repo, path, rule_id, occ, line, path || ':' || CAST(line AS VARCHAR) || ': ' || {msg} AS recommendation FROM ({sub})"


COMMON_SQL = f"""WITH {FILES_CTE}
{_occ_out(_occ_sql('E1', E.TODO, ''), q('Review TODO/FIXME'))}
UNION ALL {_lines_numbered(_line_sql('E2', rl('l', E.LONG_LINE)), "'Line too long (' || CAST(strlen(l) AS VARCHAR) || ' chars)'")}
UNION ALL {_lines_numbered(_line_sql('E3', rl('l', E.TRAILING_WS)), q('Trailing whitespace'))}
UNION ALL {_occ_out(_occ_sql('E4', E.DEBUG_PRINT, ''), q('Remove debug print statement'))}
UNION ALL {_occ_out(_occ_sql('E5', E.COMMENTED_OUT, ''), q('Review commented-out code'))}
UNION ALL {_lines_numbered(_line_sql('E6', rl('l', E.COMPLEX_COMPARISON)), q('Simplify complex comparison'))}
UNION ALL {_occ_out(_occ_sql('E7', E.MAGIC_NUMBER, ''), "'Use named constant instead of magic number ''' || m || ''''")}"""


@register("common_findings", COMMON_SQL)
def q_common_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E7 (CommonChecks) on every Java file."""
    files = derived_files(spark, sf_dir).where(F.col("lang") == "java")
    return shape(run_rules(files, E.rules()))


# ------------------------------------------------------------------ G PHP

def _snippet_sql(lines: str, n: str) -> str:
    return (
        f"array_to_string(list_transform(generate_series(greatest(0, {n} - 2), least(len({lines}), {n} + 1) - 1), "
        f"lambda i: CASE WHEN i = {n} - 1 THEN '--> ' ELSE '    ' END || CAST(i + 1 AS VARCHAR) || ': ' || {lines}[i + 1] || chr(10)), '')"
    )


def _offsets_sql(s: str, pattern: str) -> str:
    p = q(pattern)
    parts = f"regexp_split_to_array({s}, {p})"
    ms = f"regexp_extract_all({s}, {p})"
    return f"list_transform({ms}, lambda x, k: strlen(array_to_string({parts}[1:k], '') || array_to_string({ms}[1:k-1], '')))"


def _php_issues_sql() -> str:
    from revkit.operators import php as G

    sel = []
    for seq, (t, p, d, s) in enumerate(G.CHECKS, start=1):
        sel.append(
            f"""SELECT repo, path, {q(t)} AS type, {seq} AS type_seq, {q(s)} AS severity, n AS line, o + 1 AS col, {q(d)} AS description, {_snippet_sql('all_lines', 'n')} AS snippet
  FROM (SELECT repo, path, all_lines, n, unnest({_offsets_sql('line_text', p)}) AS o FROM ln)"""
        )
    sel.append(
        f"""SELECT repo, path, {q(G.HEADERS_TYPE)}, {len(G.CHECKS) + 1}, 'Medium', 1, 0, {q(G.HEADERS_DESC)}, '' FROM p
  WHERE (contains(path, 'controller') OR contains(path, 'Controller')) AND NOT contains(content, 'X-Frame-Options') AND NOT contains(content, 'X-XSS-Protection')"""
    )
    return f"""WITH {FILES_CTE},
p AS (SELECT repo, path, content, string_split(content, chr(10)) AS all_lines FROM files WHERE lang = 'php'),
ln AS (SELECT repo, path, all_lines, unnest(all_lines) AS line_text, generate_subscripts(all_lines, 1) AS n FROM p),
iss AS (
{chr(10).join(('  ' if i == 0 else '  UNION ALL ') + s for i, s in enumerate(sel))}
)"""


PHP_ISSUES_SQL = _php_issues_sql() + """
SELECT repo, path, type, severity, CAST(line AS INT) AS line, CAST(col AS INT) AS col, description, snippet FROM iss"""


@register("php_issues", PHP_ISSUES_SQL)
def q_php_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every PHP issue with line, byte column and context snippet."""
    from revkit.operators import php as G

    files = derived_files(spark, sf_dir).where(F.col("lang") == "php")
    return G.issue_rows(files).select("repo", "path", "type", "severity", "line", "col", "description", "snippet")


PHP_RECS_SQL = _php_issues_sql() + """,
r AS (SELECT *, CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 ELSE 5 END AS sr,
        count(*) OVER (PARTITION BY repo, path, type) AS tc,
        row_number() OVER (PARTITION BY repo, path, type ORDER BY line, col) AS tn FROM iss),
rows AS (
  SELECT repo, path, sr, 0 AS ts, 0 AS l, 0 AS c, '--- ' || upper(severity) || ' Issues (' || CAST(count(*) AS VARCHAR) || ') ---' AS rec
    FROM r GROUP BY repo, path, sr, severity
  UNION ALL
  SELECT repo, path, sr, type_seq, 0, 0, type || ': ' || first(description) || ' (Found at '
      || string_agg(CASE WHEN tn <= 3 THEN 'line ' || CAST(line AS VARCHAR) END, ', ' ORDER BY line, col) || ' and ' || CAST(count(*) - 3 AS VARCHAR) || ' more locations)'
    FROM r WHERE tc > 3 GROUP BY repo, path, sr, type_seq, type
  UNION ALL
  SELECT repo, path, sr, type_seq, line, col, type || ' [L' || CAST(line AS VARCHAR) || ':C' || CAST(col AS VARCHAR) || ']: ' || description
      || CASE WHEN snippet <> '' THEN chr(10) || 'Code context:' || chr(10) || snippet ELSE '' END
    FROM r WHERE tc <= 3
)
SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY sr, ts, l, c)::BIGINT AS occ, rec AS recommendation FROM rows"""


@register("php_recommendations", PHP_RECS_SQL)
def q_php_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G25 over G1-G23: severity-grouped recommendation lines per PHP file."""
    files = derived_files(spark, sf_dir).where(F.col("lang") == "php")
    found = analyze(files, langs=("php",), with_aspects=False)
    return found.select("repo", "path", F.col("occ").cast("bigint").alias("occ"), F.col("msg").alias("recommendation"))


# ------------------------------------------------------------------ F Java

def _occ_groups(rule_id: str, pattern: str, groups=(), table: str = "j") -> str:
    """Rows per match: repo, path, rule_id, k, line, m0, g<n>..."""
    p = q(pattern)
    extra = "".join(f", unnest(regexp_extract_all(content, {p}, {g})) AS g{g}" for g in groups)
    return f"""SELECT repo, path, {q(rule_id)} AS rule_id, generate_subscripts(regexp_extract_all(content, {p}), 1) AS k,
      unnest({match_lines_sql('content', pattern)}) AS line, unnest(regexp_extract_all(content, {p})) AS m0{extra} FROM {table}"""


def _char_offsets_sql(s: str, pattern: str) -> str:
    p = q(pattern)
    parts = f"regexp_split_to_array({s}, {p})"
    ms = f"regexp_extract_all({s}, {p})"
    return f"list_transform({ms}, lambda x, k: length(array_to_string({parts}[1:k], '') || array_to_string({ms}[1:k-1], '')))"


def _loc(msg: str, line: str = "line") -> str:
    return f"path || ':' || CAST({line} AS VARCHAR) || ': ' || {msg}"


def _java_sql() -> str:
    from revkit.operators import java as J

    lit = lambda s: q(s)
    first_line = lambda p: f"({match_lines_sql('content', p)})[1]"
    byte_cut = (
        "substr(g1, 1, list_max(list_filter(generate_series(0, 17), lambda i: strlen(substr(g1, 1, i)) <= 17))) || "
        "CASE WHEN strlen(substr(g1, 1, list_max(list_filter(generate_series(0, 17), lambda i: strlen(substr(g1, 1, i)) <= 17)))) < 17 "
        "THEN chr(65533) ELSE '' END"
    )
    name_sql = f"CASE WHEN {rl('m0', J.METHOD_NAME)} THEN regexp_extract(m0, {q(J.METHOD_NAME)}, 1) ELSE 'unknown' END"
    ops = f"({count_sub('m0', '&&')} + {count_sub('m0', '||')})"
    close_prefix = "substr(content, 1, strpos(content, '.close()') - 1)"
    return f"""WITH {FILES_CTE},
j AS (SELECT repo, path, content FROM files WHERE lang = 'java'),
f1 AS ({_occ_groups('F1', J.CATCH_THROWABLE, (1,))}),
f2 AS ({_occ_groups('F2', J.EMPTY_BLOCK, (1,))}),
f4 AS ({_occ_groups('F4', J.PUBLIC_FIELD, (1, 2))}),
tr AS (
  SELECT repo, path, content, unnest({_char_offsets_sql('content', J.TRY)}) AS o, unnest({match_lines_sql('content', J.TRY)}) AS line,
    generate_subscripts(regexp_extract_all(content, {q(J.TRY)}), 1) AS k,
    greatest(coalesce(list_max({_char_offsets_sql('content', J.CATCH)}), -1), coalesce(list_max({_char_offsets_sql('content', J.FINALLY)}), -1)) AS lh,
    {_char_offsets_sql('content', J.EMPTY_CATCH)} AS eco, {match_lines_sql('content', J.EMPTY_CATCH)} AS ecl
  FROM j
),
tr2 AS (SELECT *, list_position(list_transform(eco, lambda x: x >= o), true) AS fe FROM tr),
f5 AS (
  SELECT repo, path, k, 0 AS sub, line, {_loc(lit('Try block without catch or finally. Ensure proper exception handling'))} AS rec FROM tr2
    WHERE NOT (strlen(content) > strlen(substr(content, 1, o)) + 4 AND lh >= o)
  UNION ALL
  SELECT repo, path, k, 1, ecl[fe], {_loc(lit('Empty catch block suppresses exceptions. At minimum, add a comment or log'), 'ecl[fe]')} FROM tr2 WHERE fe IS NOT NULL
),
f7 AS ({_occ_groups('F7', J.GENERIC_CATCH, (1,))}),
f8 AS ({_occ_groups('F8', J.STRING_LITERAL, (1,))}),
f8n AS (SELECT repo, path, count(*) AS n FROM f8 GROUP BY repo, path),
f10 AS (SELECT repo, path, content, regexp_extract_all(content, {q(J.IMPORT)}, 1) AS names FROM j),
f13 AS ({_occ_groups('F13', J.METHOD, (3,))}),
f14 AS ({_occ_groups('F14', J.COMPLEX_CONDITION, ())}),
res AS (
  SELECT repo, path, 'F1' AS rule_id, k AS occ, line, {_loc("'Catching Throwable ''' || g1 || ''' is too broad. Catch more specific exceptions'")} AS rec FROM f1
  UNION ALL SELECT repo, path, 'F2', k, line, {_loc("'Empty ' || g1 || ' block. Add comments explaining why or implement properly'")} FROM f2
  UNION ALL SELECT repo, path, 'F3', 1, {first_line(J.NULL_CHECK)},
      {_loc("'Found ' || CAST(len(regexp_extract_all(content, " + q(J.NULL_CHECK) + ")) AS VARCHAR) || ' null checks (e.g., ''' || CASE WHEN regexp_extract(content, " + q(J.NULL_CHECK) + ", 1) <> '' THEN regexp_extract(content, " + q(J.NULL_CHECK) + ", 1) ELSE regexp_extract(content, " + q(J.NULL_CHECK) + ", 2) END || '''). Consider using Objects.isNull() and Objects.nonNull()'", first_line(J.NULL_CHECK))}
    FROM j WHERE len(regexp_extract_all(content, {q(J.NULL_CHECK)})) > 5
  UNION ALL SELECT repo, path, 'F4', row_number() OVER (PARTITION BY repo, path ORDER BY k), line,
      {_loc("'Public field ''' || g1 || ' ' || g2 || '''. Consider using private fields with getter/setter methods'")}
    FROM f4 WHERE NOT {rl("split_part(m0, chr(10), 1)", J.NON_FIELD)}
  UNION ALL SELECT repo, path, 'F5', row_number() OVER (PARTITION BY repo, path ORDER BY k, sub), line, rec FROM f5
  UNION ALL SELECT repo, path, 'F7', k, line, {_loc("'Catching generic Exception ''' || g1 || '''. Catch more specific exceptions'")} FROM f7
  UNION ALL SELECT f8.repo, f8.path, 'F8', k, line,
      {_loc("'Long string literal \"' || CASE WHEN strlen(g1) > 20 THEN " + byte_cut + " || '...' ELSE g1 END || '\". Consider using string constants or resource bundles'")}
    FROM f8 JOIN f8n USING (repo, path) WHERE n > 3 AND k <= 3
  UNION ALL SELECT repo, path, 'F8', 4, 0, path || ': Found ' || CAST(n - 3 AS VARCHAR) || ' more long string literals. Consider using string constants or resource bundles' FROM f8n WHERE n > 3
  UNION ALL SELECT repo, path, 'F10', 1, {first_line(J.IMPORT)},
      {_loc("'Found ' || CAST(len(names) AS VARCHAR) || ' imports (e.g., ' || array_to_string(names[1:3], ', ') || '). Consider refactoring to reduce dependencies'", first_line(J.IMPORT))}
    FROM f10 WHERE len(names) > 30
  UNION ALL SELECT repo, path, 'F10', 1 + (len(names) > 30)::INT, {first_line(J.WILDCARD_IMPORT)},
      {_loc("'Wildcard import ''' || trim(regexp_extract(content, " + q(J.WILDCARD_IMPORT) + ", 0)) || '''. Import specific classes instead'", first_line(J.WILDCARD_IMPORT))}
    FROM f10 WHERE {rl('content', J.WILDCARD_IMPORT)}
  UNION ALL SELECT repo, path, 'F12', 1, {first_line(J.SERIALIZABLE_CLASS)},
      {_loc("'Class ''' || regexp_extract(content, " + q(J.SERIALIZABLE_CLASS) + ", 1) || ''' implements Serializable but doesn''t define serialVersionUID'", first_line(J.SERIALIZABLE_CLASS))}
    FROM j WHERE (contains(content, 'implements Serializable') OR contains(content, 'extends.*Serializable'))
      AND {rl('content', J.SERIALIZABLE_CLASS)} AND NOT contains(content, 'serialVersionUID')
  UNION ALL SELECT repo, path, 'F13', row_number() OVER (PARTITION BY repo, path ORDER BY k), line,
      {_loc("'Method ''' || " + name_sql + " || ''' is too long (' || CAST(" + count_sub('g3', chr(10)) + " AS VARCHAR) || ' lines). Consider refactoring'")}
    FROM f13 WHERE {count_sub('g3', chr(10))} > 50
  UNION ALL SELECT repo, path, 'F14', row_number() OVER (PARTITION BY repo, path ORDER BY k), line,
      {_loc("'Complex condition with ' || CAST(" + ops + " AS VARCHAR) || ' logical operators. Consider extracting into a separate method'")}
    FROM f14 WHERE {ops} >= 3
  UNION ALL SELECT repo, path, 'F15', 1, {first_line(J.RESOURCE)},
      {_loc("'Using ''' || regexp_extract(content, " + q(J.RESOURCE) + ", 1) || ''' without try-with-resources. Use ''try (Resource res = new Resource())'' for automatic resource management'", first_line(J.RESOURCE))}
    FROM j WHERE {rl('content', J.RESOURCE)} AND NOT {rl('content', J.TRY_WITH_RESOURCES)}
  UNION ALL SELECT repo, path, 'F15', 1 + ({rl('content', J.RESOURCE)} AND NOT {rl('content', J.TRY_WITH_RESOURCES)})::INT, {nl_count(close_prefix)} + 1,
      {_loc("'Manual closing of ' || CASE WHEN regexp_extract(" + close_prefix + ", '(\\w+)$', 1) <> '' THEN regexp_extract(" + close_prefix + ", '(\\w+)$', 1) ELSE 'resource' END || ' without finally block. Use try-with-resources or ensure close() in finally'", nl_count(close_prefix) + " + 1")}
    FROM j WHERE strpos(content, '.close()') > 0 AND NOT contains(content, 'finally')
)
SELECT repo, path, rule_id, CAST(occ AS BIGINT) AS occ, CAST(line AS BIGINT) AS line, rec AS recommendation FROM res"""


JAVA_SQL = _java_sql()


@register("java_findings", JAVA_SQL)
def q_java_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1-F16 on every Java file (language rules after E1-E7)."""
    from revkit.operators import java as J

    files = derived_files(spark, sf_dir).where(F.col("lang") == "java")
    return shape(run_rules(files, J.rules()))


# ------------------------------------------------------------------ H Python

PY_FSM_CODES = ("PYL001", "PYL003", "PYL302", "PYL502")
_GOSP = "[\\t\\n\\x{0B}\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + _GOSP + '+|' + _GOSP + '+$')}, '', 'g')"


def _bidx(s: str, sub: str) -> str:
    return f"(CASE WHEN strpos({s}, {sub}) > 0 THEN strlen(substr({s}, 1, strpos({s}, {sub}) - 1)) ELSE -1 END)"


def _py_out(line: str, col: str, sev: str, code: str, msg: str) -> str:
    return (
        f"SELECT repo, path, {q(code)} AS code, CAST({line} AS BIGINT) AS line, base || ':' || CAST({line} AS VARCHAR) || "
        f"CASE WHEN ({col}) > 0 THEN ':' || CAST({col} AS VARCHAR) ELSE '' END || ' [{sev}] {code}: ' || {msg} AS recommendation"
    )


def _python_sql() -> str:
    from revkit.operators import python as H

    has_doc = (
        "((n < total AND (starts_with(t1, '\"\"\"') OR starts_with(t1, ''''''''))) OR "
        "(n < total AND NOT (t1 <> '' AND NOT starts_with(t1, '#') AND t1 <> 'pass') AND n + 1 < total AND (starts_with(t2, '\"\"\"') OR starts_with(t2, ''''''''))))"
    )
    fields = f"list_filter(regexp_split_to_array(l, {q(_GOSP + '+')}), lambda x: x <> '')"
    mut2 = f"regexp_extract(l, {q(H.MUTABLE_DEFAULT)}, 2)"
    name = f"regexp_extract(l, {q(H.ASSIGN)}, 1)"
    kind = f"regexp_extract(l, {q(H.DEF_OR_CLASS)}, 1)"
    dname = f"regexp_extract(l, {q(H.DEF_OR_CLASS)}, 2)"
    return f"""WITH {FILES_CTE},
p AS (SELECT repo, path, regexp_extract(path, '[^/]*$') AS base, string_split(content, chr(10)) AS ls FROM files WHERE lang = 'python'),
ln AS (SELECT repo, path, base, ls, len(ls) AS total, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM p),
t AS (SELECT *, {_trim('l')} AS tr, {_trim('ls[n + 1]')} AS t1, {_trim('ls[n + 2]')} AS t2 FROM ln),
imp AS (
  SELECT repo, path, base, n,
    CASE WHEN contains(tr, 'my_local_module') THEN 'local' WHEN contains(tr, 'requests') OR contains(tr, 'numpy') THEN 'third-party' ELSE 'standard' END AS grp,
    CASE WHEN len({fields}) > 1 AND {fields}[1] IN ('import', 'from') THEN {fields}[2] ELSE l END AS nm
  FROM t WHERE starts_with(tr, 'import ') OR starts_with(tr, 'from ')
),
imp2 AS (SELECT *, lag(nm) OVER (PARTITION BY repo, path, grp ORDER BY n) AS prev FROM imp),
grp AS (
  SELECT repo, path, base,
    max(n) FILTER (WHERE grp = 'standard') AS s_max, min(n) FILTER (WHERE grp = 'third-party') AS tp_min,
    max(n) FILTER (WHERE grp = 'third-party') AS tp_max, min(n) FILTER (WHERE grp = 'local') AS l_min
  FROM imp GROUP BY repo, path, base
),
res AS (
  {_py_out('n', '1', 'error', 'PYL002', q('Mixed tab and space indentation'))} FROM t WHERE NOT (tr = '' OR starts_with(tr, '#')) AND contains(l, chr(9)) AND contains(l, '    ')
  UNION ALL {_py_out('n', _bidx('l', "'except'") + ' + 1', 'warning', 'PYL101', q("Bare 'except:' clause used. Always catch specific exceptions"))} FROM t WHERE {rl('l', H.EXCEPT_BARE)}
  UNION ALL {_py_out('n', _bidx('l', "'except'") + ' + 1', 'warning', 'PYL102', q("'except Exception:' used. Catch specific exceptions instead"))} FROM t WHERE {rl('l', H.EXCEPT_EXCEPTION)}
  UNION ALL {_py_out('n + 1', '1', 'warning', 'PYL103', q("Empty except block with 'pass'. Either handle the exception or add a comment explaining why it is ignored"))}
    FROM t WHERE contains(l, 'except') AND n < total AND t1 = 'pass'
  UNION ALL {_py_out('n', _bidx('l', "'import *'") + ' + 1', 'warning', 'PYL201', "'Wildcard import from ''' || regexp_extract(l, " + q(H.IMPORT_STAR) + ", 1) || '''. Explicitly import only what you need'")}
    FROM t WHERE {rl('l', H.IMPORT_STAR)}
  UNION ALL {_py_out('n', '1', 'info', 'PYL202', "'Imports in group ''' || grp || ''' are not in alphabetical order'")} FROM imp2 WHERE prev > nm
  UNION ALL {_py_out('tp_min', '1', 'info', 'PYL203', q('Imports are not grouped in the correct order (standard, third-party, local)'))} FROM grp WHERE s_max > tp_min
  UNION ALL {_py_out('l_min', '1', 'info', 'PYL203', q('Imports are not grouped in the correct order (standard, third-party, local)'))} FROM grp
    WHERE (s_max IS NOT NULL AND tp_min IS NULL AND s_max > l_min) OR (s_max IS NOT NULL AND tp_max > l_min)
  UNION ALL {_py_out('n', _bidx('l', mut2) + ' + 1', 'warning', 'PYL301', "'Mutable default argument ''' || regexp_extract(l, " + q(H.MUTABLE_DEFAULT) + ", 1) || '=' || " + mut2 + " || ''' can cause unexpected behavior'")}
    FROM t WHERE NOT (tr = '' OR starts_with(tr, '#')) AND {rl('l', H.MUTABLE_DEFAULT)}
  UNION ALL {_py_out('n', _bidx('l', name) + ' + 1', 'info', 'PYL401', "'Variable ''' || " + name + " || ''' appears to be a constant but doesn''t follow UPPER_CASE naming'")}
    FROM t WHERE {rl('l', H.ASSIGN)} AND NOT (starts_with({name}, '__') AND ends_with({name}, '__')) AND upper({name}) = {name} AND NOT {rl(name, H.CONSTANT)}
  UNION ALL {_py_out('n', _bidx('l', name) + ' + 1', 'info', 'PYL402', "'Variable ''' || " + name + " || ''' uses camelCase but Python convention is snake_case'")}
    FROM t WHERE {rl('l', H.ASSIGN)} AND NOT (starts_with({name}, '__') AND ends_with({name}, '__')) AND NOT {rl(name, H.CONSTANT)} AND NOT {rl(name, H.SNAKE)} AND {rl(name, H.CAMEL)}
  UNION ALL {_py_out('n', '100', 'info', 'PYL501', "'Line too long (' || CAST(strlen(l) AS VARCHAR) || ' characters, max suggested 100)'")} FROM t WHERE strlen(l) > 100
  UNION ALL {_py_out('n', '1', 'error', 'PYL601', q('Potential SQL injection vulnerability. Use parameterized queries instead'))} FROM t WHERE {rl('l', H.SQL_INJECTION)}
  UNION ALL {_py_out('n', '1', 'error', 'PYL602', q('Potential shell injection vulnerability. Sanitize user input before using in shell commands'))} FROM t WHERE {rl('l', H.SHELL_INJECTION)}
  UNION ALL {_py_out('n', _bidx('lower(l)', "'password'"), 'error', 'PYL603', q('Hard-coded password detected. Use environment variables or a secure configuration system'))}
    FROM t WHERE contains(l, 'password') AND (contains(l, '=') OR contains(l, ':')) AND {rl('l', H.PASSWORD)}
  UNION ALL {_py_out('n + 1', '1', 'warning', 'PYL701', q('List concatenation in loop is inefficient. Consider using list.append() or a list comprehension'))}
    FROM t WHERE contains(tr, 'for ') AND n < total AND contains(ls[n + 1], ' += [')
  UNION ALL {_py_out('n', '1', 'warning', 'PYL702', q("String concatenation in loop is inefficient. Use ''.join() or string formatting instead"))}
    FROM t WHERE contains(tr, 'for ') AND n + 1 < total AND (contains(ls[n + 1] || ls[n + 2], ' += "') OR contains(ls[n + 1] || ls[n + 2], ' += ' || chr(39)))
  UNION ALL {_py_out('n', _bidx('l', kind), 'info', 'PYL801', "'Missing docstring for ' || " + kind + " || ' ''' || " + dname + " || ''''")}
    FROM t WHERE {rl('l', H.DEF_OR_CLASS)} AND NOT (starts_with({dname}, '_') AND NOT starts_with({dname}, '__') AND NOT ends_with({dname}, '__')) AND NOT {has_doc}
)
SELECT * FROM res"""


PYTHON_SQL = _python_sql()


def _python_rows(spark: SparkSession, sf_dir: str, bundles: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the named rule bundles (default: all) on every Python file."""
    from revkit.operators import python as H

    files = derived_files(spark, sf_dir).where(F.col("lang") == "python")
    found = run_rules(files, [r for r in H.rules() if not bundles or r.rule_id in bundles])
    return found.select(
        "repo", "path", F.regexp_extract("msg", r" (PYL\d+): ", 1).alias("code"), F.col("line").cast("bigint").alias("line"),
        F.col("msg").alias("recommendation"),
    )


@register("python_findings", PYTHON_SQL)
def q_python_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H4-H11, H13, H15-H17, H19-H24 on every Python file."""
    bundles = ("H2", "H4", "H7", "H13", "H15", "H17", "H19", "H22", "H24")
    return _python_rows(spark, sf_dir, bundles).where(~F.col("code").isin(*PY_FSM_CODES))


@register("python_stateful_findings")
def q_python_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 (delimiter stack), H3 (indent stack), H14 (function length), H18
    (quote balance): order-dependent folds; checked against hand fixtures."""
    return _python_rows(spark, sf_dir, ("H1", "H2", "H13", "H17")).where(F.col("code").isin(*PY_FSM_CODES))


# ------------------------------------------------------------------ I Go

GO_KIND = [
    ("Package lacks documentation comment", "I1"), ("Blank import found", "I2"), ("statements, consider refactoring", "I3"),
    ("Exported function '", "I4"), ("Naked return in function", "I5"), ("Consider separating error assignment", "I6"),
    ("Error check doesn't properly", "I7"), ("Many error checks don't", "I8"), ("Using context package but", "I10"),
]
GO_BLOCK_CODES = ("I3", "I5", "I7", "I8")


def _go_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from revkit.operators import golang as G

    files = derived_files(spark, sf_dir).where(F.col("lang") == "go")
    found = run_rules(files, G.rules())
    kind = F.lit(None).cast("string")
    for text, code in reversed(GO_KIND):
        kind = F.when(F.contains("msg", F.lit(text)), F.lit(code)).otherwise(kind)
    return found.select("repo", "path", kind.alias("code"), F.col("line").cast("bigint").alias("line"), F.col("msg").alias("recommendation"))


def _go_sql() -> str:
    from revkit.operators import golang as G

    code = f"regexp_replace(regexp_replace(l, {q(G.STRING_LITERAL)}, '\"\"', 'g'), {q(G.LINE_COMMENT)}, '')"
    is_comment = lambda x: f"(starts_with({_trim(x)}, '//') OR ends_with({_trim(x)}, '*/'))"
    rhs = f"regexp_extract(code, {q(G.ASSIGN_CHECK)}, 1)"
    closed = "ls[n : n - 1 + list_position(list_transform(ls[n:], lambda x: contains(x, ')')), true)]"
    sig = f"CASE WHEN {rl('l', G.FUNC)} THEN l WHEN {rl('l', G.FUNC_OPEN)} THEN array_to_string({closed}, ' ') END"
    return f"""WITH {FILES_CTE},
g AS (SELECT repo, path, string_split(content, chr(10)) AS ls FROM files WHERE lang = 'go'),
gl AS (SELECT repo, path, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM g),
gc AS (SELECT *, {code} AS code FROM gl),
pk AS (SELECT repo, path, min(n) AS pn FROM gl WHERE {rl('l', G.PACKAGE)} GROUP BY repo, path),
gp AS (SELECT gc.*, {sig} AS sig FROM gc JOIN pk USING (repo, path)),
res AS (
  SELECT g.repo, g.path, 'I1' AS code, 1 AS line, g.path || ':1: Package lacks documentation comment' AS recommendation
    FROM g JOIN pk USING (repo, path) WHERE NOT (pn > 1 AND {is_comment('ls[pn - 1]')})
  UNION ALL SELECT repo, path, 'I2', n, path || ':' || CAST(n AS VARCHAR) || ': Blank import found - ensure it''s necessary' FROM gp WHERE {rl('l', G.BLANK_IMPORT)}
  UNION ALL SELECT repo, path, 'I4', n, path || ':' || CAST(n AS VARCHAR) || ': Exported function ''' || regexp_extract(sig, {q(G.FUNC)}, 2) || ''' lacks documentation comment'
    FROM gp WHERE {rl('sig', G.FUNC)} AND regexp_matches(regexp_extract(sig, {q(G.FUNC)}, 2), '^[A-Z]') AND NOT coalesce(n > 1 AND {is_comment('ls[n - 1]')}, false)
  UNION ALL SELECT repo, path, 'I6', n, path || ':' || CAST(n AS VARCHAR) || ': Consider separating error assignment and checking for better readability'
    FROM gp WHERE {rl('code', G.ERR_CHECK)} AND {rl('code', G.ASSIGN_CHECK)} AND NOT contains(regexp_replace({rhs}, '\\([^()]*\\)', '', 'g'), ',')
  UNION ALL SELECT repo, path, 'I10', 1, path || ':1: Using context package but not passing context through functions' FROM gp
    GROUP BY repo, path
    HAVING bool_or({rl('l', G.CONTEXT_IMPORT)}) AND NOT bool_or(coalesce({rl('sig', G.FUNC)} AND contains(regexp_extract(sig, {q(G.FUNC)}, 3), 'context.Context'), false))
)
SELECT repo, path, code, CAST(line AS BIGINT) AS line, recommendation FROM res"""


GO_SQL = _go_sql()


@register("go_findings", GO_SQL)
def q_go_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, I2, I4, I6, I9, I10 (line and file rules) on every Go file."""
    return _go_rows(spark, sf_dir).where(~F.col("code").isin(*GO_BLOCK_CODES))


@register("go_block_findings")
def q_go_block_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I3, I5, I7, I8 (function and block segments); checked against hand fixtures."""
    return _go_rows(spark, sf_dir).where(F.col("code").isin(*GO_BLOCK_CODES))


# ------------------------------------------ H14 / H18 with their own oracles

def _py_lines_cte() -> str:
    return f"""p AS (SELECT repo, path, regexp_extract(path, '[^/]*$') AS base, string_split(content, chr(10)) AS ls FROM files WHERE lang = 'python'),
ln AS (SELECT repo, path, base, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM p),
t AS (SELECT *, {_trim('l')} AS tr, strlen(l) - strlen(ltrim(l, ' ' || chr(9))) AS ind FROM ln)"""


def _function_length_sql() -> str:
    from revkit.operators import python as H

    return f"""WITH {FILES_CTE}, {_py_lines_cte()},
c AS (SELECT *, starts_with(tr, 'def ') AS defp, starts_with(tr, 'def ') AND {rl('tr', H.FUNC_NAME)} AS valid
      FROM t WHERE NOT (tr = '' OR starts_with(tr, '#'))),
d AS (SELECT repo, path, base, n, ind, regexp_extract(tr, {q(H.FUNC_NAME)}, 1) AS name FROM c WHERE valid),
e AS (SELECT d.repo, d.path, d.n, min(c.n) AS end_n FROM d JOIN c ON c.repo = d.repo AND c.path = d.path AND c.n > d.n
        AND (c.valid OR (NOT c.defp AND c.ind <= d.ind)) GROUP BY d.repo, d.path, d.n),
k AS (SELECT d.repo, d.path, d.base, d.n, d.name, 1 + count(c.n) AS cnt
      FROM d LEFT JOIN e ON e.repo = d.repo AND e.path = d.path AND e.n = d.n
      LEFT JOIN c ON c.repo = d.repo AND c.path = d.path AND c.n > d.n AND c.n < coalesce(e.end_n, 2147483647) AND NOT c.defp
      GROUP BY d.repo, d.path, d.base, d.n, d.name)
SELECT repo, path, 'PYL302' AS code, CAST(n AS BIGINT) AS line,
  base || ':' || CAST(n AS VARCHAR) || ':1 [warning] PYL302: Function ''' || name || ''' is too long (' || CAST(cnt AS VARCHAR) || ' lines). Consider refactoring' AS recommendation
FROM k WHERE cnt > 50"""


@register("python_function_length", _function_length_sql())
def q_python_function_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions longer than 50 counted lines (the function-length fold)."""
    return _python_rows(spark, sf_dir, ("H13",)).where(F.col("code") == "PYL302")


def _quote_style_sql() -> str:
    tok = q("'\"*'?|\"'*\"?")
    sq, dq = "chr(39)", "chr(34)"
    return f"""WITH {FILES_CTE}, {_py_lines_cte()},
qt AS (SELECT repo, path, base, regexp_extract_all(regexp_replace(l, '[^' || {sq} || {dq} || ']', '', 'g'), {tok}) AS toks FROM t),
cnt AS (SELECT repo, path, base,
          sum(len(list_filter(toks, lambda x: starts_with(x, {sq}))) + len(list_filter(toks, lambda x: starts_with(x, {sq}) AND len(x) >= 2 AND ends_with(x, {sq})))) AS s,
          sum(len(list_filter(toks, lambda x: starts_with(x, {dq}))) + len(list_filter(toks, lambda x: starts_with(x, {dq}) AND len(x) >= 2 AND ends_with(x, {dq})))) AS d
        FROM qt GROUP BY repo, path, base)
SELECT repo, path, 'PYL502' AS code, CAST(1 AS BIGINT) AS line,
  base || ':1:1 [info] PYL502: Inconsistent quote style. Consider using consistent string quotes' AS recommendation
FROM cnt WHERE s > 0 AND d > 0 AND (s > d * 3 OR d > s * 3)"""


@register("python_quote_style", _quote_style_sql())
def q_python_quote_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote-balance fold per line, summed per file."""
    return _python_rows(spark, sf_dir, ("H17",)).where(F.col("code") == "PYL502")


def _go_block_sql() -> str:
    from revkit.operators import golang as G

    code = f"regexp_replace(regexp_replace(l, {q(G.STRING_LITERAL)}, '\"\"', 'g'), {q(G.LINE_COMMENT)}, '')"
    strip = _trim
    ret_pieces = f"string_split(regexp_extract(b.code, {q(G.RETURN)}, 1), ',')"
    named = f"len(list_filter(string_split(regexp_extract(rest, {q(r'^\s*\(([^)]*)\)')}, 1), ','), lambda e: regexp_matches({strip('e')}, {q(r'^\w+\s+\S')}))) > 0"
    return f"""WITH {FILES_CTE},
g AS (SELECT repo, path, string_split(content, chr(10)) AS ls FROM files WHERE lang = 'go'),
gl AS (SELECT repo, path, len(ls) AS total, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM g),
pk AS (SELECT DISTINCT repo, path FROM gl WHERE {rl('l', G.PACKAGE)}),
gc AS (SELECT gl.*, {code} AS code FROM gl JOIN pk USING (repo, path)),
gs AS (SELECT *, {strip('code')} AS sc, strlen(code) - strlen(ltrim(code, ' ' || chr(9))) AS ind FROM gc),
f AS (SELECT repo, path, total, n AS fn, regexp_extract(l, {q(G.FUNC)}, 2) AS name, regexp_extract(l, {q(G.FUNC)}, 4) AS rest FROM gs WHERE {rl('l', G.FUNC)}),
fe AS (SELECT f.repo, f.path, f.fn, coalesce(min(x.n), any_value(f.total)) AS end_n FROM f
       LEFT JOIN gs x ON x.repo = f.repo AND x.path = f.path AND x.n > f.fn AND rtrim(x.code, ' ' || chr(9) || chr(13)) = '}}'
       GROUP BY f.repo, f.path, f.fn),
body AS (SELECT f.repo, f.path, f.fn, f.name, f.rest, b.n, b.sc FROM f JOIN fe USING (repo, path, fn)
         JOIN gs b ON b.repo = f.repo AND b.path = f.path AND b.n > f.fn AND b.n < fe.end_n),
i3 AS (SELECT repo, path, fn, name, count(*) FILTER (WHERE sc <> '' AND NOT starts_with(sc, '}}')) + count(*) FILTER (WHERE ends_with(sc, '{{')) AS k
       FROM body GROUP BY repo, path, fn, name),
ck AS (SELECT repo, path, total, n, ind FROM gs WHERE {rl('code', G.ERR_CHECK)}),
ce AS (SELECT ck.repo, ck.path, ck.n, coalesce(min(x.n), any_value(ck.total) + 1) AS end_n FROM ck
       LEFT JOIN gs x ON x.repo = ck.repo AND x.path = ck.path AND x.n > ck.n AND x.ind = ck.ind AND starts_with(x.sc, '}}')
       GROUP BY ck.repo, ck.path, ck.n),
hd AS (SELECT ce.repo, ce.path, ce.n,
         coalesce(bool_or({rl('b.code', G.RETURN)} AND len(list_filter({ret_pieces}, lambda r: regexp_matches({strip('r')}, '^(err|\\w*Err|\\w*Error)$'))) > 0), false) AS handled
       FROM ce LEFT JOIN gs b ON b.repo = ce.repo AND b.path = ce.path AND b.n > ce.n AND b.n < ce.end_n
       GROUP BY ce.repo, ce.path, ce.n),
res AS (
  SELECT repo, path, 'I3' AS code, fn AS line, path || ':' || CAST(fn AS VARCHAR) || ': Function ''' || name || ''' is too long (' || CAST(k AS VARCHAR) || ' statements, consider refactoring)' AS recommendation
    FROM i3 WHERE k > 50
  UNION ALL SELECT repo, path, 'I5', n, path || ':' || CAST(n AS VARCHAR) || ': Naked return in function ''' || name || ''' reduces code readability'
    FROM body WHERE sc = 'return' AND {named}
  UNION ALL SELECT repo, path, 'I7', n, path || ':' || CAST(n AS VARCHAR) || ': Error check doesn''t properly return or handle the error' FROM hd WHERE NOT handled
  UNION ALL SELECT repo, path, 'I8', 1, path || ':1: Many error checks don''t properly return or handle the error' FROM hd
    GROUP BY repo, path HAVING count(*) > 0 AND count(*) FILTER (WHERE handled) < count(*) // 2
)
SELECT repo, path, code, CAST(line AS BIGINT) AS line, recommendation FROM res"""


from revkit.plans.queries import ORACLE as _ORACLE  # noqa: E402

_ORACLE["go_block_findings"] = _go_block_sql()


def _delimiter_sql() -> str:
    """H1 replayed per character with a recursive CTE (stack as a string of
    expected closers, reset per line; a mismatch is reported and not popped)."""
    ch = "substr(s.l, s.k + 1, 1)"
    bad = f"({ch} IN (')', ']', '}}') AND (s.stack = '' OR right(s.stack, 1) <> {ch}))"
    return f"""WITH RECURSIVE {FILES_CTE}, {_py_lines_cte()},
st(repo, path, base, n, l, k, stack, hits) AS (
  SELECT repo, path, base, n, l, 0, '', []::INTEGER[] FROM t WHERE regexp_matches(l, '[)\\]}}]')
  UNION ALL
  SELECT s.repo, s.path, s.base, s.n, s.l, s.k + 1,
    CASE WHEN {ch} = '(' THEN s.stack || ')' WHEN {ch} = '[' THEN s.stack || ']' WHEN {ch} = '{{' THEN s.stack || '}}'
         WHEN {bad} THEN s.stack WHEN {ch} IN (')', ']', '}}') THEN left(s.stack, length(s.stack) - 1) ELSE s.stack END,
    CASE WHEN {bad} THEN list_append(s.hits, s.k + 1) ELSE s.hits END
  FROM st s WHERE s.k < length(s.l)
),
fin AS (SELECT repo, path, base, n, l, unnest(hits) AS h FROM st WHERE k = length(l))
SELECT repo, path, 'PYL001' AS code, CAST(n AS BIGINT) AS line,
  base || ':' || CAST(n AS VARCHAR) || ':' || CAST(strlen(substr(l, 1, h - 1)) + 1 AS VARCHAR) || ' [error] PYL001: Unbalanced delimiter: ''' || substr(l, h, 1) || '''' AS recommendation
FROM fin"""


def _indent_sql() -> str:
    """H3 replayed line by line with a recursive CTE over each file's counted lines."""
    last_le = "len(r.stack) - list_position(list_reverse(list_transform(r.stack, lambda v: v <= x.ind)), true) + 1"
    new_stack = (
        f"CASE WHEN ends_with(x.tr, ':') THEN list_append(r.stack, x.ind + 4) WHEN x.ind < r.stack[-1] THEN list_slice(r.stack, 1, {last_le}) "
        "ELSE r.stack END"
    )
    return f"""WITH RECURSIVE {FILES_CTE}, {_py_lines_cte()},
nl AS (SELECT repo, path, base, n, tr, ind, row_number() OVER (PARTITION BY repo, path ORDER BY n) AS rn FROM t WHERE NOT (tr = '' OR starts_with(tr, '#'))),
rec(repo, path, base, rn, stack, n, ind) AS (
  SELECT DISTINCT repo, path, base, 0, [0], NULL::BIGINT, NULL::BIGINT FROM nl
  UNION ALL
  SELECT x.repo, x.path, x.base, x.rn, {new_stack}, x.n, x.ind
  FROM rec r JOIN nl x ON x.repo = r.repo AND x.path = r.path AND x.rn = r.rn + 1
)
SELECT repo, path, 'PYL003' AS code, CAST(n AS BIGINT) AS line,
  base || ':' || CAST(n AS VARCHAR) || ':1 [error] PYL003: Indentation error: expected ' || CAST(stack[-1] AS VARCHAR) || ' spaces, got ' || CAST(ind AS VARCHAR) AS recommendation
FROM rec WHERE rn > 0 AND ind > 0 AND ind <> stack[-1]"""


_ORACLE["python_stateful_findings"] = "\nUNION ALL\n".join(
    f"SELECT * FROM ({sql}) q{i}" for i, sql in enumerate([_delimiter_sql(), _indent_sql(), _function_length_sql(), _quote_style_sql()])
)
