"""Small helpers to write the DuckDB oracle SQL next to each Spark query.

The oracle text uses the rules' original RE2 patterns (DuckDB's regex engine
is RE2), so a match between both sides also checks the Java translation.
"""

from __future__ import annotations

from revkit.sources.tables import REVIEW_COMMENTS_SQL, SOURCE_FILES_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cnt(expr: str, pattern: str) -> str:
    """Number of matches of an RE2 pattern."""
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def rl(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def has(expr: str, sub: str) -> str:
    return f"contains({expr}, {q(sub)})"


def count_sub(expr: str, sub: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {q(sub)}, ''))) // {len(sub)})"


LANG_SQL = """CASE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$', 1))
  WHEN '.go' THEN 'go' WHEN '.php' THEN 'php' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java'
  WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.ts' THEN 'typescript'
  WHEN '.tsx' THEN 'typescript' ELSE 'unknown' END"""

FILES_CTE = f"""files AS (
  SELECT repo, path, {LANG_SQL} AS lang, content FROM ({SOURCE_FILES_SQL}) sf
)"""

COMMENTS_CTE = f"rc AS ({REVIEW_COMMENTS_SQL})"


def nl_count(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


def match_lines_sql(content: str, pattern: str) -> str:
    """Oracle OCC: line of match k = 1 + newlines before it, from the split
    parts and the matches (quadratic, but independent of the Spark method)."""
    p = q(pattern)
    parts = f"regexp_split_to_array({content}, {p})"
    ms = f"regexp_extract_all({content}, {p})"
    prefix = f"(array_to_string({parts}[1:k], '') || array_to_string({ms}[1:k-1], ''))"
    return f"list_transform({ms}, lambda x, k: 1 + {nl_count(prefix)})"
