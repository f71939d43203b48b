"""Registered context-join queries: J14/J15, M2-M5, E8-E10 over M3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import common as E
from revkit.operators import context as M
from revkit.plans.queries import register
from revkit.plans.sqlkit import FILES_CTE, q
from revkit.sources.files import derived_files
from revkit.sources.tables import REVIEW_COMMENTS_SQL, review_comments


def comments_with_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived comments, each aimed at one derived repository (conv_id mod 5)."""
    rc = review_comments(spark, sf_dir)
    return rc.withColumn("repo", F.concat(F.lit("repo"), (F.floor(F.col("review_id") / 100) % 5).cast("string")))


_REFS_SQL = f"""c AS (SELECT review_id, message, 'repo' || CAST((review_id // 100) % 5 AS VARCHAR) AS repo FROM ({REVIEW_COMMENTS_SQL}) rc),
rx AS (
  SELECT review_id, repo, generate_subscripts(regexp_extract_all(message, {q(M.REFERENCE)}), 1) AS ref_seq,
    unnest(regexp_extract_all(message, {q(M.REFERENCE)}, 1)) AS filename,
    unnest(regexp_extract_all(message, {q(M.REFERENCE)}, 2)) AS a, unnest(regexp_extract_all(message, {q(M.REFERENCE)}, 3)) AS b
  FROM c
),
nm AS (
  SELECT review_id, repo, len(regexp_extract_all(message, {q(M.REFERENCE)})) AS n,
    {", ".join(f"contains(message, {q(name)}) AS h{i}" for i, (name, _a, _b) in enumerate(M.NAMED_FILES))}
  FROM c
),
refs AS (
  SELECT review_id, repo, CAST(ref_seq AS INT) AS ref_seq, filename, TRY_CAST(a AS INT) AS line_start,
    coalesce(TRY_CAST(nullif(b, '') AS INT), TRY_CAST(a AS INT)) AS line_end FROM rx
  {" ".join(
      f"UNION ALL SELECT review_id, repo, CAST(n + {' + '.join([f'h{j}::INT' for j in range(i)] or ['0'])} + 1 AS INT), {q(name)}, {a}, {b} FROM nm WHERE h{i}"
      for i, (name, a, b) in enumerate(M.NAMED_FILES))}
)"""

REFERENCES_SQL = f"""WITH {_REFS_SQL}
SELECT review_id, repo, ref_seq, filename, line_start, line_end FROM refs"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extract_references(comments_with_repo(spark, sf_dir).select("review_id", "repo", "message"))


@register("comment_references", REFERENCES_SQL)
def q_comment_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code references (path:a-b and named files) in every comment."""
    return _refs(spark, sf_dir).select(
        "review_id", "repo", F.col("ref_seq").cast("int").alias("ref_seq"), "filename", "line_start", "line_end"
    )


def _context_sql() -> str:
    return f"""WITH {FILES_CTE}, {_REFS_SQL},
ex AS (SELECT r.*, f.path AS exact_path FROM refs r LEFT JOIN files f ON f.repo = r.repo AND f.path = trim(r.filename)),
fo AS (SELECT repo, lower(path) AS lp, min(path) AS fold_path FROM files GROUP BY repo, lower(path)),
rs AS (SELECT ex.*, coalesce(exact_path, fo.fold_path) AS path FROM ex LEFT JOIN fo ON fo.repo = ex.repo AND fo.lp = lower(trim(ex.filename))),
hit AS (SELECT rs.*, string_split(f.content, chr(10)) AS ls FROM rs JOIN files f ON f.repo = rs.repo AND f.path = rs.path),
c1 AS (SELECT *, len(ls) AS total, CASE WHEN line_start <= 0 THEN 1 ELSE line_start END AS s1 FROM hit),
c2 AS (SELECT *, CASE WHEN line_end <= 0 OR line_end < s1 THEN s1 ELSE line_end END AS e1 FROM c1),
c3 AS (SELECT *, CASE WHEN s1 > total THEN 1 ELSE s1 END AS s, CASE WHEN s1 > total THEN least(total, 10) WHEN e1 > total THEN total ELSE e1 END AS e FROM c2),
blk AS (
  SELECT review_id, repo, ref_seq, filename, line_start, line_end, s AS shown_start, e AS shown_end,
    'Context for ' || filename || ' (lines ' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) || '):' || chr(10) || '```' || chr(10)
    || array_to_string(list_transform(generate_series(greatest(0, s - 3), least(total, e + 3) - 1),
         lambda i: CASE WHEN i + 1 >= s AND i + 1 <= e THEN '> ' ELSE '  ' END || lpad(CAST(i + 1 AS VARCHAR), 4, ' ') || ': ' || ls[i + 1] || chr(10)), '')
    || '```' || chr(10) || chr(10) AS block
  FROM c3
)
SELECT * FROM blk
UNION ALL
SELECT review_id, repo, ref_seq, filename, line_start, line_end, NULL, NULL,
  'Error retrieving ' || filename || ': file not found: ' || trim(filename) || chr(10) || chr(10) FROM rs WHERE path IS NULL"""


CONTEXT_SQL = _context_sql()


@register("comment_context", CONTEXT_SQL)
def q_comment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 (exact then case-insensitive file match), M4 clamp, M3/M5 fenced
    context block or retrieval error, per comment reference."""
    files = derived_files(spark, sf_dir)
    blocks = M.context_blocks(_refs(spark, sf_dir), files)
    return blocks.select(
        "review_id", "repo", F.col("ref_seq").cast("int").alias("ref_seq"), "filename", "line_start", "line_end",
        F.col("shown_start").cast("int").alias("shown_start"), F.col("shown_end").cast("int").alias("shown_end"), "block",
    )


ENHANCED_SQL = f"""WITH b AS ({CONTEXT_SQL}),
c AS (SELECT review_id, message FROM ({REVIEW_COMMENTS_SQL}) rc),
e AS (SELECT review_id, string_agg(block, '' ORDER BY ref_seq) AS blocks FROM b GROUP BY review_id),
t AS (SELECT c.review_id, c.message || chr(10) || chr(10) || e.blocks AS enhanced_comment FROM c JOIN e USING (review_id))
SELECT review_id, enhanced_comment,
  CASE WHEN contains(enhanced_comment, 'validateToken') THEN 'validateToken' WHEN contains(enhanced_comment, 'authenticate_user') THEN 'authenticate_user'
       WHEN contains(enhanced_comment, 'login') THEN 'login' ELSE 'unknown_context' END AS code_context
FROM t"""


@register("enhanced_comments", ENHANCED_SQL)
def q_enhanced_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP4: comment + context blocks in reference order, and its J15 label."""
    files = derived_files(spark, sf_dir)
    blocks = M.context_blocks(_refs(spark, sf_dir), files)
    return M.enhanced_comments(review_comments(spark, sf_dir), blocks)


# --------------------------------------------------- E8-E10 via range join M3

def _todo_refs_sql() -> str:
    from revkit.plans.file_queries import _occ_out, _occ_sql

    return _occ_out(_occ_sql("E1", E.TODO, "", "true"), q("x"))


TARGETED_SQL = f"""WITH {FILES_CTE},
t AS ({_todo_refs_sql()}),
refs AS (SELECT repo, path, CAST(occ AS INT) AS ref_seq, CAST(line AS INT) - 1 AS line_start, CAST(line AS INT) + 2 AS line_end FROM t),
hit AS (SELECT refs.*, string_split(f.content, chr(10)) AS ls FROM refs JOIN files f USING (repo, path)),
rng AS (SELECT *, greatest(line_start, 1) AS s, least(line_end, len(ls)) AS e FROM hit),
ln AS (SELECT repo, path, ref_seq, unnest(generate_series(s, e)) AS line_no, ls FROM rng WHERE e >= s),
l2 AS (SELECT repo, path, ref_seq, line_no, ls[line_no] AS line FROM ln),
chk AS (
  SELECT repo, path, ref_seq, line_no, 0 AS check_seq, 'E8a' AS check_id, ': Missing error handling.' AS m FROM l2 WHERE contains(line, 'err !=')
  UNION ALL SELECT repo, path, ref_seq, line_no, 1, 'E8b', ': Review WaitGroup usage.' FROM l2 WHERE contains(line, 'sync.WaitGroup')
  UNION ALL SELECT repo, path, ref_seq, line_no, 2, 'E9a', ': Simplify complex comparisons.' FROM l2 WHERE contains(line, '==') OR contains(line, '!=')
  UNION ALL SELECT repo, path, ref_seq, line_no, 3, 'E9b', ': Line too long.' FROM l2 WHERE strlen(line) > 80
  UNION ALL SELECT repo, path, ref_seq, line_no, 4, 'E9c', ': Avoid using empty interface.' FROM l2 WHERE contains(line, 'interface{{}}')
  UNION ALL SELECT repo, path, ref_seq, line_no, 5, 'E10a', ': Review TODOs/commented-out code.' FROM l2 WHERE contains(line, 'TODO') OR contains(line, '//')
  UNION ALL SELECT repo, path, ref_seq, line_no, 6, 'E10b', ': Avoid panics; use error handling.' FROM l2 WHERE contains(line, 'panic(')
)
SELECT repo, path, ref_seq, CAST(line_no AS INT) AS line_no, check_seq, check_id, path || ':' || CAST(line_no AS VARCHAR) || m AS recommendation FROM chk"""


@register("targeted_recommendations", TARGETED_SQL)
def q_targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8-E10 over M3: the targeted line checks on the range from the line
    before to two lines after every TODO/FIXME marker of the files of every language."""
    from revkit.operators.findings import run_rules

    files = derived_files(spark, sf_dir)
    todo = run_rules(files, [E.rules()[0]])
    refs = todo.select(
        "repo", "path", F.col("occ").cast("int").alias("ref_seq"), (F.col("line") - 1).alias("line_start"),
        (F.col("line") + 2).alias("line_end"), F.lit(0).alias("review_id"),
    )
    lines = M.targeted_lines(refs, files)
    out = E.targeted_findings(lines, ["Thoroughness", "Clarity", "Actionability"])
    return out.select("repo", "path", "ref_seq", F.col("line_no").cast("int").alias("line_no"), "check_seq", "check_id", "recommendation")
