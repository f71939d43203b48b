"""Registered report queries: A6 locations, K7 report sections, L6 reply text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.functions.paths import display_path, raw_content_url
from revkit.operators import history as L
from revkit.operators import metrics as K
from revkit.operators import reviews
from revkit.operators.analyze import analyze
from revkit.plans import agg_queries as AQ
from revkit.plans import file_queries as FQ
from revkit.plans.queries import ORACLE, _scores, register
from revkit.plans.sqlkit import FILES_CTE
from revkit.sources.files import decoded, derived_files

# ------------------------------------------------------------- A6 locations

_PROVIDER = "CASE repo WHEN 'repo0' THEN 'github' WHEN 'repo1' THEN 'gitlab' WHEN 'repo2' THEN 'bitbucket' WHEN 'repo3' THEN 'github' ELSE 'svn' END"

LOCATIONS_SQL = f"""WITH {FILES_CTE}, f AS (SELECT repo, path, {_PROVIDER} AS provider FROM files)
SELECT repo, path, provider,
  CASE provider
    WHEN 'github' THEN 'https://raw.githubusercontent.com/acme/' || repo || '/main/' || path
    WHEN 'gitlab' THEN 'https://gitlab.com/api/v4/projects/acme%2F' || repo || '/repository/files/' || replace(path, '/', '%2F') || '/raw?ref=main'
    WHEN 'bitbucket' THEN 'https://api.bitbucket.org/2.0/repositories/acme/' || repo || '/src/main/' || path END AS url
FROM f"""


@register("raw_content_urls", LOCATIONS_SQL)
def q_raw_content_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-content location per file (provider by repository, owner
    'acme', branch 'main'); an unknown provider has no location."""
    files = derived_files(spark, sf_dir).select("repo", "path")
    provider = F.expr(_PROVIDER)
    out = files.select("repo", "path", provider.alias("provider"))
    return out.select("repo", "path", "provider",
                      raw_content_url(F.col("provider"), F.lit("acme"), F.col("repo"), F.lit("main"), F.col("path")).alias("url"))


# ------------------------------------------------------------- B3 display paths

#: Where the derived files stand on disk: below the scan root, some with a doubled slash, some elsewhere.
_ON_DISK = "CASE length(path) % 3 WHEN 0 THEN '/scan/' || repo || '/' || path WHEN 1 THEN '/scan//' || path ELSE '/other/' || path END"


@register("display_paths", f"""WITH {FILES_CTE}, d AS (SELECT repo, path, {_ON_DISK} AS full_path FROM files),
r AS (SELECT repo, full_path, CASE WHEN starts_with(full_path, '/scan') THEN substr(full_path, 6) ELSE full_path END AS rel FROM d)
SELECT repo, full_path, CASE WHEN starts_with(rel, '/') THEN substr(rel, 2) ELSE rel END AS shown FROM r""")
def q_display_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path below the scan root, less one slash (reads paths only)."""
    files = derived_files(spark, sf_dir).select("repo", F.expr(_ON_DISK).alias("full_path"))
    return files.select("repo", "full_path", display_path(F.col("full_path"), "/scan").alias("shown"))


# ------------------------------------------------------------- K7 sections

def _ordered_recs_sql() -> str:
    rank = "CASE substr(rule_id, 1, 1) WHEN 'D' THEN 0 WHEN 'E' THEN 1 WHEN 'F' THEN 2 ELSE 3 END"
    num = "CAST(substr(rule_id, 2) AS INT)"
    return f"""SELECT repo, path, {rank} AS g, {num} AS n, occ, recommendation FROM ({FQ.ASPECTS_SQL}) a
UNION ALL SELECT repo, path, {rank}, {num}, occ, recommendation FROM ({FQ.COMMON_SQL}) e
UNION ALL SELECT repo, path, {rank}, {num}, occ, recommendation FROM ({FQ.JAVA_SQL}) j
UNION ALL SELECT repo, path, 3, 25, occ, recommendation FROM ({FQ.PHP_RECS_SQL}) p
UNION ALL SELECT repo, path, 4, 0, 0, recommendation FROM ({FQ.PYTHON_SQL}) h
UNION ALL SELECT repo, path, 4, 0, 0, recommendation FROM ({ORACLE["python_stateful_findings"]}) hs
UNION ALL SELECT repo, path, 4, 0, 0, recommendation FROM ({FQ.GO_SQL}) i
UNION ALL SELECT repo, path, 4, 0, 0, recommendation FROM ({ORACLE["go_block_findings"]}) ib"""


#: Files over this length are not read (K9); longer than any that is derived.
MAX_BYTES = 1 << 28

#: Files beside the derived ones, as a listing shows them: of a repository in which
#: nothing is found, and files that cannot be read, of repositories with and
#: without other files (length only, or bytes that are not UTF-8).
_ODD_FILES = """SELECT 'clean' AS repo, 'src/test_ok' || CAST(doc_id AS STRING) || '.ts' AS path, 20 AS length, 'const a = 1;' AS content FROM documents WHERE doc_id % 97 = 1
UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'repo0' ELSE 'broken' END, 'src/bad' || CAST(doc_id AS STRING) || '.py', 20, '?' FROM documents WHERE doc_id % 97 = 5
UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'repo0' ELSE 'broken' END, 'src/huge' || CAST(doc_id AS STRING) || '.go', 1073741824, NULL FROM documents WHERE doc_id % 97 = 6"""

ERRORS_SQL = f"""SELECT repo, path, 'error reading file ' || path || ': ' || CASE WHEN content IS NULL THEN CAST(length AS VARCHAR) || ' bytes, more than {MAX_BYTES}'
  ELSE 'not valid UTF-8' END AS error FROM ({_ODD_FILES}) o WHERE content IS NULL OR content = '?'"""

SECTIONS_SQL = f"""WITH {FILES_CTE}, r AS ({_ordered_recs_sql()}),
fr AS (SELECT repo, path, string_agg('- ' || recommendation || chr(10), '' ORDER BY g, n, occ, recommendation) AS recs FROM r GROUP BY repo, path),
er AS ({ERRORS_SQL}),
repos AS (SELECT DISTINCT repo FROM (SELECT repo FROM files UNION ALL SELECT repo FROM ({_ODD_FILES}) o) x)
SELECT repo, 0 AS seq, '' AS path, '## Code Analysis Results' || chr(10) || chr(10) AS text FROM repos
UNION ALL SELECT DISTINCT repo, 1, '', '### Analyzed Files:' || chr(10) FROM fr
UNION ALL SELECT repo, 1, path, '- ' || path || chr(10) FROM fr
UNION ALL SELECT repo, 2, '', CASE WHEN repo IN (SELECT repo FROM fr) THEN chr(10) ELSE '' END || '### Recommendations:' || chr(10) FROM repos
  WHERE repo IN (SELECT repo FROM fr) OR repo IN (SELECT repo FROM er)
UNION ALL SELECT repo, 3, path, '## ' || path || chr(10) || chr(10) || recs FROM fr
UNION ALL SELECT repo, 3, path, '## ' || path || chr(10) || '- Error during analysis: ' || error || chr(10) FROM er
UNION ALL SELECT repo, 3, '', 'No issues found in the analyzed files.' || chr(10) FROM repos
  WHERE repo NOT IN (SELECT repo FROM fr) AND repo NOT IN (SELECT repo FROM er)"""


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived files and the odd ones, decoded (K9)."""
    files = derived_files(spark, sf_dir).select("repo", "path", F.octet_length("content").cast("long").alias("length"), F.col("content").cast("binary").alias("content"))
    odd = spark.sql(_ODD_FILES)
    content = F.when(F.col("content") == "?", F.unhex(F.lit("78FF"))).otherwise(F.col("content").cast("binary"))
    return decoded(files.unionByName(odd.select("repo", "path", F.col("length").cast("long").alias("length"), content.alias("content"))), MAX_BYTES)


@register("report_sections", SECTIONS_SQL)
def q_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 + K7 + K9: per-file recommendation lists and the code-analysis report as
    ordered rows (repo, seq, path, text), for the files of every language; with a
    repository in which nothing is found and files that cannot be read."""
    files = listed_files(spark, sf_dir)
    sections = K.report_sections(K.file_recommendations(analyze(files)), repos=files.select("repo"))
    return K.ordered_report(sections).select("repo", F.col("seq").cast("int").alias("seq"), "path", "text")


# ------------------------------------------------------------- L6 reply text

ENHANCED_REPORT_SQL = f"""WITH qr AS ({AQ.QUALITY_REPORT_SQL}), h AS ({AQ.HISTORY_SQL})
SELECT review_id, quality_text || CASE WHEN hist_count > 0 THEN chr(10) || '### Historical Perspective' || chr(10) || trend_label || chr(10)
  || comparison_label ELSE '' END AS reply_text
FROM qr JOIN h USING (review_id)"""


@register("enhanced_report", ENHANCED_REPORT_SQL)
def q_enhanced_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 + L6: quality section followed by the historical perspective."""
    h = L.with_history_split(_scores(spark, sf_dir))
    text = F.concat(F.col("quality_text"), L.historical_section(F.col("overall"), F.col("hist_count"), F.col("hist_avg"), F.col("trend")))
    return reviews.quality_report(h).select("review_id", text.alias("reply_text"))
