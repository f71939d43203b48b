"""Registered reply queries: A7 end to end, M7 report join, A4/B8 rejects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import replies as A
from revkit.operators import requests as R
from revkit.operators.analyze import analyze
from revkit.plans import agg_queries as AQ
from revkit.plans import report_queries as RQ
from revkit.plans import request_queries as Q
from revkit.plans.queries import _SCORES_SQL, register
from revkit.plans.sqlkit import FILES_CTE, count_sub
from revkit.session import ensure_checkpoint_dir, written
from revkit.sources import tables
from revkit.sources.files import derived_files

#: Requests ask for small repositories: 24 neighbouring files each, so that the
#: number of repositories grows with the table and a reply's report does not.
_BLOCK = "CAST(floor(CAST(regexp_extract(path, '([0-9]+)', 1) AS BIGINT) / 24) AS BIGINT)"
_SMALL_REPO = f"repo || '-' || CAST({_BLOCK} AS STRING)"
_ASKED = "CAST(floor(review_id / 200) AS BIGINT)"
REPLY_FIELDS_SQL = Q.REQUEST_FIELDS_SQL.replace(
    "CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING)", f"CAST(24 * {_ASKED} % 5 AS STRING) || '-' || CAST({_ASKED} AS STRING)"
)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed requests with the time of their comment."""
    parsed = R.parse_messages(Q.request_json(spark, sf_dir, REPLY_FIELDS_SQL).select("review_id", "value"))
    return parsed.join(tables.review_comments(spark, sf_dir).select("review_id", "ts"), "review_id")


def _replies_sql(columns: str) -> str:
    asp = "string_split(aspects, '|')"
    te, tt = AQ._label_sql("trend", "📈", "📉", "Stable", "Improving", "Declining")
    ce, ct = AQ._label_sql("round(overall - hist_avg, 6)", "🌟", "⚠️", "On par with typical reviews", "Above average", "Below average")
    w = "OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    recent, before = w.format(10), w.format("UNBOUNDED")
    pick = lambda a: f"CASE WHEN list_contains({asp}, '{a}') THEN {a} ELSE 0.0::DOUBLE END AS {a}"
    names = ("thoroughness", "clarity", "actionability")
    positive = " + ".join(f"({a} > 0)::INT" for a in names)
    kw = ", ".join(f"sum({AQ._kw_sql(a)}) AS {a}" for a in names)
    weighted = " + ".join(f"{a} * len(list_filter({asp}, lambda x: x = '{a}'))" for a in names)
    return f"""WITH {FILES_CTE}, small AS (SELECT {_SMALL_REPO} AS repo, path FROM files),
rc AS ({tables.REVIEW_COMMENTS_SQL}),
bad AS (SELECT review_id FROM ({REPLY_FIELDS_SQL}) r WHERE make_corrupt),
st AS (SELECT *, CASE WHEN code_source <> 'direct' THEN repo_name END AS repo FROM ({Q._settings_sql(REPLY_FIELDS_SQL)}) x),
ad AS (SELECT *, CASE WHEN code_source = 'direct' THEN NULL WHEN route_error IS NOT NULL THEN 'Invalid repository URL: ' || route_error
    WHEN repo NOT IN (SELECT repo FROM small) THEN '{A.NO_FILES}' END AS error,
  CASE WHEN code_source = 'direct' THEN '' ELSE repo || chr(10) || aspects END AS variant FROM st),
good AS (SELECT * FROM ad WHERE error IS NULL),
kinds AS (SELECT DISTINCT variant, repo, aspects FROM good WHERE repo IS NOT NULL),
ent AS (SELECT variant, repo, unnest({asp}) AS aspect, generate_subscripts({asp}, 1) AS place FROM kinds
  UNION ALL SELECT variant, repo, 'language', 1000000 FROM kinds),
recs AS (SELECT *, {_SMALL_REPO} AS small_repo,
  CASE WHEN g > 0 THEN 'language' WHEN n <= 4 THEN 'thoroughness' WHEN n <= 7 THEN 'clarity' ELSE 'actionability' END AS aspect FROM ({RQ._ordered_recs_sql()}) o),
sel AS (SELECT variant, place, path, g, n, occ, recommendation FROM recs JOIN ent ON ent.repo = recs.small_repo AND ent.aspect = recs.aspect),
fr AS (SELECT variant, path, string_agg('- ' || recommendation || chr(10), '' ORDER BY place, g, n, occ, recommendation) AS block, {kw} FROM sel GROUP BY variant, path),
rep AS (SELECT variant, string_agg('- ' || path || chr(10), '' ORDER BY path) AS listed, string_agg('## ' || path || chr(10) || chr(10) || block, '' ORDER BY path) AS blocks,
  count(*) AS files_analyzed, avg(CAST({weighted} AS DOUBLE) / len({asp})) AS mean_quality FROM fr JOIN kinds USING (variant) GROUP BY variant),
sc AS (SELECT review_id, s.channel_id, rc.ts, rc.message, variant, include_recommendations, CAST(floor(epoch(rc.ts) / 86400) AS BIGINT) AS period,
    {", ".join(map(pick, names))} FROM good JOIN ({_SCORES_SQL}) s USING (review_id) JOIN rc USING (review_id)),
ov AS (SELECT *, CASE WHEN {positive} > 0 THEN ({" + ".join(names)}) / ({positive}) ELSE 0.0::DOUBLE END AS mean FROM sc),
oa AS (SELECT *, CASE WHEN message = '' THEN 0.0::DOUBLE WHEN {count_sub("message", " ")} + 1 > 10 AND mean < 30 THEN 30.0::DOUBLE ELSE mean END AS overall FROM ov),
hw AS (SELECT *, count(overall) {before} AS hist_count, avg(overall) {before} AS hist_avg, count(overall) {recent} AS n_recent,
    last(overall) {recent} AS last_v, first(overall) {recent} AS first_v FROM oa),
ht AS (SELECT *, CASE WHEN n_recent >= 2 THEN last_v - first_v ELSE 0.0::DOUBLE END AS trend FROM hw),
res AS (SELECT review_id,
    '## Code Analysis Results' || chr(10) || chr(10) || CASE WHEN listed IS NULL THEN 'No issues found in the analyzed files.' || chr(10)
      ELSE '### Analyzed Files:' || chr(10) || listed || chr(10) || '### Recommendations:' || chr(10) || blocks END
    || '## Code Review Quality Analysis' || chr(10) || chr(10) || {AQ._fmt("thoroughness", "Thoroughness")} || {AQ._fmt("clarity", "Clarity")} || {AQ._fmt("actionability", "Actionability")}
    || CASE WHEN overall >= 70 THEN chr(10) || '✅ **Meets quality threshold** (70.0%)' || chr(10) ELSE chr(10) || '⚠️ **Below quality threshold** (70.0%)' || chr(10) END
    || CASE WHEN message = '' AND include_recommendations THEN chr(10) || '### Recommendations for Improvement' || chr(10) || '- No review comment provided. Please add detailed comments about the code.' || chr(10) ELSE '' END
    || CASE WHEN hist_count > 0 THEN chr(10) || '### Historical Perspective' || chr(10) || {te} || ' Quality trend: ' || {tt} || chr(10) || {ce} || ' Compared to average: ' || {ct} ELSE '' END AS message,
    coalesce(files_analyzed, 0) AS files_analyzed, mean_quality
  FROM ht LEFT JOIN rep USING (variant))
{columns}"""


REPLIES_SQL = _replies_sql(f"""SELECT review_id, 200 AS http_status, NULL::VARCHAR AS error, message, files_analyzed, round(mean_quality, 6) AS mean_quality FROM res
UNION ALL SELECT review_id, CASE WHEN error = '{A.NO_FILES}' THEN 500 ELSE 400 END, error, NULL, 0, NULL FROM ad WHERE error IS NOT NULL
UNION ALL SELECT review_id, 400, '{A.BAD_BODY}', NULL, 0, NULL FROM bad""")


@register("review_replies", REPLIES_SQL)
def q_review_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request answered: refused, or the report of its repository under
    its own aspects, the quality of its comment, and the channel's history; in
    direct mode without files."""
    files = derived_files(spark, sf_dir).withColumn("repo", F.expr(_SMALL_REPO))
    findings = written(analyze(files), "reply-findings")
    out = A.answer(_requests(spark, sf_dir), files, findings)
    return out.select(
        "review_id", F.col("http_status").cast("int").alias("http_status"), "error", "message", "files_analyzed", F.round("mean_quality", 6).alias("mean_quality")
    )


@register("request_rejects", f"""WITH v AS ({Q.VALIDATION_SQL})
SELECT review_id, 'valid' AS sink, http_status, error FROM v WHERE http_status = 200
UNION ALL SELECT review_id, 'rejects', http_status, error FROM v WHERE http_status <> 200""")
def q_request_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the requests writes the valid ones and the rejects
    (with their raw body, status and reason) as two partitions of a table."""
    checked = R.validate(Q._parsed(spark, sf_dir), field="value")
    path = os.path.join(ensure_checkpoint_dir(spark), "requests", uuid.uuid4().hex)
    valid, rejects = R.split_valid(checked, path)
    rows = valid.select("review_id", F.lit("valid").alias("sink"), "http_status", "error")
    rows = rows.unionByName(rejects.select("review_id", F.lit("rejects").alias("sink"), "http_status", "error"))
    return rows.select("review_id", "sink", F.col("http_status").cast("int").alias("http_status"), "error")
