"""Registered queries for A5/G24 (external report), L8 (history records),
M6 (branch preference) and Q3 (own keyword lists)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import context as M
from revkit.operators import history as L
from revkit.operators import metrics as K
from revkit.functions import text as T
from revkit.operators import php as G
from revkit.operators.analyze import analyze
from revkit.operators.findings import Rule, batch_rule, finding, run_rules
from revkit.plans import agg_queries as AQ
from revkit.plans.queries import _SCORES_SQL, _scores, register
from revkit.plans.sqlkit import FILES_CTE, match_lines_sql, q
from revkit.session import ensure_checkpoint_dir
from revkit.sources.files import derived_files
from revkit.sources.tables import REVIEW_COMMENTS_SQL

# ------------------------------------------------------- A5 / G24 external report

#: What the derived external report says of a PHP file, by the length of its path.
_MESSAGES = ("possible SQL injection", "deprecated call", "unused variable", "no return type")
_REPORT_LINE = "length(path) % 7 + 1"


def _message(k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {q(m)}" for i, m in enumerate(_MESSAGES)) + " END"


EXTERNAL_SQL = f"""WITH {FILES_CTE}, m AS (
  SELECT repo, path, {_REPORT_LINE} AS line, unnest([{_message("length(path) % 4")}, {_message("(length(path) + 1) % 4")}]) AS description FROM files WHERE lang = 'php')
SELECT repo, path, CAST(line AS INT) AS line, description,
  CASE WHEN contains(description, 'injection') THEN 'Critical' WHEN contains(description, 'deprecated') THEN 'Medium'
    WHEN contains(description, 'unused') THEN 'Low' ELSE 'Medium' END AS severity
FROM m"""


@register("external_report", EXTERNAL_SQL)
def q_external_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + G24: an external analyzer's JSON report per PHP file as issue rows."""
    files = derived_files(spark, sf_dir).where(F.col("lang") == "php")
    cell = lambda k: F.struct(F.expr(_message(k)).alias("message"), F.expr(_REPORT_LINE).alias("line"), F.lit(1).alias("column"))
    messages = F.struct(F.array(cell("length(path) % 4"), cell("(length(path) + 1) % 4")).alias("messages"))
    report = F.to_json(F.struct(F.create_map(F.col("path"), messages).alias("files")))
    issues = G.external_report_issues(files.select("repo", "path", report.alias("report")), files)
    return issues.select("repo", "path", "line", "description", "severity")


# ----------------------------------------------------------------- L8 records

RECORDS_SQL = f"""WITH s AS ({_SCORES_SQL}), h AS ({AQ.HISTORY_SQL}), c AS (SELECT review_id, ts FROM ({REVIEW_COMMENTS_SQL}) x)
SELECT s.channel_id, CAST(c.ts AS VARCHAR) AS date, overall AS overall_quality, comment_length, thoroughness, clarity, actionability,
  coalesce(h.hist_avg, 0.0::DOUBLE) AS average, coalesce(h.trend, 0.0::DOUBLE) AS trend
FROM s JOIN h USING (review_id) JOIN c USING (review_id)"""


@register("history_records", RECORDS_SQL)
def q_history_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history record per review."""
    rec = L.history_records(L.with_history_split(_scores(spark, sf_dir)))
    return rec.select(
        "channel_id", F.col("date").cast("string").alias("date"), "overall_quality", "comment_length", "thoroughness", "clarity", "actionability",
        F.round("average", 6).alias("average"), F.round("trend", 6).alias("trend"),
    )


@register("history_append", RECORDS_SQL)
def q_history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records table after the mornings came as one batch and the
    afternoons as the next (which is then written again): as in one batch."""
    table = L.HistoryTable(spark, os.path.join(ensure_checkpoint_dir(spark), "history", uuid.uuid4().hex))
    scored = _scores(spark, sf_dir).select(*L.RECORDED).checkpoint()  # all batches read the scores: they are computed once
    morning = F.hour("ts") < 12
    for number, rows in ((0, scored.where(morning)), (1, scored.where(~morning)), (1, scored.where(~morning))):
        table.append(rows, number)
    return table.records().select(
        "channel_id", F.col("date").cast("string").alias("date"), "overall_quality", "comment_length", "thoroughness", "clarity", "actionability",
        F.round("average", 6).alias("average"), F.round("trend", 6).alias("trend"),
    )


# ------------------------------------------------------------------ M6 branches

_PROVIDER = "CASE repo WHEN 'repo1' THEN 'gitlab' WHEN 'repo2' THEN 'bitbucket' ELSE 'github' END"
#: Branches that hold a file, by the length of its path.
_HELD = "branch = 'dev' OR (branch = 'main' AND length(path) % 3 <> 0) OR (branch = 'master' AND length(path) % 2 = 0)"

BRANCH_SQL = f"""WITH {FILES_CTE}, s AS (
  SELECT {_PROVIDER} AS provider, repo, path, branch FROM files, (VALUES ('main'), ('master'), ('dev')) b(branch) WHERE {_HELD})
SELECT provider, repo, path, branch FROM s WHERE branch = 'main' OR (branch = 'master' AND provider = 'github')
QUALIFY row_number() OVER (PARTITION BY provider, repo, path ORDER BY CASE branch WHEN 'main' THEN 1 ELSE 2 END) = 1"""


@register("branch_content", BRANCH_SQL)
def q_branch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the branch whose content counts (github: main, then master; others: main)."""
    files = derived_files(spark, sf_dir).select("repo", "path")
    rows = files.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in ("main", "master", "dev")]))).where(_HELD)
    rows = rows.select(F.expr(_PROVIDER).alias("provider"), F.lit("acme").alias("owner"), "repo", "path", "branch")
    return M.branch_resolve(rows).select("provider", "repo", "path", "branch")


# ----------------------------------------------------------------- Q3 keywords

OWN_KEYWORDS = {"clarity": ["line", "print"], "actionability": ["remove"]}


def _own(aspect: str) -> str:
    words = {**K.ASPECT_KEYWORDS, **OWN_KEYWORDS}[aspect]
    return " + ".join(f"CAST(contains(lower(recommendation), {q(w)}) AS BIGINT)" for w in words)


KEYWORDS_SQL = f"""SELECT repo, path, count(*) AS n_recs, {", ".join(f"CAST(sum({_own(a)}) AS DOUBLE) AS {a}" for a in K.ASPECT_KEYWORDS)}
FROM ({AQ.RECS_SQL}) r GROUP BY repo, path"""


@register("own_keyword_metrics", KEYWORDS_SQL)
def q_own_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: file metrics with a user's keyword lists, over all files and rules."""
    keywords = {**K.ASPECT_KEYWORDS, **OWN_KEYWORDS}
    return K.file_metrics(analyze(derived_files(spark, sf_dir)), keywords=keywords).select("repo", "path", "n_recs", *K.ASPECT_KEYWORDS)


# ---------------------------------------------------------------- Q1/Q4 own rules

_MARKS = {"U1": r"(?i)todo", "U2": r"\bpool\b|=="}


def _own_rule(rule_id: str, pattern: str) -> Rule:
    """Both rules call their prepared lines ``hits``."""
    def build(c):
        return F.transform(c.extra["hits"], lambda ln: finding(ln, F.concat(F.lit(f"{rule_id} at "), ln.cast("string"))))

    return Rule(rule_id, build, prep=(("hits", lambda c: T.match_lines(c.content, pattern)),))


def _tabs(files):
    import pandas as pd

    counts = files["content"].str.count("\t")
    hit = files[counts > 0]
    return pd.DataFrame({**{c: hit[c] for c in ("repo", "path", "lang")}, "line": 0, "col": 0, "msg": counts[counts > 0].map("{} tabs".format)})


USER_RULES_SQL = f"WITH {FILES_CTE}\n" + "\nUNION ALL ".join(
    f"SELECT repo, path, '{r}' AS rule_id, ln AS line, '{r} at ' || CAST(ln AS VARCHAR) AS msg FROM (SELECT repo, path, CAST(unnest({match_lines_sql('content', p)}) AS INT) AS ln FROM files) x"
    for r, p in _MARKS.items()
) + """
UNION ALL SELECT repo, path, 'U3', 0, CAST(length(content) - length(replace(content, chr(9), '')) AS VARCHAR) || ' tabs' FROM files WHERE contains(content, chr(9))"""


@register("user_rules", USER_RULES_SQL)
def q_user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1/Q4: two rules of a user that prepare different columns under one name,
    and an analyzer over batches, unioned."""
    files = derived_files(spark, sf_dir)
    found = run_rules(files, [_own_rule(r, p) for r, p in _MARKS.items()])
    return found.unionByName(batch_rule(files, "U3", _tabs)).select("repo", "path", "rule_id", "line", "msg")
