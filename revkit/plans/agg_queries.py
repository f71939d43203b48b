"""Registered aggregation (K), report (K8) and history-window (L) queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import history as L
from revkit.operators import metrics as K
from revkit.operators import reviews
from revkit.operators.analyze import analyze
from revkit.plans import file_queries as FQ
from revkit.plans.queries import _SCORES_SQL, ORACLE, _scores, register
from revkit.plans.sqlkit import FILES_CTE, q
from revkit.sources.files import derived_files
from revkit.sources.tables import REVIEW_COMMENTS_SQL

# ------------------------------------------------------------- K1-K4 metrics

RECS_SQL = "\nUNION ALL ".join(
    f"SELECT repo, path, recommendation FROM ({sql}) r{i}"
    for i, sql in enumerate(
        (FQ.ASPECTS_SQL, FQ.COMMON_SQL, FQ.JAVA_SQL, FQ.PHP_RECS_SQL, FQ.PYTHON_SQL, ORACLE["python_stateful_findings"], FQ.GO_SQL, ORACLE["go_block_findings"])
    )
)


def _kw_sql(aspect: str) -> str:
    return " + ".join(f"CAST(contains(lower(recommendation), {q(k)}) AS BIGINT)" for k in K.ASPECT_KEYWORDS[aspect])


FILE_METRICS_SQL = f"""WITH recs AS ({RECS_SQL}),
m AS (SELECT repo, path, count(*) AS n_recs,
        CAST(sum({_kw_sql('thoroughness')}) AS DOUBLE) AS thoroughness,
        CAST(sum({_kw_sql('clarity')}) AS DOUBLE) AS clarity,
        CAST(sum({_kw_sql('actionability')}) AS DOUBLE) AS actionability
      FROM recs GROUP BY repo, path)
SELECT repo, path, n_recs, thoroughness, clarity, actionability, (thoroughness + clarity + actionability) / 3.0::DOUBLE AS overall FROM m"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.file_metrics(analyze(derived_files(spark, sf_dir)))


@register("file_metrics", FILE_METRICS_SQL)
def q_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1/K2: keyword aspect scores and overall per file of every language over
    its full recommendation list (aspects D and the rules of its language)."""
    return _metrics(spark, sf_dir)


REPO_QUALITY_SQL = f"""WITH fm AS ({FILE_METRICS_SQL})
SELECT repo, round(avg(overall), 6) AS mean_quality, count(*) AS files_analyzed FROM fm GROUP BY repo"""


@register("repo_quality", REPO_QUALITY_SQL)
def q_repo_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: mean file quality per repository (rounded to 6 places: float sums
    are order dependent)."""
    return K.repo_quality(_metrics(spark, sf_dir)).select(
        "repo", F.round("mean_quality", 6).alias("mean_quality"), "files_analyzed"
    )


LANG_COUNTS_SQL = f"""WITH {FILES_CTE}
SELECT repo, lang, count(*) AS files FROM files WHERE lang <> 'unknown' GROUP BY repo, lang"""


@register("language_counts", LANG_COUNTS_SQL)
def q_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1/B2/K6: known-language file counts per repository (reads paths only)."""
    files = derived_files(spark, sf_dir).where(F.col("lang") != "unknown")
    return K.language_counts(files)


SEVERITY_SQL = f"""WITH i AS ({FQ.PHP_ISSUES_SQL})
SELECT repo, path, severity, type, count(*) AS issues FROM i GROUP BY repo, path, severity, type"""


@register("php_severity_counts", SEVERITY_SQL)
def q_php_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PHP issues per file, severity and type."""
    from revkit.operators import php as G

    files = derived_files(spark, sf_dir).where(F.col("lang") == "php")
    return K.severity_counts(G.issue_rows(files))


# ------------------------------------------------------------- K8 report

def _fmt(col: str, label: str) -> str:
    band = f"CASE WHEN {col} >= 85 THEN '🟢' WHEN {col} >= 70 THEN '🟡' ELSE '🔴' END"
    return f"CASE WHEN {col} > 0 THEN {band} || ' **{label}**: ' || printf('%.1f', {col}) || '%' || chr(10) ELSE '' END"


QUALITY_REPORT_SQL = f"""WITH s AS ({_SCORES_SQL})
SELECT review_id, '## Code Review Quality Analysis' || chr(10) || chr(10) || {_fmt('thoroughness', 'Thoroughness')} || {_fmt('clarity', 'Clarity')}
  || {_fmt('actionability', 'Actionability')}
  || CASE WHEN overall >= 70 THEN chr(10) || '✅ **Meets quality threshold** (70.0%)' || chr(10) ELSE chr(10) || '⚠️ **Below quality threshold** (70.0%)' || chr(10) END
  || CASE WHEN message = '' THEN chr(10) || '### Recommendations for Improvement' || chr(10) || '- No review comment provided. Please add detailed comments about the code.' || chr(10) ELSE '' END
  AS quality_text
FROM s JOIN (SELECT review_id, message FROM ({REVIEW_COMMENTS_SQL}) m) USING (review_id)"""


@register("quality_report", QUALITY_REPORT_SQL)
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality section of the reply for every comment."""
    return reviews.quality_report(_scores(spark, sf_dir)).select("review_id", "quality_text")


# ------------------------------------------------------------- L history

def _label_sql(x: str, pos: str, neg: str, zero: str, up: str, down: str, big: float = 5) -> str:
    emoji = f"CASE WHEN {x} > {big} THEN '{pos}' WHEN {x} < -{big} THEN '{neg}' ELSE '➡️' END"
    txt = (
        f"CASE WHEN abs({x}) < 2 THEN '{zero}' WHEN {x} > 0 THEN '{up} (+' || printf('%.1f', round({x}, 1)) || '%)' "
        f"ELSE '{down} (' || printf('%.1f', round(abs({x}), 1)) || '%)' END"
    )
    return emoji, txt


def _history_sql(comments: str = REVIEW_COMMENTS_SQL) -> str:
    te, tt = _label_sql("trend", "📈", "📉", "Stable", "Improving", "Declining")
    ce, ct = _label_sql("round(overall - hist_avg, 6)", "🌟", "⚠️", "On par with typical reviews", "Above average", "Below average")
    return f"""WITH s AS ({_SCORES_SQL}),
c AS (SELECT s.*, m.ts, CAST(floor(epoch(m.ts) / 86400) AS BIGINT) AS period FROM s JOIN (SELECT review_id, ts FROM ({comments}) x) m USING (review_id)),
w AS (
  SELECT *,
    count(overall) OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_count,
    avg(overall) OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_avg,
    count(overall) OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n_recent,
    last(overall) OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last_v,
    first(overall) OVER (PARTITION BY channel_id, period ORDER BY ts, review_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS first_v
  FROM c
),
t AS (SELECT *, CASE WHEN n_recent >= 2 THEN last_v - first_v ELSE 0.0::DOUBLE END AS trend FROM w)
SELECT review_id, channel_id, period, hist_count, round(hist_avg, 6) AS hist_avg, round(trend, 6) AS trend,
  CASE WHEN hist_count > 0 THEN {te} || ' Quality trend: ' || {tt} END AS trend_label,
  CASE WHEN hist_count > 0 THEN {ce} || ' Compared to average: ' || {ct} END AS comparison_label
FROM t"""


HISTORY_SQL = _history_sql()


@register("history_trends", HISTORY_SQL)
def q_history_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running average and last-10 trend per channel and 24 h period,
    a channel's day split into buckets."""
    h = L.with_history_split(_scores(spark, sf_dir))
    return h.select(
        "review_id", "channel_id", "period", "hist_count", F.round("hist_avg", 6).alias("hist_avg"), F.round("trend", 6).alias("trend"),
        F.when(F.col("hist_count") > 0, L.trend_label(F.col("trend"))).alias("trend_label"),
        F.when(F.col("hist_count") > 0, L.comparison_label(F.col("overall"), F.col("hist_avg"))).alias("comparison_label"),
    )


HISTORY_SPLIT_SQL = f"""WITH h AS ({HISTORY_SQL}) SELECT review_id, channel_id, period, hist_count, hist_avg, trend FROM h"""


@register("history_trends_split", HISTORY_SPLIT_SQL)
def q_history_trends_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L3 with hot channels split into 5-minute buckets (prefix sums over
    buckets), same numbers as the single-window plan."""
    h = L.with_history_split(_scores(spark, sf_dir), bucket_seconds=300)
    return h.select("review_id", "channel_id", "period", "hist_count", F.round("hist_avg", 6).alias("hist_avg"), F.round("trend", 6).alias("trend"))
