"""Registered request queries: A4 parse, B5-B9/B12 settings, validation, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.operators import requests as R
from revkit.plans.queries import register
from revkit.sources import tables

# Request fields derived from each review comment (same SQL in both engines).
REQUEST_FIELDS_SQL = f"""SELECT review_id, channel_id, message,
  'repo' || CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING) AS repo,
  CASE review_id % 5 WHEN 0 THEN 'github' WHEN 1 THEN 'direct' WHEN 2 THEN 'gitlab' WHEN 3 THEN '' ELSE 'github' END AS code_source,
  CASE review_id % 7
    WHEN 0 THEN 'https://github.com/acme/repo' || CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING)
    WHEN 1 THEN 'https://gitlab.com/acme/repo' || CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING)
    WHEN 2 THEN 'https://github.com/acme'
    WHEN 3 THEN ''
    WHEN 4 THEN 'https://bitbucket.org/team/repo' || CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING) || '.git'
    WHEN 5 THEN 'http://example.com/a/b'
    ELSE 'https://github.com/acme/repo' || CAST(CAST(floor(review_id / 100) AS BIGINT) % 5 AS STRING) || '/blob/main/x.py' END AS repository_url,
  CASE review_id % 3 WHEN 0 THEN '85' WHEN 1 THEN 'abc' ELSE '70.5' END AS threshold_text,
  CASE review_id % 4 WHEN 0 THEN 'Thoroughness,Clarity,Actionability' WHEN 1 THEN 'Thoroughness, Clarity' WHEN 2 THEN 'clarity'
    ELSE 'Actionability,Thoroughness' END AS aspects_text,
  CASE review_id % 2 WHEN 0 THEN 'true' ELSE 'false' END AS include_text,
  review_id % 11 = 0 AS make_corrupt
FROM ({tables.REVIEW_COMMENTS_SQL}) rc"""


def request_json(spark: SparkSession, sf_dir: str, fields: str = REQUEST_FIELDS_SQL) -> DataFrame:
    """A4 input: one JSON request body per review comment (some cut short,
    so they do not decode; some repeat a setting so the last one wins)."""
    tables.register(spark, sf_dir, ("conversations",))
    f = spark.sql(fields)

    def s(label: str, v) -> F.Column:
        return F.struct(
            F.lit(label).alias("label"), F.lit("text").alias("type"), F.lit("").alias("description"), v.alias("default"),
            v.alias("value"), F.lit(True).alias("required"), F.array().cast("array<string>").alias("options"),
        )

    settings = F.concat(
        F.when(F.col("review_id") % 6 == 0, F.array(s("repository_url", F.lit("https://github.com/old/stale")))).otherwise(F.array()),
        F.array(s("repository_url", F.col("repository_url"))),
        F.when(F.col("code_source") != "", F.array(s("code_source", F.col("code_source")))).otherwise(F.array()),
        F.array(
            s("minimum_quality_threshold", F.col("threshold_text")),
            s("analysis_aspects", F.col("aspects_text")),
            s("include_recommendations", F.col("include_text")),
        ),
    )
    body = F.to_json(F.struct(F.col("channel_id"), F.col("message"), settings.alias("settings")))
    value = F.when(F.col("make_corrupt"), F.substr(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).otherwise(body)
    return f.select("review_id", "repo", value.alias("value"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_messages(request_json(spark, sf_dir))


VALIDATION_SQL = f"""WITH r AS ({REQUEST_FIELDS_SQL})
SELECT review_id,
  CASE WHEN make_corrupt THEN 400 WHEN message = '' THEN 400 WHEN code_source = '' THEN 400
       WHEN code_source = 'github' AND repository_url = '' THEN 400
       WHEN code_source = 'github' AND NOT starts_with(repository_url, 'https://github.com/') THEN 400
       WHEN code_source = 'github' AND len(string_split(substr(repository_url, 20), '/')) < 2 THEN 400
       WHEN code_source = 'github' AND NOT (contains(message, 'UserAuthentication.java') OR contains(message, 'user_service.py') OR contains(message, 'auth.js')) THEN 400
       WHEN code_source = 'github' THEN 200
       WHEN code_source = 'direct' AND NOT (contains(message, '```') OR contains(message, '.java') OR contains(message, '.py') OR contains(message, '.js') OR contains(message, '.go')) THEN 400
       WHEN code_source = 'direct' THEN 200 ELSE 400 END AS http_status,
  CASE WHEN make_corrupt THEN 'Invalid request body' WHEN message = '' THEN 'Empty message'
       WHEN code_source = '' THEN 'Missing required setting: code_source'
       WHEN code_source = 'github' AND repository_url = '' THEN 'Repository URL is required for GitHub source'
       WHEN code_source = 'github' AND NOT starts_with(repository_url, 'https://github.com/') THEN 'Invalid repository URL: ' || repository_url
       WHEN code_source = 'github' AND len(string_split(substr(repository_url, 20), '/')) < 2 THEN 'Invalid repository URL format'
       WHEN code_source = 'github' AND NOT (contains(message, 'UserAuthentication.java') OR contains(message, 'user_service.py') OR contains(message, 'auth.js')) THEN 'no code references found in comment'
       WHEN code_source = 'github' THEN NULL
       WHEN code_source = 'direct' AND NOT (contains(message, '```') OR contains(message, '.java') OR contains(message, '.py') OR contains(message, '.js') OR contains(message, '.go')) THEN 'No code references found in comment'
       WHEN code_source = 'direct' THEN NULL ELSE 'Unsupported code source: ' || code_source END AS error
FROM r"""


@register("request_validation", VALIDATION_SQL)
def q_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 (JSON decode, corrupt bodies kept) + B8/B9 validation status per request."""
    v = R.validate(_parsed(spark, sf_dir), field="value")
    return v.select("review_id", F.col("http_status").cast("int").alias("http_status"), "error")


def _url_sql(col: str) -> tuple[str, str]:
    host = f"regexp_extract({col}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)', 1)"
    path = f"regexp_extract({col}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return host, path


def _settings_sql(fields: str = REQUEST_FIELDS_SQL) -> str:
    host, path = _url_sql("repository_url")
    parts = f"string_split(regexp_replace({path}, '^/+|/+$', '', 'g'), '/')"
    prov = f"CASE {host} WHEN 'github.com' THEN 'github' WHEN 'gitlab.com' THEN 'gitlab' WHEN 'bitbucket.org' THEN 'bitbucket' END"
    err = (
        f"CASE WHEN repository_url = '' THEN 'empty repository URL' WHEN {prov} IS NULL THEN 'unsupported repository provider: ' || {host} "
        f"WHEN len({parts}) < 2 THEN 'invalid repository URL format' END"
    )
    return f"""WITH r AS ({fields}), v AS (SELECT *, {err} AS e FROM r WHERE NOT make_corrupt)
SELECT review_id, repository_url, CASE WHEN code_source = '' THEN 'github' ELSE code_source END AS code_source,
  coalesce(TRY_CAST(threshold_text AS DOUBLE), 70.0::DOUBLE) AS threshold,
  array_to_string(list_transform(string_split(aspects_text, ','), lambda a: lower(a)), '|') AS aspects,
  include_text = 'true' AS include_recommendations,
  CASE WHEN code_source <> 'direct' AND e IS NULL THEN {prov} END AS provider,
  CASE WHEN code_source <> 'direct' AND e IS NULL THEN {parts}[1] END AS owner,
  CASE WHEN code_source <> 'direct' AND e IS NULL THEN {parts}[2] END AS repo_name,
  CASE WHEN code_source <> 'direct' THEN e END AS route_error
FROM v"""


SETTINGS_SQL = _settings_sql()


@register("request_settings", SETTINGS_SQL)
def q_request_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 (last setting wins, defaults, unparsable threshold keeps 70), B7
    (aspect list split untrimmed, compared lower-cased), B5 URL parse, B12 routing."""
    p = _parsed(spark, sf_dir).where(~F.col("corrupt"))
    routed = R.route(R.resolve_settings(p, field="default"))
    return routed.select(
        "review_id", "repository_url", "code_source", "threshold",
        F.array_join(F.transform("aspects", lambda a: F.lower(a)), "|").alias("aspects"),
        "include_recommendations", "provider", "owner", "repo_name", "route_error",
    )



# --------------------------------------------------------------- M7 repo join

def _repo_reports_sql() -> str:
    from revkit.plans.agg_queries import REPO_QUALITY_SQL

    return f"""WITH s AS ({SETTINGS_SQL}), rq AS ({REPO_QUALITY_SQL})
SELECT s.review_id, s.repo_name, rq.files_analyzed, rq.mean_quality
FROM s JOIN rq ON rq.repo = s.repo_name
WHERE s.code_source <> 'direct' AND s.route_error IS NULL"""


def _register_repo_reports():
    @register("request_repo_reports", _repo_reports_sql())
    def q_request_repo_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each routed (non-direct) request joined to its repository's
        file-quality summary; every repository is analysed once, then joined."""
        from revkit.plans.agg_queries import q_repo_quality

        routed = q_request_settings(spark, sf_dir).where((F.col("code_source") != "direct") & F.col("route_error").isNull())
        quality = q_repo_quality(spark, sf_dir)
        return routed.join(quality, routed.repo_name == quality.repo).select("review_id", "repo_name", "files_analyzed", "mean_quality")


_register_repo_reports()
