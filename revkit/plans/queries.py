"""Registered queries: one Spark plan per operator family, each with the
DuckDB SQL that computes the same rows from the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revkit.functions import scoring as S
from revkit.operators import reviews
from revkit.plans.sqlkit import COMMENTS_CTE, cnt, count_sub, has, q
from revkit.sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return deco


# ---------------------------------------------------------------- comments (J)

def _feature_sql(m: str = "message") -> dict[str, str]:
    low = f"lower({m})"
    field = S._FIELD.replace("\\x0B", "\\x{0B}")
    return {
        "file_refs": cnt(m, S.FILE_MENTION),
        "code_elements": cnt(m, S.CODE_ELEMENT),
        "technical_terms": " + ".join(f"CAST({has(low, t)} AS BIGINT)" for t in S.TECHNICAL_TERMS),
        "paragraphs": f"({count_sub(m, chr(10) * 2)} + 1)",
        "list_items": f"({cnt(m, S.BULLET)} + {cnt(m, S.NUMBERED)})",
        "explanations": cnt(low, S.EXPLANATION),
        "code_spans": cnt(m, S.CODE_SPAN),
        "comparatives": cnt(low, S.COMPARATIVE),
        "long_sentences": f"len(list_filter(regexp_split_to_array({m}, {q(S.SENTENCE_SPLIT)}), lambda s: len(regexp_extract_all(s, {q(field)})) > 25))",
        "suggestions": cnt(m, S.SUGGESTION),
        "inline_code": cnt(m, S.INLINE_CODE),
        "block_code": cnt(m, S.BLOCK_CODE),
        "action_items": cnt(m, S.ACTION_ITEM),
        "todo_items": cnt(m, S.TODO_MARKER),
        "implementation": cnt(m, S.IMPLEMENTATION),
    }


def _fix_newlines(sql: str) -> str:
    # count_sub received a literal two-newline string; SQL needs chr(10) || chr(10)
    return sql.replace("'\n\n'", "chr(10) || chr(10)")


_FEATURES_SQL = _fix_newlines(
    f"""WITH {COMMENTS_CTE}
SELECT review_id, channel_id, CAST(ts AS VARCHAR) AS ts,
  {", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _feature_sql().items())}
FROM rc"""
)


@register("comment_features", _FEATURES_SQL)
def q_comment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rc = tables.review_comments(spark, sf_dir).withColumn("ts", F.col("ts").cast("string"))
    return reviews.comment_features(rc)


def _D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_SCORES_SQL = f"""WITH feats AS ({_FEATURES_SQL.replace("SELECT review_id, channel_id, CAST(ts AS VARCHAR) AS ts,", "SELECT review_id, channel_id, message,")}),
asp AS (
  SELECT review_id, channel_id, message,
    CASE WHEN message = '' THEN 0.0::DOUBLE ELSE least(30.0::DOUBLE + least({_D('file_refs')} * 10.0::DOUBLE, 20.0::DOUBLE)
      + least({_D('code_elements')} * 5.0::DOUBLE, 15.0::DOUBLE) + least({_D('technical_terms')} * 5.0::DOUBLE, 25.0::DOUBLE), 100.0::DOUBLE) END AS t,
    CASE WHEN message = '' THEN 0.0::DOUBLE ELSE (greatest(least({_D('paragraphs')} * 0.7::DOUBLE, 2.0::DOUBLE), least({_D('list_items')} * 0.5::DOUBLE, 2.0::DOUBLE))
      + least({_D('explanations')} * 0.8::DOUBLE, 2.5::DOUBLE) + least({_D('code_spans')} * 1.0::DOUBLE, 2.5::DOUBLE)
      + least({_D('comparatives')} * 0.5::DOUBLE, 1.5::DOUBLE) + (1.5::DOUBLE - least({_D('long_sentences')} * 0.5::DOUBLE, 1.5::DOUBLE))) / 10.0::DOUBLE * 100.0::DOUBLE END AS c,
    CASE WHEN message = '' THEN 0.0::DOUBLE ELSE (least({_D('suggestions')} * 0.6::DOUBLE, 2.5::DOUBLE)
      + least({_D('inline_code')} * 0.7::DOUBLE + {_D('block_code')} * 1.5::DOUBLE, 3.0::DOUBLE)
      + least({_D('action_items')} * 0.8::DOUBLE + {_D('todo_items')} * 1.0::DOUBLE, 2.5::DOUBLE)
      + least({_D('implementation')} * 0.6::DOUBLE, 2.0::DOUBLE)) / 10.0::DOUBLE * 100.0::DOUBLE END AS a
  FROM feats
),
ov AS (
  SELECT *,
    CASE WHEN (t > 0)::INT + (c > 0)::INT + (a > 0)::INT > 0 THEN
      (CASE WHEN t > 0 THEN t ELSE 0.0::DOUBLE END + CASE WHEN c > 0 THEN c ELSE 0.0::DOUBLE END + CASE WHEN a > 0 THEN a ELSE 0.0::DOUBLE END)
      / ((t > 0)::INT + (c > 0)::INT + (a > 0)::INT) ELSE 0.0::DOUBLE END AS mean
  FROM asp
)
SELECT review_id, channel_id, CAST(strlen(message) AS BIGINT) AS comment_length,
  t AS thoroughness, c AS clarity, a AS actionability,
  CASE WHEN message = '' THEN 0.0::DOUBLE WHEN {count_sub('message', ' ')} + 1 > 10 AND mean < 30 THEN 30.0::DOUBLE ELSE mean END AS overall
FROM ov"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.score_comments(tables.review_comments(spark, sf_dir))


@register("comment_scores", _SCORES_SQL)
def q_comment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select(
        "review_id", "channel_id", "comment_length", "thoroughness", "clarity", "actionability", "overall"
    )


_GATE_SQL = f"""WITH s AS ({_SCORES_SQL})
SELECT review_id, overall,
  CASE WHEN overall >= 85 THEN '🟢' WHEN overall >= 70 THEN '🟡' ELSE '🔴' END AS band,
  overall >= 70 AS meets_threshold
FROM s"""


@register("quality_gate", _GATE_SQL)
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews.gate(_scores(spark, sf_dir)).select("review_id", "overall", "band", "meets_threshold")


def chr(n: int) -> str:  # noqa: A001
    return "\n" if n == 10 else "\\x%02x" % n
