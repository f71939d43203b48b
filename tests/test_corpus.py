"""The derived corpora reach the rules: every branch that a registered query checks occurs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"


def values(spark, query, column):
    return {r[0] for r in E.queries()[query](spark, SF).select(column).distinct().collect()}


def test_scores_reach_every_band(spark):
    assert values(spark, "quality_gate", "band") == {"🟢", "🟡", "🔴"}
    assert values(spark, "quality_gate", "meets_threshold") == {True, False}


def test_history_is_longer_than_the_last_ten(spark):
    assert max(values(spark, "history_trends", "hist_count")) > 10


def test_references_resolve_and_clamp(spark):
    df = E.queries()["comment_context"](spark, SF).cache()
    found = df.where("shown_start IS NOT NULL")
    assert found.count() > 0 and df.where("shown_start IS NULL").count() > 0
    assert found.where(F.col("filename") == F.upper("filename")).count() > 0  # found by another case
    assert found.where("shown_end <> line_end").count() > 0 and found.where("shown_start <> line_start").count() > 0


def test_targeted_checks_all_fire(spark):
    assert values(spark, "targeted_recommendations", "check_id") == {"E8a", "E8b", "E9a", "E9b", "E9c", "E10a", "E10b"}


@pytest.mark.parametrize("query, texts", [
    ("java_findings", ["Try block without catch"]),
    ("go_block_findings", ["is too long", "Naked return", "properly return or handle the error", "Many error checks"]),
    ("go_findings", ["Exported function 'Many'"]),
    ("aspect_findings", ["Consider adding type hints", "smaller modules", "shorter variable declarations"]),
])
def test_rules_fire(spark, query, texts):
    out = E.queries()[query](spark, SF).cache()
    for t in texts:
        assert out.where(F.contains("recommendation", F.lit(t))).count() > 0, t


def test_stream_rate_limit_fires(spark):
    assert E.queries()["stream_rate_limited"](spark, SF).count() > 0
