"""Review-comment operators: scoring (J), gate and band (B10/B11), reports (K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions import scoring

GATE = 70.0


def comment_features(comments: DataFrame, message: str = "message") -> DataFrame:
    """Per-comment raw counts (J2, J3, J5-J9, J11) next to the key columns."""
    feats = scoring.features(F.col(message))
    keep = [c for c in comments.columns if c != message]
    return comments.select(*keep, *[v.cast("bigint").alias(k) for k, v in feats.items()])


def score_comments(comments: DataFrame, aspects: Column | None = None, message: str = "message") -> DataFrame:
    """Thoroughness, clarity, actionability, overall, comment_length.

    Three projections: raw counts, aspect scores, overall. Each expensive
    expression is computed once per row; the optimizer does not inline a
    costly column that a later projection reads several times."""
    m = F.col(message)
    feats = scoring.features(m)
    staged = comments.select("*", *[v.alias(f"_f_{k}") for k, v in feats.items()])
    f = {k: F.col(f"_f_{k}") for k in feats}
    empty = m == ""

    def pick(name: str, value: Column) -> Column:
        v = value if aspects is None else F.when(scoring.aspect_selected(aspects, name), value).otherwise(F.lit(0.0))
        return F.when(empty, F.lit(0.0)).otherwise(v)

    staged = staged.select(
        "*",
        pick("thoroughness", scoring.thoroughness(m, f)).alias("thoroughness"),
        pick("clarity", scoring.clarity(m, f)).alias("clarity"),
        pick("actionability", scoring.actionability(m, f)).alias("actionability"),
    )
    overall = scoring.overall(m, F.col("thoroughness"), F.col("clarity"), F.col("actionability"))
    return staged.select(
        *comments.columns,
        "thoroughness", "clarity", "actionability",
        overall.alias("overall"),
        F.octet_length(m).cast("bigint").alias("comment_length"),
        scoring.recommendations(m).alias("recommendations"),
    )


def gate(scored: DataFrame, threshold: Column | float = GATE) -> DataFrame:
    """Quality band per aspect and overall, and the threshold flag."""
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.select(
        "*",
        scoring.quality_band(F.col("overall")).alias("band"),
        (F.col("overall") >= thr).alias("meets_threshold"),
    )


def _pct(label: str, score: Column) -> Column:
    return F.when(
        score > 0,
        F.concat(scoring.quality_band(score), F.lit(f" **{label}**: "), F.format_string("%.1f", score), F.lit("%\n")),
    ).otherwise(F.lit(""))


def quality_report(scored: DataFrame, include_recommendations: Column | bool = True, threshold: float = GATE) -> DataFrame:
    """K8: the quality section of the reply, one text per comment."""
    inc = include_recommendations if isinstance(include_recommendations, Column) else F.lit(bool(include_recommendations))
    thr_txt = f"{threshold:.1f}"
    recs = F.col("recommendations")
    text = F.concat(
        F.lit("## Code Review Quality Analysis\n\n"),
        _pct("Thoroughness", F.col("thoroughness")),
        _pct("Clarity", F.col("clarity")),
        _pct("Actionability", F.col("actionability")),
        F.when(F.col("overall") >= threshold, F.lit(f"\n✅ **Meets quality threshold** ({thr_txt}%)\n")).otherwise(
            F.lit(f"\n⚠️ **Below quality threshold** ({thr_txt}%)\n")
        ),
        F.when(
            inc & (F.size(recs) > 0),
            F.concat(
                F.lit("\n### Recommendations for Improvement\n"),
                F.array_join(F.transform(recs, lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), ""),
            ),
        ).otherwise(F.lit("")),
    )
    return scored.withColumn("quality_text", text)


def has_code_or_file_reference(message: Column) -> Column:
    """B9."""
    return (
        F.contains(message, F.lit("```"))
        | F.contains(message, F.lit(".java"))
        | F.contains(message, F.lit(".py"))
        | F.contains(message, F.lit(".js"))
        | F.contains(message, F.lit(".go"))
    )
