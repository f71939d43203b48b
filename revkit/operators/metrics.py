"""K: aggregations over findings and files (file metrics, repo quality,
counts, report sections)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions.scoring import DEFAULT_ASPECTS
from revkit.session import written

# Keyword lists of the per-file aspect score.
ASPECT_KEYWORDS = {
    "thoroughness": [
        "performance", "security", "scalability", "maintainability", "testing", "edge case", "complexity",
        "algorithm", "pattern", "readability", "efficiency", "memory", "time complexity", "space complexity",
    ],
    "clarity": ["clear", "concise", "understandable", "readable", "well-documented", "simple", "consistent"],
    "actionability": [
        "fix", "improve", "change", "refactor", "optimize", "add", "remove", "implement", "consider", "suggest", "recommend",
    ],
}


def keyword_score(rec: Column, aspect: str, keywords: dict[str, list[str]] | None = None) -> Column:
    """K1 for one recommendation: +1 per keyword contained (lower-cased)."""
    low = F.lower(rec)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in (keywords or ASPECT_KEYWORDS)[aspect]), F.lit(0))


def file_metrics(findings: DataFrame, aspects: Sequence[str] = DEFAULT_ASPECTS, rec_col: str = "msg",
                 keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """K1/K2: per file (with at least one recommendation) the aspect scores and overall.

    ``keywords`` (Q3) replaces the keyword list of any aspect.

    Per-row keyword scores are summed with a partial (map-side) aggregate,
    so only small partial sums are shuffled by (repo, path)."""
    rec = F.col(rec_col)
    scored = findings.select(
        "repo", "path",
        *[keyword_score(rec, a, keywords).alias(a) for a in ASPECT_KEYWORDS],
    )
    per_file = scored.groupBy("repo", "path").agg(
        F.count(F.lit(1)).alias("n_recs"), *[F.sum(a).cast("double").alias(a) for a in ASPECT_KEYWORDS]
    )
    # overall = sum over the listed aspects (unknown ones add 0) / number listed
    parts = [F.col(a.lower()) if a.lower() in ASPECT_KEYWORDS else F.lit(0.0) for a in aspects]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    overall = total / F.lit(float(len(aspects))) if aspects else F.lit(0.0)
    shown = {a: (F.col(a) if any(x.lower() == a for x in aspects) else F.lit(0.0)).alias(a) for a in ASPECT_KEYWORDS}
    return per_file.select("repo", "path", "n_recs", *shown.values(), overall.alias("overall"))


def repo_quality(metrics: DataFrame) -> DataFrame:
    """K3: mean file quality and analysed-file count per repository."""
    return metrics.groupBy("repo").agg(F.avg("overall").alias("mean_quality"), F.count(F.lit(1)).alias("files_analyzed"))


def language_counts(files: DataFrame) -> DataFrame:
    """K6: files per repo and language, plus the known-language total."""
    return files.groupBy("repo", "lang").agg(F.count(F.lit(1)).alias("files"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """K5: PHP issues per file, severity and type."""
    return issues.groupBy("repo", "path", "severity", "type").agg(F.count(F.lit(1)).alias("issues"))


#: Rule families whose recommendations of a file are listed by their text, after the others.
BY_TEXT = ("H", "I")
#: The rule id of a file that could not be read; its message is the error (K9).
UNREAD = "K9"


def file_recommendations(findings: DataFrame, by: Sequence[str] = ("repo", "path"), before: Sequence[str] = ()) -> DataFrame:
    """K4: ordered recommendation list per file, or its ``error`` (K9); files
    with neither drop out.

    In the order of the columns ``before``, then rule order and match order; the
    Python and Go bundles by text. ``by`` names the file. The list is bounded by
    one file's findings (never a repo's)."""
    by_text = F.substring("rule_id", 1, 1).isin(*BY_TEXT)
    seq, occ = (F.when(by_text, F.lit(1 << 30)).otherwise(F.col(c)).alias(c) for c in ("rule_seq", "occ"))
    unread = F.col("rule_id") == UNREAD
    entry = F.when(~unread, F.struct(*before, seq, occ, F.col("msg").alias("rec")))
    ordered = F.array_sort(F.collect_list(entry))
    error = F.max(F.when(unread, F.col("msg"))).alias("error")
    return findings.groupBy(*by).agg(F.transform(ordered, lambda x: x["rec"]).alias("recommendations"), error)


#: The lines of the code-analysis report.
REPORT_HEAD = "## Code Analysis Results\n\n"
FILES_HEAD = "### Analyzed Files:\n"
RECOMMENDATIONS_HEAD = "### Recommendations:\n"
NO_ISSUES = "No issues found in the analyzed files.\n"


def report_sections(file_recs: DataFrame, repos: DataFrame | None = None, by: str = "repo") -> DataFrame:
    """K7/K9: the code-analysis report as rows (``by``, seq, path, text), to be
    read in the order (``by``, seq, path) (N5; see ``ordered_report``).

    seq 0: report header; 1: the list of analysed files, if a file has
    recommendations; 2: the recommendations header, if there is a recommendation
    or an error; 3: one block per file (or its ``error``, K9), or the line that
    nothing was found. ``repos`` (default: those in ``file_recs``) names the
    repositories that get a report; no repository is ever gathered into one
    value, and the findings are evaluated once: the files' rows are written, each
    is exploded into its lines, and the headers count these."""
    file_recs = written(file_recs, "file-recommendations")  # the headers need so few columns that Spark would run all rules again for them
    item = lambda seq, path, text: F.struct(F.lit(seq).alias("seq"), path.alias("path"), text.alias("text"))
    listed = F.concat(F.lit("- "), F.col("path"), F.lit("\n"))
    block = F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), F.array_join(F.transform("recommendations", lambda r: F.concat(F.lit("- "), r, F.lit("\n"))), ""))
    error = F.col("error") if "error" in file_recs.columns else F.lit(None).cast("string")
    failed = F.concat(F.lit("## "), F.col("path"), F.lit("\n- Error during analysis: "), error, F.lit("\n"))
    items = F.when(error.isNotNull(), F.array(item(3, F.col("path"), failed))).otherwise(F.array(item(1, F.col("path"), listed), item(3, F.col("path"), block)))
    lines = file_recs.select(by, F.explode(items).alias("x")).select(by, "x.*")
    repos = (file_recs if repos is None else repos).select(by).distinct()
    none = F.lit("")
    counts = lines.groupBy(by).agg(F.count(F.when(F.col("seq") == 1, 1)).alias("files"), F.count(F.lit(1)).alias("blocks"))
    heads = repos.join(counts, by, "left")
    files, blocks = F.coalesce("files", F.lit(0)) > 0, F.coalesce("blocks", F.lit(0)) > 0
    shown = F.array(
        item(0, none, F.lit(REPORT_HEAD)),
        F.when(files, item(1, none, F.lit(FILES_HEAD))),
        F.when(files, item(2, none, F.lit("\n" + RECOMMENDATIONS_HEAD))).when(blocks, item(2, none, F.lit(RECOMMENDATIONS_HEAD))),
        F.when(~blocks, item(3, none, F.lit(NO_ISSUES))),
    )
    heads = heads.select(by, F.explode(F.filter(shown, lambda x: x.isNotNull())).alias("x")).select(by, "x.*")
    return heads.unionByName(lines)


def ordered_report(sections: DataFrame, by: str = "repo") -> DataFrame:
    """The report rows in reading order (a range-partitioned sort, for a writer)."""
    return sections.orderBy(by, "seq", "path")


def report_text(sections: DataFrame, by: str = "repo") -> DataFrame:
    """K7: one text per report, for reports that one reply can hold."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "path", "text")))
    return sections.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("report"))
