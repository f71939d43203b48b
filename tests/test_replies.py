"""A7 end to end on hand-made requests; A4/B8 rejects."""

import json
import os
import tempfile

from helpers import files_df
from pyspark.sql import functions as F

from revkit.operators import replies as A
from revkit.operators import requests as R
from revkit.operators.analyze import analyze
from revkit.sources.files import files_from_table

HEAD, NONE = "## Code Analysis Results\n\n", "No issues found in the analyzed files.\n"
RECS = {  # the file's recommendations by aspect, and those of its language
    "thoroughness": ["Add more documentation to src/a.py to improve code understanding", "Improve error handling in src/a.py", "Create unit tests for src/a.py"],
    "clarity": ["Improve naming clarity in src/a.py for: x"],
    "actionability": ["Address TODO comments in src/a.py", "Consider adding type hints for better code maintainability"],
}


def body(message, **settings):
    return json.dumps({"channel_id": settings.pop("channel", "c"), "message": message, "settings": [{"label": k, "default": v} for k, v in settings.items()]})


def answers(spark, rows, files):
    frame = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", b) for i, b in enumerate(rows)], "review_id long, ts string, value string")
    requests = R.parse_messages(frame.withColumn("ts", F.col("ts").cast("timestamp")))
    return {r.review_id: r for r in A.answer(requests, files, analyze(files).cache()).collect()}


def report(*recs):
    return HEAD + "### Analyzed Files:\n- src/a.py\n\n### Recommendations:\n## src/a.py\n\n" + "".join(f"- {r}\n" for r in recs)


def test_replies(spark):
    files = files_df(spark, [("src/a.py", "x = 1\n# TODO do\nexcept:\n")])
    url = "https://github.com/o/r"
    got = answers(
        spark,
        [
            body("", repository_url=url, analysis_aspects="Actionability,Clarity"),
            body("ok", repository_url=url, analysis_aspects="Actionability,Clarity,Clarity, Thoroughness", include_recommendations="false"),
            body("", repository_url=url, analysis_aspects="thoroughness", include_recommendations="false"),
            body("ok", repository_url=url),
            body("ok", code_source="direct", analysis_aspects="Clarity"),
            body("ok", repository_url="https://svn.org/o/r"),
            body("ok", repository_url="https://github.com/o/gone"),
            '{"message": "cut',
            body("because", repository_url=url, analysis_aspects="Clarity", channel="other"),
        ],
        files,
    )
    own = {r.msg for r in analyze(files).where("rule_id LIKE 'H%'").collect()}
    lang = sorted(own)
    assert lang  # the file's language rules are in every report, after the aspects
    asked = "\n### Recommendations for Improvement\n- No review comment provided. Please add detailed comments about the code.\n"
    low = "\n⚠️ **Below quality threshold** (70.0%)\n"
    quality = "## Code Review Quality Analysis\n\n"
    a, c, t = RECS["actionability"], RECS["clarity"], RECS["thoroughness"]
    assert got[0].message == report(*a, *c, *lang) + quality + low + asked
    assert got[1].message.startswith(report(*a, *c, *c, *lang) + quality + "🔴 **Clarity**: 22.0%\n" + low + "\n### Historical Perspective\n➡️ Quality trend: Stable\n")
    assert got[2].message.startswith(report(*t, *lang) + quality + low + "\n### Historical Perspective\n")
    assert got[3].message.startswith(report(*lang) + quality + low)  # no aspects are listed: none apply
    assert got[4].message.startswith(HEAD + NONE + quality + "🔴 **Clarity**: 22.0%\n" + low)
    assert (got[5].http_status, got[5].error) == (400, "Invalid repository URL: unsupported repository provider: svn.org")
    assert (got[6].http_status, got[6].error) == (500, A.NO_FILES)
    assert (got[7].http_status, got[7].error, got[7].message) == (400, "Invalid request body", None)
    assert got[8].message.startswith(report(*c, *lang)) and "Historical" not in got[8].message  # its channel has no history
    assert [got[i].files_analyzed for i in range(9)] == [1, 1, 1, 1, 0, 0, 0, 0, 1]


def test_mean_quality_follows_the_list_of_aspects(spark):
    files = files_df(spark, [("src/a.py", "x = 1\n# TODO do\nexcept:\n")])
    url = "https://github.com/o/r"
    rows = [body("m", repository_url=url, analysis_aspects=x) for x in ("Clarity,Actionability", "Clarity,unknown", "Actionability,Actionability", "")]
    got = answers(spark, rows, files)
    texts = [r.msg for r in analyze(files).where("rule_id LIKE 'H%'").collect()]

    def score(recs, aspect):
        from revkit.operators.metrics import ASPECT_KEYWORDS

        return sum(k in r.lower() for r in recs for k in ASPECT_KEYWORDS[aspect])

    both = RECS["clarity"] + RECS["actionability"] + texts
    assert got[0].mean_quality == (score(both, "clarity") + score(both, "actionability")) / 2
    assert got[1].mean_quality == score(RECS["clarity"] + texts, "clarity") / 2
    assert got[2].mean_quality == score(RECS["actionability"] * 2 + texts, "actionability")
    assert got[3].mean_quality == 0.0


def test_errors_and_repositories_apart(spark):
    rows = [("r", "src/a.js", "let a = 1", None), ("r", "src/bad.js", "", "error reading file src/bad.js: not valid UTF-8"), ("q", "src/test_a.js", "let a", None)]
    frame = spark.createDataFrame(rows, "repo string, path string, content string, error string")
    files = files_from_table(frame).join(frame.select("repo", "path", "error"), ["repo", "path"])
    got = answers(spark, [body("m", repository_url=f"https://gitlab.com/o/{r}", analysis_aspects="thoroughness") for r in ("r", "q")], files)
    assert got[0].message.startswith(
        HEAD + "### Analyzed Files:\n- src/a.js\n\n### Recommendations:\n## src/a.js\n\n- Create unit tests for src/a.js\n"
        "## src/bad.js\n- Error during analysis: error reading file src/bad.js: not valid UTF-8\n## Code Review"
    )
    assert got[1].message.startswith(HEAD + NONE)
    assert (got[0].files_analyzed, got[1].files_analyzed) == (1, 0)


def test_one_pass_two_sinks(spark):
    rows = [body("see a.py `x`", code_source="direct"), '{"cut', body("", code_source="direct"), json.dumps({"message": "```x```", "settings": [{"label": "code_source", "value": "direct"}]})]
    frame = spark.createDataFrame(list(enumerate(rows)), "review_id long, value string")
    checked = R.validate(R.parse_messages(frame), field="default")
    valid, rejects = R.split_valid(checked, os.path.join(tempfile.mkdtemp(prefix="revkit-test-", dir="/tmp"), "sinks"))
    assert [r.review_id for r in valid.collect()] == [0]
    assert {(r.review_id, r.http_status, r.error, r.raw) for r in rejects.collect()} == {
        (1, 400, "Invalid request body", rows[1]), (2, 400, "Empty message", rows[2]), (3, 400, "Missing required setting: code_source", rows[3])
    }
    assert "PartitionFilters: [isnotnull(sink" in rejects._jdf.queryExecution().executedPlan().toString()
