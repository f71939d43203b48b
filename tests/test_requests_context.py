"""The reference integration cases (status, message, code context) as
DataFrame jobs: A4 parse -> B8 validation -> J14/M2-M5 context -> J15."""

import json

from pyspark.sql import functions as F

from revkit.operators import context as M
from revkit.operators import requests as R
from revkit.streaming.comments import request_counts

JAVA = "\n" + "\n".join(
    ["public class UserAuthentication {", "    public boolean validateToken(String token) {", "        if (token == null) {",
     "            return false;", "        }", "        return token.length() > 10;", "    }"] + [f"    // line {i}" for i in range(19)]
    + ["}"]
)
PY = "\n" + "\n".join([f"import mod{i}" for i in range(10)] + ["def authenticate_user(name, password):", "    user = find(name)"]
                       + [f"    step_{i}()" for i in range(12)] + ["    return user"])
JS = "\n" + "\n".join([f"const c{i} = {i};" for i in range(14)] + ["function login(user) {", "  const ok = check(user);"]
                       + [f"  step{i}();" for i in range(23)] + ["  return ok;", "}"])


def files(spark):
    rows = [("github", "acme", "svc", "main", "UserAuthentication.java", JAVA), ("github", "acme", "svc", "main", "user_service.py", PY),
            ("github", "acme", "svc", "main", "auth.js", JS)]
    return spark.createDataFrame(rows, "provider string, owner string, repo string, branch string, path string, content string")


def body(message, code_source="github", url="https://github.com/acme/svc", drop=()):
    settings = []
    if "code_source" not in drop:
        settings.append({"label": "code_source", "type": "text", "default": code_source, "value": code_source, "required": True})
    settings.append({"label": "repository_url", "type": "text", "default": url, "value": url, "required": True})
    return json.dumps({"channel_id": "test-channel", "message": message, "settings": settings})


CASES = [
    ("java", body("Please check UserAuthentication.java, token validation looks weak."), 200, None, "validateToken"),
    ("python", body("In user_service.py the password check should be stricter."), 200, None, "authenticate_user"),
    ("js", body("auth.js: the login flow has no rate limiting."), 200, None, "login"),
    ("direct", body("```java\nint x = 1;\n```", code_source="direct"), 200, None, None),
    ("bad_url", body("See auth.js", url="https://example.com/x/y"), 400, "Invalid repository URL: https://example.com/x/y", None),
    ("no_refs", body("Looks fine to me", code_source="direct"), 400, "No code references found in comment", None),
    ("empty", body(""), 400, "Empty message", None),
    ("missing", body("See auth.js", drop=("code_source",)), 400, "Missing required setting: code_source", None),
    ("unsupported", body("See auth.js", code_source="svn"), 400, "Unsupported code source: svn", None),
    ("corrupt", '{"channel_id": "x", "message": ', 400, "Invalid request body", None),
]


def test_reference_cases(spark):
    raw = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "review_id long, value string")
    v = R.validate(R.parse_messages(raw), field="value")
    got = {r.review_id: (r.http_status, r.error) for r in v.collect()}
    for i, (name, _b, status, err, _ctx) in enumerate(CASES):
        assert got[i] == (status, err), name
    ok = v.where("http_status = 200 and message not like '```%'").withColumn("repo", F.lit("svc"))
    refs = M.extract_references(ok.select("review_id", "repo", "message"), named=True)
    refs = refs.where(F.col("filename").isin(*[n for n, _a, _b in M.NAMED_FILES]))
    blocks = M.context_blocks(refs, files(spark).select("repo", "path", "content"))
    enhanced = {r.review_id: r.code_context for r in M.enhanced_comments(ok.select("review_id", "message"), blocks).collect()}
    for i, (name, _b, _s, _e, ctx) in enumerate(CASES):
        if ctx:
            assert enhanced[i] == ctx, name


def test_context_block_clamps_past_end(spark):
    refs = spark.createDataFrame([(1, "svc", 1, "UserAuthentication.java", 45, 52)],
                                 "review_id long, repo string, ref_seq int, filename string, line_start int, line_end int")
    b = M.context_blocks(refs, files(spark).select("repo", "path", "content")).first()
    assert (b.shown_start, b.shown_end) == (1, 10)
    lines = b.block.split("\n")
    assert lines[0] == "Context for UserAuthentication.java (lines 1-10):"
    assert lines[1] == "```" and lines[2] == ">    1: " and lines[11] == ">   10:     // line 1"
    assert lines[12] == "    11:     // line 2" and lines[14] == "    13:     // line 4" and lines[15] == "```"
    assert b.block.endswith("```\n\n")


def test_missing_and_case_insensitive_file(spark):
    refs = spark.createDataFrame([(1, "svc", 1, "AUTH.JS", 16, 17), (1, "svc", 2, " nope.py", 1, 1)],
                                 "review_id long, repo string, ref_seq int, filename string, line_start int, line_end int")
    got = {r.ref_seq: r.block for r in M.context_blocks(refs, files(spark).select("repo", "path", "content")).collect()}
    # shown from 0-based start-3 (line 14) to end+3 (line 20)
    assert got[1].startswith("Context for AUTH.JS (lines 16-17):\n```\n    14: const c12 = 12;\n")
    assert got[1].endswith("    20:   step2();\n```\n\n")
    assert ">   16: function login(user) {\n" in got[1]
    assert got[2] == "Error retrieving  nope.py: file not found: nope.py\n\n"


def test_rate_limit_window(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1, 10, 0, 0)
    rows = [(i, "busy", t0 + timedelta(milliseconds=100 * i)) for i in range(101)] + [(500, "calm", t0)]
    df = spark.createDataFrame(rows, "review_id long, channel_id string, ts timestamp")
    counts = {(r.channel_id): r.requests for r in request_counts(df).collect()}
    assert counts == {"busy": 101, "calm": 1}


def test_branch_resolution(spark):
    snaps = spark.createDataFrame(
        [("github", "o", "r", "master", "a.py", "m"), ("github", "o", "r", "main", "a.py", "M"), ("github", "o", "r", "master", "b.py", "x"),
         ("gitlab", "o", "r", "master", "c.py", "y")],
        "provider string, owner string, repo string, branch string, path string, content string",
    )
    got = {(r.provider, r.path): r.branch for r in M.branch_resolve(snaps).collect()}
    assert got == {("github", "a.py"): "main", ("github", "b.py"): "master"}
