"""Review requests answered end to end.

Settings apply per request. Every finding is evaluated once and carries the bit
of the aspect that asks for it (or of its language's rules) and its keyword
scores; a request's list of aspects selects findings by a join on repository and
bit, in the order and as often as the list names them. Requests of one
repository with the same list share one report (a *variant*). A report stays
ordered rows (``reports``); only the last step makes one text of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.operators import aspects as D
from revkit.operators import history as L
from revkit.operators import metrics as K
from revkit.operators import requests as R
from revkit.operators import reviews

BITS = {"thoroughness": 1, "clarity": 2, "actionability": 4}
#: The bit of the language rules and of errors: every request gets these.
ALWAYS = 8
#: What a request is refused with.
NO_FILES = "Error accessing repository: repository appears to be empty or inaccessible"
BAD_BODY = "Invalid request body"


def with_bit(findings: DataFrame) -> DataFrame:
    """Findings with ``bit`` and the keyword scores of their text."""
    bit = F.lit(ALWAYS)
    for aspect, rules in (("thoroughness", D.thoroughness_rules()), ("clarity", D.clarity_rules()), ("actionability", D.actionability_rules())):
        bit = F.when(F.col("rule_id").isin(*[r.rule_id for r in rules]), BITS[aspect]).otherwise(bit)
    return findings.select("*", bit.alias("bit"), *[K.keyword_score(F.col("msg"), a).alias(f"k_{a}") for a in BITS])


def variant(repo: Column, aspects: Column) -> Column:
    """One name for the requests that get the same report."""
    return F.concat(repo, F.lit("\n"), F.coalesce(F.array_join(F.transform(aspects, F.lower), ","), F.lit("")))


def entries(requests: DataFrame) -> DataFrame:
    """(variant, repo, place, bit): what each variant selects, in the order of its
    aspects; the language rules come last. Unknown aspects select nothing."""
    bits = F.create_map(*[F.lit(x) for kv in BITS.items() for x in kv])
    listed = F.transform(F.coalesce("aspects", F.array().cast("array<string>")), lambda a, k: F.struct(k.alias("place"), F.try_element_at(bits, F.lower(a)).alias("bit")))
    last = F.array(F.struct(F.lit(1 << 30).alias("place"), F.lit(ALWAYS).alias("bit")))
    kinds = requests.dropDuplicates(["variant"]).select("variant", "repo", F.explode(F.concat(listed, last)).alias("e"))
    return kinds.select("variant", "repo", "e.place", "e.bit").where("bit IS NOT NULL")


def selected(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """The findings of every variant: ``findings`` (see ``with_bit``) joined on repository and bit."""
    return findings.join(entries(requests), ["repo", "bit"])


def reports(chosen: DataFrame, requests: DataFrame) -> DataFrame:
    """K7: the report of every variant as rows (variant, seq, path, text)."""
    recs = K.file_recommendations(chosen, by=("variant", "path"), before=("place",))
    return K.report_sections(recs, repos=requests, by="variant")


def quality(chosen: DataFrame, requests: DataFrame) -> DataFrame:
    """K1-K3 per variant: (variant, files_analyzed, mean_quality), the files with
    recommendations and the mean of their overall scores: the sum of the listed
    aspects' scores over the number of entries, known or not."""
    files = chosen.where(F.col("rule_id") != K.UNREAD).groupBy("variant", "path").agg(*[F.sum(f"k_{a}").alias(a) for a in BITS])
    names = F.coalesce("aspects", F.array().cast("array<string>"))
    count = lambda a: F.size(F.filter(F.transform(names, F.lower), lambda x: x == a))
    weights = [count(a).alias(f"w_{a}") for a in BITS]
    kinds = requests.dropDuplicates(["variant"]).select("variant", F.size(names).alias("n"), *weights)
    total = sum((F.col(a) * F.col(f"w_{a}") for a in BITS), F.lit(0)).cast("double")
    overall = F.when(F.col("n") > 0, total / F.col("n")).otherwise(F.lit(0.0))
    return files.join(kinds, "variant").groupBy("variant").agg(F.count(F.lit(1)).alias("files_analyzed"), F.avg(overall).alias("mean_quality"))


def admit(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with ``http_status`` and ``error`` as the service answers
    them: bodies that do not decode, repository URLs that do not parse, and
    repositories without files are refused; direct requests read no files."""
    requests = requests.select("review_id", F.coalesce("channel_id", F.lit("")).alias("channel_id"), "ts", "message", "settings", "corrupt")
    routed = R.route(R.resolve_settings(requests))
    direct = F.col("code_source") == "direct"
    routed = routed.withColumn("repo", F.when(direct, F.lit(None)).otherwise(F.col("repo_name")))
    held = files.select("repo").distinct().withColumn("has_files", F.lit(True))
    routed = routed.join(held, "repo", "left")
    error = (
        F.when(F.col("corrupt"), F.lit(BAD_BODY))
        .when(~direct & F.col("route_error").isNotNull(), F.concat(F.lit("Invalid repository URL: "), F.col("route_error")))
        .when(~direct & F.col("has_files").isNull(), F.lit(NO_FILES))
    )
    status = F.when(error.isNull(), 200).when(error == NO_FILES, 500).otherwise(400)
    name = variant(F.coalesce("repo", F.lit("")), F.when(direct, F.lit(None).cast("array<string>")).otherwise(F.col("aspects")))
    return routed.select("*", status.alias("http_status"), error.alias("error"), name.alias("variant")).drop("has_files", "repo_name")


def responses(answered: DataFrame) -> DataFrame:
    """K8 + L6 per answered request: ``response``, the quality of the comment under
    the request's aspects, and how it compares with the channel's earlier ones."""
    none = F.array().cast("array<string>")
    scored = answered.withColumns({"message": F.coalesce("message", F.lit("")), "aspects": F.coalesce("aspects", none)})
    scored = L.with_history_split(reviews.score_comments(scored, aspects=F.col("aspects")))
    text = reviews.quality_report(scored, F.col("include_recommendations"))
    past = L.historical_section(F.col("overall"), F.col("hist_count"), F.col("hist_avg"), F.col("trend"))
    return text.withColumn("response", F.concat(F.col("quality_text"), past))


def answer(requests: DataFrame, files: DataFrame, findings: DataFrame, keep: Sequence[str] = ("review_id",)) -> DataFrame:
    """Every request's answer: ``keep``, http_status, error, and of those answered
    the message, files_analyzed and mean_quality.

    ``requests`` (``review_id, channel_id, ts, message, settings, corrupt``, see
    ``requests.parse_messages``; ``ts``, not null, is when it came); ``findings`` of ``analyze(files)`` with the
    default aspects, evaluated once: pass a written table."""
    seen = admit(requests, files)
    good = responses(seen.where("http_status = 200"))
    chosen = selected(with_bit(findings), good.where("repo IS NOT NULL").select("variant", "repo", "aspects"))
    kinds = good.select("variant", "aspects")
    text = K.report_text(reports(chosen, kinds), "variant")
    stats = quality(chosen, kinds)
    full = good.join(text, "variant").join(stats, "variant", "left")
    full = full.select(*keep, "http_status", "error", F.concat("report", "response").alias("message"), F.coalesce("files_analyzed", F.lit(0)).alias("files_analyzed"), "mean_quality")
    bad = seen.where("http_status <> 200").select(*keep, "http_status", "error", F.lit(None).cast("string").alias("message"), F.lit(0).cast("long").alias("files_analyzed"), F.lit(None).cast("double").alias("mean_quality"))
    return full.unionByName(bad)
