"""Findings as typed rows, and their sink.

A recommendation is a line of text; a typed finding keeps its parts: the rule
(each of a bundle under its own id), the analyzer's code, severity, place,
message and snippet. All files are scanned once and exploded once, as in
``analyze``; PHP issues come as they are, before they are rendered in groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revkit.functions.scoring import DEFAULT_ASPECTS
from revkit.operators import aspects as D
from revkit.operators import python as H
from revkit.operators.analyze import LANGS, found_or_error, language_rules, readable, sibling_test_findings, with_language
from revkit.operators.findings import explode_findings, prepare, rule_array

#: The severity of rules that give none, and of files that could not be read.
UNRATED, UNREADABLE = "unrated", "error"
KEYS = ["repo", "path", "lang"]
TYPED = ["rule_id", "code", "severity", "line", "col", "message", "snippet"]


def _of_text(x: Column) -> Column:
    """A tagged finding as a typed one. ``key`` is an issue code, or the id of the
    rule inside its bundle."""
    code = F.when(x["key"].startswith("PYL"), x["key"])
    looked = F.create_map(*[F.lit(v) for c, (rule, severity) in H.CODES.items() for v in (c, f"{rule} {severity}")])[code]
    return F.struct(
        F.when(code.isNotNull(), F.substring_index(looked, " ", 1)).otherwise(F.coalesce(x["key"], x["rule_id"])).alias("rule_id"),
        F.coalesce(code, F.lit("")).alias("code"),
        F.when(code.isNotNull(), F.substring_index(looked, " ", -1)).when(x["rule_id"] == "K9", UNREADABLE).otherwise(UNRATED).alias("severity"),
        x["line"].alias("line"),
        x["col"].alias("col"),
        F.when(code.isNotNull(), F.regexp_extract(x["msg"], r"(?s)\] PYL[0-9]{3}: (.*)", 1)).otherwise(x["msg"]).alias("message"),
        F.lit("").alias("snippet"),
    )


def _of_issue(x: Column) -> Column:
    """A PHP issue as a typed finding."""
    return F.struct(
        F.concat(F.lit("G"), x["type_seq"].cast("string")).alias("rule_id"), x["type"].alias("code"), x["severity"].alias("severity"),
        x["line"].alias("line"), x["col"].alias("col"), x["description"].alias("message"), x["snippet"].alias("snippet"),
    )


def typed_findings(files: DataFrame, aspects: Sequence[str] = DEFAULT_ASPECTS, langs: Sequence[str] = LANGS) -> DataFrame:
    """Rows (repo, path, lang, rule_id, code, severity, line, col, message, snippet)."""
    files = with_language(files)
    rules = D.bundle(aspects) + language_rules(langs)
    prepped, ctx = prepare(files, rules)
    texts = found_or_error(files, rule_array(ctx, [r for r in rules if r.rule_id != "G25"]))
    found = F.transform(texts, _of_text)
    if "php" in langs:
        readable_php = (ctx.lang == "php") & F.col("error").isNull() if "error" in files.columns else ctx.lang == "php"
        none = F.array().cast("array<struct<rule_id:string,code:string,severity:string,line:int,col:int,message:string,snippet:string>>")
        found = F.concat(found, F.when(readable_php, F.transform("php_issues", _of_issue)).otherwise(none))
    out = explode_findings(prepped, found, KEYS)
    siblings = sibling_test_findings(readable(files), [0] * [r.rule_id for r in rules].count("D3"), known=files) if any(r.rule_id == "D3" for r in rules) else None
    return out if siblings is None else out.unionByName(siblings.select(*KEYS, _of_text(F.struct("rule_id", "key", "line", "col", "msg")).alias("f")).select(*KEYS, "f.*"))


def write_findings(found: DataFrame, path: str, batch: int | str) -> None:
    """Append a batch to the findings table, by batch, language and severity.

    The partitions that the batch has are replaced, so a batch that is written
    again (a retried job, a restarted stream) leaves one copy. Rows are dealt by
    partition before, large ones split, so a task writes few files."""
    rows = found.withColumn("batch", F.lit(str(batch))).hint("rebalance", F.col("lang"), F.col("severity"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "lang", "severity").parquet(path)


def read_findings(spark, path: str) -> DataFrame:
    schema = "repo string, path string, rule_id string, code string, line int, col int, message string, snippet string, batch string, lang string, severity string"
    return spark.read.schema(schema).parquet(path).select(*KEYS, *TYPED)


def sink(path: str):
    """For ``foreachBatch``: each micro-batch under its own number."""
    return lambda found, number: write_findings(found, path, f"stream-{number}")
